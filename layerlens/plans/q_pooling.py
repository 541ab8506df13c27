"""Registered embedding / pooling queries over F5 (token hidden states from
the embeddings table) and conversation words (M1, M3–M5, J5, J9)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerlens.operators import pooling as M
from layerlens.operators import sequences as Q
from layerlens.operators import text as X
from layerlens.plans.fixtures import f5_hidden_states, f5_spans
from layerlens.plans.registry import register
from layerlens.sources.tables import table
from layerlens.streaming.metric_streams import scratch

VOCAB = 1000
DIM = 16
POOL_DIM = 8
LAYER = 1


def _word_ids(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    w = conv.select("conv_id", "turn", F.posexplode(X.words(F.col("text"))).alias("word_idx", "word"))
    h = F.conv(F.substring(F.md5(F.col("word")), 1, 8), 16, 10).cast("long")
    return w.withColumn("token_id", h % VOCAB)


ORACLES_RANDOM = f"""
WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{X.WORD_PATTERN}')) AS word FROM conversations),
t AS (SELECT conv_id, turn, ('0x' || substr(md5(word), 1, 8))::BIGINT % {VOCAB} AS token_id FROM w),
v AS (SELECT conv_id, turn, token_id, unnest(range(0, {DIM})) AS d FROM t),
x AS (SELECT conv_id, turn, token_id, d,
        ('0x' || substr(md5('42:' || CAST(token_id AS VARCHAR) || ':' || CAST(d AS VARCHAR)), 1, 8))::BIGINT
          / 4294967296.0 * 2.0 - 1.0 AS val FROM v)
SELECT conv_id, turn, count(*) // {DIM} AS n_tokens, round(sum(val), 5) AS vec_sum,
       round(sum(CASE WHEN d = 0 THEN val ELSE 0 END), 5) AS dim0_sum
FROM x GROUP BY conv_id, turn
"""


@register("random_embedding_lookup", oracle=ORACLES_RANDOM)
def random_embedding_lookup(spark, sf_dir):
    """Every conversation word → token id (hash) → fixed random
    16-dim vector from a 1,000-row embedding table; summed per turn."""
    ids = _word_ids(spark, sf_dir)
    emb = M.lookup_embeddings(ids, M.random_embedding_table(spark, VOCAB, DIM))
    return emb.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.round(F.sum(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)), 5).alias("vec_sum"),
        F.round(F.sum(F.element_at("vector", 1)), 5).alias("dim0_sum"),
    )


@register("hidden_state_extraction", oracle=ORACLES_RANDOM)
def hidden_state_extraction(spark, sf_dir):
    """M2: the same lookup run as batch inference — the random-embedding
    subject model loaded once per worker and applied to batches of token
    ids with ``predict_batch_udf``; equals the table-join form."""
    ids = _word_ids(spark, sf_dir)
    model = M.random_embedding_model(VOCAB, DIM)
    emb = M.extract_hidden_states(ids, model, "token_id", DIM, batch_size=1024, element_type=T.DoubleType())
    return emb.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.round(F.sum(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)), 5).alias("vec_sum"),
        F.round(F.sum(F.element_at("vector", 1)), 5).alias("dim0_sum"),
    )


_F5 = f"""
f5 AS (SELECT CAST(vec_id // 20 AS INTEGER) AS seq, CAST(vec_id % 20 AS INTEGER) AS pos,
          list_transform(range(0, len(embedding)), lambda i: embedding[((i + {LAYER}) % len(embedding)) + 1]) AS vector
       FROM embeddings)"""


@register("layer_select", oracle=f"""
WITH {_F5}
SELECT seq, pos, round(list_sum(vector), 5) AS v_sum, round(vector[1], 6) AS v0 FROM f5
""")
def layer_select(spark, sf_dir):
    """M3/M8: hidden states of all layers written once, a folder for each;
    then the probed layer read back, which opens that folder only."""
    path = scratch(spark, "hidden-states")
    M.write_hidden_states(f5_hidden_states(spark, sf_dir), path)
    h = M.select_layer(spark.read.parquet(path), LAYER)
    return h.select(
        "seq", "pos",
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 5).alias("v_sum"),
        F.round(F.element_at("vector", 1), 6).alias("v0"),
    )


def _pool_sql(name: str, spans: str, slot: int, POOL_DIM: int = POOL_DIM) -> str:
    w = f"(((r * 7 + d * 3 + {slot}) % 11) - 5) / 10.0"
    b = f"(((r * 5 + {slot}) % 7) - 3) / 10.0"
    v = f"(((r * 3 + {slot}) % 5) - 2) / 10.0"
    return f"""
{name}_j AS (SELECT s.seq, s.target_idx, h.pos, h.vector FROM {spans} s JOIN f5 h
             ON h.seq = s.seq AND h.pos >= s.a AND h.pos < s.b),
{name}_h AS (SELECT seq, target_idx, pos,
               list_transform(range(0, {POOL_DIM}), lambda r:
                 list_sum(list_transform(range(0, len(vector)), lambda d: {w} * vector[d + 1])) + {b}) AS hp
             FROM {name}_j),
{name}_s AS (SELECT *, list_sum(list_transform(range(0, {POOL_DIM}), lambda r: {v} * hp[r + 1])) AS s FROM {name}_h),
{name}_m AS (SELECT seq, target_idx, max(s) AS m FROM {name}_s GROUP BY seq, target_idx),
{name}_w AS (SELECT x.*, exp(x.s - m.m) AS w FROM {name}_s x JOIN {name}_m m USING (seq, target_idx)),
{name}_u AS (SELECT seq, target_idx, w, unnest(hp) AS x, unnest(range(0, {POOL_DIM})) AS r FROM {name}_w),
{name}_c AS (SELECT seq, target_idx, r, sum(w * x) / sum(w) AS c FROM {name}_u GROUP BY seq, target_idx, r),
{name} AS (SELECT s.seq, s.target_idx,
             COALESCE(list(c.c ORDER BY c.r) FILTER (WHERE c.c IS NOT NULL), list_transform(range(0, {POOL_DIM}), lambda r: 0.0)) AS pooled
           FROM {spans} s LEFT JOIN {name}_c c USING (seq, target_idx) GROUP BY s.seq, s.target_idx)"""


_SPANS = """
seqs AS (SELECT DISTINCT CAST(vec_id // 20 AS INTEGER) AS seq FROM embeddings),
spans AS (SELECT seq, 0 AS target_idx, 3 AS a, 8 AS b FROM seqs
          UNION ALL SELECT seq, 1, 5, 5 FROM seqs WHERE seq = 0
          UNION ALL SELECT seq, 2, 17, 25 FROM seqs WHERE seq = 0)"""


def _pooled(spark, sf_dir, slot=0, spans=None, width=64, pool_dim=POOL_DIM):
    """``width``: the 64 components of a state are repeated up to it."""
    tokens = M.select_layer(f5_hidden_states(spark, sf_dir), LAYER)
    if width != 64:
        tokens = tokens.withColumn("vector", F.flatten(F.array_repeat("vector", width // 64)))
    spans = f5_spans(spark, sf_dir) if spans is None else spans
    params = M.projection_params(spark, width, pool_dim)
    return M.attention_pool(tokens, spans, params, slot)


def _summary(df, col="pooled"):
    return df.select(
        "seq", "target_idx",
        F.size(col).cast("long").alias("width"),
        F.round(F.element_at(col, 1), 6).alias("p0"),
        F.round(F.aggregate(col, F.lit(0.0), lambda a, x: a + x), 6).alias("p_sum"),
        F.round(F.aggregate(col, F.lit(0.0), lambda a, x: a + x * x), 6).alias("p_sq"),
    )


_SUMMARY = """SELECT seq, target_idx, CAST(len(pooled) AS BIGINT) AS width, round(pooled[1], 6) AS p0,
       round(list_sum(pooled), 6) AS p_sum, round(list_sum(list_transform(pooled, lambda x: x * x)), 6) AS p_sq"""


@register("span_attention_pool", oracle=f"""
WITH {_F5}, {_SPANS}, {_pool_sql('pool0', 'spans', 0)}
{_SUMMARY} FROM pool0
""")
def span_attention_pool(spark, sf_dir):
    """Attention pooling of layer-1 states over spans [3,8) of every
    sequence, plus an empty span and one running past the end."""
    return _summary(_pooled(spark, sf_dir, 0))


@register("span_attention_pool_768", oracle=f"""
WITH {_F5.replace("range(0, len(embedding))", "range(0, 768)")}, {_SPANS}, {_pool_sql('pool0', 'spans', 0, 256)}
{_SUMMARY} FROM pool0
""")
def span_attention_pool_768(spark, sf_dir):
    """M4 at the usual sizes: 768 components projected to 256."""
    return _summary(_pooled(spark, sf_dir, 0, None, 768, 256))


BUCKETS = 8


def stored_states(spark, sf_dir):
    """All layers of F5 stored by sequence, as a table of its own."""
    path = scratch(spark, "states")
    name = "states_" + path.rsplit("-", 1)[-1]
    return Q.store_states(f5_hidden_states(spark, sf_dir), name, path, BUCKETS)


@register("span_pool_stored", oracle=f"""
WITH {_F5}, {_SPANS}, {_pool_sql('pool0', 'spans', 0)}
{_SUMMARY} FROM pool0
""")
def span_pool_stored(spark, sf_dir):
    """The same pooling over states stored in buckets of their
    sequences: neither the join nor the sums move a token."""
    tokens = M.select_layer(stored_states(spark, sf_dir), LAYER)
    return _summary(M.attention_pool(tokens, f5_spans(spark, sf_dir), M.projection_params(spark, 64, POOL_DIM), 0))


_MIX_DIM, _MIX_LAYERS = 4, 3


def _mix_sql(x: str, i: int) -> str:
    side = lambda f: f"coalesce({f}(x) OVER (PARTITION BY conv_id, turn, d ORDER BY pos), 0)"
    return f"""
{x}{i + 1} AS (SELECT conv_id, turn, pos, d, kind, x / 2 + ({side('lag')} + {side('lead')}) / 4 + kind / 10.0 AS x FROM {x}{i})"""


@register("sequence_states", oracle=f"""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '{X.WORD_PATTERN}') AS w FROM conversations),
t AS (SELECT conv_id, turn, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM w),
s0 AS (SELECT conv_id, turn, pos, d, pos % 2 AS kind, (((('0x' || substr(md5(word), 1, 8))::BIGINT % {VOCAB} * 7 + d * 3) % 11) - 5) / 10.0::DOUBLE AS x
  FROM t CROSS JOIN (SELECT unnest(range(0, {_MIX_DIM})) AS d)),
{', '.join(_mix_sql('s', i) for i in range(_MIX_LAYERS - 1))},
a AS ({' UNION ALL '.join(f"SELECT {i} AS layer, * FROM s{i}" for i in range(_MIX_LAYERS))})
SELECT conv_id, turn, layer, count(*) // {_MIX_DIM} AS n_tokens, round(sum(x) + 1000, 5) AS v_sum, round(sum(x * (pos + 1) * (d + 1)) / 7.3, 4) AS v_place
FROM a GROUP BY conv_id, turn, layer
""")
def sequence_states(spark, sf_dir):
    """M2: all layers of a model whose states depend on their neighbours, over
    whole turns in padded batches of like length."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.words(F.col("text")).alias("w"))
    ids = F.transform("w", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % VOCAB)
    seqs = words.select(
        "conv_id", "turn", ids.alias("input_ids"), F.transform("w", lambda _, i: i % 2).alias("token_type_ids"),
        F.transform("w", lambda _: F.lit(1)).alias("attention_mask"),
    )
    states = Q.extract_states(seqs, Q.neighbour_model(_MIX_DIM, _MIX_LAYERS), ["conv_id", "turn"])
    place = F.aggregate(F.transform("vector", lambda x, d: x * (d + 1)), F.lit(0.0), lambda a, x: a + x) * (F.col("pos") + 1)
    return states.groupBy("conv_id", "turn", "layer").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.round(F.sum(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)) + 1000, 5).alias("v_sum"),
        F.round(F.sum(place) / 7.3, 4).alias("v_place"),
    )


@register("pair_concat", oracle=f"""
WITH {_F5},
seqs AS (SELECT DISTINCT CAST(vec_id // 20 AS INTEGER) AS seq FROM embeddings),
sp1 AS (SELECT seq, 0 AS target_idx, 3 AS a, 8 AS b FROM seqs),
sp2 AS (SELECT seq, 0 AS target_idx, 10 AS a, 15 AS b FROM seqs),
{_pool_sql('pa', 'sp1', 0)}, {_pool_sql('pb', 'sp2', 1)},
pooled AS (SELECT pa.seq, pa.target_idx, list_concat(pa.pooled, pb.pooled) AS pooled FROM pa JOIN pb USING (seq, target_idx))
{_SUMMARY} FROM pooled
""")
def pair_concat(spark, sf_dir):
    """M5: pair targets — span1 [3,8) pooled with slot-0 parameters, span2
    [10,15) with slot-1 parameters, concatenated."""
    spans = f5_spans(spark, sf_dir).filter(F.col("target_idx") == 0)
    p1 = _pooled(spark, sf_dir, 0, spans)
    p2 = _pooled(spark, sf_dir, 1, spans.withColumn("a", F.lit(10)).withColumn("b", F.lit(15)))
    return _summary(M.pair_concat(p1, p2))
