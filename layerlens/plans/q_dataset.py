"""Registered dataset-preparation queries: splits, samples, portions (F1,
F3, F2), label handling (F2), score normalisation and buckets (F1), pair
texts (F4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerlens.operators import sampling as S
from layerlens.operators import targets as T
from layerlens.plans.fixtures import f1_scored, f2_instances, f3_vectors, f4_pairs, f4_star
from layerlens.plans.registry import register
from layerlens.sources.tables import table

# Portions for the 500-row embeddings fixture (the default 0.001 would give
# int(0.5) = 0 rows in the first portion).
F3_PORTIONS = (0.0625, 0.125, 0.25, 0.5, 1.0)
NUM_BUCKETS = 10


def _split_sizes(n: int) -> tuple[int, int]:
    """Held-out 30 % (half test, half validation), all other rows train."""
    return n - n * 3 // 10, n * 3 // 10


def _sizes_with_rest(n: int) -> tuple[int, int]:
    """train 60 %, held-out 30 %; the unused rest is a feature of the split."""
    return n * 6 // 10, n * 3 // 10


def _f1_split(spark, sf_dir, sizes=_split_sizes):
    f1 = f1_scored(spark, sf_dir)
    n = f1.count()
    return S.exact_split(f1, *sizes(n), n=n)


_PERM = "row_number() OVER (ORDER BY md5('5823905:' || CAST({id} AS VARCHAR)), {id}) - 1"

_WHOLE_TRAIN, _PART_TRAIN = "count(*) - count(*) * 3 // 10", "count(*) * 6 // 10"


def _f1_split_sql(train: str = _WHOLE_TRAIN) -> str:
    return f"""
f1 AS (SELECT o_orderkey AS id, o_totalprice AS label FROM orders),
sz AS (SELECT {train} AS n_train, count(*) * 3 // 10 AS n_test FROM orders),
p AS (SELECT id, label, {_PERM.format(id='id')} AS perm FROM f1),
sp AS (
  SELECT id, label, perm,
    CASE WHEN perm < n_test // 2 THEN 'test'
         WHEN perm < n_test THEN 'validation'
         WHEN perm < n_test + n_train THEN 'train' END AS split
  FROM p, sz)"""


_F1_SPLIT = _f1_split_sql()


@register("exact_split", oracle=f"""
WITH {_f1_split_sql(_PART_TRAIN)}
SELECT id, split FROM sp WHERE split IS NOT NULL
""")
def exact_split(spark, sf_dir):
    """Exact-size seeded split of F1 (60 % train, 15 % val, 15 % test)."""
    return _f1_split(spark, sf_dir, _sizes_with_rest).select("id", "split")


@register("sample_n", oracle=f"""
WITH p AS (SELECT o_orderkey AS id, {_PERM.format(id='o_orderkey')} AS perm FROM orders)
SELECT id FROM p WHERE perm < (SELECT count(*) // 10 FROM orders)
""")
def sample_n(spark, sf_dir):
    """D3: a fixed-seed sample of exactly 10 % of the orders."""
    f1 = f1_scored(spark, sf_dir)
    n = f1.count() // 10
    return S.sample_n(f1, n).select("id")


def _f3_perm(spark, sf_dir):
    f3 = f3_vectors(spark, sf_dir).select("id", "label")
    n = f3.count()
    return S.permute(f3), S.portions_table(spark, n, F3_PORTIONS), n


_F3_PORTIONS = f"""
p AS (SELECT vec_id AS id, label, {_PERM.format(id='vec_id')} AS perm FROM embeddings),
fr AS (SELECT * FROM (VALUES (0, 0.0625), (1, 0.125), (2, 0.25), (3, 0.5), (4, 1.0)) t(portion_idx, fraction)),
pt0 AS (SELECT portion_idx, CAST(fraction AS DOUBLE) AS fraction,
          CAST(floor((SELECT count(*) FROM embeddings) * fraction) AS BIGINT) AS n FROM fr),
pt AS (SELECT portion_idx, fraction, n, lead(n) OVER (ORDER BY portion_idx) AS n_next FROM pt0)"""


@register("portion_sizes", oracle=f"""
WITH {_F3_PORTIONS}
SELECT pt.portion_idx, pt.fraction, pt.n, count(p.id) AS n_instances, count(p.id) AS n_targets
FROM pt LEFT JOIN p ON p.perm < pt.n GROUP BY pt.portion_idx, pt.fraction, pt.n
""")
def portion_sizes(spark, sf_dir):
    """Portion sizes int(N·p) and the instances/targets they hold."""
    perm, portions, _ = _f3_perm(spark, sf_dir)
    members = S.portion_members(perm.withColumn("n_targets", F.lit(1)), portions)
    counts = S.target_counts(members)
    return portions.join(counts.drop("fraction"), "portion_idx", "left").select(
        "portion_idx", "fraction", "n",
        F.coalesce("n_instances", F.lit(0)).cast("long").alias("n_instances"),
        F.coalesce("n_targets", F.lit(0)).cast("long").alias("n_targets"),
    )


@register("portion_members", oracle=f"""
WITH {_F3_PORTIONS}
SELECT p.id, pt.portion_idx FROM p JOIN pt ON p.perm < pt.n
""")
def portion_members(spark, sf_dir):
    """Nested prefixes of the permutation (a row is in every
    portion that contains it)."""
    perm, portions, _ = _f3_perm(spark, sf_dir)
    return S.portion_members(perm, portions).select("id", "portion_idx")


@register("next_chunk", oracle=f"""
WITH {_F3_PORTIONS}
SELECT p.id, pt.portion_idx FROM p JOIN pt ON p.perm >= pt.n AND p.perm < pt.n_next
""")
def next_chunk(spark, sf_dir):
    """Rows predicted after fitting on portion k."""
    perm, portions, _ = _f3_perm(spark, sf_dir)
    return S.next_chunks(perm, portions).select("id", "portion_idx")


@register("val_fraction", oracle=f"""
WITH p AS (SELECT vec_id AS id, {_PERM.format(id='vec_id')} AS perm FROM embeddings),
sz AS (SELECT count(*) * 3 // 10 AS n_test FROM embeddings)
SELECT id FROM p, sz
WHERE perm >= n_test // 2 AND perm < n_test // 2 + CAST(floor((n_test - n_test // 2) * 0.5) AS BIGINT)
""")
def val_fraction(spark, sf_dir):
    """The first half of the validation split, in its seeded order."""
    f3 = f3_vectors(spark, sf_dir).select("id", "label")
    n = f3.count()
    split = S.exact_split(f3, *_sizes_with_rest(n), n=n, val_fraction=0.5)
    return split.filter(F.col("split") == "validation").select("id")


@register("portion_report", oracle=f"""
WITH {_F3_PORTIONS}
SELECT 'portion_percentage/portion_' || lpad(CAST(portion_idx AS VARCHAR), 2, '0') AS metric, fraction AS value FROM pt
UNION ALL
SELECT 'portion_size/portion_' || lpad(CAST(portion_idx AS VARCHAR), 2, '0'), CAST(n AS DOUBLE) FROM pt
""")
def portion_report(spark, sf_dir):
    """Per-portion fraction and size logged under ``…/portion_NN``."""
    perm, portions, _ = _f3_perm(spark, sf_dir)
    counts = S.target_counts(S.portion_members(perm.withColumn("n_targets", F.lit(1)), portions))
    return S.portion_report(counts)


_F2_ITEMS = """
items AS (
  SELECT l_orderkey AS id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS target_idx,
    l_linenumber AS span1_a, l_linenumber + 1 + CAST(l_quantity % 5 AS INTEGER) AS span1_b,
    l_returnflag AS label
  FROM lineitem)"""


@register("portion_targets", oracle=f"""
WITH {_F2_ITEMS},
inst AS (SELECT o_orderkey AS id, count(i.id) AS n_targets FROM orders o LEFT JOIN items i ON i.id = o.o_orderkey
         GROUP BY o_orderkey HAVING count(i.id) > 0),
p AS (SELECT id, n_targets, {_PERM.format(id='id')} AS perm FROM inst),
fr AS (SELECT * FROM (VALUES (0, 0.0625), (1, 0.125), (2, 0.25), (3, 0.5), (4, 1.0)) t(portion_idx, fraction)),
pt AS (SELECT portion_idx, CAST(fraction AS DOUBLE) AS fraction,
          CAST(floor((SELECT count(*) FROM inst) * fraction) AS BIGINT) AS n FROM fr)
SELECT pt.portion_idx, pt.fraction, count(*) AS n_instances, CAST(sum(p.n_targets) AS BIGINT) AS n_targets
FROM pt JOIN p ON p.perm < pt.n GROUP BY pt.portion_idx, pt.fraction
""")
def portion_targets(spark, sf_dir):
    """Targets (not instances) per portion of the multi-target F2 set."""
    inst = T.drop_empty(f2_instances(spark, sf_dir)).select("id", F.size("targets").alias("n_targets"))
    n = inst.count()
    members = S.portion_members(S.permute(inst), S.portions_table(spark, n, F3_PORTIONS))
    return S.target_counts(members)


@register("minmax_normalize", oracle=f"""
WITH {_F1_SPLIT},
b AS (SELECT min(label) AS lo, max(label) AS hi FROM sp WHERE split = 'train')
SELECT id, split, round((least(greatest(label, lo), hi) - lo) / (hi - lo), 6) AS label
FROM sp, b WHERE split IS NOT NULL
""")
def minmax_normalize(spark, sf_dir):
    """T4: normalise all splits by the train min/max, clamping val/test."""
    out = T.minmax_normalize(_f1_split(spark, sf_dir))
    return out.select("id", "split", F.round("label", 6).alias("label"))


def _bucket_sql(x: str, b: int) -> str:
    terms = [
        f"CASE WHEN CAST(CAST({i} AS DOUBLE) / {b - 1} AS FLOAT) < CAST({x} AS FLOAT) THEN 1 ELSE 0 END"
        for i in range(1, b)
    ]
    return "(" + " + ".join(terms) + ")"


@register("bucketize_scores", oracle=f"""
WITH {_F1_SPLIT},
b AS (SELECT min(label) AS lo, max(label) AS hi FROM sp WHERE split = 'train'),
nrm AS (SELECT id, split, (least(greatest(label, lo), hi) - lo) / (hi - lo) AS x FROM sp, b WHERE split IS NOT NULL)
SELECT id, split, {_bucket_sql('x', NUM_BUCKETS)} AS bucket FROM nrm
""")
def bucketize_scores(spark, sf_dir):
    """T5: normalised scores into 10 right-closed float32 buckets (0..8)."""
    out = T.bucketize_scores(T.minmax_normalize(_f1_split(spark, sf_dir)), NUM_BUCKETS)
    return out.select("id", "split", "bucket")


@register("explode_targets", oracle=f"""
WITH {_F2_ITEMS}
SELECT id, target_idx, span1_a, span1_b, label FROM items
""")
def explode_targets(spark, sf_dir):
    """One row per (instance, target) of F2."""
    ex = T.explode_targets(f2_instances(spark, sf_dir))
    return ex.select("id", F.col("target_idx").cast("long").alias("target_idx"), "span1_a", "span1_b", "label")


@register("drop_empty_targets", oracle="""
SELECT o_orderkey AS id, count(l_orderkey) AS n_targets
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey HAVING count(l_orderkey) > 0
""")
def drop_empty_targets(spark, sf_dir):
    """S1 filter: instances without targets are dropped."""
    kept = T.drop_empty(f2_instances(spark, sf_dir))
    return kept.select("id", F.size("targets").cast("long").alias("n_targets"))


@register("label_dictionary", oracle="""
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS id
FROM (SELECT DISTINCT l_returnflag AS label FROM lineitem)
""")
def label_dictionary(spark, sf_dir):
    """T3/S3 content: sorted distinct labels with their ids."""
    return T.label_dictionary(T.explode_targets(f2_instances(spark, sf_dir)))


_LABEL_IDS = f"""
{_F2_ITEMS},
dict AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id
         FROM (SELECT DISTINCT label FROM items)),
ids AS (SELECT items.id, items.target_idx, items.label, dict.label_id FROM items JOIN dict USING (label))"""


def _label_dictionary(spark, sf_dir):
    """The dictionary from the raw label column, before instances are built."""
    return T.label_dictionary(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label")))


@register("label_ids", oracle=f"""
WITH {_LABEL_IDS}
SELECT id, target_idx, label, label_id FROM ids
""")
def label_ids(spark, sf_dir):
    """Label → id through the (broadcast) dictionary."""
    ex = T.explode_targets(f2_instances(spark, sf_dir))
    out = T.label_ids(ex, _label_dictionary(spark, sf_dir))
    return out.select("id", F.col("target_idx").cast("long").alias("target_idx"), "label", "label_id")


@register("label_onehot", oracle=f"""
WITH {_LABEL_IDS},
c AS (SELECT count(*) AS n FROM (SELECT DISTINCT label FROM items))
SELECT id, target_idx, label_id,
  array_to_string(list_transform(range(0, CAST(c.n AS BIGINT)), lambda i: CASE WHEN i = label_id THEN 1 ELSE 0 END), ',') AS onehot
FROM ids, c
""")
def label_onehot(spark, sf_dir):
    """One-hot rows of eye(C) (rendered as text for the value check)."""
    ex = T.explode_targets(f2_instances(spark, sf_dir))
    d = _label_dictionary(spark, sf_dir)
    c = d.count()
    out = T.label_onehot(T.label_ids(ex, d), c)
    return out.select(
        "id", F.col("target_idx").cast("long").alias("target_idx"), "label_id",
        F.array_join(F.transform("onehot", lambda v: v.cast("int").cast("string")), ",").alias("onehot"),
    )


@register("split_pair", oracle="""
WITH u AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user'),
     a AS (SELECT conv_id, turn - 1 AS turn, text AS passage FROM conversations WHERE role = 'assistant'),
     t AS (SELECT conv_id, turn, query || ' [SEP] ' || passage AS text FROM u JOIN a USING (conv_id, turn))
SELECT conv_id, turn, string_split(text, ' [SEP] ')[1] AS query, string_split(text, ' [SEP] ')[2] AS passage,
       len(string_split(text, ' [SEP] ')) AS n_parts
FROM t
""")
def split_pair(spark, sf_dir):
    """Compose ``query [SEP] passage`` and split it back."""
    pairs = f4_pairs(spark, sf_dir)
    parts = T.split_pair(T.compose_pair(F.col("query"), F.col("passage")))
    return pairs.select(
        "conv_id", "turn",
        parts.getItem(0).alias("query"), parts.getItem(1).alias("passage"),
        F.size(parts).cast("long").alias("n_parts"),
    )


@register("compose_pair", oracle="""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations),
     q AS (SELECT conv_id * 100 + turn AS q_idx, conv_id * 1000 + turn AS orig_q_id, text FROM c WHERE role = 'user'),
     d AS (SELECT conv_id * 100 + turn AS d_idx, conv_id * 1000 + turn AS orig_d_id, text FROM c WHERE role = 'assistant'),
     pr AS (SELECT u.conv_id * 100 + u.turn AS q_idx, a.conv_id * 100 + a.turn AS d_idx,
                   CASE WHEN a.turn = u.turn + 1 THEN 1 ELSE 0 END AS label
            FROM c u JOIN c a ON u.conv_id = a.conv_id AND u.role = 'user' AND a.role = 'assistant'
             AND (a.turn = u.turn + 1 OR a.turn = u.turn + 3))
SELECT q.orig_q_id, d.orig_d_id, q.text || ' [SEP] ' || d.text AS text, pr.label
FROM pr JOIN q USING (q_idx) JOIN d USING (d_idx)
""")
def compose_pair(spark, sf_dir):
    """Ranking fact ⋈ query/doc dimensions → original ids and
    ``query [SEP] doc`` texts."""
    star = f4_star(spark, sf_dir)
    return T.ranking_pairs(star["pairs"], star["queries"], star["docs"])
