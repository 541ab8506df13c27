"""Registered probe / classification / code-length queries over F3 (pooled
vectors with 10 classes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerlens.functions.columns import softmax
from layerlens.operators import classification as C
from layerlens.operators import codelength as L
from layerlens.operators import probes as P
from layerlens.operators import ranking as R
from layerlens.operators import sampling as S
from layerlens.plans.fixtures import f3_vectors
from layerlens.plans.q_dataset import F3_PORTIONS, _PERM, _split_sizes
from layerlens.plans.registry import register
from layerlens.session import materialize
from layerlens.sources.tables import table
from layerlens.streaming.metric_streams import scratch

NUM_CLASSES = 10


def _f3_split(spark, sf_dir):
    f3 = f3_vectors(spark, sf_dir)
    n = f3.count()
    num_train, num_test = _split_sizes(n)
    return S.exact_split(f3, num_train, num_test, n=n)


def centroid_predictions(spark, sf_dir):
    """Closed-form probe fitted on the F3 train split, scored on the
    validation and test splits: ``(id, split, label, logits, pred, ce, prob, score)``."""
    sp = _f3_split(spark, sf_dir)
    cents = L.fit_centroids(sp.filter(F.col("split") == "train"), [])
    ev = sp.filter(F.col("split") != "train")
    scored = L.score_centroids(ev, cents, NUM_CLASSES)
    return C.with_predictions(scored.select("id", "split", "label", "logits"))


# --- DuckDB building blocks --------------------------------------------------
_F3_SPLIT = f"""
f3 AS (SELECT vec_id AS id, embedding AS v, label FROM embeddings),
sz AS (SELECT count(*) - count(*) * 3 // 10 AS n_train, count(*) * 3 // 10 AS n_test FROM embeddings),
p AS (SELECT id, v, label, {_PERM.format(id='id')} AS perm FROM f3),
sp AS (
  SELECT id, v, label, perm,
    CASE WHEN perm < n_test // 2 THEN 'test'
         WHEN perm < n_test THEN 'validation'
         WHEN perm < n_test + n_train THEN 'train' END AS split
  FROM p, sz)"""


def _centroid_sql(train: str, ev: str, c: int = NUM_CLASSES, x: str = "") -> str:
    """CTEs scoring ``ev(g, id, v, label, …)`` with centroids of ``train(g, v, label)``
    per group g; ends with ``{x}sc(g, id, label, m, lse, pred, z_true, z_last, ce)``.
    ``x`` prefixes every CTE name so the block can appear twice."""
    return f"""
{x}tr AS (SELECT g, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM {train}),
{x}cen0 AS (SELECT g, label AS k, i, avg(x) AS c FROM {x}tr GROUP BY g, label, i),
{x}gm AS (SELECT g, i, avg(x) AS c FROM {x}tr GROUP BY g, i),
{x}cen AS (SELECT gs.g, cls.k, gm.i, COALESCE(c0.c, gm.c) AS c
           FROM (SELECT DISTINCT g FROM {x}tr) gs CROSS JOIN (SELECT range AS k FROM range(0, {c})) cls
           JOIN {x}gm gm ON gm.g = gs.g
           LEFT JOIN {x}cen0 c0 ON c0.g = gs.g AND c0.k = cls.k AND c0.i = gm.i),
{x}evx AS (SELECT g, id, unnest(v) AS x, unnest(range(len(v))) AS i FROM {ev}),
{x}dist AS (SELECT e.g, e.id, c.k, sum((e.x - c.c) * (e.x - c.c)) AS d
         FROM {x}evx e JOIN {x}cen c ON e.g = c.g AND e.i = c.i GROUP BY e.g, e.id, c.k),
{x}lg AS (SELECT e.g, e.id, e.label, cls.k, -dist.d AS z
       FROM {ev} e CROSS JOIN (SELECT range AS k FROM range(0, {c})) cls
       LEFT JOIN {x}dist dist ON dist.g = e.g AND dist.id = e.id AND dist.k = cls.k),
{x}mx AS (SELECT g, id, max(z) AS m FROM {x}lg GROUP BY g, id),
{x}sc0 AS (SELECT lg.g, lg.id, lg.label, mx.m,
          mx.m + ln(sum(exp(lg.z - mx.m))) AS lse,
          min(CASE WHEN lg.z = mx.m THEN lg.k END) AS pred,
          max(CASE WHEN lg.k = lg.label THEN lg.z END) AS z_true,
          max(CASE WHEN lg.k = {c - 1} THEN lg.z END) AS z_last
        FROM {x}lg lg JOIN {x}mx mx ON lg.g = mx.g AND lg.id = mx.id GROUP BY lg.g, lg.id, lg.label, mx.m),
{x}sc AS (SELECT *, lse - z_true AS ce FROM {x}sc0)"""


_CLS = _F3_SPLIT + """,
trn AS (SELECT 0 AS g, v, label FROM sp WHERE split = 'train'),
evs AS (SELECT 0 AS g, id, v, label, split FROM sp WHERE split IN ('validation', 'test')),""" + _centroid_sql(
    "trn", "evs"
) + """,
scs AS (SELECT sc.*, evs.split FROM sc JOIN evs USING (id))"""


@register("softmax_probs", oracle=f"""
WITH {_CLS}
SELECT id, round(exp(m - lse), 6) AS p_max, round(exp(z_last - lse), 6) AS p_last, pred FROM scs
""")
def softmax_probs(spark, sf_dir):
    """Softmax of the centroid logits; max and last-class probability."""
    pr = centroid_predictions(spark, sf_dir)
    return pr.select(
        "id",
        F.round(F.array_max("prob"), 6).alias("p_max"),
        F.round("score", 6).alias("p_last"),
        F.col("pred").cast("long").alias("pred"),
    )


@register("accuracy", oracle=f"""
WITH {_CLS}
SELECT split, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scs GROUP BY split
""")
def accuracy(spark, sf_dir):
    """A1: argmax accuracy per evaluated split."""
    acc = C.accuracy(centroid_predictions(spark, sf_dir), ["split"])
    return acc.select("split", F.round("accuracy", 6).alias("accuracy"))


@register("macro_f1", oracle=f"""
WITH {_CLS},
cls AS (SELECT range AS k FROM range(0, {NUM_CLASSES})),
st AS (SELECT s.split, cls.k,
         sum(CASE WHEN label = k AND pred = k THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN label <> k AND pred = k THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN label = k AND pred <> k THEN 1 ELSE 0 END) AS fn
       FROM scs s CROSS JOIN cls GROUP BY s.split, cls.k)
SELECT split, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1
FROM st GROUP BY split
""")
def macro_f1(spark, sf_dir):
    """A2: macro F1 per evaluated split (absent classes skipped)."""
    f1 = C.macro_f1(centroid_predictions(spark, sf_dir), NUM_CLASSES, ["split"])
    return f1.select("split", F.round("macro_f1", 6).alias("macro_f1"))


@register("cross_entropy", oracle=f"""
WITH {_CLS}
SELECT split, round(avg(ce), 6) AS loss FROM scs GROUP BY split
""")
def cross_entropy(spark, sf_dir):
    """A3: mean cross-entropy per evaluated split."""
    ce = C.mean_cross_entropy(centroid_predictions(spark, sf_dir), ["split"])
    return ce.select("split", F.round("loss", 6).alias("loss"))


_MDL = f"""
p AS (SELECT vec_id AS id, embedding AS v, label, {_PERM.format(id='vec_id')} AS perm FROM embeddings),
fr AS (SELECT * FROM (VALUES (0, 0.0625), (1, 0.125), (2, 0.25), (3, 0.5), (4, 1.0)) t(portion_idx, fraction)),
pt0 AS (SELECT portion_idx, CAST(floor((SELECT count(*) FROM embeddings) * fraction) AS BIGINT) AS n FROM fr),
pt AS (SELECT portion_idx, n, lead(n) OVER (ORDER BY portion_idx) AS n_next FROM pt0),
mem AS (SELECT pt.portion_idx AS g, p.v, p.label FROM p JOIN pt ON p.perm < pt.n WHERE pt.n_next IS NOT NULL),
chk AS (SELECT pt.portion_idx AS g, p.id, p.v, p.label FROM p JOIN pt ON p.perm >= pt.n AND p.perm < pt.n_next),
{_centroid_sql('mem', 'chk')},
per AS (SELECT g AS portion_idx, sum(ce) AS ce_sum, count(*) AS n_scored FROM sc GROUP BY g)"""


def _mdl(spark, sf_dir):
    f3 = f3_vectors(spark, sf_dir)
    return L.online_coding(f3, NUM_CLASSES, F3_PORTIONS)


@register("mdl_online_coding", oracle=f"""
WITH {_MDL}
SELECT CAST(portion_idx AS INTEGER) AS portion_idx, round(ce_sum, 6) AS ce_sum, n_scored FROM per
""")
def mdl_online_coding(spark, sf_dir):
    """Summed code length (nats) of each next chunk under the probe
    fitted on the portion before it (closed-form centroid probe)."""
    per, _ = _mdl(spark, sf_dir)
    return per.select(F.col("portion_idx").cast("int"), F.round("ce_sum", 6).alias("ce_sum"), "n_scored")


@register("compression", oracle=f"""
WITH {_MDL},
tot AS (SELECT count(*) AS t FROM embeddings),
first AS (SELECT n AS t0 FROM pt WHERE portion_idx = 0),
m AS (SELECT t0 * log2({NUM_CLASSES}) + (SELECT sum(ce_sum) FROM per) AS mdl FROM first)
SELECT round(mdl, 6) AS mdl, round(t * log2({NUM_CLASSES}) / mdl, 6) AS compression,
       round(t * log2({NUM_CLASSES}), 6) AS uniform_codelength,
       CAST((SELECT sum(n_scored) FROM per) AS BIGINT) AS n_scored
FROM m, tot
""")
def compression(spark, sf_dir):
    """MDL = first-portion targets·log2 C + Σ losses; compression."""
    _, rep = _mdl(spark, sf_dir)
    return rep.select(
        F.round("mdl", 6).alias("mdl"), F.round("compression", 6).alias("compression"),
        F.round("uniform_codelength", 6).alias("uniform_codelength"), "n_scored",
    )


_HIDDEN = 8


def _rule(i: str, j: str, salt: int, mod: int = 11, off: int = 5) -> str:
    return f"(((({i}) * 7 + ({j}) * 3 + {salt}) % {mod}) - {off}) / 10.0"


def _vec_rule(i: str, salt: int) -> str:
    return f"(((({i}) * 5 + {salt}) % 7) - 3) / 10.0"


def _linear_sql(rows: int, cols: int, x: str, w_salt: int, b_salt: int) -> str:
    return (f"list_transform(range(0, {rows}), lambda hi: list_sum(list_transform(range(0, {cols}), lambda d: "
            f"{_rule('hi', 'd', w_salt)} * {x}[d + 1])) + {_vec_rule('hi', b_salt)})")


def _tenney_sql(dim: int = 64, hidden: int = _HIDDEN) -> str:
    """CTEs from ``f3(id, v)`` to ``out(id, z)``."""
    return f"""
h1 AS (SELECT id, list_transform({_linear_sql(hidden, dim, 'v', 0, 0)}, lambda x: tanh(x)) AS h FROM f3),
ln AS (SELECT id, h, list_sum(h) / len(h) AS mu FROM h1),
ln2 AS (SELECT id, h, mu, list_sum(list_transform(h, lambda x: (x - mu) * (x - mu))) / len(h) AS var FROM ln),
hn AS (SELECT id, list_transform(range(0, {hidden}), lambda hi:
          (h[hi + 1] - mu) / sqrt(var + 1e-5) * (1.0 + hi / 10.0) + {_vec_rule('hi', 1)}) AS h FROM ln2),
out AS (SELECT id, {_linear_sql(NUM_CLASSES, hidden, 'h', 1, 2)} AS z FROM hn)"""


def _hewitt_sql(dim: int, hidden: int) -> str:
    return f"""
h1 AS (SELECT id, list_transform({_linear_sql(hidden, dim, 'v', 0, 0)}, lambda x: greatest(x, 0.0)) AS h FROM f3),
h2 AS (SELECT id, list_transform({_linear_sql(hidden, hidden, 'h', 2, 1)}, lambda x: greatest(x, 0.0)) AS h FROM h1),
out AS (SELECT id, {_linear_sql(NUM_CLASSES, hidden, 'h', 1, 2)} AS z FROM h2)"""


_SCORED = """SELECT id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred, round(list_max(z), 6) AS z_max,
       round(z[1], 6) AS z_0"""


def _scored(df):
    z = F.col("logits")
    return df.select(
        "id",
        (F.array_position(z, F.array_max(z)) - 1).cast("int").alias("pred"),
        F.round(F.array_max(z), 6).alias("z_max"),
        F.round(F.element_at(z, 1), 6).alias("z_0"),
    )


@register("probe_score", oracle=f"""
WITH f3 AS (SELECT vec_id AS id, embedding AS v FROM embeddings), {_tenney_sql()}
{_SCORED} FROM out
""")
def probe_score(spark, sf_dir):
    """M7: forward pass of stored probe weights (1-hidden-layer head: Linear,
    Tanh, LayerNorm, Linear) over every pooled vector."""
    params = P.params_from_rule(spark, 64, _HIDDEN, NUM_CLASSES, "tenney")
    return _scored(P.score_with_weights(f3_vectors(spark, sf_dir), params, "tenney"))


_F3_WIDE = """WITH f3 AS (SELECT vec_id AS id, list_transform(range(0, 512), lambda i: embedding[(i % 64) + 1]) AS v FROM embeddings)"""


def _wide(spark, sf_dir, kind):
    wide = f3_vectors(spark, sf_dir).withColumn("vector", F.flatten(F.array_repeat("vector", 8)))
    return _scored(P.score_with_weights(wide, P.params_from_rule(spark, 512, 256, NUM_CLASSES, kind), kind))


@register("probe_score_512", oracle=f"""
{_F3_WIDE}, {_tenney_sql(512, 256)}
{_SCORED} FROM out
""")
def probe_score_512(spark, sf_dir):
    """M7 at the usual pair size, 512 → 256 → classes, first head."""
    return _wide(spark, sf_dir, "tenney")


@register("probe_score_512_relu", oracle=f"""
{_F3_WIDE}, {_hewitt_sql(512, 256)}
{_SCORED} FROM out
""")
def probe_score_512_relu(spark, sf_dir):
    """M7 at the usual pair size, second head (two ReLU layers)."""
    return _wide(spark, sf_dir, "hewitt")


_RULE_SCORED = f"""
{_F3_SPLIT}, {_tenney_sql()},
sc0 AS (SELECT sp.id, split, label, z, list_max(z) AS m FROM out JOIN sp USING (id)),
sc AS (SELECT id, split, label, list_position(z, m) - 1 AS pred,
         m + ln(list_sum(list_transform(z, lambda x: exp(x - m)))) AS lse, z FROM sc0 WHERE split IS NOT NULL),
cls AS (SELECT range AS k FROM range(0, {NUM_CLASSES})),
st AS (SELECT s.split, cls.k,
         sum(CASE WHEN label = k AND pred = k THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN label <> k AND pred = k THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN label = k AND pred <> k THEN 1 ELSE 0 END) AS fn
       FROM sc s CROSS JOIN cls GROUP BY s.split, cls.k),
f1 AS (SELECT split, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END) AS f1 FROM st GROUP BY split),
acc AS (SELECT split, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS acc, avg(lse - z[label + 1]) AS loss FROM sc GROUP BY split)"""


def rule_scored(spark, sf_dir):
    """Rows of all F3 splits scored by a stored probe: the weights are
    written, loaded again and applied."""
    path = scratch(spark, "probe-weights")
    P.params_from_rule(spark, 64, _HIDDEN, NUM_CLASSES, "tenney").write.parquet(path)
    scored = P.score_with_weights(_f3_split(spark, sf_dir), spark.read.parquet(path), "tenney")
    return C.with_predictions(scored)


@register("test_only", oracle=f"""
WITH {_RULE_SCORED}
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'accuracy' AS metric, acc AS value FROM acc WHERE split = 'test'
  UNION ALL SELECT 'macro_f1', f1 FROM f1 WHERE split = 'test'
  UNION ALL SELECT 'loss', loss FROM acc WHERE split = 'test')
""")
def test_only(spark, sf_dir):
    """A10: load a stored probe and evaluate it on the test split."""
    # split and scored once; the three metrics read the kept columns
    test = materialize(rule_scored(spark, sf_dir).filter(F.col("split") == "test").select("label", "pred", "ce"))
    rows = [
        C.accuracy(test).select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
        C.macro_f1(test, NUM_CLASSES).select(F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("value")),
        C.mean_cross_entropy(test).select(F.lit("loss").alias("metric"), F.col("loss").alias("value")),
    ]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.select("metric", F.round("value", 6).alias("value"))


_QUERIES = 25


@register("probe_ranking_bundles", oracle=f"""
WITH {_RULE_SCORED},
run AS (SELECT split, id % {_QUERIES} AS q, id, exp(z[{NUM_CLASSES}] - lse) AS score,
          CASE WHEN label >= 7 THEN label - 6 ELSE 0 END AS grade FROM sc),
rk AS (SELECT *, CASE WHEN grade >= 1 THEN 1 ELSE 0 END AS rel,
         row_number() OVER (PARTITION BY split, q ORDER BY score DESC, id) AS rnk FROM run),
cu AS (SELECT *, sum(rel) OVER (PARTITION BY split, q ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM rk),
pq AS (SELECT split, q, sum(rel) AS n_rel,
    sum(CASE WHEN rnk <= 10 THEN rel ELSE 0 END) / 10.0 AS p10, sum(CASE WHEN rnk <= 20 THEN rel ELSE 0 END) / 20.0 AS p20,
    min(CASE WHEN rel = 1 THEN rnk END) AS first_rel, avg(CASE WHEN rel = 1 THEN cum / rnk END) AS ap,
    sum(CASE WHEN rel = 1 THEN cum / rnk ELSE 0 END) AS ap_sum,
    sum(CASE WHEN rnk <= 10 THEN grade / log2(rnk + 1) ELSE 0 END) AS d10,
    sum(CASE WHEN rnk <= 20 THEN grade / log2(rnk + 1) ELSE 0 END) AS d20
  FROM cu GROUP BY split, q),
qrels AS (SELECT vec_id % {_QUERIES} AS q, CASE WHEN label >= 7 THEN label - 6 ELSE 0 END AS grade FROM embeddings),
ideal AS (SELECT q, sum(CASE WHEN r <= 10 THEN grade / log2(r + 1) ELSE 0 END) AS i10,
            sum(CASE WHEN r <= 20 THEN grade / log2(r + 1) ELSE 0 END) AS i20, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) AS n_all
          FROM (SELECT q, grade, row_number() OVER (PARTITION BY q ORDER BY grade DESC) AS r FROM qrels) GROUP BY q),
m AS (SELECT split, avg(CASE WHEN n_rel > 0 THEN p10 ELSE 0 END) AS p10, avg(CASE WHEN n_rel > 0 THEN p20 ELSE 0 END) AS p20,
    avg(CASE WHEN n_rel > 0 THEN 1.0 / first_rel ELSE 0 END) AS mrr, avg(CASE WHEN n_rel > 0 THEN ap ELSE 0 END) AS map,
    avg(CASE WHEN n_all > 0 THEN ap_sum / n_all ELSE 0 END) AS trec_map,
    avg(CASE WHEN i10 <> 0 THEN d10 / i10 END) AS t10, avg(CASE WHEN i20 <> 0 THEN d20 / i20 END) AS t20
  FROM pq LEFT JOIN ideal USING (q) GROUP BY split)
SELECT split, metric, round(value, 6) AS value FROM (
  SELECT split, 'accuracy' AS metric, acc AS value FROM acc
  UNION ALL SELECT split, 'macro_f1', f1 FROM f1
  UNION ALL SELECT split, 'precision@10', p10 FROM m WHERE split <> 'train'
  UNION ALL SELECT split, 'precision@20', p20 FROM m WHERE split <> 'train'
  UNION ALL SELECT split, 'mrr', mrr FROM m WHERE split <> 'train'
  UNION ALL SELECT split, 'map', map FROM m WHERE split = 'validation'
  UNION ALL SELECT split, 'trec_map', trec_map FROM m WHERE split = 'test'
  UNION ALL SELECT split, 'trec_ndcg@10', t10 FROM m WHERE split = 'test'
  UNION ALL SELECT split, 'trec_ndcg@20', t20 FROM m WHERE split = 'test')
""")
def probe_ranking_bundles(spark, sf_dir):
    """The main evaluation end to end: stored probe weights → logits →
    softmax → probability of the last class as the score → judged run →
    the metric bundle of each split (A1, A2, A9, R1–R8)."""
    grade = F.when(F.col("label") >= 7, F.col("label") - 6).otherwise(0).cast("int")
    scored = materialize(rule_scored(spark, sf_dir).select(
        "split", (F.col("id") % _QUERIES).alias("q_id"), F.col("id").alias("d_id"), "label", "pred", "score", grade.alias("own_grade")
    ))
    qrels = f3_vectors(spark, sf_dir).select((F.col("id") % _QUERIES).alias("q_id"), F.col("id").alias("d_id"), grade.alias("grade"))
    return R.split_bundles(scored, qrels, NUM_CLASSES).select("split", "metric", F.round("value", 6).alias("value"))


_MULTI = """
tg AS (SELECT l_orderkey AS inst, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_linenumber, l_suppkey) AS id,
         [l_quantity / 50.0, l_discount * 10.0, l_tax * 10.0, CAST(l_linenumber AS DOUBLE) / 7.0]::DOUBLE[] AS v,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem),
ip AS (SELECT inst, {perm} AS perm FROM (SELECT DISTINCT inst FROM tg)),
fr AS (SELECT * FROM (VALUES {portions}) t(portion_idx, fraction)),
pt0 AS (SELECT portion_idx, CAST(floor((SELECT count(*) FROM ip) * CAST(fraction AS DOUBLE)) AS BIGINT) AS n FROM fr),
pt AS (SELECT portion_idx, n, lead(n) OVER (ORDER BY portion_idx) AS n_next FROM pt0),
p AS (SELECT tg.id, tg.v, tg.label, ip.perm FROM tg JOIN ip USING (inst)),
mem AS (SELECT pt.portion_idx AS g, p.v, p.label FROM p JOIN pt ON p.perm < pt.n WHERE pt.n_next IS NOT NULL),
chk AS (SELECT pt.portion_idx AS g, p.id, p.v, p.label FROM p JOIN pt ON p.perm >= pt.n AND p.perm < pt.n_next),
""".format(perm=_PERM.format(id="inst"), portions=", ".join(f"({i}, {f})" for i, f in enumerate(S.DEFAULT_PORTIONS)))


def _target_vectors(spark, sf_dir):
    """One row per target: an order's line items, with a vector and a class."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("id"),
        F.array(F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0,
                F.col("l_linenumber").cast("double") / 7.0).cast("array<double>").alias("vector"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"),
    )


@register("mdl_multi_target", oracle=f"""
WITH {_MULTI} {_centroid_sql('mem', 'chk', 3)},
m AS (SELECT (SELECT count(*) FROM p WHERE perm < (SELECT n FROM pt WHERE portion_idx = 0)) * log2(3) + (SELECT sum(ce) FROM sc) AS mdl,
        (SELECT count(*) FROM p) * log2(3) AS uniform, (SELECT count(*) FROM sc) AS n_scored)
SELECT round(mdl, 4) AS mdl, round(uniform / mdl, 6) AS compression, round(uniform, 4) AS uniform_codelength, n_scored FROM m
""")
def mdl_multi_target(spark, sf_dir):
    """A5–A8 over instances with several targets and the 11 default
    portions: portions are cut over instances, losses and T run over
    targets."""
    _, rep = L.online_coding(_target_vectors(spark, sf_dir), 3)
    return rep.select(F.round("mdl", 4).alias("mdl"), F.round("compression", 6).alias("compression"),
                      F.round("uniform_codelength", 4).alias("uniform_codelength"), "n_scored")


@register("probe_fit_predict", oracle=f"""
WITH {_F3_SPLIT}
SELECT split, count(*) AS n_rows, true AS probabilities, true AS learned FROM sp WHERE split IS NOT NULL GROUP BY split
""")
def probe_fit_predict(spark, sf_dir):
    """Fit a Spark ML MLP probe on the F3 train split and predict
    every row. SQL cannot repeat the fit, so what it must give is checked:
    all rows, probabilities, and on the rows it was fitted on more hits than
    the most frequent class would give."""
    sp = P.features(_f3_split(spark, sf_dir))
    model = P.probe_estimator("mlp", 64, NUM_CLASSES, hidden_dim=32, max_iter=50).fit(
        sp.filter(F.col("split") == "train")
    )
    pred = P.predict(model, sp, keep=("id", "split"))
    p = F.element_at(softmax(F.col("logits")), F.col("label") + 1)
    rows = pred.select("split", "label", (F.col("pred") == F.col("label")).cast("int").alias("right"), p.between(0, 1).alias("ok"))
    major = rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("split").agg(F.max("c").alias("major"))
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ok").alias("probabilities"), F.sum("right").alias("right")
    ).join(major, "split").select(
        "split", "n_rows", "probabilities", ((F.col("split") != "train") | (F.col("right") > F.col("major"))).alias("learned")
    )


@register("online_coding_trained", oracle=f"""
WITH {_MDL}
SELECT CAST(portion_idx AS INTEGER) AS portion_idx, n_scored, true AS finite, true AS compresses FROM per
""")
def online_coding_trained(spark, sf_dir):
    """A8/A11 with a trained probe (multinomial logistic regression) per
    portion. What SQL knows of it is checked: the rows scored after each
    portion, finite code lengths, and a code shorter than the uniform one."""
    f3 = P.features(f3_vectors(spark, sf_dir))
    est = P.probe_estimator("logreg", 64, NUM_CLASSES, max_iter=50)
    per, rep = L.online_coding_with_estimator(f3, est, NUM_CLASSES, F3_PORTIONS)
    shorter = F.lit(bool(rep.first()["compression"] > 1.0))
    return per.select(F.col("portion_idx").cast("int"), "n_scored", F.col("ce_sum").between(0, 1e12).alias("finite"), shorter.alias("compresses"))
