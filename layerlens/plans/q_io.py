"""Registered source/sink round trips and end-to-end procedures: split
export and re-read (K1, K2, K5, S1), label dictionary file (K3, S3), TREC
qrels and run files (S4, K4), a layer sweep (M9), evaluation of a stored
probe (A10) and the full probing procedure (A11)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from layerlens.functions.columns import rotate_left
from layerlens.operators import classification as C
from layerlens.operators import codelength as L
from layerlens.operators import ranking as R
from layerlens.operators import targets as T
from layerlens.operators.sampling import split_fits
from layerlens.plans.fixtures import f2_instances, f3_vectors, f4_star, f6_qrels, f6_run
from layerlens.plans.q_dataset import F3_PORTIONS, _F1_SPLIT, _f1_split
from layerlens.plans.q_probe import NUM_CLASSES, _centroid_sql, _f3_split, _PERM
from layerlens.plans.q_ranking import _PQ
from layerlens.plans.registry import ORACLES, register
from layerlens.sinks import writers as K
from layerlens.sources import instances as S
from layerlens.sources.tables import table
from layerlens.streaming.metric_streams import scratch


@register("export_splits", oracle=f"""
WITH {_F1_SPLIT},
b AS (SELECT min(label) AS lo, max(label) AS hi FROM sp WHERE split = 'train'),
n AS (SELECT split, (least(greatest(label, lo), hi) - lo) / (hi - lo) AS x FROM sp, b WHERE split IS NOT NULL)
SELECT split, count(*) AS n_instances, round(sum(x), 6) AS label_sum, round(min(x), 6) AS label_min,
       round(max(x), 6) AS label_max, round(min(lo), 6) AS min_score, round(max(hi), 6) AS max_score,
       true AS was_missing, false AS now_missing
FROM n, b GROUP BY split
""")
def export_splits(spark, sf_dir):
    """Normalised F1 splits written as JSON lines (one folder
    per split) with their bounds, then read back as probing instances."""
    root = scratch(spark, "splits")
    was_missing = K.splits_missing(spark, root)
    sp = _f1_split(spark, sf_dir)
    bounds = T.train_bounds(sp)
    norm = T.minmax_normalize(sp)
    inst = norm.select(
        "split",
        F.col("id").cast("string").alias("text"),
        F.array(F.struct(F.col("label").alias("label"))).alias("targets"),
    )
    if was_missing:
        K.write_splits(inst, root)
        K.write_bounds(bounds, os.path.join(root, "meta"))
    lo, hi = S.read_bounds(spark, os.path.join(root, "meta"))
    now_missing = K.splits_missing(spark, root)
    parts = []
    for split in K.SPLITS:
        df = S.read_jsonl_instances(spark, os.path.join(root, f"split={split}"))
        parts.append(df.select(F.lit(split).alias("split"), F.col("targets")[0]["label"].cast("double").alias("x")))
    back = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_instances"),
        F.round(F.sum("x"), 6).alias("label_sum"),
        F.round(F.min("x"), 6).alias("label_min"),
        F.round(F.max("x"), 6).alias("label_max"),
    ).withColumn("min_score", F.round(F.lit(lo), 6)).withColumn("max_score", F.round(F.lit(hi), 6)).withColumn("was_missing", F.lit(was_missing)).withColumn("now_missing", F.lit(now_missing))


_TWO_SPANS = """
SELECT l_orderkey AS id, l_linenumber AS span1_a, l_linenumber + 1 + CAST(l_quantity % 5 AS INTEGER) AS span1_b,
       l_linenumber + 2 AS span2_a, l_linenumber + 4 AS span2_b, l_returnflag AS label
FROM lineitem
"""


@register("json_array_instances", oracle=_TWO_SPANS)
def json_array_instances(spark, sf_dir):
    """Instances with two spans per target, stored as JSON arrays (a
    file for each run of order keys, as the format is one document a file),
    read back and unpacked."""
    root = scratch(spark, "json-arrays")
    item = F.struct(
        F.array("l_linenumber", F.col("l_linenumber") + 1 + (F.col("l_quantity") % 5).cast("int")).alias("span1"),
        F.array(F.col("l_linenumber") + 2, F.col("l_linenumber") + 4).alias("span2"),
        F.col("l_returnflag").alias("label"),
    )
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("targets"))
    run = F.floor(F.col("l_orderkey") / 4096)
    arrays = orders.groupBy(run.alias("run")).agg(
        F.to_json(F.collect_list(F.struct(F.col("l_orderkey").cast("string").alias("text"), "targets"))).alias("value")
    )
    arrays.write.partitionBy("run").text(root)
    back = S.read_json_array_instances(spark, os.path.join(root, "run=*"))
    return T.explode_targets(back, keep=("text",)).select(
        F.col("text").cast("long").alias("id"), "span1_a", "span1_b", "span2_a", "span2_b", "label"
    )


@register("split_sizes_fit", oracle="""
SELECT c_nationkey AS nation, count(*) AS n, CAST(5 + c_nationkey AS BIGINT) AS num_train, CAST(2 * c_nationkey AS BIGINT) AS num_test,
       count(*) >= 5 + 3 * c_nationkey AS fits
FROM customer GROUP BY c_nationkey
""")
def split_sizes_fit(spark, sf_dir):
    """Whether each nation's customers can give the asked-for split."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.withColumn("num_train", (F.col("nation") + 5).cast("long")).withColumn("num_test", (F.col("nation") * 2).cast("long"))
    return split_fits(sizes, "num_train", "num_test")


@register("label_file", oracle="""
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS id
FROM (SELECT DISTINCT l_returnflag AS label FROM lineitem)
""")
def label_file(spark, sf_dir):
    """K3/S3: the label dictionary written as labels.txt and read back
    (line number = id)."""
    d = T.label_dictionary(T.explode_targets(f2_instances(spark, sf_dir)))
    path = scratch(spark, "labels")
    K.write_label_dictionary(d, path)
    return S.read_label_dictionary(spark, path)


def _doc_id():
    return F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")


@register("trec_files", oracle=f"""
WITH {_PQ}
SELECT q_id, round(trec_ndcg_10, 6) AS trec_ndcg_10, round(trec_ap, 6) AS trec_ap FROM trec
""")
def trec_files(spark, sf_dir):
    """F6 qrels written in TREC qrels format and the run in TREC run
    format, both read back and evaluated (doc ids pack the document key)."""
    root = scratch(spark, "trec")
    qrels = f6_qrels(spark, sf_dir).select("q_id", F.lit("0").alias("u"), _doc_id().alias("d_id"), "grade")
    qrels.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in qrels.columns]).alias("v")).write.text(
        os.path.join(root, "qrels")
    )
    qr = R.dedupe_qrels(f6_qrels(spark, sf_dir), "q_id", ["l_orderkey", "l_partkey", "l_linenumber"])
    judged = R.judge_run(f6_run(spark, sf_dir), qr, "q_id", ["l_orderkey", "l_partkey", "l_linenumber"])
    ranked = R.rank_run(judged, "q_id", ["l_orderkey", "l_partkey", "l_linenumber"], "score")
    K.write_trec_run(R.trec_run_rows(ranked, "q_id", _doc_id(), "score", "layerlens"), os.path.join(root, "run"))
    run = spark.read.schema("q_id long, q0 string, d_id string, rank int, score double, name string").option(
        "sep", "\t").csv(os.path.join(root, "run"))
    q_back = S.read_trec_qrels(spark, os.path.join(root, "qrels"))
    pq = R.evaluate_run(run.select("q_id", "d_id", "score"), q_back, ks=(10,))
    return pq.select("q_id", F.round("trec_ndcg_10", 6).alias("trec_ndcg_10"), F.round("trec_ap", 6).alias("trec_ap"))


@register("ranking_star_files", oracle=ORACLES["compose_pair"])
def ranking_star_files(spark, sf_dir):
    """The ranking star schema (pairs, queries, docs) written as
    parquet, read back through the source and composed into texts."""
    root = scratch(spark, "star")
    for name, df in f4_star(spark, sf_dir).items():
        df.write.parquet(os.path.join(root, name))
    star = S.read_ranking_tables(spark, root)
    return T.ranking_pairs(star["pairs"], star["queries"], star["docs"])


_GRID = [(m, l) for m in (0, 1) for l in (0, 1, 2)]


@register("layer_sweep", oracle=f"""
WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label, {_PERM.format(id='vec_id')} AS perm FROM embeddings),
grid AS (SELECT * FROM (VALUES {", ".join(map(str, _GRID))}) t(model, layer)),
pl AS (SELECT p.id, p.label, p.perm, model, layer,
         list_transform(range(0, 64), lambda i: e[i + 1] * CAST(1 + model * (i % 3) AS DOUBLE) + CAST(layer AS DOUBLE) / 2 * e[((i + layer) % 64) + 1]) AS v
       FROM p CROSS JOIN grid),
fr AS (SELECT * FROM (VALUES (0, 0.0625), (1, 0.125), (2, 0.25), (3, 0.5), (4, 1.0)) t(portion_idx, fraction)),
pt0 AS (SELECT portion_idx, CAST(floor((SELECT count(*) FROM embeddings) * fraction) AS BIGINT) AS n FROM fr),
pt AS (SELECT portion_idx, n, lead(n) OVER (ORDER BY portion_idx) AS n_next FROM pt0),
mem AS (SELECT (pl.model * 10 + pl.layer) * 10 + pt.portion_idx AS g, pl.v, pl.label FROM pl JOIN pt ON pl.perm < pt.n WHERE pt.n_next IS NOT NULL),
chk AS (SELECT (pl.model * 10 + pl.layer) * 10 + pt.portion_idx AS g, pl.id, pl.v, pl.label FROM pl JOIN pt ON pl.perm >= pt.n AND pl.perm < pt.n_next),
{_centroid_sql('mem', 'chk')},
n0 AS (SELECT n AS n0 FROM pt WHERE portion_idx = 0),
tot AS (SELECT count(*) AS t FROM embeddings),
per AS (SELECT g // 10 AS point, sum(ce) AS ce, count(*) AS n_scored FROM sc GROUP BY g // 10)
SELECT CAST(point // 10 AS INTEGER) AS model, CAST(point % 10 AS INTEGER) AS layer,
       round(n0 * log2({NUM_CLASSES}) + ce, 6) AS mdl,
       round(t * log2({NUM_CLASSES}) / (n0 * log2({NUM_CLASSES}) + ce), 6) AS compression, n_scored
FROM per, n0, tot
""")
def layer_sweep(spark, sf_dir):
    """M8/M9: features of two models and three layers written once, a folder
    for each, then MDL and compression at every point of the grid, read from
    the stored features in one job."""
    path = scratch(spark, "features")
    points = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(l).alias("layer")) for m, l in _GRID]))
    wide = f3_vectors(spark, sf_dir).withColumn("vector", F.col("vector").cast("array<double>"))
    rows = wide.withColumn("_p", points).select("id", "label", "vector", "_p.model", "_p.layer")
    turned = rotate_left(F.col("vector"), F.col("layer"))
    stretch = F.transform("vector", lambda x, i: x * (1 + F.col("model") * (i % 3)).cast("double"))
    state = F.zip_with(stretch, turned, lambda x, y: x + F.col("layer").cast("double") / 2 * y)
    rows.withColumn("vector", state).write.partitionBy("model", "layer").parquet(path)
    res = L.sweep(spark.read.parquet(path), ["model", "layer"], NUM_CLASSES, F3_PORTIONS)
    return res.select("model", "layer", F.round("mdl", 6).alias("mdl"), F.round("compression", 6).alias("compression"),
                      F.col("n_scored").cast("long").alias("n_scored"))


@register("full_procedure", oracle=f"""
WITH f3 AS (SELECT vec_id AS id, embedding AS v, label FROM embeddings),
sz AS (SELECT count(*) - count(*) * 3 // 10 AS n_train, count(*) * 3 // 10 AS n_test FROM embeddings),
p0 AS (SELECT id, v, label, {_PERM.format(id='id')} AS perm FROM f3),
sp AS (SELECT id, v, label,
         CASE WHEN perm < n_test // 2 THEN 'test' WHEN perm < n_test THEN 'validation'
              WHEN perm < n_test + n_train THEN 'train' END AS split FROM p0, sz),
trn AS (SELECT id, v, label, {_PERM.format(id='id')} AS perm FROM sp WHERE split = 'train'),
fr AS (SELECT * FROM (VALUES (0, 0.0625), (1, 0.125), (2, 0.25), (3, 0.5), (4, 1.0)) t(portion_idx, fraction)),
pt0 AS (SELECT portion_idx, CAST(floor((SELECT count(*) FROM trn) * fraction) AS BIGINT) AS n FROM fr),
pt AS (SELECT portion_idx, n, lead(n) OVER (ORDER BY portion_idx) AS n_next FROM pt0),
mem AS (SELECT pt.portion_idx AS g, t.v, t.label FROM trn t JOIN pt ON t.perm < pt.n WHERE pt.n_next IS NOT NULL),
chk AS (SELECT pt.portion_idx AS g, t.id, t.v, t.label FROM trn t JOIN pt ON t.perm >= pt.n AND t.perm < pt.n_next),
{_centroid_sql('mem', 'chk', x='a_')},
ftr AS (SELECT 0 AS g, v, label FROM trn),
fte AS (SELECT 0 AS g, id, v, label FROM sp WHERE split = 'test'),
{_centroid_sql('ftr', 'fte', x='b_')},
m AS (SELECT (SELECT n FROM pt WHERE portion_idx = 0) * log2({NUM_CLASSES}) + (SELECT sum(ce) FROM a_sc) AS mdl)
SELECT round(mdl, 6) AS mdl, round((SELECT count(*) FROM trn) * log2({NUM_CLASSES}) / mdl, 6) AS compression,
       round((SELECT avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) FROM b_sc), 6) AS accuracy
FROM m
""")
def full_procedure(spark, sf_dir):
    """Online coding on the train split (MDL, compression), then the
    probe fitted on all train rows and tested (rows-only)."""
    sp = _f3_split(spark, sf_dir)
    train = sp.filter(F.col("split") == "train").select("id", "vector", "label")
    _, mdl = L.online_coding(train, NUM_CLASSES, F3_PORTIONS)
    cents = L.fit_centroids(train, [])
    test = sp.filter(F.col("split") == "test")
    scored = C.with_predictions(L.score_centroids(test, cents, NUM_CLASSES))
    acc = C.accuracy(scored).first()["accuracy"]
    return mdl.select(F.round("mdl", 6).alias("mdl"), F.round("compression", 6).alias("compression"),
                      F.round(F.lit(acc), 6).alias("accuracy"))
