"""MDL / compression identities (card C1) and classification metrics."""

import math

import pytest
from pyspark.sql import functions as F

from layerlens.operators import classification as C
from layerlens.operators import codelength as L


def test_uniform_predictor_code_length(spark):
    # identical vectors → every centroid equal → uniform logits → CE = ln C
    df = spark.range(400).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), (F.col("id") % 4).cast("int").alias("label"))
    per, rep = L.online_coding(df, 4, (0.25, 0.5, 1.0))
    r = rep.collect()[0]
    assert r.n_scored == 300
    assert r.mdl == pytest.approx(100 * math.log2(4) + 300 * math.log(4))
    assert r.compression == pytest.approx(400 * 2 / r.mdl)
    # compression · MDL / log2 C = number of targets (golden identity)
    assert r.compression * r.mdl / math.log2(4) == pytest.approx(400)


def test_missing_class_falls_back_to_overall_mean(spark):
    rows = [(i, [float(i % 2)], i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    cents = L.fit_centroids(df, [])
    out = L.centroid_logits(df.crossJoin(cents), 3).collect()
    # classes 0 and 1 present (centroids 0 and 1), class 2 absent → mean 0.5
    for r in out:
        x = r.vector[0]
        assert r.missing_class == 1
        assert r.logits == pytest.approx([-(x - 0.0) ** 2, -(x - 1.0) ** 2, -(x - 0.5) ** 2])


def test_accuracy_f1_ce(spark):
    df = spark.createDataFrame(
        [([2.0, 1.0, 0.0], 0), ([0.0, 3.0, 0.0], 1), ([0.0, 0.0, 1.0], 1), ([1.0, 0.0, 0.0], 0)],
        "logits array<double>, label int",
    )
    p = C.with_predictions(df)
    assert C.accuracy(p).collect()[0].accuracy == pytest.approx(0.75)
    # class 0: tp2 fp0 fn0 → 1; class 1: tp1 fp0 fn1 → 2/3; class 2: tp0 fp1 fn0 → 0
    assert C.macro_f1(p, 3).collect()[0].macro_f1 == pytest.approx((1 + 2 / 3 + 0) / 3)
    assert C.macro_f1(p, 4, absent="zero").collect()[0].macro_f1 == pytest.approx((1 + 2 / 3) / 4)
    lse = math.log(math.exp(2) + math.exp(1) + 1)
    assert p.filter(F.col("label") == 0).orderBy("pred").collect()[0].ce == pytest.approx(lse - 2.0)


def test_mdl_units(spark):
    per = spark.createDataFrame([(0, 2.0, 3, 3, 0), (1, 4.0, 6, 6, 0)],
                                "portion_idx int, ce_sum double, n_scored long, n_targets long, n_missing_class long")
    mixed = L.mdl_and_compression(spark, per, 1, 10, 4).collect()[0]
    bits = L.mdl_and_compression(spark, per, 1, 10, 4, unit="bits").collect()[0]
    assert mixed.mdl == pytest.approx(2 + 6.0)
    assert bits.mdl == pytest.approx(2 + 6.0 / math.log(2))
    assert mixed.compression == pytest.approx(20 / 8.0)


@pytest.mark.parametrize("kind", ["tenney", "hewitt"])
def test_probe_forward_pass(spark, kind):
    import numpy as np

    from layerlens.operators import probes as P

    params = P.params_from_rule(spark, 6, 5, 3, kind)
    x = np.array([[((i * 3 + d) % 7) / 7.0 - 0.4 for d in range(6)] for i in range(40)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, vector array<double>")
    got = np.array([r.logits for r in P.score_with_weights(df, params, kind, batch_rows=7).orderBy("id").collect()])
    w = {k: np.array(v) for k, v in params.first().asDict().items()}
    h = x @ w["w1"].T + w["b1"]
    if kind == "tenney":
        h = np.tanh(h)
        h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5) * w["gamma"] + w["beta"]
    else:
        h = np.maximum(np.maximum(h, 0) @ w["wh"].T + w["bh"], 0)
    assert np.allclose(got, h @ w["w2"].T + w["b2"])


def test_several_targets_per_instance(spark):
    """Identical vectors: every loss is ln C, and T counts targets."""
    rows = [(i, [1.0], (i + j) % 4) for i in range(100) for j in range(1 + i % 3)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    per, rep = L.online_coding(df, 4, (0.25, 0.5, 1.0))
    r = rep.first()
    first = len(rows) - r.n_scored
    assert per.agg(F.sum("n_targets")).first()[0] == r.n_scored
    assert r.uniform_codelength == pytest.approx(len(rows) * 2)
    assert r.mdl == pytest.approx(first * 2 + r.n_scored * math.log(4))
    other = L.online_coding(df, 4, (0.25, 0.5, 1.0), seed=7)[1].first()
    kept = L.online_coding(df, 4, (0.25, 0.5, 1.0), shuffle_first=False)[1].first()
    assert kept.n_scored == sum(1 for i, *_ in rows if i >= 25) and other.uniform_codelength == r.uniform_codelength


def test_trained_coding_with_missing_classes_and_empty_portions(spark):
    from layerlens.operators import probes as P

    # the top class only in the last rows, and fewer than 1000 rows for the
    # default portions, so that the first is empty
    rows = [(i, [float(i % 2), float(i % 3)], 9 if i >= 150 else i % 3) for i in range(200)]
    df = P.features(spark.createDataFrame(rows, "id long, vector array<double>, label int"))
    est = P.probe_estimator("logreg", 2, 10, max_iter=5)
    per, rep = L.online_coding_with_estimator(df, est, 10, shuffle_first=False)
    got = {r.portion_idx: r for r in per.collect()}
    assert len(got) == 10 and got[0].n_missing_class == got[0].n_scored == 0
    assert all(math.isfinite(r.ce_sum) for r in got.values())
    assert sum(r.n_scored for r in got.values()) == 200 and got[9].n_missing_class == 100
    assert rep.first().n_scored == 200
    closed = L.online_coding(df.select("id", "vector", "label"), 10)[1].first()
    assert closed.n_scored + 0 == 200 and math.isfinite(closed.mdl)
