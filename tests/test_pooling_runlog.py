"""Pooling edge cases, layer pruning, batch inference wrapper, early stop."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from layerlens.operators import pooling as M
from layerlens.operators import runlog as RL


def test_attention_pool_matches_numpy(spark):
    rng = np.random.default_rng(3)
    h = rng.normal(size=(6, 4)).round(3)
    tokens = spark.createDataFrame([(0, i, [float(x) for x in h[i]]) for i in range(6)], "seq int, pos int, vector array<double>")
    spans = spark.createDataFrame([(0, 0, 1, 4), (0, 1, 3, 3)], "seq int, target_idx int, a int, b int")
    params = M.projection_params(spark, 4, 3)
    out = {r.target_idx: r.pooled for r in M.attention_pool(tokens, spans, params, 1).collect()}
    p = params.filter("slot = 1").collect()[0]
    w, b, v = np.array(p.w), np.array(p.b), np.array(p.v)
    hp = h[1:4] @ w.T + b
    s = hp @ v
    a = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    assert np.allclose(out[0], a @ hp)
    assert out[1] == [0.0, 0.0, 0.0]  # empty span → zero vector


def test_hidden_states_partition_pruning(spark):
    d = os.path.join(tempfile.mkdtemp(), "hs")
    hs = spark.range(30).select((F.col("id") % 3).cast("int").alias("layer"), F.col("id").cast("int").alias("pos"),
                                F.array(F.col("id").cast("double")).alias("vector"))
    M.write_hidden_states(hs, d)
    sel = M.select_layer(spark.read.parquet(d), 2)
    plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and "(layer" in plan
    assert sel.count() == 10


def test_predict_batch_udf_wrapper(spark):
    def make():
        def predict(x):
            return np.stack([x * 2.0, x + 1.0], axis=1).astype(np.float32)
        return predict

    df = spark.range(5).select(F.col("id").cast("float").alias("x"))
    out = M.extract_hidden_states(df, make, "x", 2, batch_size=2).collect()
    assert [list(r.vector) for r in out] == [[2.0 * i, i + 1.0] for i in range(5)]


def test_early_stop_patience(spark):
    vals = [5, 4, 4, 6, 7, 3, 3, 3, 3]
    df = spark.createDataFrame([(1, "m", i + 1, float(v)) for i, v in enumerate(vals)], "run long, metric string, step int, value double")
    r = RL.early_stop(df, patience=3).collect()[0]
    # improvements at steps 1, 2, 6 (4 at step 3 is not strict); 3 checks without improvement after step 2 → step 5
    assert r.stop_step == 5 and r.best == 3.0


def test_early_stop_and_running_bounds_with_nulls(spark):
    nan = float("nan")
    series = {
        "a": [5.0, 4.0, 4.0, 4.5, 3.9, 4.0, 4.0, 4.0],
        "b": [None, nan, 2.0, 3.0, 1.0, 1.0],
        "c": [None, None, None, None],
        "d": [1.0] * 400,
    }
    rows = [(k, i + 1, v) for k, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "run string, step int, value double").withColumn("metric", F.lit("m"))
    got = {r.run: r for r in RL.early_stop(df, patience=3).collect()}
    for k, vs in series.items():
        best, last, stop = None, 1, None
        for i, v in enumerate(vs, 1):
            if v is not None and v == v and (best is None or v < best):
                best, last = v, i
            if stop is None and i - last >= 3:
                stop = i
        assert (got[k].stop_step, got[k].best, got[k].n_steps) == (stop, best, len(vs)), k
    bounds = {(r.run, r.step): (r.run_min, r.run_max) for r in RL.running_bounds(df).collect()}
    assert bounds[("b", 2)] == (None, None) and bounds[("b", 6)] == (1.0, 3.0) and bounds[("a", 5)] == (3.9, 5.0)


def test_best_checkpoints(spark):
    rows = [("r", "loss", i, float(v)) for i, v in enumerate([3, 1, 2, 1, 5])] + [("r", "other", 0, 0.0)]
    df = spark.createDataFrame(rows, "run string, metric string, step int, value double")
    assert [(r.step, r.rank) for r in RL.best_checkpoints(df, "loss", 2).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    assert [r.step for r in RL.best_checkpoints(df, "loss", 1, mode="max").collect()] == [4]
