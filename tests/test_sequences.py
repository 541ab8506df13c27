"""Sequence inference in padded batches, and pooling over stored states."""

import random

import numpy as np
from conftest import SF_SMALL
from pyspark.sql import functions as F

from layerlens.operators import pooling as M
from layerlens.operators import sequences as Q
from layerlens.plans.fixtures import f5_spans
from layerlens.plans.q_pooling import stored_states


def test_batches_hold_like_lengths():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(3, 1.2, 4000).astype(int), 512)
    batches = list(Q.length_batches(lengths, 4096))
    assert sorted(np.concatenate(batches).tolist()) == np.flatnonzero(lengths).tolist()
    cells = [len(b) * int(lengths[b].max()) for b in batches]
    assert all(c <= 4096 or len(b) == 1 for c, b in zip(cells, batches))
    assert sum(cells) <= 1.1 * lengths.sum()  # padding costs under a tenth
    in_order = sum(64 * int(lengths[i : i + 64].max()) for i in range(0, 4000, 64))
    assert in_order > 3 * lengths.sum()


def own_states(ids, types, mask, dim, layers):
    x = [[(((t * 7 + d * 3) % 11) - 5) / 10.0 * m for d in range(dim)] for t, m in zip(ids, mask)]
    out = [x]
    for _ in range(layers - 1):
        at = lambda i, d: x[i][d] if 0 <= i < len(x) else 0.0  # noqa: B023, E731
        x = [[(x[i][d] / 2 + (at(i - 1, d) + at(i + 1, d)) / 4 + types[i] / 10.0) * mask[i] for d in range(dim)] for i in range(len(x))]
        out.append(x)
    return out


def test_states_of_any_batching_equal_each_sequence_alone(spark):
    rng = random.Random(2)
    rows = []
    for i in range(90):
        n = rng.choice([0, 1, 2, 5, 30])
        rows.append((i // 2, f"k{i % 5}", [rng.randint(0, 900) for _ in range(n)], [rng.randint(0, 1) for _ in range(n)],
                     [1] * (n - n // 4) + [0] * (n // 4)))
    rows.append((99, None, None, None, None))
    df = spark.createDataFrame(rows, "seq long, name string, input_ids array<int>, token_type_ids array<int>, attention_mask array<int>")
    want = sorted(
        (s, k or "", layer, p, [round(v, 9) for v in x])
        for s, k, ids, types, mask in rows if ids
        for layer, states in enumerate(own_states(ids, types, mask, 3, 3)) for p, x in enumerate(states) if mask[p]
    )
    for tokens in (1, 64, 100_000):
        got = Q.extract_states(df.repartition(3), Q.neighbour_model(3, 3), ["seq", "name"], batch_tokens=tokens)
        assert sorted((r.seq, r.name or "", r.layer, r.pos, [round(v, 9) for v in r.vector]) for r in got.collect()) == want
    one = Q.extract_states(df, Q.neighbour_model(3, 3), ["seq", "name"], layers=[2])
    assert {r.layer for r in one.select("layer").distinct().collect()} == {2}


def token_side(plan: str) -> list[str]:
    """Operators from the scan of the stored states up to the join."""
    lines = plan.split("== Initial Plan ==")[-1].split("\n")
    at = next(i for i, x in enumerate(lines) if "Scan parquet spark_catalog" in x)
    depth, out = lines[at].index("Scan"), []
    for x in reversed(lines[: at + 1]):
        name = x.lstrip(" :+-*")
        if "- " in x and x.index(name) < depth:
            depth = x.index(name)
            out.append(name)
            if "Join" in name:
                break
    return out


def test_pooling_over_stored_states_moves_no_token(spark):
    states = stored_states(spark, SF_SMALL)
    spans, params = f5_spans(spark, SF_SMALL), M.projection_params(spark, 64, 8)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pooled = M.attention_pool(M.select_layer(states, 1), spans, params, 0)
        plan = pooled._jdf.queryExecution().executedPlan().toString()
        up = token_side(plan)
        assert "Join" in up[-1] and not any("Exchange" in x for x in up)
        assert "SelectedBucketsCount" in plan
        after = plan[: plan.index("Scan parquet spark_catalog")]
        # only sums of spans are exchanged after the join
        assert after.rindex("MapInArrow") > after.rindex("Window")
        rows = sorted(map(repr, pooled.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    plain = states.select("seq", "layer", "pos", "vector").where("layer = 1").repartition(5)
    again = M.attention_pool(plain, spans, params, 0).collect()
    for a, b in zip(rows, sorted(map(repr, again))):
        assert a[:40] == b[:40]
    assert Q.bucketed_by(spark, states._jdf.queryExecution().analyzed().collectLeaves().head().catalogTable().get().identifier().table()) == 8


def test_partial_sums_are_one_softmax(spark):
    """Batches of two tokens: partial sums on scales that differ widely."""
    rng = np.random.default_rng(3)
    n = 23
    rows = [(0, i, (rng.normal(size=4) * 30).tolist()) for i in range(n)]
    tokens = spark.createDataFrame(rows, "seq int, pos int, vector array<double>").coalesce(1)
    spans = spark.createDataFrame([(0, 0, 0, 23), (0, 1, 4, 9), (0, 2, 3, 3)], "seq int, target_idx int, a int, b int")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r.target_idx: r.pooled for r in M.attention_pool(tokens, spans, M.projection_params(spark, 4, 3), 0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    p = M.projection_params(spark, 4, 3).where(F.col("slot") == 0).first()
    w, b, v = (np.array(p[c]) for c in ("w", "b", "v"))
    for t, (lo, hi) in enumerate([(0, 23), (4, 9)]):
        h = np.array([r[2] for r in rows[lo:hi]]) @ w.T + b
        a = np.exp(h @ v - (h @ v).max())
        assert np.allclose(got[t], (a / a.sum()) @ h)
    assert got[2] == [0.0, 0.0, 0.0]
