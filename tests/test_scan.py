"""The skew-safe ordered scan against pandas brute force, including one hot
group spread over many partitions and groups crossing partition borders."""

import numpy as np
import pandas as pd

from layerlens.operators.scan import global_rank, group_rank, segmented_scan, top_k


def _frame(spark):
    rng = np.random.default_rng(7)
    n = 5000
    # group 0 holds ~a third of all rows
    g = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 60, n))
    pdf = pd.DataFrame({"g": g.astype("int64"), "k": rng.permutation(n).astype("int64"),
                        "v": rng.normal(size=n).round(3), "r": rng.integers(0, 2, n).astype("int64")})
    return pdf, spark.createDataFrame(pdf)


def test_group_positions_and_running_values(spark):
    pdf, df = _frame(spark)
    out = segmented_scan(df, ["g"], ["-v", "k"], sums=["r"], mins=["v"], maxs=["v"],
                         num_partitions=16).toPandas()
    exp = pdf.sort_values(["g", "v", "k"], ascending=[True, False, True]).copy()
    exp["pos"] = exp.groupby("g").cumcount() + 1
    exp["cum_r"] = exp.groupby("g")["r"].cumsum()
    exp["runmin_v"] = exp.groupby("g")["v"].cummin()
    exp["runmax_v"] = exp.groupby("g")["v"].cummax()
    m = out.merge(exp, on=["g", "k"], suffixes=("", "_e"))
    assert len(m) == len(pdf)
    assert (m["pos"] == m["pos_e"]).all()
    assert np.allclose(m["cum_r"], m["cum_r_e"])
    assert np.allclose(m["runmin_v"], m["runmin_v_e"])
    assert np.allclose(m["runmax_v"], m["runmax_v_e"])


def test_global_rank_is_a_permutation(spark):
    pdf, df = _frame(spark)
    out = global_rank(df, ["k"], num_partitions=7).toPandas()
    assert sorted(out["rank"]) == list(range(1, len(pdf) + 1))
    assert (out.sort_values("k")["rank"].to_numpy() == np.arange(1, len(pdf) + 1)).all()


def test_multi_column_groups_with_nulls(spark):
    df = spark.createDataFrame(
        [(None, "a", 1), (None, "a", 2), (1, None, 3), (1, None, 1), (1, "b", 5)], "x int, y string, o int"
    )
    out = {(r.x, r.y, r.o): r.rank for r in group_rank(df, ["x", "y"], ["o"], num_partitions=3).collect()}
    assert out == {(None, "a", 1): 1, (None, "a", 2): 2, (1, None, 1): 1, (1, None, 3): 2, (1, "b", 5): 1}


def test_nulls_and_nan_change_no_bound(spark):
    """A long series in many ranges with a null and a NaN in it."""
    n = 3000
    rows = [("a", i, float(n - i) if i > 10 else -1.0 - (i == 5)) for i in range(1, n + 1)]
    rows[1500] = ("a", 1501, None)
    rows[2200] = ("a", 2201, float("nan"))
    rows += [("b", 1, None), ("b", 2, 3.0), (None, 1, 4.0), (None, 2, None)]
    df = spark.createDataFrame(rows, "s string, i int, v double").repartition(7)
    out = segmented_scan(df, ["s"], ["i"], sums=["v"], mins=["v"], maxs=["v"], before_mins=["v"], num_partitions=16)
    got = {(r.s, r.i): r for r in out.collect()}
    assert len(got) == len(rows)
    assert got[("a", n)].runmin_v == -2.0 and got[("a", 1501)].runmin_v == -2.0 and got[("a", 2201)].runmin_v == -2.0
    assert got[("a", 2201)].runmax_v == float(n - 11) == got[("a", n)].runmax_v
    assert got[("a", 5)].prevmin_v == -1.0 and got[("a", 6)].prevmin_v == -2.0 and got[("a", 1)].prevmin_v is None
    assert got[("b", 1)].runmin_v is None and got[("b", 2)].cum_v == 3.0 and got[(None, 2)].runmax_v == 4.0
    assert [got[("a", i)].pos for i in (1, 1501, n)] == [1, 1501, n]


def test_hot_group_is_split_without_python(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 0, id % 500) as g", "hash(id) as o", "id")
    out = segmented_scan(df, ["g"], ["-o", "id"], num_partitions=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "_r" in plan
    hot = out.where("g = 0").orderBy("pos").collect()
    assert [r.pos for r in hot] == list(range(1, len(hot) + 1))
    assert all(a.o >= b.o for a, b in zip(hot, hot[1:]))


def test_lead_columns_of_other_types(spark):
    rows = [("x" * (i % 9) + str(i % 7), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int").selectExpr(
        "k", "i", "timestamp_ntz'2020-01-01' + make_interval(0,0,0,0,i) as t",
        "date_add(date'2020-01-01', i) as d", "cast(i as decimal(20,2)) as n")
    for lead in ("k", "t", "d", "n", "-k", "-t"):
        got = [r.i for r in global_rank(df, [lead, "i"], num_partitions=9).orderBy("rank").collect()]
        key = lead.lstrip("-")
        want = [r.i for r in df.orderBy(df[key].desc() if lead[0] == "-" else df[key], "i").collect()]
        assert got == want, lead


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(5000).selectExpr("id % 3 as g", "hash(id) as v", "id")
    out = top_k(df, ["g"], ["v", "id"], 4)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    want = df.toPandas().sort_values(["v", "id"]).groupby("g").head(4)
    assert sorted(out.toPandas()["id"]) == sorted(want["id"])
