"""Split / portion properties."""

import pytest
from pyspark.sql import functions as F

from layerlens.operators import sampling as S


@pytest.fixture()
def ids(spark):
    return spark.range(1003).select(F.col("id"))


def test_exact_split_sizes_and_disjoint(ids):
    sp = S.exact_split(ids, num_train=600, num_test=301)
    counts = {r.split: r["count"] for r in sp.groupBy("split").count().collect()}
    assert counts == {"test": 150, "validation": 151, "train": 600}
    assert sp.select("id").distinct().count() == 901


def test_split_precondition(ids):
    with pytest.raises(ValueError):
        S.exact_split(ids, num_train=900, num_test=200)


def test_permutation_is_seeded_and_complete(ids):
    a = {r.id: r.perm for r in S.permute(ids).collect()}
    b = {r.id: r.perm for r in S.permute(ids.repartition(7)).collect()}
    assert a == b and sorted(a.values()) == list(range(1003))
    c = {r.id: r.perm for r in S.permute(ids, seed=1).collect()}
    assert c != a


def test_portions_nested_and_chunks_cover(spark, ids):
    fr = (0.1, 0.25, 0.5, 1.0)
    perm = S.permute(ids)
    pt = S.portions_table(spark, 1003, fr)
    assert [r.n for r in pt.orderBy("portion_idx").collect()] == [int(1003 * p) for p in fr]
    mem = S.portion_members(perm, pt)
    sets = [set(r.id for r in mem.filter(F.col("portion_idx") == k).collect()) for k in range(4)]
    assert all(sets[k] < sets[k + 1] for k in range(3))
    chunks = S.next_chunks(perm, pt)
    got = set(r.id for r in chunks.collect()) | sets[0]
    assert got == set(range(1003)) and chunks.count() + len(sets[0]) == 1003


def test_sample_n_exact(ids):
    assert S.sample_n(ids, 37).count() == 37


def test_permutation_independent_of_bucket_width(ids):
    base = {r.id: r.perm for r in S.permute(ids).collect()}
    for k in (1, 2, 5):
        assert {r.id: r.perm for r in S.permute(ids, prefix_chars=k).collect()} == base


def test_cut_keys_equal_the_permutation(spark, ids):
    perm = {r.perm: r.id for r in S.permute(ids).collect()}
    for k in (1, 4):
        keys = S.cut_keys(ids, [0, 1, 37, 500, 1002, 1003, 5000], prefix_chars=k)
        assert {p: key and key[1] for p, key in keys.items()} == {p: perm.get(p) for p in keys}
    assert {r.id for r in S.sample_n(ids, 37).collect()} == {perm[i] for i in range(37)}
    plan = S.sample_n(ids, 37)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    half = S.exact_split(ids, 600, 301, val_fraction=0.5)
    assert {r.id for r in half.filter("split = 'validation'").collect()} == {perm[i] for i in range(150, 225)}
    assert S.sample_n(ids, 0).count() == 0 and S.sample_n(ids, 9999).count() == 1003
