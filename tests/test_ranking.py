"""Hand-computed ranking metrics on a tiny run."""

import math

import pytest

from layerlens.operators import ranking as R


@pytest.fixture()
def run_and_qrels(spark):
    # query 1: docs scored 0.9 (grade 2), 0.8 (0), 0.7 (1); qrels also judge
    # doc 9 (grade 3) which is not retrieved. query 2: nothing relevant.
    run = spark.createDataFrame(
        [(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7), (2, 4, 0.5), (2, 5, 0.4)], "q_id long, d_id long, score double"
    )
    qrels = spark.createDataFrame(
        [(1, 1, 2), (1, 2, 0), (1, 3, 1), (1, 9, 3), (2, 4, 0)], "q_id long, d_id long, grade int"
    )
    return run, qrels


def test_per_query_metrics(run_and_qrels):
    run, qrels = run_and_qrels
    pq = {r.q_id: r for r in R.evaluate_run(run, qrels, ks=(1, 2)).collect()}
    q1 = pq[1]
    assert q1.p_at_1 == 1.0 and q1.p_at_2 == 0.5
    assert q1.rr == 1.0
    assert q1.ap == pytest.approx((1 / 1 + 2 / 3) / 2)
    assert q1.trec_ap == pytest.approx((1 / 1 + 2 / 3) / 3)
    dcg1 = 2 / math.log2(2)
    idcg1 = 3 / math.log2(2)
    assert q1.trec_ndcg_1 == pytest.approx(dcg1 / idcg1)
    dcg2 = 2 / math.log2(2) + 0 / math.log2(3)
    idcg2 = 3 / math.log2(2) + 2 / math.log2(3)
    assert q1.trec_ndcg_2 == pytest.approx(dcg2 / idcg2)
    # empty target → neg → 0; TREC MAP 0; TREC NDCG skipped (0/0)
    q2 = pq[2]
    assert q2.rr == 0.0 and q2.ap == 0.0 and q2.trec_ap == 0.0 and q2.trec_ndcg_1 is None


@pytest.mark.parametrize("action,expected", [("neg", 0.5), ("pos", 1.0), ("skip", 1.0)])
def test_empty_target_actions(run_and_qrels, action, expected):
    run, qrels = run_and_qrels
    pq = R.evaluate_run(run, qrels, ks=(1,), empty_target_action=action)
    rep = {r.metric: r.value for r in R.ranking_report(pq, ks=(1,)).collect()}
    assert rep["mrr"] == pytest.approx(expected)


def test_empty_target_error(run_and_qrels):
    run, qrels = run_and_qrels
    with pytest.raises(Exception):
        R.evaluate_run(run, qrels, ks=(1,), empty_target_action="error").collect()


def test_ideal_order_gives_ndcg_one(spark):
    run = spark.createDataFrame([(1, d, float(10 - d)) for d in range(6)], "q_id long, d_id long, score double")
    qrels = spark.createDataFrame([(1, d, g) for d, g in enumerate([3, 3, 2, 1, 0, 0])], "q_id long, d_id long, grade int")
    r = R.evaluate_run(run, qrels, ks=(3, 20)).collect()[0]
    assert r.trec_ndcg_3 == pytest.approx(1.0) and r.trec_ndcg_20 == pytest.approx(1.0)


def test_metrics_invariant_under_repartition(run_and_qrels):
    run, qrels = run_and_qrels
    a = sorted(R.evaluate_run(run, qrels).collect())
    b = sorted(R.evaluate_run(run.repartition(5), qrels.repartition(3)).collect())
    assert a == b


@pytest.mark.parametrize("policy,expected", [("skip", None), ("zero", 0.0), ("nan", "nan")])
def test_no_relevant_policy(run_and_qrels, policy, expected):
    run, qrels = run_and_qrels
    q2 = [r for r in R.evaluate_run(run, qrels, ks=(1,), no_relevant=policy).collect() if r.q_id == 2][0]
    if expected == "nan":
        assert math.isnan(q2.trec_ndcg_1)
    else:
        assert q2.trec_ndcg_1 == expected


def test_duplicate_qrels_keep_highest_grade(spark):
    qrels = spark.createDataFrame([(1, 1, 0), (1, 1, 2), (1, 2, 1)], "q_id long, d_id long, grade int")
    d = {(r.q_id, r.d_id): (r.grade, r.n_lines) for r in R.dedupe_qrels(qrels).collect()}
    assert d == {(1, 1): (2, 2), (1, 2): (1, 1)}
