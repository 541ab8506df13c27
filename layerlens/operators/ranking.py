"""Ranking evaluation: judged runs, per-query ranks, retrieval metrics
(P@k, MRR, MAP, NDCG), the judgement-aware TREC variants (MAP over all
relevant qrels, NDCG@k against the ideal qrels list), the metric bundle
report and TREC run rows.

Plan shape: ``run ⟕ qrels`` (shuffle on (q, doc): a hot query is spread by
its documents) → one ordered scan per query (hot queries split) giving ``rank`` and the
running relevant count → every metric as a conditional aggregate grouped by
query (partial aggregation map-side) → one averaging aggregate. The ideal
DCG comes from grade counts per (query, grade), never from sorting qrels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlens.operators.scan import segmented_scan

EMPTY_ACTIONS = ("neg", "pos", "skip", "error")
NO_RELEVANT = ("skip", "zero", "nan")


def _disc(rank: Column) -> Column:
    return F.log2(rank.cast("double") + 1.0)


def dedupe_qrels(qrels: DataFrame, q: str = "q_id", doc: Sequence[str] = ("d_id",), grade: str = "grade") -> DataFrame:
    """One grade per (query, document). The reference keeps the last line of
    the file; files have no order in Spark, so the highest grade wins and the
    number of lines folded is kept in ``n_lines``."""
    return qrels.groupBy(q, *doc).agg(F.max(grade).alias(grade), F.count(F.lit(1)).alias("n_lines"))


def judge_run(
    run: DataFrame,
    qrels: DataFrame,
    q: str = "q_id",
    doc: Sequence[str] = ("d_id",),
    grade: str = "grade",
    threshold: int = 1,
    split: str = "test",
    label: str | None = None,
) -> DataFrame:
    """Attach the graded label and binary relevance to each run row.

    ``split='test'``: grade from qrels, 0 when the pair is not judged (left
    join + coalesce). Other splits: grade from the run's own ``label`` column.
    ``rel = grade >= threshold`` (threshold 1 = "grade > 0")."""
    doc = list(doc)
    if split == "test":
        j = run.join(qrels.select(q, *doc, F.col(grade).alias("_g")), [q, *doc], "left")
        g = F.coalesce(F.col("_g"), F.lit(0)).cast("int")
        out = j.withColumn(grade, g).drop("_g")
    else:
        if label is None:
            raise ValueError("non-test splits take the grade from the run's label column")
        out = run.withColumn(grade, F.col(label).cast("int"))
    return out.withColumn("rel", (F.col(grade) >= threshold).cast("int"))


def binary_relevance(grade: Column, threshold: int = 1) -> Column:
    """``grade > 0 → 1`` (threshold-parameterised)."""
    return F.when(grade >= threshold, 1).otherwise(0)


def rank_run(judged: DataFrame, q: str = "q_id", doc: Sequence[str] = ("d_id",), score: str = "score",
             run: DataFrame | None = None) -> DataFrame:
    """Add ``rank`` (1 = highest score, ties by document key) and ``cum_rel``
    (relevant rows at or above the row) per query. ``run`` is the run before
    it was judged, when at hand: hot queries are looked for there."""
    keys = run.select(q, score) if run is not None else None
    out = segmented_scan(judged, [q], [f"-{score}", *doc], sums=["rel"], keys=keys)
    return out.withColumnRenamed("pos", "rank").withColumn("cum_rel", F.col("cum_rel").cast("long"))


def ideal_dcg(qrels: DataFrame, q: str = "q_id", grade: str = "grade", ks: Sequence[int] = (10, 20)) -> DataFrame:
    """Per query, DCG@k of all its qrels grades sorted descending.

    Grades are counted per (query, grade); the grade blocks take consecutive
    positions, and each block adds ``grade * Σ 1/log2(r+1)`` over its
    positions up to k (at most k terms), so no query's list is sorted."""
    counts = qrels.groupBy(q, grade).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(q).orderBy(F.col(grade).desc()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_c").over(w), F.lit(0)) + 1
    blocks = counts.select(q, grade, "_c", start.alias("_start"))
    aggs = []
    for k in ks:
        last = F.least(F.col("_start") + F.col("_c") - 1, F.lit(k))
        terms = F.aggregate(
            F.sequence(F.col("_start"), last),
            F.lit(0.0),
            lambda acc, r: acc + 1.0 / F.log2(r.cast("double") + 1.0),
        )
        aggs.append(F.sum(F.when(F.col("_start") <= k, F.col(grade) * terms).otherwise(0.0)).alias(f"idcg_{k}"))
    aggs.append(F.sum(F.when(F.col(grade) > 0, F.col("_c")).otherwise(0)).alias("n_rel_qrels"))
    return blocks.groupBy(q).agg(*aggs)


def _empty(metric: Column, has_rel: Column, action: str) -> Column:
    if action == "neg":
        return F.when(has_rel, metric).otherwise(F.lit(0.0))
    if action == "pos":
        return F.when(has_rel, metric).otherwise(F.lit(1.0))
    if action == "skip":
        return F.when(has_rel, metric)
    if action == "error":
        return F.when(has_rel, metric).otherwise(
            F.raise_error(F.lit("empty_target_action is error, and some query has nothing relevant")).cast("double")
        )
    raise ValueError(f"empty_target_action must be one of {EMPTY_ACTIONS}")


def per_query_metrics(
    ranked: DataFrame,
    q: str = "q_id",
    ks: Sequence[int] = (10, 20),
    ndcg_k: int | None = None,
    empty_target_action: str = "neg",
    grade: str = "grade",
) -> DataFrame:
    """Base retrieval metrics per query over the retrieved list (R3–R6),
    with the empty-target policy (R2), plus the raw sums the TREC metrics
    need (``ap_sum``, ``dcg_k``)."""
    rel = F.col("rel") == 1
    rank = F.col("rank")
    aggs = [F.count(F.lit(1)).alias("n_ret"), F.sum("rel").cast("long").alias("n_rel_ret")]
    for k in ks:
        aggs.append((F.sum(F.when(rank <= k, F.col("rel")).otherwise(0)) / F.lit(float(k))).alias(f"_p{k}"))
        aggs.append(F.sum(F.when(rank <= k, F.col(grade) / _disc(rank)).otherwise(0.0)).alias(f"dcg_{k}"))
    aggs.append(F.min(F.when(rel, rank)).alias("_first_rel"))
    aggs.append(F.avg(F.when(rel, F.col("cum_rel") / rank)).alias("_ap"))
    aggs.append(F.sum(F.when(rel, F.col("cum_rel") / rank).otherwise(0.0)).alias("ap_sum"))
    cut_run = rank <= ndcg_k if ndcg_k else F.lit(True)
    cut_ideal = F.col("cum_rel") <= ndcg_k if ndcg_k else F.lit(True)
    aggs.append(F.sum(F.when(cut_run, F.col("rel") / _disc(rank)).otherwise(0.0)).alias("_dcg"))
    aggs.append(F.sum(F.when(rel & cut_ideal, 1.0 / _disc(F.col("cum_rel"))).otherwise(0.0)).alias("_idcg"))
    g = ranked.groupBy(q).agg(*aggs)
    has_rel = F.col("n_rel_ret") > 0
    cols = [q, "n_ret", "n_rel_ret"]
    for k in ks:
        cols.append(_empty(F.col(f"_p{k}"), has_rel, empty_target_action).alias(f"p_at_{k}"))
    cols.append(_empty(F.coalesce(1.0 / F.col("_first_rel"), F.lit(0.0)), has_rel, empty_target_action).alias("rr"))
    cols.append(_empty(F.col("_ap"), has_rel, empty_target_action).alias("ap"))
    cols.append(_empty(F.col("_dcg") / F.col("_idcg"), has_rel, empty_target_action).alias("ndcg"))
    cols += ["ap_sum"] + [f"dcg_{k}" for k in ks]
    return g.select(*cols)


def trec_metrics(
    per_query: DataFrame,
    ideal: DataFrame,
    q: str = "q_id",
    ks: Sequence[int] = (10, 20),
    no_relevant: str = "skip",
) -> DataFrame:
    """R7/R8 per query: TREC MAP divides by the relevant count in qrels (0
    when none); TREC NDCG@k divides by the ideal DCG of all qrels grades.
    Ideal DCG 0 gives 0/0 in the reference; ``no_relevant`` picks
    skip (null, left out of the mean), zero, or nan."""
    if no_relevant not in NO_RELEVANT:
        raise ValueError(f"no_relevant must be one of {NO_RELEVANT}")
    j = per_query.join(ideal, q, "left")
    nrel = F.coalesce(F.col("n_rel_qrels"), F.lit(0))
    # keep the per-query columns: one pass produces base and TREC metrics
    cols = [F.col(c) for c in per_query.columns]
    cols.append(F.when(nrel == 0, F.lit(0.0)).otherwise(F.col("ap_sum") / nrel).alias("trec_ap"))
    for k in ks:
        idcg = F.coalesce(F.col(f"idcg_{k}"), F.lit(0.0))
        val = F.col(f"dcg_{k}") / idcg
        if no_relevant == "skip":
            v = F.when(idcg != 0, val)
        elif no_relevant == "zero":
            v = F.when(idcg != 0, val).otherwise(F.lit(0.0))
        else:
            v = F.when(idcg != 0, val).otherwise(F.lit(float("nan")))
        cols.append(v.alias(f"trec_ndcg_{k}"))
    return j.select(*cols)


def evaluate_run(
    run: DataFrame,
    qrels: DataFrame,
    q: str = "q_id",
    doc: Sequence[str] = ("d_id",),
    score: str = "score",
    grade: str = "grade",
    ks: Sequence[int] = (10, 20),
    empty_target_action: str = "neg",
    no_relevant: str = "skip",
    threshold: int = 1,
    dedupe: bool = True,
) -> DataFrame:
    """Per-query base and TREC metrics for a run against qrels."""
    doc = list(doc)
    if dedupe:
        qrels = dedupe_qrels(qrels, q, doc, grade)
    judged = judge_run(run, qrels, q, doc, grade, threshold)
    ranked = rank_run(judged, q, doc, score, run)
    pq = per_query_metrics(ranked, q, ks, None, empty_target_action, grade)
    return trec_metrics(pq, ideal_dcg(qrels, q, grade, ks), q, ks, no_relevant)


def ranking_report(per_query: DataFrame, ks: Sequence[int] = (10, 20)) -> DataFrame:
    """One row per metric ``(metric, value, n_queries)`` — the mean over
    the queries present in the run (nulls = skipped queries)."""
    names = [(f"p_at_{k}", f"precision@{k}") for k in ks]
    names += [("rr", "mrr"), ("ap", "map"), ("ndcg", "ndcg"), ("trec_ap", "trec_map")]
    names += [(f"trec_ndcg_{k}", f"trec_ndcg@{k}") for k in ks]
    wide = per_query.agg(*[F.avg(c).alias(c) for c, _ in names], F.count(F.lit(1)).alias("n_queries"))
    stack = "stack({n}, {body}) as (metric, value)".format(
        n=len(names), body=", ".join(f"'{m}', `{c}`" for c, m in names)
    )
    return wide.selectExpr(stack, "n_queries")


# The metrics reported for each split.
SPLIT_BUNDLES = {
    "train": ("accuracy", "macro_f1"),
    "validation": ("accuracy", "macro_f1", "precision@10", "precision@20", "mrr", "map"),
    "test": ("accuracy", "macro_f1", "precision@10", "precision@20", "mrr", "trec_map", "trec_ndcg@10", "trec_ndcg@20"),
}


def split_bundles(scored: DataFrame, qrels: DataFrame, num_classes: int, q: str = "q_id", doc: Sequence[str] = ("d_id",)) -> DataFrame:
    """A9 by split: ``(split, metric, value)``. ``scored`` has ``split``, the
    query and document keys, ``label``, ``pred``, ``score`` and, for splits
    without judgements, ``own_grade``."""
    from layerlens.operators import classification as C

    doc = list(doc)
    keyed = scored.withColumn("_q", F.struct("split", q))
    plain = C.accuracy(scored, ["split"]).join(C.macro_f1(scored, num_classes, ["split"]), "split")
    # the split leads every key: one join with the judgements, one ranking and
    # one aggregate for the queries of all splits
    ranked_splits = [s for s, wanted in SPLIT_BUNDLES.items() if len(wanted) > 2]
    run = keyed.where(F.col("split").isin(*ranked_splits)).select("split", "_q", *doc, "score", "own_grade")
    judgements = dedupe_qrels(qrels, q, doc).withColumn("_q", F.struct(F.lit("test").alias("split"), F.col(q))).drop(q, "n_lines")
    judged = judge_run(run, judgements, "_q", doc)
    grade = F.when(F.col("split") == "test", F.col("grade")).otherwise(F.col("own_grade")).cast("int")
    judged = judged.withColumn("grade", grade).withColumn("rel", binary_relevance(F.col("grade")))
    ranked = rank_run(judged, "_q", doc, "score", run)
    per_query = trec_metrics(per_query_metrics(ranked, "_q"), ideal_dcg(judgements, "_q"), "_q")
    means = {"precision@10": "p_at_10", "precision@20": "p_at_20", "mrr": "rr", "map": "ap", "trec_map": "trec_ap",
             "trec_ndcg@10": "trec_ndcg_10", "trec_ndcg@20": "trec_ndcg_20"}
    wide = per_query.groupBy(F.col("_q.split").alias("split")).agg(*[F.avg(c).alias(m) for m, c in means.items()])
    names = ["accuracy", "macro_f1", *means]
    stack = f"stack({len(names)}, {', '.join(f'{m!r}, `{m}`' for m in names)}) as (metric, value)"
    long = plain.join(wide, "split", "left").selectExpr("split", stack)
    wanted = F.lit(False)
    for split, own in SPLIT_BUNDLES.items():
        wanted = wanted | ((F.col("split") == split) & F.col("metric").isin(*own))
    return long.where(wanted)


def trec_run_rows(ranked: DataFrame, q: str, doc_id: Column, score: str, name: str) -> DataFrame:
    """K4/R10 rows ``q_id Q0 doc_id rank score name`` (rank from 1)."""
    return ranked.select(
        F.col(q).alias("q_id"),
        F.lit("Q0").alias("q0"),
        doc_id.alias("doc_id"),
        F.col("rank").cast("long").alias("rank"),
        F.col(score).alias("score"),
        F.lit(name).alias("name"),
    )
