"""Minimum description length by online coding.

For portions ``n_0 < … < n_{K-1} = N`` of a seeded permutation: fit a probe
on ``perm < n_k``, score the next chunk ``n_k <= perm < n_{k+1}``, sum the
cross-entropy per portion. ``MDL = T(perm < n_0)·log2 C + Σ_k CE_k`` — T
counts targets, the first term is in bits and the sum in nats, as in the
reference (``unit='bits'`` converts the sum; never the default).
``compression = T(all)·log2 C / MDL``.

The *closed-form* probe (class centroids, logits ``-‖x - c‖²``) makes the
whole procedure one Spark job whose every step is SQL-checkable: centroids
of all portions at once from vector sums per (chunk, label), which are added
up over the nested portions (no row is copied), a K×C centroid table
(bounded by the parameters K, C, D → broadcast), and scoring by array HOFs.
Trained probes are fitted together, all portions in one job a step
(``online_coding_fitted``); Spark ML estimators run one fit per portion.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlens.functions.columns import cross_entropy, sq_dist
from layerlens.operators import sampling as S
from layerlens.operators import training
from layerlens.operators.inference import infer, one_row
from layerlens.session import materialize


def _class_sums(rows: DataFrame, by: Sequence[str], vector: str, label: str) -> DataFrame:
    """``by…, _y, _s`` (vector sum), ``_n``: partial sums in every task."""
    return rows.groupBy(*by, F.col(label).cast("int").alias("_y")).agg(
        Summarizer.sum(array_to_vector(F.col(vector))).alias("_s"), F.count(F.lit(1)).alias("_n")
    )


def _centroids(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Centroid map of each group from its class sums (≤ C rows a group)."""
    grouped = sums.groupBy(*by).agg(
        F.collect_list(F.struct("_y", "_n", vector_to_array("_s").alias("_v"))).alias("_l")
    )
    first = F.element_at(F.col("_l"), 1)["_v"]
    total = F.aggregate("_l", F.lit(0).cast("long"), lambda acc, e: acc + e["_n"])
    whole = F.aggregate(
        "_l", F.transform(first, lambda _: F.lit(0.0)), lambda acc, e: F.zip_with(acc, e["_v"], lambda a, b: a + b)
    )
    overall = F.transform(whole, lambda v: v / total)
    per = F.map_from_entries(F.transform("_l", lambda e: F.struct(e["_y"], F.transform(e["_v"], lambda v: v / e["_n"]))))
    return grouped.select(*by, F.map_concat(per, F.create_map(F.lit(-1), overall)).alias("centroids"))


def fit_centroids(train: DataFrame, by: Sequence[str], vector: str = "vector", label: str = "label") -> DataFrame:
    """Per group in ``by``: ``centroids map<int, array<double>>`` = mean
    vector of each class, plus key -1 = mean of all rows of the group (the
    fallback for a class absent from the fit rows)."""
    by = list(by)
    return _centroids(_class_sums(train, by, vector, label), by)


def fit_portion_centroids(
    permuted: DataFrame, portions: DataFrame, by: Sequence[str], vector: str = "vector", label: str = "label"
) -> DataFrame:
    """``fit_centroids`` of every portion with a next chunk. Portions are
    nested: each row is summed once, in the first portion that holds it, and
    the few sums (chunks × classes) are then added up over the portions."""
    by = list(by)
    sizes = sorted((r["portion_idx"], r["n"]) for r in portions.filter(F.col("n_next").isNotNull()).collect())
    first = F.lit(None).cast("int")
    for idx, n in reversed(sizes):
        first = F.when(F.col(S.PERM) < n, idx).otherwise(first)
    own = permuted.withColumn("_first", first).filter(F.col("_first").isNotNull())
    sums = _class_sums(own, [*by, "_first"], vector, label)
    later = F.filter(F.array(*[F.lit(i) for i, _ in sizes]), lambda i: i >= F.col("_first"))
    spread = sums.withColumn("portion_idx", F.explode(later))
    added = spread.groupBy(*by, "portion_idx", "_y").agg(Summarizer.sum(F.col("_s")).alias("_s"), F.sum("_n").alias("_n"))
    return _centroids(added, [*by, "portion_idx"])


def centroid_logits(rows: DataFrame, num_classes: int, vector: str = "vector", centroids: str = "centroids") -> DataFrame:
    """Logits ``-‖x - c_y‖²`` for y = 0..C-1. A class absent from the fit
    rows is scored against the overall mean of those rows (an uninformative
    but finite logit); ``missing_class`` flags rows scored with such a gap."""
    x = F.col(vector)
    cents = F.col(centroids)
    logits = F.transform(
        F.sequence(F.lit(0), F.lit(num_classes - 1)),
        lambda y: -sq_dist(x, F.coalesce(F.element_at(cents, y), F.element_at(cents, F.lit(-1)))),
    )
    missing = (F.size(F.map_keys(cents)) - 1) < num_classes
    return rows.withColumn("logits", logits).withColumn("missing_class", missing.cast("int"))


def scored_chunks(
    permuted: DataFrame,
    portions: DataFrame,
    num_classes: int,
    vector: str = "vector",
    label: str = "label",
    by: Sequence[str] = (),
) -> DataFrame:
    """Every chunk row scored by the centroid probe of the portion before
    it: adds ``portion_idx``, ``logits``, ``missing_class`` and ``ce``.
    ``by`` adds sweep keys (e.g. layer): one probe per key and portion."""
    keys = [*by, "portion_idx"]
    cents = fit_portion_centroids(permuted, portions, by, vector, label)
    chunks = S.next_chunks(permuted, portions)
    # (sweep points × K-1) rows of C centroids of D values: bounded by the
    # parameters, not by the data
    scored = centroid_logits(chunks.join(F.broadcast(cents), keys, "left"), num_classes, vector)
    # an empty portion has no probe: its chunk is coded uniformly
    ce = F.coalesce(cross_entropy(F.col("logits"), F.col(label)), F.lit(math.log(num_classes)))
    return scored.withColumn("ce", ce).withColumn("missing_class", F.coalesce("missing_class", F.lit(1)))


def score_centroids(rows: DataFrame, fitted: DataFrame, num_classes: int, vector: str = "vector") -> DataFrame:
    """``centroid_logits`` with one set of centroids (one row) for all rows,
    by batch inference."""
    cents = one_row(fitted.select("centroids"))["centroids"]
    dim = len(cents[-1])
    table = np.asarray([cents.get(y) or cents[-1] for y in range(num_classes)], dtype=np.float64)
    missing = int(any(y not in cents for y in range(num_classes)))

    def predict(x):
        x = np.asarray(x, dtype=np.float64)
        return -np.stack([((x - c) ** 2).sum(axis=1) for c in table], axis=1)

    return infer(rows, predict, vector, dim, "logits").withColumn("missing_class", F.lit(missing))


def online_code_lengths(
    permuted: DataFrame,
    portions: DataFrame,
    num_classes: int,
    vector: str = "vector",
    label: str = "label",
    by: Sequence[str] = (),
) -> DataFrame:
    """A5: ``(by…, portion_idx, ce_sum, n_scored, n_targets, n_missing_class)``
    with the closed-form centroid probe, all portions in one job. Every row
    is one target."""
    scored = scored_chunks(permuted, portions, num_classes, vector, label, by)
    return scored.groupBy(*by, "portion_idx").agg(
        F.sum("ce").alias("ce_sum"),
        F.count(F.lit(1)).alias("n_scored"),
        F.count(F.lit(1)).alias("n_targets"),
        F.sum("missing_class").cast("long").alias("n_missing_class"),
    )


def mdl_and_compression(
    spark: SparkSession,
    code_lengths: DataFrame,
    first_portion_targets: int,
    total_targets: int,
    num_classes: int,
    unit: str = "mixed",
) -> DataFrame:
    """One row ``(mdl, compression, uniform_codelength, …)``.

    ``unit='mixed'`` reproduces the reference (bits + nats); ``'bits'``
    converts the cross-entropy sum to bits. An empty first chunk counts as
    zero targets (the reference fails there)."""
    log2c = math.log2(num_classes)
    ce = F.coalesce(F.sum("ce_sum"), F.lit(0.0))
    if unit == "bits":
        ce = ce / math.log(2.0)
    elif unit != "mixed":
        raise ValueError("unit must be 'mixed' or 'bits'")
    mdl = F.lit(first_portion_targets * log2c) + ce
    uniform = F.lit(total_targets * log2c)
    return code_lengths.agg(
        mdl.alias("mdl"),
        (uniform / mdl).alias("compression"),
        uniform.alias("uniform_codelength"),
        F.coalesce(F.sum("n_scored"), F.lit(0)).cast("long").alias("n_scored"),
        F.coalesce(F.sum("n_missing_class"), F.lit(0)).cast("long").alias("n_missing_class"),
    )


def permute_instances(targets: DataFrame, id_col: str = "id", seed: int = S.SPLIT_SEED, shuffle: bool = True) -> DataFrame:
    """Target rows with the position of their instance: portions are cut
    over instances, an instance's targets stay together."""
    ids = targets.select(id_col).distinct()
    return targets.join(S.permute(ids, id_col, seed, shuffle), id_col)


def _sizes(permuted: DataFrame, fractions: Sequence[float]) -> tuple[int, list[int], int, int]:
    """Instances, portion sizes, targets in the first portion, all targets."""
    last = permuted.agg(F.max(S.PERM)).first()[0]
    n = 0 if last is None else int(last) + 1
    sizes = S.portion_sizes(n, fractions)
    first, total = permuted.agg(F.sum((F.col(S.PERM) < sizes[0]).cast("long")), F.count(F.lit(1))).first()
    return n, sizes, int(first or 0), int(total)


def online_coding(
    train: DataFrame,
    num_classes: int,
    fractions: Sequence[float] = S.DEFAULT_PORTIONS,
    id_col: str = "id",
    vector: str = "vector",
    label: str = "label",
    unit: str = "mixed",
    seed: int = S.SPLIT_SEED,
    shuffle_first: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """A8 with the closed-form probe: per-portion code lengths and the MDL
    / compression row. ``train`` has one row per target; ``id_col`` names
    the instance, of which portions are made (``seed`` and ``shuffle_first``
    fix their order). Driver work is counts and a ≤ K-row table."""
    spark = train.sparkSession
    # read by the counts, every portion and every chunk: written once
    permuted = materialize(permute_instances(train, id_col, seed, shuffle_first))
    n, sizes, first, total = _sizes(permuted, fractions)
    per = online_code_lengths(permuted, S.portions_table(spark, n, fractions), num_classes, vector, label)
    return per, mdl_and_compression(spark, per, first, total, num_classes, unit)


def padded_logits(raw: Column, num_classes: int) -> Column:
    """Raw scores of all classes. A class that the fit never saw (beyond the
    model's classes, or scored -inf) gets the mean of the others: finite and
    uninformative."""
    finite = F.filter(raw, lambda x: (x > float("-inf")) & ~F.isnan(x))
    mean = F.aggregate(finite, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(finite), F.lit(1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(num_classes - 1)),
        lambda i: F.coalesce(F.when(F.get(raw, i) > float("-inf"), F.get(raw, i)), mean),
    )


def online_coding_with_estimator(
    train: DataFrame,
    estimator,
    num_classes: int,
    fractions: Sequence[float] = S.DEFAULT_PORTIONS,
    id_col: str = "id",
    features: str = "features",
    label: str = "label",
    seed: int = S.SPLIT_SEED,
    shuffle_first: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """A8 with a trained Spark ML probe: for each portion, fit from scratch
    on the prefix and score the next chunk (≤ K-1 fits driven from the
    driver; each fit and transform is a distributed job). The code length
    comes from the raw scores by log-sum-exp. An empty portion has no probe:
    its chunk is coded uniformly; a portion with one class as well."""
    spark = train.sparkSession
    permuted = materialize(permute_instances(train, id_col, seed, shuffle_first))
    _, sizes, first, total = _sizes(permuted, fractions)
    rows = []
    for k in range(len(sizes) - 1):
        fit_rows = permuted.filter(F.col(S.PERM) < sizes[k]).persist()
        chunk = permuted.filter((F.col(S.PERM) >= sizes[k]) & (F.col(S.PERM) < sizes[k + 1]))
        seen = fit_rows.select(F.col(label).cast("int").alias("y")).distinct().limit(num_classes).collect()
        if len(seen) < 2:
            n = chunk.count()
            rows.append((k, n * math.log(num_classes), n, n, n))
        else:
            scored = estimator.fit(fit_rows).transform(chunk)
            ce = cross_entropy(padded_logits(vector_to_array(F.col("rawPrediction")), num_classes), F.col(label))
            ce_sum, n = scored.agg(F.sum(ce), F.count(F.lit(1))).first()
            n = int(n)
            rows.append((k, float(ce_sum or 0.0), n, n, n if len(seen) < num_classes else 0))
        fit_rows.unpersist()
    per = spark.createDataFrame(
        rows, "portion_idx int, ce_sum double, n_scored long, n_targets long, n_missing_class long"
    )
    return per, mdl_and_compression(spark, per, first, total, num_classes)


def sweep(
    features: DataFrame,
    by: Sequence[str],
    num_classes: int,
    fractions: Sequence[float] = S.DEFAULT_PORTIONS,
    id_col: str = "id",
    vector: str = "vector",
    label: str = "label",
) -> DataFrame:
    """M9: online coding at every point of a grid (model × layer × …) in one
    job, from stored features: ``features`` has one row per point of ``by``
    and target. Every point uses the same order of instances:
    ``(by…, mdl, compression, n_scored)``."""
    by = list(by)
    spark = features.sparkSession
    order = S.permute(features.select(id_col).distinct(), id_col)
    permuted = features.join(order, id_col)
    n = features.select(id_col).distinct().count()
    portions = S.portions_table(spark, n, fractions)
    n0 = S.portion_sizes(n, fractions)[0]
    per = online_code_lengths(permuted, portions, num_classes, vector, label, by=by)
    counts = permuted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_t"), F.sum((F.col(S.PERM) < n0).cast("long")).alias("_t0")
    )
    log2c = math.log2(num_classes)
    total = per.groupBy(*by).agg(F.sum("ce_sum").alias("_ce"), F.sum("n_scored").alias("n_scored")).join(counts, by)
    mdl = F.col("_t0") * log2c + F.col("_ce")
    return total.select(*by, mdl.alias("mdl"), (F.col("_t") * log2c / mdl).alias("compression"), "n_scored")


def online_coding_fitted(
    train: DataFrame,
    shape: training.Shape,
    plan: training.Plan,
    path: str,
    fractions: Sequence[float] = S.DEFAULT_PORTIONS,
    settings: Sequence[training.Model] = (training.Model(),),
    by: Sequence[str] = (),
    id_col: str = "id",
    vectors: Sequence[str] = ("vector",),
    label: str = "label",
    validation: DataFrame | None = None,
    first: np.ndarray | None = None,
    seed: int = S.SPLIT_SEED,
) -> DataFrame:
    """A8/M9 with trained probes: the probes of all portions, of all points of
    ``by`` (layers, models: a column of ``train``) and of all ``settings``
    (penalty, rate) are fitted together, one job a step, and all chunks are
    scored in one more: ``(by…, setting, portion_idx, n_fit, ce_sum, n_scored,
    mdl, compression)``, MDL and compression repeated on the portions of a
    point. An empty portion has no probe: its chunk is coded uniformly.
    ``first``: first parameters of all models (points, settings, portions, in
    this order), by default from each setting's seed."""
    spark, by = train.sparkSession, list(by)
    rows = train.join(materialize(S.permute(train.select(id_col).distinct(), id_col, seed)), id_col)
    points = sorted(tuple(r) for r in train.select(*by).distinct().limit(10_000).collect()) if by else [()]
    grp = F.lit(0)
    if by:
        number = F.lit(None).cast("int")
        for i, p in enumerate(points):
            number = F.when(_all_equal(by, p), i).otherwise(number)
        grp = number
    rows = materialize(rows.withColumn("_grp", grp))
    last = rows.agg(F.max(S.PERM)).first()[0]
    n = 0 if last is None else int(last) + 1
    sizes = S.portion_sizes(n, fractions)
    models, of = [], []
    for i, _ in enumerate(points):
        for j, setting in enumerate(settings):
            for k in range(len(sizes) - 1):
                models.append(replace(setting, limit=sizes[k], grp=i))
                of.append((i, j, k))
    examples = training.example_rows(rows, vectors, id_col, label, S.PERM, "_grp")
    held_out = None if validation is None else training.example_rows(validation, vectors, id_col, label)
    fitted = training.fit(examples, shape, models, plan, path, held_out, first)
    lo = np.array([sizes[k] for _, _, k in of])
    hi = np.array([sizes[k + 1] for _, _, k in of])
    group = np.array([i for i, _, _ in of])

    def chunk(perm, grp):
        return (perm[None, :] >= lo[:, None]) & (perm[None, :] < hi[:, None]) & (grp[None, :] == group[:, None])

    loss, _, count = training.losses(examples, shape, models, fitted.theta, chunk)
    uniform = math.log(shape.num_classes)
    loss = np.where(lo > 0, loss, count * uniform)
    targets = rows.groupBy("_grp").agg(F.count("*").alias("t"), F.sum((F.col(S.PERM) < sizes[0]).cast("long")).alias("t0")).collect()
    targets = {r["_grp"]: (r["t"], r["t0"]) for r in targets}
    log2c = math.log2(shape.num_classes)
    out = []
    for i, p in enumerate(points):
        for j, _ in enumerate(settings):
            mine = [m for m, x in enumerate(of) if x[:2] == (i, j)]
            t, t0 = targets.get(i, (0, 0))
            mdl = t0 * log2c + float(loss[mine].sum())
            ratio = t * log2c / mdl if mdl else None
            for m in mine:
                out.append((*p, j, of[m][2], int(lo[m]), float(loss[m]), int(count[m]), mdl, ratio))
    kinds = "".join(f"`{c}` {t}, " for c, t in train.select(*by).dtypes) if by else ""
    return spark.createDataFrame(
        out, f"{kinds}setting int, portion_idx int, n_fit long, ce_sum double, n_scored long, mdl double, compression double"
    )


def _all_equal(names: Sequence[str], values: Sequence) -> Column:
    out = F.lit(True)
    for c, v in zip(names, values):
        out = out & F.col(c).eqNullSafe(F.lit(v))
    return out
