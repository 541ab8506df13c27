"""Deterministic permutations, exact-size splits, samples and the nested
training portions used by online coding (D1–D10, J8).

A permutation is the order of ``md5('<seed>:<id>')`` (ties by id); its exact
0-based rank ``perm`` comes from an exact histogram over hash prefixes, never
from a one-partition window. Everything else is a predicate on ``perm``
against a portions table of at most a few dozen rows (broadcast: bounded by
the fraction list, not by the data).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerlens.functions.columns import SPLIT_SEED, hash_key
from layerlens.operators.scan import global_rank

# The reference's portion fractions for online coding.
DEFAULT_PORTIONS = (0.001, 0.002, 0.004, 0.008, 0.016, 0.032, 0.0625, 0.125, 0.25, 0.5, 1.0)

PERM = "perm"


# Hex digits of the hash that name a bucket: 65,536 buckets of equal size.
# One bucket is sorted by one task, so very large tables ask for more.
PREFIX_CHARS = 4


def permute(df: DataFrame, id_col: str = "id", seed: int = SPLIT_SEED, shuffle: bool = True,
            prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Add ``perm`` = exact 0-based position in the seeded order
    ``(md5('<seed>:<id>'), id)`` (or in id order when ``shuffle`` is False).

    md5 is uniform, so its first ``prefix_chars`` hex digits cut the order
    into 16^k equal-sized buckets: an exact count per bucket (≤ 16^k rows,
    broadcast), their running offsets, and a ``row_number`` inside each
    bucket give the global position with no one-partition window, no Python
    and no checkpoint (every step is a deterministic function of the row).
    Ids are unique per instance, so no bucket is hot."""
    if not shuffle:
        return global_rank(df, [id_col], name=PERM).withColumn(PERM, F.col(PERM) - 1)
    d = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_b", F.substring("_h", 1, prefix_chars))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # one ordered pass over at most 16^k bucket counts
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_b").orderBy("_h", id_col)
    return (
        d.join(F.broadcast(offsets), "_b")
        .withColumn(PERM, (F.row_number().over(inside) - 1 + F.col("_off")).cast("long"))
        .drop("_h", "_b", "_off")
    )


def check_split_sizes(n: int, num_train: int, num_test: int) -> None:
    """A split needs as many rows as it hands out."""
    if n < num_train + num_test:
        raise ValueError(f"{n} rows cannot give {num_train} train and {num_test} held-out rows")


def split_fits(counts: DataFrame, num_train: str, num_test: str, n: str = "n") -> DataFrame:
    """D2 for many tables at once: ``fits`` beside each row of sizes."""
    return counts.withColumn("fits", F.col(n) >= F.col(num_train) + F.col(num_test))


def cut_keys(df: DataFrame, positions: Sequence[int], id_col: str = "id", seed: int = SPLIT_SEED,
             prefix_chars: int = PREFIX_CHARS) -> dict[int, tuple | None]:
    """The ``(hash, id)`` at each 0-based position of the seeded order (None
    past the end). Counts per hash bucket say in which bucket a position
    lies, and only the rows of those few buckets are ranked: no row of any
    other bucket is shuffled."""
    d = df.select(hash_key(id_col, seed).alias("_h"), F.col(id_col).alias("_id"))
    d = d.withColumn("_b", F.substring("_h", 1, prefix_chars))
    counts = sorted(tuple(r) for r in d.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect())  # ≤ 16^k rows
    wanted: dict[str, list[tuple[int, int]]] = {}
    for position in set(positions):
        before = 0
        for bucket, n in counts:
            if before <= position < before + n:
                wanted.setdefault(bucket, []).append((position, position - before + 1))
            before += n
    out: dict[int, tuple | None] = {p: None for p in positions}
    if wanted:
        inside = Window.partitionBy("_b").orderBy("_h", "_id")
        ranked = d.filter(F.col("_b").isin(list(wanted))).withColumn("_r", F.row_number().over(inside))
        hit = F.lit(False)
        for bucket, places in wanted.items():
            hit = hit | ((F.col("_b") == bucket) & F.col("_r").isin([r for _, r in places]))
        found = {(r["_b"], r["_r"]): (r["_h"], r["_id"]) for r in ranked.filter(hit).collect()}
        for bucket, places in wanted.items():
            out.update({position: found[bucket, r] for position, r in places})
    return out


def is_before(key: tuple | None, id_col: str = "id", seed: int = SPLIT_SEED) -> Column:
    """Whether a row comes before a key of the seeded order: a test of the row alone."""
    if key is None:
        return F.lit(True)
    h = hash_key(id_col, seed)
    return (h < F.lit(key[0])) | ((h == F.lit(key[0])) & (F.col(id_col) < F.lit(key[1])))


def exact_split(
    df: DataFrame, num_train: int, num_test: int, id_col: str = "id", seed: int = SPLIT_SEED, n: int | None = None,
    val_fraction: float = 1.0,
) -> DataFrame:
    """D1+D2: rows with a ``split`` column; unused rows are dropped. In the
    seeded order the first ``num_test`` rows are held out, their first half is
    **test**, the second half **validation** (D9: only its first
    ``val_fraction``); the next ``num_train`` rows are **train**."""
    n = df.count() if n is None else n
    check_split_sizes(n, num_train, num_test)
    half = num_test // 2
    kept = half + int((num_test - half) * val_fraction)
    keys = cut_keys(df, [half, kept, num_test, num_test + num_train], id_col, seed)
    before = {p: is_before(k, id_col, seed) for p, k in keys.items()}
    split = F.when(before[half], "test").when(before[kept], "validation").when(before[num_test], F.lit(None))
    split = split.when(before[num_test + num_train], "train")
    return df.withColumn("split", split).filter(F.col("split").isNotNull())


def sample_n(df: DataFrame, n: int, id_col: str = "id", seed: int = SPLIT_SEED) -> DataFrame:
    """D3: exactly ``n`` rows without replacement, fixed by the seed."""
    return df.filter(is_before(cut_keys(df, [n], id_col, seed)[n], id_col, seed))


def portion_sizes(n_total: int, fractions: Sequence[float] = DEFAULT_PORTIONS) -> list[int]:
    """D5 ``int(N * p)`` for each fraction (Python float semantics)."""
    return [int(n_total * p) for p in fractions]


def portions_table(spark: SparkSession, n_total: int, fractions: Sequence[float] = DEFAULT_PORTIONS) -> DataFrame:
    """``(portion_idx, fraction, n, n_next)``; ``n_next`` is null for the last."""
    sizes = portion_sizes(n_total, fractions)
    rows = [
        (i, float(p), sizes[i], sizes[i + 1] if i + 1 < len(sizes) else None)
        for i, p in enumerate(fractions)
    ]
    return spark.createDataFrame(rows, "portion_idx int, fraction double, n long, n_next long")


MAX_PORTIONS = 10_000


def _portion_array(portions: DataFrame) -> Column:
    """The portions table (parameters: one row per fraction, size checked)
    as a literal ``array<struct<portion_idx, fraction, n, n_next>>``."""
    rows = portions.select("portion_idx", "fraction", "n", "n_next").limit(MAX_PORTIONS + 1).collect()
    if len(rows) > MAX_PORTIONS:
        raise ValueError(f"more than {MAX_PORTIONS} portions")
    return F.array(*[
        F.struct(
            F.lit(r.portion_idx).cast("int").alias("portion_idx"),
            F.lit(r.fraction).cast("double").alias("fraction"),
            F.lit(r.n).cast("long").alias("n"),
            F.lit(r.n_next).cast("long").alias("n_next"),
        )
        for r in sorted(rows, key=lambda r: r.portion_idx)
    ])


def portion_members(permuted: DataFrame, portions: DataFrame) -> DataFrame:
    """Each row once per portion that contains it (``perm < n``).
    The matching portions of a row are picked from the literal portions
    array and exploded: a generator in the scan's stage, no join."""
    hit = F.filter(_portion_array(portions), lambda p: F.col(PERM) < p["n"])
    return permuted.select("*", F.explode(hit).alias("_pt")).select(
        *[F.col(f"`{c}`") for c in permuted.columns], "_pt.portion_idx", "_pt.fraction", "_pt.n"
    )


def next_chunks(permuted: DataFrame, portions: DataFrame) -> DataFrame:
    """The rows scored after fitting on portion k: ``n_k <= perm < n_{k+1}``
    (at most one portion per row)."""
    hit = F.filter(
        _portion_array(portions),
        lambda p: p["n_next"].isNotNull() & (F.col(PERM) >= p["n"]) & (F.col(PERM) < p["n_next"]),
    )
    return permuted.select("*", F.explode(hit).alias("_pt")).select(
        *[F.col(f"`{c}`") for c in permuted.columns], "_pt.portion_idx", "_pt.fraction", "_pt.n", "_pt.n_next"
    )


def target_counts(members: DataFrame, n_targets: str = "n_targets") -> DataFrame:
    """Instances and targets per portion."""
    return members.groupBy("portion_idx", "fraction").agg(
        F.count(F.lit(1)).alias("n_instances"), F.sum(n_targets).cast("long").alias("n_targets")
    )


def limit_fraction(permuted: DataFrame, fraction: float, n_total: int) -> DataFrame:
    """Keep the first ``floor(N * f)`` rows of the permutation."""
    return permuted.filter(F.col(PERM) < int(n_total * fraction))


def portion_report(counts: DataFrame, postfix: str = "portion") -> DataFrame:
    """Per portion the logged fraction and size, keyed ``…/portion_NN``."""
    key = F.format_string(f"/{postfix}_%02d", F.col("portion_idx"))
    return counts.select(
        F.explode(F.array(
            F.struct(F.concat(F.lit("portion_percentage"), key).alias("metric"), F.col("fraction").alias("value")),
            F.struct(F.concat(F.lit("portion_size"), key).alias("metric"), F.col("n_instances").cast("double").alias("value")),
        )).alias("m")
    ).select("m.metric", "m.value")
