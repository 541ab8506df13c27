"""Hard-negative mining with segment summaries.

For every anchor the best rows of its own label are its positives; for every
positive, the best rows of other labels whose score lies in a window below the
positive's are its hard negatives. A score is the inner product of vectors of
whole numbers, ``floor(scale * x)``.

With each vector the mean and the deviation (the length of what is left
without the mean) of its segments are stored, for segments of the whole
vector, of 8 and of 2 components. Of two segments of n components the inner
product is n times the product of their means, plus or minus at most the
product of their deviations. The sums over all segments bound a score from
both sides. Pairs whose bounds miss every window, or the best scores found so
far, go out at each level; what is left is scored exactly.

The anchors are a stated set of queries against all rows. Both are dealt to
tiles, every tile of anchors meets every tile of rows in one task of bounded
size, and the best rows of each (anchor, window) in a tile go on to a ranked
cut that Spark makes in every task before the shuffle.

Defined cases: rows with a null label, a null vector, or a component that is
null or not finite (also after scaling) take no part; shorter vectors end in
zeros; rows with an anchor's id are never its partners; equal anchor rows are
one anchor, other repeated rows are rows of their own; a null id is no anchor
and comes last among equal scores; scores beyond 2^52 are taken in whole
numbers and end at 2^56; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlens.llm.common import give_back
from layerlens.session import materialize

SEGMENTS = (None, 8, 2)  # components of a segment at each level, None: all
TILE_BYTES = 16 << 20  # vectors of a tile
STEP_ROWS = 1024
STEP_ANCHORS = 512
FEW = 0.05  # share of pairs from which single pairs are scored
EXACT = 2.0**52  # whole numbers up to here add up without error in doubles
LIMIT = 1 << 56
NO_ID = np.iinfo(np.int64).max


# -------------------------------------------------------------------- the rows


def whole_numbers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, as doubles; null if one is
    null or not finite."""
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    bad = F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > F.lit(1.7976931348623157e308)))
    # floor() would go through long: whole numbers above 2^53 stay as they are
    floor = lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)
    return F.when(~bad, F.transform(scaled, floor))


def padded(dim: int) -> int:
    return -(-max(dim, 1) // 8) * 8


def summaries(v: np.ndarray) -> np.ndarray:
    """Means and deviations of the segments of each level, per row: first all
    means of a level (times the root of the segment's length), then all
    deviations."""
    parts = []
    for length in SEGMENTS:
        x = v.reshape(len(v), -1, length or v.shape[1])
        mean = x.mean(axis=2)
        deviation = np.sqrt(((x - mean[:, :, None]) ** 2).sum(axis=2))
        parts += [mean * np.sqrt(x.shape[2]), deviation]
    return np.concatenate(parts, axis=1)


def levels(dim: int) -> list[tuple[int, int, int]]:
    """Columns ``first, middle, end`` of each level's means and deviations."""
    out, at = [], 0
    for length in SEGMENTS:
        n = dim // (length or dim)
        out.append((at, at + n, at + 2 * n))
        at += 2 * n
    return out


STORED = "vec_id long, label long, vector binary, summary binary"


def stored(rows: DataFrame, dim: int, wide: bool) -> DataFrame:
    """Packed vectors with their summaries. ``rows``: vec_id, label, q."""
    kind = np.float64 if wide else np.float32

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(lo, STEP_ROWS)
                q = part.column(2)
                size = q.value_lengths().to_numpy()
                flat = q.flatten().to_numpy(zero_copy_only=False)
                v = np.zeros((len(size), dim))
                v[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
                held, about = v.astype(kind), summaries(v).astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array([x.tobytes() for x in y], pa.binary()) for y in (held, about)]],
                    names=["vec_id", "label", "vector", "summary"],
                )

    return rows.mapInArrow(run, STORED)


# ------------------------------------------------------------------- one tile


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


class Best:
    """The best ``k`` rows so far of each (anchor, window): score from the
    highest down, then the smaller id."""

    def __init__(self, windows: int, k: int, low: np.ndarray):
        self.windows, self.k = windows, k
        self.at, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = low.reshape(-1).copy()  # scores below cannot be among them

    def add(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.at, self.id, self.score = (np.concatenate(x) for x in ((self.at, at), (self.id, ids), (self.score, score)))
        order = np.lexsort((self.id, -self.score, self.at))
        at = self.at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        stay = order[place < self.k]
        self.at, self.id, self.score = self.at[stay], self.id[stay], self.score[stay]
        last = place[place < self.k] == self.k - 1
        self.floor[self.at[last]] = np.maximum(self.floor[self.at[last]], self.score[last])

    def least(self) -> np.ndarray:
        """The smallest score that any window of an anchor can still use."""
        return self.floor.reshape(-1, self.windows).min(axis=1)


def _exact(a: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray, plain: bool) -> np.ndarray:
    if plain:
        if len(i) > FEW * len(a) * len(r):
            return (a @ r.T)[i, j].astype(np.int64)
        return np.einsum("ij,ij->i", a[i], r[j]).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(a[p], r[q])) for p, q in zip(i.tolist(), j.tolist())]
    return np.array([max(-LIMIT, min(LIMIT, x)) for x in whole], np.int64)


def mine_tile(anchors: dict, rows: dict, k: int, same_label: bool, dim: int) -> tuple[Best, list[int]]:
    """The best rows of a tile for its anchors. Both sides: ``id, label,
    vector, summary``; anchors also ``low, high``, inclusive score windows.
    Also returns how many pairs were left after each level."""
    low, high = anchors["low"], anchors["high"]
    best = Best(low.shape[1], k, low)
    left = [0] * (len(SEGMENTS) + 1)
    norm_a, norm_r = (np.sqrt((x["vector"] ** 2).sum(axis=1)) for x in (anchors, rows))
    plain = norm_a.max(initial=0) * norm_r.max(initial=0) < EXACT
    for lo in range(0, len(rows["id"]), STEP_ROWS):
        rs = slice(lo, lo + STEP_ROWS)
        for la in range(0, len(anchors["id"]), STEP_ANCHORS):
            sa = slice(la, la + STEP_ANCHORS)
            least, most = best.least()[sa, None], high[sa].max(axis=1)[:, None]
            alive = (anchors["label"][sa, None] == rows["label"][None, rs]) == same_label
            alive &= anchors["id"][sa, None] != rows["id"][None, rs]
            left[0] += int(alive.sum())
            slack = 0.5 + 1e-5 * norm_a[sa, None] * norm_r[None, rs]  # summaries may be rounded
            for n, (x, m, y) in enumerate(levels(dim)):
                if alive.any():
                    middle = anchors["summary"][sa, x:m] @ rows["summary"][rs, x:m].T
                    spread = anchors["summary"][sa, m:y] @ rows["summary"][rs, m:y].T + slack
                    alive &= (middle + spread >= least) & (middle - spread <= most)
                left[n + 1] += int(alive.sum())
            i, j = np.nonzero(alive)
            if not len(i):
                continue
            score = _exact(anchors["vector"][sa], rows["vector"][rs], i, j, plain)
            i, j = i + la, j + lo
            for w in range(low.shape[1]):
                at = i * low.shape[1] + w
                inside = (score >= best.floor[at]) & (score <= high[i, w])
                best.add(at[inside], rows["id"][j[inside]], score[inside])
    return best, left


# --------------------------------------------------------------------- the job


def _side(table: pa.Table, kind) -> dict:
    ids = table.column("vec_id").combine_chunks().cast(pa.int64()).fill_null(int(NO_ID))
    return {
        "id": ids.to_numpy(zero_copy_only=False),
        "label": table.column("label").to_numpy(),
        "vector": _matrix(table.column("vector"), kind),
        "summary": _matrix(table.column("summary"), kind),
    }


FOUND = "anchor long, window int, vec_id long, score long"


def _best_rows(anchors: DataFrame, rows: DataFrame, k: int, same_label: bool, dim: int, wide: bool, tiles: tuple[int, int]) -> DataFrame:
    """``anchor, window, vec_id, score, place``: the first ``k`` rows of each
    window (``lows, highs`` of the anchors)."""
    kind = np.float64 if wide else np.float32
    n_a, n_r = tiles
    key = F.pmod(F.xxhash64("anchor"), F.lit(n_a)).cast("int")
    a = anchors.withColumn("_a", key).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_r)).cast("int")
    r = rows.withColumn("_r", own).withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(n_a - 1))))

    names = a.columns
    a = a.toDF(*[f"x_{c}" for c in names])  # the sides share columns

    def run(key, left, right):
        left = left.rename_columns(names)
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(("anchor", "window", "vec_id", "score"), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))})
        x = _side(left, kind)
        x["low"], x["high"] = (np.array(left.column(c).to_pylist(), np.int64).reshape(left.num_rows, -1) for c in ("lows", "highs"))
        best, _ = mine_tile(x, _side(right, kind), k, same_label, dim)
        windows = x["low"].shape[1]
        anchor = left.column("anchor").to_numpy()
        ids = pa.array(best.id, mask=best.id == NO_ID)
        give_back()
        return pa.table(
            {
                "anchor": pa.array(anchor[best.at // windows], pa.int64()),
                "window": pa.array((best.at % windows).astype(np.int32), pa.int32()),
                "vec_id": ids,
                "score": pa.array(best.score, pa.int64()),
            }
        )

    found = a.groupBy("x__a", "x__r").cogroup(r.groupBy("_a", "_r")).applyInArrow(run, FOUND)
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("place", place).where(F.col("place") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Callable[[Column], Column],
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``. ``vectors``: vec_id, label, vector; ``is_anchor`` says
    of an id whether its row is an anchor. Negatives of a positive score
    between ``low_percent`` and ``high_percent`` of its score."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        whole_numbers(F.col("vector"), scale).alias("q"),
    ).where("label is not null and q is not null")
    size = rows.agg(
        F.count("*").alias("n"), F.max(F.size("q")).alias("dim"),
        F.max(F.aggregate("q", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))).alias("most"),
        F.count(F.when(is_anchor(F.col("vec_id")), 1)).alias("anchors"),
    ).first()
    dim, wide = padded(size["dim"] or 0), (size["most"] or 0) > 2**24
    rows = materialize(stored(rows, dim, wide))
    per_tile = max(1, TILE_BYTES // (dim * (8 if wide else 4)))
    n_a = size["anchors"] // per_tile + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_r = max(size["n"] // per_tile + 1, -(-parts // n_a))
    anchors = rows.where(is_anchor(F.col("vec_id"))).distinct().withColumn("anchor", F.monotonically_increasing_id())
    anchors = materialize(anchors)
    all_scores = [F.array(F.lit(x).cast("long")) for x in (-LIMIT, LIMIT)]
    wide_open = anchors.withColumn("lows", all_scores[0]).withColumn("highs", all_scores[1])
    near = materialize(_best_rows(wide_open, rows, positives, True, dim, wide, (n_a, n_r)))
    # 100 * negative between low and high percent of the positive's score
    window = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))  # at most `positives` entries
    low = lambda p: (-F.floor(-(p["score"] * low_percent).cast("decimal(38,0)") / 100)).cast("long")
    high = lambda p: F.floor((p["score"] * high_percent).cast("decimal(38,0)") / 100).cast("long")
    shut = lambda c, x: F.concat(c, F.array_repeat(F.lit(x).cast("long"), F.lit(positives) - F.size("p")))
    window = window.select(
        "anchor", shut(F.transform("p", low), LIMIT + 1).alias("lows"), shut(F.transform("p", high), -LIMIT - 1).alias("highs")
    )
    hard = _best_rows(anchors.join(window, "anchor"), rows, negatives, False, dim, wide, (n_a, n_r))
    hard = hard.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").withColumnRenamed("place", "rank")
    of = near.select("anchor", (F.col("place") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    out = hard.join(of, ["anchor", "window"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

