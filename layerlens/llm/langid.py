"""Language ID by string kernels. A text is the set (presence, not counts) of
its character n-grams of 1 to ``max_n`` letters, hashed into a fixed number of
bins; the blended-spectrum kernel of two texts is the size of the common set,
normalised by the geometric mean of both sizes. Landmark texts give the
Nyström map of that kernel, one-versus-rest kernel ridge regression is fitted
on it, and texts are scored by batched matrix products.

Fitting uses a bounded sample of labelled rows (``SAMPLE_ROWS``, spread over
the labels by hash of the text); of each only the fixed-size presence bitmap
reaches the driver. Scoring reads every whole text. More than
``MAX_LABELS`` labels are refused, none is left out.

Defined cases: a null text, or one without any letter, gets ``und`` and score
0; labels that are null are not learned; ties between languages go to the
smaller name; repeated rows are scored alike; other columns are carried, those
named like the results replaced. With
no labelled row (or an empty table) every text is ``und`` with score 0; with
one label only, that label is predicted with score 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlens.llm.common import give_back, text_slices

MAX_N = 3
BINS = 1 << 14
LANDMARKS = 256
MAX_LABELS = 10_000
SAMPLE_ROWS = 2400
RIDGE = 1e-2
SHARPNESS = 6.0
BATCH = 128
UNKNOWN = "und"

_CODE: list[np.ndarray] = []


def _letter_codes() -> np.ndarray:
    """Code of each code point: letters their lower-case code point, all else
    0. Built once per process from Python's character data."""
    if not _CODE:
        table = np.zeros(0x110000, np.int32)
        for c in range(0x30000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low[0])
        _CODE.append(table)
    return _CODE[0]


def presence(text: str, max_n: int = MAX_N, bins: int = BINS) -> np.ndarray | None:
    """The set of n-gram bins of a text, None without a letter. Runs of other
    characters count as one blank, also before the first and after the last
    letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letter_codes()[np.minimum(points, 0x10FFFF)]
    letters = codes > 0
    if not letters.any():
        return None
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    codes = np.concatenate(([0], codes[keep], [0])).astype(np.uint64)
    seen = np.zeros(bins, bool)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    gram = np.zeros(len(codes), np.uint64)
    for n in range(1, max_n + 1):
        if len(codes) < n:
            break
        gram = gram[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
        seen[((gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> shift] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    """Landmark bitmaps (normalised), and weights of one column per label."""

    labels: list[str]
    landmarks: np.ndarray  # bins x landmarks, float32
    weights: np.ndarray  # landmarks x labels
    bias: np.ndarray
    max_n: int
    bins: int

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        """Scores of a batch of presence sets, by two matrix products. The
        batch has always the same size, so that a text's score does not
        depend on how many come with it."""
        x = np.zeros((BATCH, self.bins), np.float32)
        for i, s in enumerate(sets):
            x[i, s] = 1.0 / np.sqrt(len(s))
        return ((x @ self.landmarks) @ self.weights + self.bias)[: len(sets)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.labels:
            return names, scores
        sets = [(i, s) for i, t in enumerate(texts) if t and (s := presence(t, self.max_n, self.bins)) is not None]
        if len(self.labels) == 1:
            for i, _ in sets:
                names[i], scores[i] = self.labels[0], 1.0
            return names, scores
        for lo in range(0, len(sets), BATCH):
            part = sets[lo : lo + BATCH]
            m = self.margins([s for _, s in part])
            e = np.exp(SHARPNESS * (m - m.max(axis=1, keepdims=True)))
            p = e / e.sum(axis=1, keepdims=True)
            p = np.round(p, 4)  # beyond that the order of additions shows
            best = p.argmax(axis=1)
            for j, (i, _) in enumerate(part):
                names[i], scores[i] = self.labels[best[j]], float(min(1.0, p[j, best[j]]))
        return names, scores


def fit(
    rows: DataFrame,
    label: str = "lang",
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    landmarks: int = LANDMARKS,
    max_n: int = MAX_N,
    bins: int = BINS,
) -> Model:
    """Fit on at most ``sample_rows`` labelled rows of ``rows``, an equal
    number per label where there are enough, chosen by hash of the text."""
    known = rows.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("at")
    )
    # the smallest hashes of each label, found without texts: the cut is
    # agreed first, then only the chosen texts are read
    counts = known.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels: one classifier a label is held by every task")
    names = sorted(r["label"] for r in counts)
    if not names:
        return Model([], np.zeros((bins, 0), np.float32), np.zeros((0, 0)), np.zeros(0), max_n, bins)
    each = max(1, sample_rows // len(names))
    if len(names) == 1:
        return Model(names, np.zeros((bins, 0), np.float32), np.zeros((0, 0)), np.zeros(0), max_n, bins)
    share = {r["label"]: min(1.0, 1.3 * each / r["n"] + 30 / r["n"]) for r in counts}
    cut = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])
    uniform = (F.shiftrightunsigned("at", 11) / F.lit(float(1 << 53))).alias("u")
    picked = known.select("label", "text", "at", uniform).where(F.col("u") < cut[F.col("label")])

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                bits, size = [], []
                for t in part.column(1).to_pylist():
                    seen = np.zeros(bins, bool)
                    s = presence(t, max_n, bins)
                    if s is not None:
                        seen[s] = True
                    bits.append(np.packbits(seen).tobytes())
                    size.append(int(seen.sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(bits, pa.binary()), pa.array(size, pa.int64())],
                    names=["label", "at", "bits", "size"],
                )

    sample = picked.mapInArrow(bitmap, "label string, at long, bits binary, size long").where("size > 0")
    # at most `each` rows a label; the windowed rows are those of the sample
    order = F.row_number().over(Window.partitionBy("label").orderBy("at", "bits"))
    got = sample.withColumn("r", order).where(F.col("r") <= each).orderBy("at", "label").collect()
    bits = np.frombuffer(b"".join(r["bits"] for r in got), np.uint8).reshape(len(got), -1)
    y = np.array([names.index(r["label"]) for r in got])
    return _solve(bits, y, names, landmarks, max_n, bins)


def _rows(bits: np.ndarray) -> np.ndarray:
    """Normalised presence vectors of packed bitmaps."""
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))


def _solve(bits: np.ndarray, y: np.ndarray, names: list[str], landmarks: int, max_n: int, bins: int) -> Model:
    # landmarks: the first rows of each label in turn (rows are in hash order)
    turn = np.zeros(len(y), np.int64)
    for c in range(len(names)):
        turn[y == c] = np.arange(int((y == c).sum()))
    order = np.argsort(turn, kind="stable")
    marks = _rows(bits[order[:landmarks]])
    kmm = (marks @ marks.T).astype(np.float64)
    value, vector = np.linalg.eigh(kmm)
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    # kernel columns of the sample, a block of rows at a time
    k = np.concatenate([_rows(bits[lo : lo + 256]) @ marks.T for lo in range(0, len(bits), 256)])
    z = k.astype(np.float64) @ root  # Nyström features
    mean = z.mean(axis=0)
    zc = z - mean
    target = np.where(y[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    # every label weighs the same, whatever its share of the sample
    w = 1.0 / np.bincount(y, minlength=len(names))[y]
    base = (w[:, None] * target).sum(axis=0) / w.sum()
    gram = zc.T @ (w[:, None] * zc) + RIDGE * w.sum() / len(y) * np.eye(z.shape[1])
    beta = np.linalg.solve(gram, zc.T @ (w[:, None] * (target - base)))
    return Model(
        names,
        np.ascontiguousarray(marks.T),
        (root @ beta).astype(np.float32),
        (base - mean @ beta).astype(np.float32),
        max_n,
        bins,
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (or replaced)."""
    docs = docs.drop("lang_pred", "score")
    carried = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = carried.index("text")
    out = docs.select("*").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                names, scores = shared.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*carried, "lang_pred", "score"],
                )
        give_back()

    return docs.mapInArrow(run, out)
