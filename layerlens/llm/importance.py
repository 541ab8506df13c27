"""Importance resampling towards a target distribution over hashed features.

A text's features are its words and its pairs of neighbouring words (joined by
one blank), repeats counted. A feature's bucket is the CRC-32 of its bytes
modulo ``buckets``. The corpus and the target each give exact totals of every
bucket; a document's weight is the floored mean of its features' log gains,
and the draw adds Gumbel noise that depends on the id alone.

Words are a head and a tail. The head, counted over the whole corpus, is
broadcast: of each frequent word the CRC state after "word + blank" (from
which the CRC of a pair goes on) and its bucket, of each frequent pair its
bucket. Both tables have fixed sizes and words of bounded length. Features
outside take the CRC of their bytes directly. Head and tail give the same
buckets, so totals and weights do not depend on which words are in the head.

A word is a run of characters other than ASCII non-alphanumerics; A-Z are
lower-cased first. These are single ASCII bytes, so the work is on UTF-8.

Defined cases: a null or empty text, or one without words, has no feature,
weight 0 and is never drawn (fewer than ``least_words`` words); a null doc_id
has the noise of the empty id and comes last among equal scores; rows with the
same id and text are separate rows, drawn one after the other; an empty corpus
or target gives totals of 0; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import give_back, text_slices
from layerlens.operators.scan import global_rank
from layerlens.session import materialize

BUCKETS = 10_000
HEAD_WORDS = 1 << 16
HEAD_PAIRS = 1 << 18
HEAD_BYTES = 64  # longer words are always tail
LOCAL_WORDS = 1 << 19  # words a task tells apart while it looks for the head
LOCAL_PAIRS = 1 << 21
HEAD_SHARE = 16  # a task names at most one of so many words as candidates

_FOLD = bytearray(range(256))
for _b in range(128):
    _FOLD[_b] = _b if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A else _b + 32 if 0x41 <= _b <= 0x5A else 0x20
_FOLD = bytes(_FOLD)


def _words(part: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts of a slice, and the number of words of each."""
    words: list[bytes] = []
    n = np.zeros(part.num_rows, np.int64)
    for i, text in enumerate(part.column(part.schema.get_field_index("text")).cast(pa.binary())):
        w = (text.as_py() or b"").translate(_FOLD).split()
        words += w
        n[i] = len(w)
    return words, n


def _pair_starts(n: np.ndarray) -> np.ndarray:
    """Positions of all words that another word of the same text follows."""
    inside = np.ones(int(n.sum()), bool)
    inside[np.cumsum(n)[n > 0] - 1] = False
    return np.flatnonzero(inside)


# ------------------------------------------------------------------- the head


@dataclass
class Head:
    """``word``: number of each frequent word; ``state``: CRC after the word
    and a blank; ``bucket``: of the word; ``pair``: sorted ``first * size +
    second`` of the frequent pairs; ``pair_bucket``."""

    word: dict[bytes, int]
    state: np.ndarray
    bucket: np.ndarray
    pair: np.ndarray
    pair_bucket: np.ndarray
    buckets: int

    @staticmethod
    def of(words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int) -> Head:
        known = {w: i for i, w in enumerate(words)}
        state = np.fromiter((zlib.crc32(w + b" ") for w in words), np.int64, len(words))
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
        pairs = [(a, b) for a, b in pairs if a in known and b in known]
        key = np.fromiter((known[a] * len(words) + known[b] for a, b in pairs), np.int64, len(pairs))
        of = np.fromiter((zlib.crc32(b, zlib.crc32(a + b" ")) % buckets for a, b in pairs), np.int32, len(pairs))
        order = np.argsort(key)
        return Head(known, state, bucket, key[order], of[order], buckets)

    def features(self, words: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all words, positions that begin a pair, and the buckets
        of the pairs."""
        if not words:
            none = np.zeros(0, np.int64)
            return none, none, none
        number = np.fromiter(map(self.word.get, words, repeat(-1)), np.int64, len(words))
        state, single = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        head = number >= 0
        state[head], single[head] = self.state[number[head]], self.bucket[number[head]]
        for i in np.flatnonzero(~head).tolist():
            crc = zlib.crc32(words[i])
            single[i], state[i] = crc % self.buckets, zlib.crc32(b" ", crc)
        at = _pair_starts(n)
        double = np.full(len(at), -1, np.int64)
        a, b = number[at], number[at + 1]
        both = np.flatnonzero((a >= 0) & (b >= 0))
        if len(both) and len(self.pair):
            key = a[both] * len(self.word) + b[both]
            place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            hit = self.pair[place] == key
            double[both[hit]] = self.pair_bucket[place[hit]]
        tail = np.flatnonzero(double < 0)
        if len(tail):
            begin = at[tail]
            after = map(words.__getitem__, (begin + 1).tolist())
            double[tail] = np.fromiter(map(zlib.crc32, after, state[begin].tolist()), np.int64, len(tail)) % self.buckets
        return single, at, double


def head_of(docs: DataFrame, buckets: int, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS) -> Head:
    """The most frequent words and pairs of the whole corpus. Tasks forget
    what they met once when their tables are full; that concerns only what is
    in the head, not the results."""

    def run(batches):
        known: dict[bytes, int] = {}
        count: Counter = Counter()
        key, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        seen = 0

        def fold(key, times):
            x, at = np.unique(np.concatenate([key, *waiting]), return_inverse=True)
            weight = np.concatenate([times, np.ones(sum(map(len, waiting)), np.int64)])
            y = np.bincount(at, weights=weight, minlength=len(x)).astype(np.int64)
            waiting.clear()
            if len(x) > LOCAL_PAIRS:
                x, y = x[y > 1], y[y > 1]
            if len(x) > LOCAL_PAIRS:
                top = np.sort(np.argpartition(-y, LOCAL_PAIRS // 2)[: LOCAL_PAIRS // 2])
                x, y = x[top], y[top]
            return x, y

        for batch in batches:
            for part in text_slices(batch):
                w, n = _words(part)
                seen += len(w)
                count.update(w)
                if len(count) > LOCAL_WORDS:
                    count = Counter(dict(count.most_common(LOCAL_WORDS // 2)))
                if len(known) < LOCAL_WORDS:
                    for x in set(w).difference(known):
                        if len(x) <= HEAD_BYTES and len(known) < LOCAL_WORDS:
                            known[x] = len(known)
                number = np.fromiter(map(known.get, w, repeat(-1)), np.int64, len(w))
                at = _pair_starts(n)
                a, b = number[at], number[at + 1]
                both = (a >= 0) & (b >= 0)
                waiting.append(a[both] << 32 | b[both])
                if sum(map(len, waiting)) > LOCAL_PAIRS:
                    key, times = fold(key, times)
        key, times = fold(key, times)
        limit = seen // HEAD_SHARE + 1
        top = [(w, c) for w, c in count.most_common(min(words, limit)) if len(w) <= HEAD_BYTES]
        order = np.argsort(-times, kind="stable")[: min(pairs, limit)]
        names = list(known)
        first, second = (key[order] >> 32).tolist(), (key[order] & 0xFFFFFFFF).tolist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([w for w, _ in top] + [names[i] for i in first], pa.binary()),
                pa.array([None] * len(top) + [names[i] for i in second], pa.binary()),
                pa.array([c for _, c in top] + times[order].tolist(), pa.int64()),
            ],
            names=["a", "b", "n"],
        )
        give_back()

    named = materialize(
        docs.select("text").mapInArrow(run, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    )
    top = lambda rows, size: rows.orderBy(F.desc("n"), "a", "b").limit(size).select("a", "b").toArrow()
    w, p = top(named.where("b is null"), words), top(named.where("b is not null and n > 1"), pairs)
    return Head.of(w.column("a").to_pylist(), list(zip(p.column("a").to_pylist(), p.column("b").to_pylist())), buckets)


# ----------------------------------------------------------- totals and weights


def bucket_totals(docs: DataFrame, head, buckets: int) -> np.ndarray:
    """Exact number of features in each bucket, over all texts. Each task
    gives one row, which is as long as there are buckets."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch):
                single, _, double = head.value.features(*_words(part))
                total += np.bincount(single, minlength=buckets) + np.bincount(double, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])
        give_back()

    got = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln)`` of each bucket's smoothed share in the target over
    that in the source."""
    n, big_s, big_t = len(source), int(source.sum()), int(target.sum())
    up = [float((int(t) + 1) * (big_s + n)) for t in target]
    down = [float((int(s) + 1) * (big_t + n)) for s in source]
    return np.fromiter((math.floor(1000 * math.log(u / d)) for u, d in zip(up, down)), np.int64, n)


def weights(docs: DataFrame, head, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in text_slices(batch):
                words, n = _words(part)
                single, at, double = head.value.features(words, n)
                of = shared.value[single]
                of[at] += shared.value[double]  # a pair counts with its first word
                total = np.concatenate(([0], np.cumsum(of)))
                ends = np.cumsum(n)
                mass = total[ends] - total[ends - n]
                features = np.maximum(2 * n - 1, 0)
                weight = mass // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(features), pa.array(weight)],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = 7) -> Column:
    """``floor(1000 x Gumbel)`` from a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``: every row of
    ``docs``; ``rank`` is set for the ``percent`` of those with at least
    ``least_words`` words that score highest."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    head = spark.sparkContext.broadcast(head_of(docs, buckets))
    gain = gains(bucket_totals(docs, head, buckets), bucket_totals(target, head, buckets))
    known = weights(docs, head, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    known = materialize(known)
    long = known.where(F.col("n_words") >= least_words)
    drawn = long.count() * percent // 100
    keyed = long.withColumn("_key", -F.col("score")).withColumn("_null", F.col("doc_id").isNull())
    ranked = global_rank(keyed, ["_key", "_null", "doc_id"]).select(*known.columns, "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    short = known.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(short).select(*known.columns, rank)
