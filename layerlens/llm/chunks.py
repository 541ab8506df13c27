"""Documents dealt to chunks, and exchanges of packed hash lists between them.

A chunk is a set of documents of bounded text size, chosen by hash of the id.
Work that compares hashes over the whole corpus runs in rounds: every chunk
sorts its own distinct hashes, sends them as packed lists to hash buckets, and
gets back one bit for each hash it sent. A very frequent hash therefore costs
one entry per chunk, never one per occurrence. All rounds of one query read
the same exchange of texts by chunk, which Spark plans once and reuses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import text_slices

CHUNK_BYTES = 32 << 20
NO_ID = np.iinfo(np.int64).max


def chunk_count(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    """As many chunks that one holds about ``chunk_bytes`` of text, and at
    least as many as there are shuffle partitions. Packed lists are one row
    for each chunk and bucket, so neither number is larger than needed."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // chunk_bytes) + 1)


def chunk_of(doc_id: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(n)).cast("int")


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers, null as the largest."""
    return column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def table_slices(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.to_batches():
        yield from text_slices(batch)


def distinct_min(hashes: list[np.ndarray], owners: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with the smallest owner of each and whether it has
    several, in order of (smallest owner, hash)."""
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    d = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    if not len(h):
        return h, d, np.zeros(0, bool)
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    last = np.r_[first[1:], len(h)] - 1
    h, low, several = h[first], d[first], d[last] != d[first]
    order = np.lexsort((h, low))
    return h[order], low[order], several[order]


def by_bucket(h: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the hashes of each non-empty bucket, in given order."""
    if not len(h):
        return
    b = (h % np.uint64(n)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.r_[True, b[order][1:] != b[order][:-1]])
    for lo, hi in zip(cut, np.r_[cut[1:], len(order)]):
        yield int(b[order[lo]]), order[lo:hi]


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length form of a sorted array: values and lengths."""
    if not len(x):
        return x, np.zeros(0, np.uint32)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[first], np.diff(np.r_[first, len(x)]).astype(np.uint32)


SENT = "chunk int, bucket int, hashes binary, owners binary, lengths binary, several binary"


def send(chunk: int, n: int, h: np.ndarray, low: np.ndarray, several: np.ndarray) -> pa.Table:
    rows = []
    for bucket, at in by_bucket(h, n):
        owner, length = runs(low[at])
        rows.append((chunk, bucket, h[at].tobytes(), owner.tobytes(), length.tobytes(), np.packbits(several[at]).tobytes()))
    cols = list(zip(*rows)) or [()] * 6
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["chunk", "bucket", "hashes", "owners", "lengths", "several"])


REPLY = "chunk int, bucket int, bits binary"


def answer(table: pa.Table, decide) -> pa.Table:
    """For one bucket: ``decide(group, owner, several, group_of)`` gets, for
    all hashes sent by all chunks, the number of its group of equal hashes,
    the smallest owner in the sending chunk and the flag; it returns a bool
    for each, which goes back packed in the order of sending."""
    h, d, s, size = [], [], [], []
    for row in zip(*[table.column(c).to_pylist() for c in ("hashes", "owners", "lengths", "several")]):
        x = np.frombuffer(row[0], np.uint64)
        h.append(x)
        d.append(np.repeat(np.frombuffer(row[1], np.int64), np.frombuffer(row[2], np.uint32)))
        s.append(np.unpackbits(np.frombuffer(row[3], np.uint8), count=len(x)).astype(bool))
        size.append(len(x))
    h, d, s = np.concatenate(h), np.concatenate(d), np.concatenate(s)
    order = np.argsort(h, kind="stable")
    first = np.r_[True, h[order][1:] != h[order][:-1]]
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(first) - 1
    bits = decide(group, d, s)
    ends = np.cumsum(size)
    packed = [np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends, size)]
    return pa.table([table.column("chunk"), table.column("bucket"), pa.array(packed, pa.binary())], names=["chunk", "bucket", "bits"])


def receive(h: np.ndarray, n: int, replies: dict[int, bytes]) -> np.ndarray:
    """The bit of each hash, in the order of ``h``."""
    out = np.zeros(len(h), bool)
    for bucket, at in by_bucket(h, n):
        out[at] = np.unpackbits(np.frombuffer(replies[bucket], np.uint8), count=len(at)).astype(bool)
    return out


def member(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)
    return sorted_set[at] == x
