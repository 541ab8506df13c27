"""Helpers shared by the operators of this subpackage: the shared folder,
byte-bounded slices of Arrow batches, and a numpy scan that finds and hashes
the words of many texts at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D. These are single
ASCII bytes, so in UTF-8 the scan can work on bytes and never decodes.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlens.session import ensure_checkpoint_dir, ship_package

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder and worker imports, once per session."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``shared_dir`` that is no longer read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Between two steps that each shuffle the texts: Spark deletes the files
    of a shuffle, and checkpoints, once the driver has collected what referred
    to them, which may be long after the next step has begun."""
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (several times, or
    inside lambdas), also where the optimizer would inline a column."""
    return F.transform(F.array(value), body).getItem(0)


def give_back() -> None:
    """At the end of a task: return freed memory to the system, since the
    worker process lives on and the next task may need little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def given_back(work, *given):
    """``work(*given)`` for one group; what it took is returned to the system
    once its own arrays are gone."""
    out = work(*given)
    give_back()
    return out


# ---------------------------------------------------------------- Arrow rows


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes
    (one longer text makes a slice alone), so that temporary arrays stay
    bounded whatever the batch size."""
    arr = batch.column(batch.schema.get_field_index(column))
    if batch.num_rows == 0:
        return
    ends = np.cumsum(byte_lengths(arr))
    lo, n = 0, batch.num_rows
    while lo < n:
        base = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the whole byte buffer of a string array."""
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(arr) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, bytes_


def byte_lengths(arr: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each value, null as 0."""
    if len(arr) == 0:
        return np.zeros(0, np.int64)
    out = np.diff(text_bytes(arr)[0])
    if arr.null_count:
        out = np.where(np.asarray(arr.is_valid()), out, 0)
    return out


# ------------------------------------------------------------------ the scan

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


KEPT_POWERS = 2 * SLICE_BYTES
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1, -(-n >> 16)) << 16
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:  # doubling: p[done:2*done] = p[:done] * base^done
            step = np.uint64(pow(base, done, 1 << 64))
            have[done : 2 * done] = have[: min(done, size - done)] * step
            done *= 2
        if size <= KEPT_POWERS:  # a worker keeps what a slice needs, not a long text's
            _POWERS[base] = have
    return have[:n]


@dataclass
class Words:
    """The words of a slice of texts, in order."""

    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    row: np.ndarray  # text that holds the word
    first: np.ndarray  # first word of each text, and the total at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a polynomial modulo 2^64 by
        differences of one running sum, shifted back to the word's start."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=total[1:])
        own = (total[self.end] - total[self.start]) * _powers(_BASE_INV, n)[self.start]
        return mix64(own + (self.end - self.start).astype(np.uint64))


def scan(arr: pa.Array, lower: bool = False) -> Words:
    """Find the words of every text of ``arr`` (null: none)."""
    rows = len(arr)
    if rows == 0:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), empty, empty, empty, np.zeros(1, np.int64))
    offsets, raw = text_bytes(arr)
    data = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    inside = ~_SEPARATOR[data]
    if arr.null_count:
        for i in np.flatnonzero(~np.asarray(arr.is_valid())):
            inside[offsets[i] : offsets[i + 1]] = False
    n = len(data)
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets, side="left").astype(np.int64)
    first[-1] = len(start)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(data, start, end, row, first)


def windows(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` words, one for each first word; runs that
    leave a text are the caller's to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(salt + k), np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        out *= factor
        out += hashes[j : j + n]
    return mix64(out)
