"""Substring dedup: seed and extend.

Seeds are winnowed anchors: of each 7 consecutive 7-word runs the one with the
smallest hash, so that every run of 13 words holds an anchor that depends on
those words alone, and equal runs hold equal anchors. Documents are joined on
their anchors; anchors of one document only are dropped. The others are
extended both ways to every 13-word window around them, windows are joined
again, and overlapping repeated windows merge into maximal repeats. A word is
removed if a window over it also starts in a document with a smaller id.

Both joins send each chunk's distinct hashes only (``chunks``), so a passage
that a third of all documents hold costs one entry per chunk.

Defined cases: a null or empty text has no words; words keep their order and
are joined by one blank; an id counts as smaller only if it really is, so rows
with equal ids do not remove each other's words; a null id is larger than all
others; a text shorter than the window loses nothing; other columns are
carried unchanged, but columns named like the results are replaced; an empty
table gives an empty result. Texts of any length are worked through whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from layerlens.llm import chunks
from layerlens.llm.common import Words, give_back, given_back, scan, windows

WINDOW = 13
ANCHOR = 7


def window_starts(w: Words, size: int = WINDOW) -> np.ndarray:
    """First words of all windows that stay within their text."""
    n = len(w.row) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.row[:n] == w.row[size - 1 :])


def anchors(h: np.ndarray, starts: np.ndarray, size: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and the anchor (its first word) of
    each window."""
    g = windows(h, k, salt=k)
    if not len(starts):
        return g, starts
    best, at = g[starts].copy(), starts.copy()
    for j in range(1, size - k + 1):
        x = g[starts + j]
        lower = x < best
        best[lower] = x[lower]
        at[lower] = starts[lower] + j
    return g, at


class Chunk:
    """One chunk's documents, scanned slice by slice."""

    def __init__(self, table: pa.Table):
        self.table = table

    def slices(self):
        for batch in chunks.table_slices(self.table):
            w = scan(batch.column(batch.schema.get_field_index("text")))
            ids = chunks.ids_of(batch.column(batch.schema.get_field_index("doc_id")))
            starts = window_starts(w)
            h = w.hashes()
            g, at = anchors(h, starts)
            yield batch, w, ids, h, starts, g, at

    def seeds(self):
        hashes, owners = [], []
        for _, w, ids, _, _, g, at in self.slices():
            once = np.unique(at)
            hashes.append(g[once])
            owners.append(ids[w.row[once]])
        return chunks.distinct_min(hashes, owners)

    def extended(self, shared: np.ndarray):
        """Windows around shared anchors."""
        hashes, owners = [], []
        for _, w, ids, h, starts, g, at in self.slices():
            near = starts[chunks.member(g[at], shared)]
            hashes.append(windows(h, WINDOW)[near] if len(near) else np.zeros(0, np.uint64))
            owners.append(ids[w.row[near]])
        return chunks.distinct_min(hashes, owners)


def _bits(table: pa.Table, phase: int) -> dict[int, bytes]:
    rows = zip(table.column("phase").to_pylist(), table.column("bucket").to_pylist(), table.column("bits").to_pylist())
    return {b: x for p, b, x in rows if p == phase}


def _done(table: pa.Table) -> pa.Table:
    give_back()
    return table


def _in_several(group: np.ndarray, low: np.ndarray, several: np.ndarray) -> np.ndarray:
    count = np.bincount(group)
    known = np.bincount(group, weights=several) > 0
    return ((count > 1) | known)[group]


def _earlier(group: np.ndarray, low: np.ndarray, several: np.ndarray) -> np.ndarray:
    least = np.full(group.max() + 1, chunks.NO_ID)
    np.minimum.at(least, group, low)
    return low > least[group]


def dedup(docs: DataFrame, untouched: bool = False) -> DataFrame:
    """``docs`` with ``text`` cut down to the words that stay, joined by one
    blank, and ``n_words``, ``n_removed`` and ``repeats`` (spans of removed
    words, first and one past the last). With ``untouched``, texts that lose
    nothing keep their white space."""
    docs = docs.drop("n_words", "n_removed", "repeats")
    n = chunks.chunk_count(docs)
    dealt_by = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))  # rows without an id are dealt by their texts
    dealt = docs.withColumn("_llm_chunk", chunks.chunk_of(dealt_by, n))
    names = dealt.columns

    # no type hints on functions given to applyInArrow: Spark reads them
    def seeds(key, table):
        return _done(chunks.send(key[0].as_py(), n, *Chunk(table.rename_columns(names)).seeds()))

    def shared_in(table: pa.Table, replies: pa.Table) -> np.ndarray:
        h, _, _ = Chunk(table).seeds()
        return np.sort(h[chunks.receive(h, n, _bits(replies, 1))])

    def extend(key, table, replies):
        table = table.rename_columns(names)
        return _done(chunks.send(key[0].as_py(), n, *Chunk(table).extended(shared_in(table, replies))))

    out_names = [c for c in names if c != "_llm_chunk"]
    span = T.StructType().add("first", "long").add("end", "long")
    schema = dealt.drop("_llm_chunk").schema.add("n_words", "long").add("n_removed", "long").add("repeats", T.ArrayType(span))

    def remove(key, table, replies):
        table = table.rename_columns(names)
        chunk = Chunk(table)
        h, low, several = chunk.extended(shared_in(table, replies))
        gone = chunks.receive(h, n, _bits(replies, 2))
        order = np.argsort(h, kind="stable")
        known, owner, foreign = h[order], low[order], gone[order]
        parts = []
        for batch, w, ids, wh, starts, _, _ in chunk.slices():
            hit = np.zeros(0, np.int64)
            if len(starts) and len(known):
                x = windows(wh, WINDOW)[starts]
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                mine = ids[w.row[starts]]
                hit = starts[(known[at] == x) & (foreign[at] | (mine > owner[at]))]
            parts.append(_cut(batch, w, hit, out_names, schema_arrow, untouched))
        if not parts:
            return pa.Table.from_batches([], schema=schema_arrow)
        return _done(pa.Table.from_batches(parts, schema=schema_arrow))

    schema_arrow = to_arrow_schema(schema)
    by_chunk = dealt.groupBy("_llm_chunk")
    sent1 = by_chunk.applyInArrow(seeds, chunks.SENT)
    reply1 = sent1.groupBy("bucket").applyInArrow(lambda t: given_back(chunks.answer, t, _in_several), chunks.REPLY)
    reply1 = reply1.withColumn("phase", F.lit(1))
    sent2 = by_chunk.cogroup(reply1.groupBy("chunk")).applyInArrow(extend, chunks.SENT)
    reply2 = sent2.groupBy("bucket").applyInArrow(lambda t: given_back(chunks.answer, t, _earlier), chunks.REPLY)
    replies = reply1.unionByName(reply2.withColumn("phase", F.lit(2)))
    return by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(remove, schema)


def _cut(
    batch: pa.RecordBatch, w: Words, hit: np.ndarray, names: list[str], schema: pa.Schema, untouched: bool
) -> pa.RecordBatch:
    """Remove the words under the windows that start at ``hit``."""
    n = len(w.start)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, hit, 1)
    np.add.at(depth, hit + WINDOW, -1)
    gone = np.cumsum(depth[:n]) > 0
    data = w.data.tobytes()
    texts, removed, spans = [], [], []
    given = batch.column(batch.schema.get_field_index("text"))
    for i in range(batch.num_rows):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        stay = lo + np.flatnonzero(~gone[lo:hi])
        if untouched and len(stay) == hi - lo:
            texts.append(given[i].as_py())
        else:
            words = [data[a:b] for a, b in zip(w.start[stay].tolist(), w.end[stay].tolist())]
            texts.append(b" ".join(words).decode("utf-8"))
        removed.append(hi - lo - len(stay))
        edge = np.flatnonzero(np.diff(np.r_[False, gone[lo:hi], False].astype(np.int8)))
        spans.append([{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
    cols = []
    for c in names:
        at = batch.schema.get_field_index(c)
        cols.append(pa.array(texts, pa.string()) if c == "text" else batch.column(at))
    cols += [pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, schema.field("repeats").type)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)


