"""Token counts: rank-synchronous array merging. Distinct pre-tokens of a
slice of texts are laid out as one ragged numpy array of symbols; in each
round every sequence merges all occurrences of its own lowest-rank pair at
once; a sequence without a mergeable pair is done, and the symbols that
survive are its tokens.

Defined cases: a null or empty text has 0 bytes and 0 tokens; rows are
counted one by one, so ties, repeated rows and extra columns do not matter;
texts of any length are worked through in pieces cut where no pre-token
crosses; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import byte_lengths, give_back, text_slices

# Unicode White_Space, and the pattern that the public
# byte-level vocabulary splits text with before merging.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
# The same cut one level up: runs without white space and the white space
# between them. No pre-token crosses a run's end, and what a run is cut into
# does not depend on its neighbours, so counts can be kept by run.
RUN = re.compile(rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
CUT = re.compile(rf"[^{SPACES}](?=[{SPACES}])")

CACHE_CHARS = 12_000_000
PIECE_CHARS = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such files:
    printable Latin-1 bytes for themselves, the others from U+0100 on."""
    out, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class RankMerger:
    """Counts the symbols that are left of byte strings after all merges."""

    def __init__(self, vocab_path: str):
        with open(vocab_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = np.int64(max(vocab.values()) + 2)
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        key = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.rank = order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def count(self, strings: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty byte string."""
        n = len(strings)
        result = np.zeros(n, np.int64)
        if not n:
            return result
        flat = np.frombuffer(b"".join(strings), np.uint8)
        sym = self.of_byte[flat]
        length = np.fromiter(map(len, strings), np.int64, n)
        owner = np.arange(n)  # string of each sequence that is still worked on
        none = np.int64(len(self.made))
        while len(sym):
            seq = np.repeat(np.arange(len(length)), length)
            first = np.cumsum(length) - length
            key = sym * self.size
            key[:-1] += sym[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.where(self.key[at] == key, self.rank[at], none)
            rank[first + length - 1] = none  # a last symbol has no right neighbour
            low = np.minimum.reduceat(rank, first)
            live = low < none
            if not live.all():
                result[owner[~live]] = length[~live]
                keep = live[seq]
                sym, rank, seq = sym[keep], rank[keep], seq[keep]
                owner, length, low = owner[live], length[live], low[live]
                if not len(sym):
                    break
                seq = np.repeat(np.arange(len(length)), length)
            hit = rank == low[seq]
            hit = _leftmost(hit)
            where = np.flatnonzero(hit)
            sym[where] = self.made[rank[where]]
            gone = np.zeros(len(sym), bool)
            gone[where + 1] = True
            length = length - np.bincount(seq[where], minlength=len(length))
            sym = sym[~gone]
        return result


def _leftmost(hit: np.ndarray) -> np.ndarray:
    """Of overlapping pairs (x x x) keep every other, from the left."""
    where = np.flatnonzero(hit)
    if len(where) < 2:
        return hit
    fresh = np.ones(len(where), bool)
    fresh[1:] = np.diff(where) > 1
    if fresh.all():
        return hit
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
    odd = (np.arange(len(where)) - begin) % 2 == 1
    out = hit.copy()
    out[where[odd]] = False
    return out


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a very long text before white space that follows a run."""
    at = 0
    while len(text) - at > limit:
        cut = CUT.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


class TokenCounter:
    """Counts of whole texts, with the counts of frequent runs kept in a
    table of bounded size that is emptied when it is full."""

    def __init__(self, vocab_path: str, cache_chars: int = CACHE_CHARS):
        self.merger = RankMerger(vocab_path)
        self.split = re.compile("|".join(map(re.escape, self.merger.special))) if self.merger.special else None
        self.known: dict[str, int] = {}
        self.chars, self.limit = 0, cache_chars

    def _learn(self, runs: list[str]) -> None:
        tokens: list[bytes] = []
        owner: list[int] = []
        for i, run in enumerate(runs):
            for piece in PRETOKEN.findall(run):
                tokens.append(piece.encode("utf-8", "surrogatepass"))
                owner.append(i)
        n = np.bincount(np.array(owner, np.int64), weights=self.merger.count(tokens), minlength=len(runs))
        self.known.update(zip(runs, n.astype(np.int64).tolist()))

    def counts(self, texts: list[str | None]) -> list[int]:
        out = []
        todo: list[tuple[int, list[str]]] = []
        for text in texts:
            total = 0
            for part in self.split.split(text) if self.split and text else [text or ""]:
                for piece in pieces(part):
                    if piece:
                        todo.append((len(out), RUN.findall(piece)))
            if self.split and text:
                total = sum(1 for _ in self.split.finditer(text))
            out.append(total)
        fresh: set[str] = set()
        for _, runs in todo:
            fresh.update(runs)
        fresh.difference_update(self.known)
        if fresh:
            self._learn(list(fresh))
            self.chars += sum(map(len, fresh))
        get = self.known.__getitem__
        for i, runs in todo:
            out[i] += sum(map(get, runs))
        if self.chars > self.limit or len(self.known) > self.limit // 24:
            self.known, self.chars = {}, 0
        return out


_COUNTERS: dict[str, TokenCounter] = {}


def counter_of(vocab_path: str) -> TokenCounter:
    """One counter per worker process, kept over its tasks."""
    if vocab_path not in _COUNTERS:
        _COUNTERS[vocab_path] = TokenCounter(vocab_path)
    return _COUNTERS[vocab_path]


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocab_path)
        for batch in batches:
            for part in text_slices(batch):
                n = counter.counts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(byte_lengths(part.column(1)), pa.int64()), pa.array(n, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )
        give_back()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
