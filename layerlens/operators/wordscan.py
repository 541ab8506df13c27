"""Words and word pieces of many texts at once, for use inside tasks.

``scan_words`` finds the words of the uncased word rules in the UTF-8 bytes of
an Arrow string array with numpy, without decoding texts. ``PieceTrie`` splits
words greedily, the longest piece first, reading each character once: a trie
over the vocabulary with failure links, so that a failed match goes on where
the pieces found so far end. All words of a batch are led through its flat
arrays together, one character a step.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
OTHER, BLANK, ALONE, DROPPED = range(4)

# Ranges of ideographs that are words of their own.
IDEOGRAPHS = [
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF),
    (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
]


def _class_of(code: int) -> int:
    kind = unicodedata.category(chr(code))
    if code in (0x09, 0x0A, 0x0D) or kind[0] == "Z":
        return BLANK
    if kind in ("Cc", "Cf", "Co") or code == 0xFFFD:
        return DROPPED
    mark = 0x21 <= code <= 0x2F or 0x3A <= code <= 0x40 or 0x5B <= code <= 0x60 or 0x7B <= code <= 0x7E
    return ALONE if mark or kind[0] == "P" or any(a <= code <= b for a, b in IDEOGRAPHS) else OTHER


_ASCII = np.array([_class_of(c) for c in range(128)] + [OTHER] * 128, np.uint8)
_CLASSES: dict[int, np.ndarray] = {}


def classes(codes: np.ndarray) -> np.ndarray:
    """Class of each code point; tables of 4,096 are made when first met."""
    out = np.empty(len(codes), np.uint8)
    block = codes >> 12
    for b in np.unique(block).tolist():
        table = _CLASSES.get(b)
        if table is None:
            table = _CLASSES[b] = np.array([_class_of((b << 12) + i) for i in range(4096)], np.uint8)
        here = block == b
        out[here] = table[codes[here] & 0xFFF]
    return out


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of texts of about ``limit`` bytes; a longer text stays whole."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        base = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def scan_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` in order, and how many each text has (null:
    none). Blanks part words, control characters vanish, punctuation and
    ideographs are words of their own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, bounds, raw = texts.buffers()
    off = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    d = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    kind = _ASCII[d]
    first = np.flatnonzero(d >= 0xC0)
    if len(first):
        lead = d[first].astype(np.int64)
        wide = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        code = lead & np.array([0, 0, 0x1F, 0x0F, 0x07])[wide]
        for i in (1, 2, 3):
            more = wide > i
            code[more] = code[more] << 6 | d[first[more] + i] & 0x3F
        k = classes(code)
        for i in range(4):
            more = wide > i
            kind[first[more] + i] = k[more]
    # a byte that goes on a character begins nothing
    begins = (d & 0xC0) != 0x80
    stay = kind != DROPPED
    if not stay.all():
        off = np.concatenate(([0], np.cumsum(stay)))[off]
        d, kind, begins = d[stay], kind[stay], begins[stay]
    word = kind == OTHER
    start = word.copy()
    start[1:] &= ~word[:-1]
    at = off[:-1][off[:-1] < len(d)]
    start[at] = word[at]
    start |= (kind == ALONE) & begins
    n = np.diff(np.concatenate(([0], np.cumsum(start)))[off])
    held = kind != BLANK
    ends = np.append(np.flatnonzero(start[held]), int(held.sum())).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(d[held]))])
    return words, n


def normalize_word(w: str) -> str:
    """Uncased normalisation: lower case, NFD, drop combining marks."""
    w = unicodedata.normalize("NFD", w.lower())
    return "".join(ch for ch in w if unicodedata.category(ch) != "Mn")


def normalized(words: pa.Array) -> list[str]:
    """``normalize_word`` of each; ASCII words only change their case."""
    out = pc.ascii_lower(words).to_pylist()
    for i in np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)).tolist():
        out[i] = normalize_word(words[i].as_py())
    return out


class PieceTrie:
    """Greedy longest-match pieces of words in one pass. Node 0 is the root of
    pieces that begin a word, node 1 that of pieces that go on one. A node's
    failure link leads to where the pieces it stands for (``pops``) end."""

    BEGIN, GO_ON = 0, 1

    def __init__(self, vocab: dict[str, int], unknown: str, mark: str, longest: int):
        self.unknown, self.longest = vocab[unknown], longest
        goto: dict[tuple[int, str], int] = {}
        parent, char, depth, token = [-1, -1], ["", ""], [0, 0], [-1, -1]

        def insert(root: int, piece: str, number: int) -> None:
            node = root
            for c in piece:
                following = goto.get((node, c))
                if following is None:
                    following = goto[node, c] = len(parent)
                    parent.append(node)
                    char.append(c)
                    depth.append(depth[node] + 1)
                    token.append(-1)
                node = following
            if node != root:
                token[node] = number

        for piece, number in vocab.items():
            insert(self.BEGIN, piece, number)
            if piece.startswith(mark):
                insert(self.GO_ON, piece[len(mark) :], number)
        fail, pops = [-1] * len(parent), [[] for _ in parent]
        for v in np.argsort(depth, kind="stable").tolist():
            if not depth[v]:
                continue
            if token[v] >= 0:
                fail[v], pops[v] = self.GO_ON, [token[v]]
                continue
            at, found = fail[parent[v]], list(pops[parent[v]])
            while at >= 0 and (at, char[v]) not in goto:
                found += pops[at]
                at = fail[at]
            if at >= 0:
                fail[v], pops[v] = goto[at, char[v]], found
        key = np.fromiter((n << 21 | ord(c) for n, c in goto), np.int64, len(goto))
        order = np.argsort(key)
        self.key, self.next = key[order], np.fromiter(goto.values(), np.int64, len(goto))[order]
        self.fail = np.array(fail, np.int64)
        self.n_pops = np.fromiter(map(len, pops), np.int64, len(pops))
        self.first_pop = np.cumsum(self.n_pops) - self.n_pops
        self.pops = np.fromiter((t for p in pops for t in p), np.int32, int(self.n_pops.sum()))

    def _goto(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = node << 21 | code
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.next[at], -1)

    def split(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all words joined, and how many each has; a word that
        cannot be split, or is too long, is one unknown piece."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.cumsum(size) - size
        good = size <= self.longest
        node = np.zeros(n, np.int64)
        of: list[np.ndarray] = []
        left: list[np.ndarray] = []

        def fall(at: np.ndarray) -> np.ndarray:
            """Words that follow a failure link; the others are unknown."""
            to = self.fail[node[at]]
            good[at[to < 0]] = False
            at, to = at[to >= 0], to[to >= 0]
            of.append(at)
            left.append(node[at])
            node[at] = to
            return at

        for i in range(int(size[good].max(initial=0))):
            at = np.flatnonzero(good & (size > i))
            while len(at):
                to = self._goto(node[at], code[start[at] + i])
                node[at[to >= 0]] = to[to >= 0]
                at = fall(at[to < 0])
        at = np.flatnonzero(good & (size > 0))
        while len(at := at[node[at] != self.GO_ON]):
            at = fall(at)
        of_all = np.concatenate(of) if of else np.zeros(0, np.int64)
        nodes = np.concatenate(left) if left else np.zeros(0, np.int64)
        keep = good[of_all]
        bad = np.flatnonzero(~good)
        # unknown words take one place with no node
        of_all = np.concatenate((of_all[keep], bad))
        nodes = np.concatenate((nodes[keep], np.full(len(bad), -1)))
        order = np.argsort(of_all, kind="stable")
        of_all, nodes = of_all[order], nodes[order]
        count = np.where(nodes < 0, 1, self.n_pops[nodes])
        ends = np.cumsum(count)
        ids = np.full(int(ends[-1]) if len(ends) else 0, self.unknown, np.int32)
        known = np.repeat(nodes >= 0, count)
        flat = np.arange(len(ids)) + np.repeat(np.where(nodes < 0, 0, self.first_pop[nodes]) - (ends - count), count)
        ids[known] = self.pops[flat[known]]
        return ids, np.bincount(of_all, weights=count, minlength=n).astype(np.int64)
