"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice has a node for every character boundary and an edge for every
piece of the vocabulary. In a BPE model a path is not scored by a sum: a path
is the model's own segmentation exactly if every two neighbouring pieces are
what the model makes of their joined text. So the step score is that of the
piece before (allowed or not), and at every boundary one backpointer survives.
Pieces have at most 16 characters: only that window of boundaries is held, and
ids are committed when all surviving backpointer paths run through one
boundary. The ids equal the library's for the same file.

No piece goes on over a blank or holds a newline, so paths always meet there;
the text between is looked up in a bounded table before the lattice is built.
Strings that lie within two windows commit at their end; the lattices of many
of them are worked through together, boundary by boundary.

Defined cases: a null or empty text has no ids and decodes to the empty text;
characters outside the vocabulary become byte pieces; rows are encoded one by
one, so ties and repeated rows do not matter; a text without any blank is
worked through in the window; a text that itself holds the blank's stand-in
U+2581 decodes with blanks there, and ``round_trip`` says so; other columns
are carried, columns named like the results are replaced; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from layerlens.llm.common import Words, give_back, text_bytes, text_slices
from layerlens.llm.idtable import IdTable

BLANK = "\u2581"
SPAN = 1 << 21  # more than there are symbols: pieces, then code points
CACHE_STRINGS = 500_000
PAIRS = 200_000


class PieceLattice:
    def __init__(self, model_path: str, limit: int = PAIRS):
        import sentencepiece

        self.limit = limit

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.id = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.id))
        self.begins = {p[:n] for p in self.id for n in range(1, len(p) + 1)}
        self.pairs: dict[int, bool] = {}
        self.pair_key, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self._number_trie()

    def _number_trie(self) -> None:
        """The trie of all pieces in arrays: sorted ``node * letters + letter``
        with the node it leads to, and the piece that ends at a node."""
        letters = sorted({c for p in self.id for c in p})
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.letters = len(letters)
        node = {"": 0}
        for p in sorted(self.begins, key=len):
            node[p] = len(node)
        edge = [node[p[:-1]] * self.letters + int(self.letter[ord(p[-1])]) for p in node if p]
        order = np.argsort(np.array(edge, np.int64))
        self.edge, self.child = np.array(edge, np.int64)[order], order + 1
        self.ending = np.fromiter((self.id.get(p, -1) for p in node), np.int64, len(node))

    def merged(self, text: str) -> list[str]:
        """What the model makes of a short text: the best-scored joinable
        neighbours are joined first, the left ones of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def allowed(self, left: str, right: str) -> bool:
        # unknown single characters are numbered after the pieces
        a, b = (self.id.get(p, -1) for p in (left, right))
        key = (a if a >= 0 else len(self.pieces) + ord(left)) * SPAN + (b if b >= 0 else len(self.pieces) + ord(right))
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(left + right) == [left, right]
        return known

    def symbol_text(self, symbol: int) -> str:
        return self.pieces[symbol] if symbol < len(self.pieces) else chr(symbol - len(self.pieces))

    def _all_allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``allowed`` for many pairs of symbols."""
        key, back = np.unique(left * SPAN + right, return_inverse=True)
        place = np.minimum(np.searchsorted(self.pair_key, key), max(0, len(self.pair_key) - 1))
        known = self.pair_key[place] == key if len(self.pair_key) else np.zeros(len(key), bool)
        ok = np.zeros(len(key), bool)
        ok[known] = self.pair_ok[place[known]]
        new = key[~known]
        if len(new):
            texts = ((self.symbol_text(k // SPAN), self.symbol_text(k % SPAN)) for k in new.tolist())
            ok[~known] = judged = np.fromiter((self.merged(a + b) == [a, b] for a, b in texts), bool, len(new))
            if len(self.pair_key) + len(new) > self.limit:
                self.pair_key, self.pair_ok = new[:0], judged[:0]
            if len(new) <= self.limit:
                both = np.concatenate((self.pair_key, new))
                order = np.argsort(both, kind="stable")
                self.pair_key, self.pair_ok = both[order], np.concatenate((self.pair_ok, judged))[order]
        return ok[back]

    def _step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Nodes one character further, -1 where no piece goes on."""
        edge = node * self.letters + letter
        at = np.minimum(np.searchsorted(self.edge, edge), len(self.edge) - 1)
        return np.where((self.edge[at] == edge) & (letter >= 0), self.child[at], -1)

    def segment_many(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all strings joined, and how many each has: the lattices
        of all strings advance by one boundary at a time. For strings of at
        most two windows, whose paths are committed at their end."""
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        first = np.cumsum(size) - size
        code = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4").astype(np.int64)
        letter = self.letter[code]
        wide = int(size.max(initial=0)) + 1
        begin = np.zeros((len(strings), wide), np.int16)
        symbol = np.full((len(strings), wide), -1, np.int64)
        for at in range(wide - 1):
            row = np.flatnonzero(size > at)
            node = np.zeros(len(row), np.int64)
            found = []
            for end in range(at + 1, min(wide, at + self.longest + 1)):
                inside = size[row] >= end
                row, node = row[inside], node[inside]
                if not len(row):
                    break
                c = first[row] + end - 1
                node = self._step(node, letter[c])
                on = node >= 0
                piece = np.where(on, self.ending[node], -1)
                if end == at + 1:  # a character outside the vocabulary
                    piece = np.where(piece < 0, len(self.pieces) + code[c], piece)
                new = (piece >= 0) & (symbol[row, end] < 0)
                found.append((row[new], np.full(int(new.sum()), end), piece[new]))
                row, node = row[on], node[on]
            row, end, piece = (np.concatenate(x) for x in zip(*found))
            if at:
                ok = self._all_allowed(symbol[row, at], piece)
                row, end, piece = row[ok], end[ok], piece[ok]
            begin[row, end], symbol[row, end] = at, piece
        # back from the ends, all strings at once
        row, at, steps = np.flatnonzero(size), size[size > 0], []
        while len(row):
            steps.append((row, at, symbol[row, at]))
            at = begin[row, at].astype(np.int64)
            row, at = row[at > 0], at[at > 0]
        if not steps:
            return np.zeros(0, np.int64), size
        row, at, piece = (np.concatenate(x) for x in zip(*steps))
        return piece[np.argsort(row * wide + at)], np.bincount(row, minlength=len(strings))

    def segment(self, text: str) -> Iterator[str]:
        """Pieces of ``text``, each yielded as soon as it is certain."""
        done = 0  # boundary up to which pieces are committed
        sure = None  # the last committed piece
        last: dict[int, tuple[int, str]] = {}  # boundary: where its last piece begins, and the piece
        n = len(text)
        for at in range(n):
            before = last[at][1] if at > done else sure
            for end in range(at + 1, min(n, at + self.longest) + 1):
                piece = text[at:end]
                if piece not in self.begins:
                    if end == at + 1:  # a character outside the vocabulary
                        last[end] = (at, piece)
                    break
                if end in last:
                    continue  # its one surviving piece is known
                if (piece in self.id or end == at + 1) and (before is None or self.allowed(before, piece)):
                    last[end] = (at, piece)
            if at - done >= 2 * self.longest and at + 1 < n:
                meet = self._meeting(last, done, at + 1)
                if meet > done:
                    yield from self._path(last, done, meet)
                    done, sure = meet, last[meet][1]
                    last = {e: v for e, v in last.items() if e > done}
        yield from self._path(last, done, n)

    @staticmethod
    def _meeting(last: dict, done: int, at: int) -> int:
        """The latest boundary that the paths to all boundaries from ``at`` on
        run through."""
        heads = {e for e in last if e >= at}
        while len(heads) > 1:
            top = max(heads)
            heads.discard(top)
            heads.add(last[top][0])
        return heads.pop()

    @staticmethod
    def _path(last: dict, done: int, end: int) -> list[str]:
        out = []
        while end > done:
            begin, piece = last[end]
            out.append(piece)
            end = begin
        return out[::-1]

    def ids_many(self, strings: list[str]) -> list[np.ndarray]:
        """``ids`` of each string."""
        out: list = [None] * len(strings)
        short = [i for i, x in enumerate(strings) if len(x) <= 2 * self.longest]
        symbols, size = self.segment_many([strings[i] for i in short])
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(short)), size)
        unknown = np.zeros(len(short), bool)  # characters that become bytes
        unknown[owner[symbols >= len(self.pieces)]] = True
        symbols = symbols.astype(np.int32)
        for i, a, b, other in zip(short, (ends - size).tolist(), ends.tolist(), unknown.tolist()):
            if not other:
                out[i] = symbols[a:b]
        return [np.array(self.ids(strings[i]), np.int32) if x is None else x for i, x in enumerate(out)]

    def ids(self, text: str) -> list[int]:
        """Ids of text in which blanks are replaced by their stand-in."""
        out: list[int] = []
        for piece in self.segment(text):
            i = self.id.get(piece)
            if i is None:
                out.extend([self.byte[b] for b in piece.encode("utf-8")])
            else:
                out.append(i)
        return out

    def decode(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            b = self.of_byte.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def blocks_of(texts: pa.Array) -> Words:
    """Texts with a blank put before them, cut before each run of blanks and
    around newlines."""
    full = pc.if_else(pc.greater(pc.binary_length(pc.fill_null(texts, "")), 0), texts, "")
    full = pc.if_else(pc.equal(full, ""), "", pc.binary_join_element_wise(" ", full, ""))
    offsets, data = text_bytes(full)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(len(texts) + 1, np.int64))
    blank, line = data == 0x20, data == 0x0A
    cut = line.copy()
    held = blank.copy()  # blanks and the last byte of their stand-in
    held[2:] |= (data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2)
    cut[1:] |= line[:-1] | (blank[1:] & ~held[:-1])
    cut[0] = True
    cut[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(cut)
    first = np.searchsorted(start, offsets, side="left")
    first[-1] = len(start)
    return Words(data, start, np.r_[start[1:], n], np.repeat(np.arange(len(texts)), np.diff(first)), first)


class Codec:
    def __init__(self, model_path: str, strings: int = CACHE_STRINGS, pairs: int = PAIRS):
        self.lattice = PieceLattice(model_path, pairs)
        self.table = IdTable(self._learn, np.int32, strings)
        surface = [b""] * len(self.lattice.pieces)
        for i, p in enumerate(self.lattice.pieces):
            b = self.lattice.of_byte.get(i)
            surface[i] = bytes([b]) if b is not None else p.replace(BLANK, " ").encode("utf-8")
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.width = np.fromiter(map(len, surface), np.int64, len(surface))
        self.at = np.cumsum(self.width) - self.width

    def _learn(self, strings: list[bytes]) -> list[np.ndarray]:
        return self.lattice.ids_many([b.decode("utf-8").replace(" ", BLANK) for b in strings])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        w = blocks_of(texts)
        ids, size = self.table.ids(w.hashes(), w.data.tobytes(), w.start, w.end)
        return ids, np.bincount(w.row, weights=size, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[bytes]:
        """UTF-8 of each text: the surfaces of its ids joined, without the
        blank put before it."""
        width = self.width[ids]
        ends = np.cumsum(width)
        flat = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[ids] - (ends - width), width)
        data = self.surface[flat].tobytes()
        stop = np.r_[0, ends][np.cumsum(size)].tolist()
        return [data[a:b][1:] if data[a : a + 1] == b" " else data[a:b] for a, b in zip([0, *stop[:-1]], stop)]


_CODECS: dict[tuple[str, int, int], Codec] = {}


def codec_of(model_path: str, strings: int = CACHE_STRINGS, pairs: int = PAIRS) -> Codec:
    """One codec per worker process, kept over its tasks."""
    key = (model_path, strings, pairs)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode(
    docs: DataFrame,
    model_path: str,
    strings: int = CACHE_STRINGS,
    pairs: int = PAIRS,
    then: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str] | None = None,
) -> DataFrame:
    """``docs`` without ``text``, with ``ids`` (array of int), ``n_ids`` and
    ``round_trip`` (the ids decode to the text). ``strings`` and ``pairs``
    bound the tables of what a worker has met; they change speed only.
    ``then``, a function of these batches and the schema it gives, runs in the
    same task, so that ids it only sums up need not leave the worker."""
    docs = docs.drop("ids", "n_ids", "round_trip")
    carried = [c for c in docs.columns if c != "text"]
    at = docs.columns.index("text")
    schema = f"{docs.drop('text')._jdf.schema().toDDL()}, ids array<int>, n_ids long, round_trip boolean"

    def run(batches):
        codec = codec_of(model_path, strings, pairs)
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column(at)
                ids, size = codec.encode(texts)
                back = codec.decode(ids, size)
                same = [b == (t or "").encode("utf-8") for b, t in zip(back, texts.to_pylist())]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(ids, pa.int32()))
                kept = [part.column(part.schema.get_field_index(c)) for c in carried]
                yield pa.RecordBatch.from_arrays(
                    [*kept, lists, pa.array(size, pa.int64()), pa.array(same, pa.bool_())],
                    names=[*carried, "ids", "n_ids", "round_trip"],
                )
        give_back()

    if then is None:
        return docs.mapInArrow(run, schema)
    after, schema = then
    return docs.mapInArrow(lambda batches: after(run(batches)), schema)
