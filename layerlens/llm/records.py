"""Token-ID output: length-delimited binary records in shards, and a separate
offset index for reads in any order.

A record is

    length   u32  bytes of the payload
    check    u32  masked CRC-32 of the 4 length bytes
    payload       flags u8 (bit 0: id is null, bit 1: 4-byte tokens),
                  doc_id i64, token ids (u16, or u32 for large vocabularies)
    check    u32  masked CRC-32 of the payload
    0x0A          end mark

all little-endian. A mask is a rotation by 15 bits and an added constant, so
that a checksum of data that holds checksums stays meaningful. Shards are
written by Spark in ascending doc_id order (file names sort in that order) and
hold at most ``SHARD_RECORDS`` records. The index has one row per record.

Defined cases: a null or empty text has only the end id; a null doc_id sorts
first and is kept; rows with the same doc_id are separate records in order of
their text's hash; an empty table gives no shard rows; other columns are
ignored. A damaged record raises an error when it is read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerlens.llm.common import LOWER as _LOWER
from layerlens.llm.common import Words, give_back, scan, text_slices
from layerlens.llm.idtable import IdTable

SHARD_RECORDS = 1000
CACHE_WORDS = 1_500_000
MASK_ADD = 0xA282EAD8  # fixed value of the masking rule


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    """A record without its end mark, which the writer adds."""
    payload = struct.pack("<Bq", (doc_id is None) | (wide << 1), doc_id or 0) + ids
    head = struct.pack("<I", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


_LETTER_OR_DIGIT = np.zeros(256, bool)
_LETTER_OR_DIGIT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_POINT = np.zeros(256, bool)
_POINT[list(b".,;:!?")] = True
_AS_IS = np.zeros(256, bool)  # words with such bytes are not lower-cased here
_AS_IS[0x80:] = True
_AS_IS[ord("<")] = True


def pieces_of(w: Words) -> tuple[Words, np.ndarray]:
    """Cut words into a core and the points after it, ASCII words in lower
    case; the second value is the text of each piece."""
    n = len(w.start)
    if not n:
        return w, w.row
    marked = np.zeros(len(w.data) + 1, np.int32)
    np.cumsum(_AS_IS[w.data], out=marked[1:])
    raw = marked[w.end] > marked[w.start]
    data = _LOWER[w.data]
    if raw.any():
        edge = np.zeros(len(data) + 1, np.int8)
        edge[w.start[raw]] += 1
        edge[w.end[raw]] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        data[inside] = w.data[inside]
    solid = np.where(_POINT[w.data], -1, np.arange(len(w.data)))
    stop = np.maximum.accumulate(solid)[w.end - 1] + 1
    cut = (stop > w.start) & (stop < w.end)
    cut[cut] = _LETTER_OR_DIGIT[w.data[stop[cut] - 1]]
    stop = np.where(cut, stop, w.end)
    place = np.arange(n) + np.cumsum(cut) - cut
    start, end = np.empty(n + int(cut.sum()), np.int64), np.empty(n + int(cut.sum()), np.int64)
    start[place], end[place] = w.start, stop
    start[place[cut] + 1], end[place[cut] + 1] = stop[cut], w.end[cut]
    row = np.repeat(w.row, 1 + cut)
    return Words(data, start, end, row, np.searchsorted(row, np.arange(len(w.first)))), row


class Encoder:
    """Ids of whole texts from the tokenizers library, asked once for each
    distinct piece that is not in a table of bounded size. Valid for
    tokenizers whose normaliser and splitter never join or look across a
    blank, lower-case ASCII letters, and part letters and digits from marks."""

    def __init__(self, vocab_path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(vocab_path)
        # lower-case letters below U+0250 (precomposed, no marks) pass
        # normaliser and splitter unchanged, so many such words can be asked
        # at once, parted by blanks; the ids that end a word show where each
        # one's ids stop
        ending = self.tok.model.end_of_word_suffix
        self.plain = Tokenizer(self.tok.model) if ending else None
        if ending:
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            self.last = np.zeros(self.tok.get_vocab_size(), bool)
            for piece, i in self.plain.get_vocab(with_added_tokens=False).items():
                self.last[i] = piece.endswith(ending)
        self.wide = self.tok.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.table = IdTable(self._ask, self.kind, cache_words)

    def _ask(self, strings: list[bytes]) -> list[np.ndarray]:
        words = [b.decode("utf-8") for b in strings]
        out: list = [None] * len(words)
        simple, cores, points = [], [], []
        if self.plain:
            for i, w in enumerate(words):
                core = w.rstrip(".,;:!?")
                if core.isalpha() and max(core) < "\u0250" and "\u0130" not in core:
                    simple.append(i)
                    cores.append(core.lower())
                    points.append(w[len(core) :])
        marks = {x: np.array(self.tok.encode(x, add_special_tokens=False).ids, self.kind) for x in set(points)}
        for lo in range(0, len(simple), 4096):
            some = simple[lo : lo + 4096]
            text = " ".join(cores[lo : lo + 4096])
            ids = np.array(self.plain.encode(text, add_special_tokens=False).ids, self.kind)
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not mark the ends of words")
            for i, a, b, x in zip(some, [0, *ends], ends, points[lo : lo + 4096]):
                out[i] = np.concatenate((ids[a:b], marks[x])) if x else ids[a:b]
        others = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(others), 4096):
            some = others[lo : lo + 4096]
            for i, e in zip(some, self.tok.encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
                out[i] = np.array(e.ids, self.kind)
        return out

    def encode(self, texts: pa.Array, end_id: int) -> list[bytes]:
        """The ids of each text and the end id, as bytes."""
        w, row = pieces_of(scan(texts))
        ids, size = self.table.ids(w.hashes(), w.data.tobytes(), w.start, w.end)
        ends = np.cumsum(np.bincount(row, weights=size, minlength=len(texts)).astype(np.int64)) * self.kind.itemsize
        data, tail = ids.tobytes(), np.array([end_id], self.kind).tobytes()
        return [data[a:b] + tail for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(vocab_path: str) -> Encoder:
    """One encoder per worker process, kept over its tasks."""
    if vocab_path not in _ENCODERS:
        _ENCODERS[vocab_path] = Encoder(vocab_path)
    return _ENCODERS[vocab_path]


def write_records(docs: DataFrame, path: str, vocab_path: str, end_id: int) -> None:
    """Encode ``text`` of every row and write shards under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocab_path)
        for batch in batches:
            for part in text_slices(batch):
                ids = encoder.encode(part.column(1), end_id)
                rows = [frame(d, x, encoder.wide) for d, x in zip(part.column(0).to_pylist(), ids)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])
        give_back()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie", "text")
        .select("doc_id", "text")
    )
    # Spark's text writer puts the bytes of a string as they are and then the
    # line separator: the end mark of the format.
    (
        ordered.mapInArrow(run, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\n")
        .option("maxRecordsPerFile", SHARD_RECORDS)
        .text(path)
    )


def _walk(content: memoryview) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(content):
        (n, check) = struct.unpack_from("<II", content, at)
        if masked(bytes(content[at : at + 4])) != check:
            raise ValueError(f"damaged length at byte {at}")
        yield at, n
        at += n + 13


INDEX = "shard string, part int, record long, offset long, n_bytes long, doc_id long, n_tokens long"


def write_index(spark: SparkSession, path: str, index_path: str) -> None:
    """Scan the frames of all shards once and write the offset index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = memoryview(content.as_buffer())
                rows = []
                for i, (at, n) in enumerate(_walk(view)):
                    flags, doc = struct.unpack_from("<Bq", view, at + 8)
                    rows.append((i, at, n + 13, None if flags & 1 else doc, (n - 9) // (4 if flags & 2 else 2)))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(rows), pa.string()),
                        pa.array([_part(shard)] * len(rows), pa.int32()),
                        *[pa.array(c, pa.int64()) for c in cols],
                    ],
                    names=["shard", "part", "record", "offset", "n_bytes", "doc_id", "n_tokens"],
                )

    _shards(spark, path).mapInArrow(run, INDEX).write.parquet(index_path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    # one file is one row: few rows per Arrow batch keep memory at some files
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    )


def _part(shard: str) -> int:
    """Number of the writing task, from a name part-NNNNN-..."""
    return int(shard.split("-")[1])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records, checked: ``shard, part, record, doc_id, ids`` where
    ``ids`` are the little-endian 32-bit ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = memoryview(content.as_buffer())
                for rows in _grouped(_walk(view), 256):
                    docs, ids = [], []
                    for _, (at, n) in rows:
                        doc, x = _parse(view[at : at + n + 13])
                        docs.append(doc)
                        ids.append(x)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard] * len(rows), pa.string()),
                            pa.array([_part(shard)] * len(rows), pa.int32()),
                            pa.array([i for i, _ in rows], pa.int64()),
                            pa.array(docs, pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        names=["shard", "part", "record", "doc_id", "ids"],
                    )

    return _shards(spark, path).mapInArrow(run, "shard string, part int, record long, doc_id long, ids binary")


def _grouped(items: Iterator[tuple[int, int]], n: int) -> Iterator[list]:
    some: list = []
    for x in enumerate(items):
        some.append(x)
        if len(some) == n:
            yield some
            some = []
    if some:
        yield some


def _parse(record: memoryview) -> tuple[int | None, bytes]:
    (n,) = struct.unpack_from("<I", record, 0)
    payload = bytes(record[8 : 8 + n])
    if struct.unpack_from("<I", record, 8 + n)[0] != masked(payload) or record[n + 12] != 10:
        raise ValueError("damaged record")
    flags, doc = struct.unpack_from("<Bq", payload, 0)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")
    return None if flags & 1 else doc, ids.tobytes()


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Records that rows of an index (or a shuffled choice of them, repeats
    included) name: each is cut out of its shard by offset and length and
    checked. Returns the columns of ``wanted`` and ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_record")
            ids = [_parse(memoryview(x.as_buffer()))[1] for x in batch.column(at)]
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for n in batch.schema.names if n != "_record"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.binary())], names=[*names, "ids"])

    cut = F.expr("substring(content, int(offset) + 1, int(n_bytes))")
    rows = wanted.join(_shards(spark, path), "shard").withColumn("_record", cut).drop("content")
    schema = rows.drop("_record").schema.add("ids", "binary")
    return rows.mapInArrow(run, schema)


def with_start(records: DataFrame, index: DataFrame) -> DataFrame:
    """Add ``start``: tokens of all records before, in file order. Totals of
    the writing tasks (as many as partitions) are summed up first, then the
    records within each task's shards."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = index.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base")
    )
    # names sort as text only up to 1000 files of a task: c1000 is after c999
    file = F.nullif(F.regexp_extract("shard", r"-c(\d+)\.", 1), F.lit("")).cast("long")
    inner = Window.partitionBy("part").orderBy(file, "shard", "record").rowsBetween(Window.unboundedPreceding, -1)
    return (
        records.join(base, "part")
        .withColumn("start", F.col("_base") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
        .drop("_base")
    )
