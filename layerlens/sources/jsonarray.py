"""One JSON array read by many tasks.

Spark's text source cuts a file into byte ranges and, with a comma as the line
end, every range begins after a comma. What a range does to the place in the
JSON text depends only on whether it begins inside a string: its map says for
both cases whether it ends inside one and by how much the depth changes, and
at which depths its commas stand. The maps of all ranges (a few numbers each)
are composed in file order, which gives every range its true start. Then each
range cuts its own text at the commas between elements; elements that go over
a range's end are put together from their pieces. A file that is one small
range anyway is read whole, in one pass: it begins outside a string and outside
the array, and no element goes over its end.

Defined cases: commas, brackets and escaped quotes inside strings part
nothing; blanks and line ends may stand anywhere; an empty array gives no
rows; several files are several arrays; nested arrays and objects belong to
their element; a file that is no array, or ends inside one, fails the read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlens.session import materialize

QUOTE, ESCAPE, COMMA = 0x22, 0x5C, 0x2C
WHOLE_BYTES = 4 << 20  # the largest file that is read whole
_MARK = np.zeros(256, bool)
_MARK[[0x5B, 0x7B, 0x5D, 0x7D, QUOTE, COMMA]] = True
_CHANGE = np.zeros(256, np.int8)
_CHANGE[[0x5B, 0x7B]] = 1
_CHANGE[[0x5D, 0x7D]] = -1


def _marks(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where quotes that are not escaped, brackets and commas are, and which
    of them they are. A quote is escaped by an odd number of backslashes."""
    at = np.flatnonzero(_MARK[d])
    if (d == ESCAPE).any():
        quote = np.flatnonzero(d[at] == QUOTE)
        plain = np.flatnonzero(d != ESCAPE)
        before = np.searchsorted(plain, at[quote]) - 1  # last byte before that is no backslash
        last = np.where(before >= 0, plain[before], -1)
        at = np.delete(at, quote[(at[quote] - 1 - last) % 2 == 1])
    return at, d[at]


def _places(mark: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether each mark is inside a string, and the depth after it."""
    within = (np.cumsum(mark == QUOTE) + int(inside)) % 2 == 1
    return within, np.cumsum(np.where(within, 0, _CHANGE[mark]), dtype=np.int64)


def range_map(d: np.ndarray) -> list[tuple[bool, int, list[int]]]:
    """For a start outside and inside a string: whether the range ends inside
    one, the change of depth, and the depths (from its start) of its commas."""
    out, mark = [], _marks(d)[1]
    for inside in (False, True):
        within, depth = _places(mark, inside)
        commas = np.unique(depth[(mark == COMMA) & ~within]).tolist()
        out.append((bool(within[-1]) if len(mark) else inside, int(depth[-1]) if len(mark) else 0, commas))
    return out


def compose(maps: list[list[tuple[bool, int, list[int]]]]) -> list[tuple[bool, int, int]]:
    """From the maps of a file's ranges in order: where each begins (inside a
    string, depth), and the number of the range in which its first element
    began."""
    inside, depth, owner, out = False, 0, -1, []
    for i, m in enumerate(maps):
        out.append((inside, depth, owner))
        ends, change, commas = m[inside]
        if 1 - depth in commas:
            owner = i
        inside, depth = ends, depth + change
    if maps and (inside or depth):
        raise ValueError("a JSON array does not end in its file")
    return out


def _cut(d: np.ndarray, inside: bool, depth: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The range's text without the array's own brackets and the commas
    between elements, and the offsets of the pieces in it: the first piece
    goes on the element before. A ``whole`` file also ends its array."""
    at, mark = _marks(d)
    within, after = _places(mark, inside)
    after = after + depth
    if whole and len(mark) and (within[-1] or after[-1]):
        raise ValueError("a JSON array does not end in its file")
    comma = (mark == COMMA) & ~within & (after == 1)
    change = _CHANGE[mark]
    plain = ~within & (((change > 0) & (after == 1)) | ((change < 0) & (after == 0)))
    if (~within & (change < 0) & (after < 0)).any() or (plain & (mark != 0x5B) & (mark != 0x5D)).any():
        raise ValueError("the file is not one JSON array")
    cuts, gone = at[comma], at[comma | plain]
    kept = np.delete(d, gone)
    return kept, np.r_[0, cuts - np.searchsorted(gone, cuts), len(kept)]


def elements(d: np.ndarray, inside: bool, depth: int) -> list[bytes]:
    """The pieces of ``_cut``."""
    kept, ends = _cut(d, inside, depth)
    text, ends = kept.tobytes(), ends.tolist()
    return [text[a:b] for a, b in zip(ends, ends[1:])]


def _ranges(spark: SparkSession, path: str, over: int = -1) -> DataFrame:
    """``file, start, text``: the rows of every range in order, of files of
    more than ``over`` bytes."""
    rows = spark.read.option("lineSep", ",").text(path).where(F.col("_metadata.file_size") > over)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _joined(batches):
    """``(file, start), bytes`` of each range of a task: the rows of a range
    follow one another. Every row is followed by the comma that ended it."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        files = batch.column(0).dictionary_encode()
        code, start = files.indices.to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (start[1:] != start[:-1])]).tolist()
        runs = pa.ListArray.from_arrays(pa.array([*cuts, batch.num_rows], pa.int32()), batch.column(2))
        for at, text in zip(cuts, pc.binary_join(runs, ",").cast(pa.binary())):
            own = (files.dictionary[int(code[at])].as_py(), int(start[at]))
            if own != key:
                if key is not None:
                    yield key, b",".join(parts) + b","
                key, parts = own, []
            parts.append(text.as_py())
    if key is not None:
        yield key, b",".join(parts) + b","


def _whole(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """``element`` of the files of at most ``limit`` bytes."""

    def run(batches):
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                kept, ends = _cut(np.frombuffer(text.as_buffer(), np.uint8), False, 0, whole=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(kept)])],
                    names=["element"],
                )

    files = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_size") <= limit)
    return files.select("value").mapInArrow(run, "element string")


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """``element``: the JSON text of every element of the arrays at ``path``."""
    limit = min(WHOLE_BYTES, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    both = _whole(spark, path, limit).unionByName(_of_ranges(spark, path, limit))
    return both.where(F.col("element").rlike(r"[^\x20\t\r\n]"))


def _of_ranges(spark: SparkSession, path: str, over: int) -> DataFrame:
    """``element`` of the files of more than ``over`` bytes."""

    def mapped(batches):
        for (f, s), text in _joined(batches):
            m = range_map(np.frombuffer(text, np.uint8))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * 2), pa.array([s] * 2, pa.int64()), pa.array([0, 1], pa.int32()), pa.array([int(x[0]) for x in m], pa.int32()),
                 pa.array([x[1] for x in m], pa.int64()), pa.array([x[2] for x in m], pa.list_(pa.int64()))],
                names=["file", "start", "inside", "ends", "change", "commas"],
            )

    found = _ranges(spark, path, over).mapInArrow(mapped, "file string, start long, inside int, ends int, change long, commas array<long>")
    # two rows a range, whatever the size of the ranges
    ranges_of = found.collect()
    if not ranges_of:
        return spark.createDataFrame([], "element string")
    files: dict[str, dict[int, list]] = {}
    for r in ranges_of:
        files.setdefault(r["file"], {}).setdefault(r["start"], [None, None])[r["inside"]] = (bool(r["ends"]), r["change"], list(r["commas"]))
    begin = {}
    for f, ranges in files.items():
        order = sorted(ranges)
        begin |= {(f, s): (*b, i, i == len(order) - 1) for i, (s, b) in enumerate(zip(order, compose([ranges[s] for s in order])))}
    shared = spark.sparkContext.broadcast(begin)

    def cut(batches):
        for (f, s), text in _joined(batches):
            inside, depth, owner, number, last = shared.value[f, s]
            if last:  # the file's last row has no comma after it
                text = text[:-1]
            got = elements(np.frombuffer(text, np.uint8), inside, depth)
            # pieces at both ends are one element with those of other ranges
            keys = [owner] + [None] * (len(got) - 2) + ([number] if len(got) > 1 else [])
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * len(got)), pa.array(keys, pa.int64()), pa.array([2 * number + (i > 0) for i in range(len(got))], pa.int64()),
                 pa.array(got, pa.binary())],
                names=["file", "owner", "place", "piece"],
            )

    pieces = materialize(_ranges(spark, path, over).mapInArrow(cut, "file string, owner long, place long, piece binary"))
    whole = pieces.where("owner is null").select(F.col("piece").cast("string").alias("element"))
    ends = pieces.where("owner is not null").groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("p"))
    # as many pieces as the element has ranges
    text = F.concat_ws("", F.transform("p", lambda x: F.hex(x["piece"])))
    joined = ends.select(F.unhex(text).cast("string").alias("element"))
    return whole.unionByName(joined)

