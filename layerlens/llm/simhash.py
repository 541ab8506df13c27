"""SimHash near-duplicates by a binary trie joined with itself.

A text's fingerprint has 64 bits; a bit is set if it is set in more than half
of the XXH64 hashes of its word shingles (repeats included). Texts link when
their fingerprints differ in at most ``budget`` bits.

Distinct fingerprints are the leaves of a binary trie over their bits, the
first bit at the root. Two nodes are traversed together: to the pairs of their
children, with the differing bits added up, until the budget is exceeded or
both are leaves. The trie is cut into subtries that hold a bounded share of
all fingerprints (deeper where there are more). First each subtrie meets
itself, then every two subtries whose first bits are within the budget meet in
one task, wherever they are.

Only connection is asked for, so a pair of nodes whose leaves are all known to
be in one component needs no traversal. The budget goes up from 0 by one: the
few links of small distance connect a group of many near copies, and the wider
passes skip it instead of listing all its pairs.

Defined cases: a null or empty text, or one without words, has fingerprint 0,
which links like any other; a text with fewer words than a shingle is one
shingle; rows with equal ids are one document (their components are joined);
rows without an id are documents of their own, with the smallest id that they
reach or null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import LOWER, give_back, text_slices
from layerlens.llm.components import components
from layerlens.session import materialize

SHINGLE = 3
SEED = 42
BUDGET = 3
VOTES = 1 << 15  # shingles whose bits are unpacked at once
CUT_BITS = 16  # subtries begin at most so deep
LEAVES = 1 << 15  # fingerprints of a subtrie, unless there are too many subtries
SUBTRIES = 1 << 12
BUCKET = 64  # pairs of leaves below two nodes that are compared at once
FRONTIER = 1 << 14  # node pairs expanded at once
_FOLD = LOWER.tobytes()


# --------------------------------------------------------------- fingerprints


def _majority(hashes: np.ndarray, votes: np.ndarray) -> None:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    votes += bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text; the bits of long texts are counted in parts."""
    from xxhash import xxh64_intdigest

    words = text.translate(_FOLD).split()  # splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(starts), VOTES):
        part = zip(starts[lo : lo + VOTES], ends[lo : lo + VOTES])
        h = [xxh64_intdigest(joined[a:b], seed) for a, b in part]
        _majority(np.array(h, np.uint64), votes)
    over = (2 * votes > len(starts)).astype(np.uint8)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` (64 bits as a long) of each row."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                fp = np.fromiter((fingerprint(t or b"", shingle, seed) for t in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------------- the trie


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Trie:
    """Sorted distinct fingerprints. A node at a depth is a run of leaves that
    share so many first bits: ``lo, hi``. ``label`` names each leaf's
    component; ``root`` follows components joined since."""

    def __init__(self, leaves: np.ndarray, label: np.ndarray):
        self.leaves = leaves
        self.name, own = np.unique(label, return_inverse=True)
        self.comp = own.astype(np.int64)
        self.root = np.arange(len(self.name))
        self.links: list[tuple[int, int]] = []
        self.fresh()

    def fresh(self) -> None:
        """Leaves under their present components, and for each leaf the end
        of the run of leaves of one component that begins there."""
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                break
            self.root = up
        self.comp = self.root[self.comp]
        change = np.flatnonzero(self.comp[1:] != self.comp[:-1]) + 1
        ends = np.r_[change, len(self.comp)]
        self.run = np.repeat(ends, np.diff(np.r_[0, ends]))

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Join the components of leaves ``x`` and ``y``, one link each."""
        a, b = self.tops(self.comp[x]), self.tops(self.comp[y])
        pairs = np.unique((a * len(self.name) + b)[a != b])
        for pair in pairs.tolist():
            a, b = (self.top(c) for c in divmod(pair, len(self.name)))
            if a != b:
                self.root[max(a, b)] = min(a, b)
                self.links.append((a, b))

    def top(self, c: int) -> int:
        root = self.root
        while root[c] != c:
            root[c] = root[root[c]]
            c = int(root[c])
        return c

    def tops(self, c: np.ndarray) -> np.ndarray:
        c = self.root[c]
        while True:
            up = self.root[c]
            if np.array_equal(up, c):
                return c
            c = up

    def traverse(self, start: tuple[int, int, int, int, int, int], budget: int) -> None:
        """Join what is within ``budget``, from one pair of nodes
        ``lo, hi, lo, hi, depth, errors`` down."""
        stack = [(np.array([start[:4]], np.int64).T, start[4], np.array([start[5]], np.int64))]
        while stack:
            (a, b, x, y), depth, spent = stack.pop()
            # one component on both sides: nothing to find below
            one = (self.run[a] >= b) & (self.run[x] >= y)
            known = np.zeros(len(a), bool)
            known[one] = self.tops(self.comp[a[one]]) == self.tops(self.comp[x[one]])
            few = (b - a) * (y - x) <= BUCKET
            self.compare(*(z[few & ~known] for z in (a, b, x, y)), budget)
            go = ~(known | few)
            if not go.any():
                continue
            a, b, x, y, spent = a[go], b[go], x[go], y[go], spent[go]
            m, n = self.middle(a, b, depth), self.middle(x, y, depth)
            same = a == x  # a node with itself: its halves meet once
            child = []
            for p, q, r, s, cost in ((a, m, x, n, 0), (m, b, n, y, 0), (a, m, n, y, 1), (m, b, x, n, 1)):
                keep = (p < q) & (r < s) & (spent + cost <= budget)
                if p is m and cost:
                    keep &= ~same
                child.append((np.stack([p[keep], q[keep], r[keep], s[keep]]), spent[keep] + cost))
            nodes = np.concatenate([c[0] for c in child], axis=1)
            errors = np.concatenate([c[1] for c in child])
            for lo in range(0, len(errors), FRONTIER):
                stack.append((nodes[:, lo : lo + FRONTIER], depth + 1, errors[lo : lo + FRONTIER]))

    def compare(self, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, budget: int) -> None:
        """Join leaves of small nodes whose whole fingerprints are near."""
        wide, count = y - x, (b - a) * (y - x)
        if not len(count):
            return
        ends = np.cumsum(count)
        nth = np.arange(int(ends[-1])) - np.repeat(ends - count, count)
        down = nth // np.repeat(wide, count)
        i = np.repeat(a, count) + down
        j = np.repeat(x, count) + nth - down * np.repeat(wide, count)
        near = (differing(self.leaves[i], self.leaves[j]) <= budget) & (i < j)
        self.join(i[near], j[near])

    def middle(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Where the leaves whose bit at ``depth`` is set begin."""
        left, right = lo.copy(), hi.copy()
        bit = np.uint64(1) << np.uint64(63 - depth)
        while True:
            open_ = left < right
            if not open_.any():
                return left
            at = (left + right) >> 1
            one = (self.leaves[np.minimum(at, len(self.leaves) - 1)] & bit) != 0
            right = np.where(open_ & one, at, right)
            left = np.where(open_ & ~one, at + 1, left)


def within(leaves: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """Component (its smallest fingerprint) of each of the sorted distinct
    fingerprints of one subtrie."""
    trie = Trie(leaves, np.arange(len(leaves)))
    for k in range(1, budget + 1):
        trie.traverse((0, len(leaves), 0, len(leaves), depth, 0), k)
        trie.fresh()
    return leaves[trie.name[trie.comp]]


def between(a: np.ndarray, label_a: np.ndarray, b: np.ndarray, label_b: np.ndarray, depth: int, spent: int, budget: int):
    """Links (pairs of labels) that connect two subtries which differ in
    ``spent`` of their first ``depth`` bits."""
    trie = Trie(np.concatenate((a, b)), np.concatenate((label_a, label_b)))
    for k in range(spent, budget + 1):
        trie.traverse((0, len(a), len(a), len(a) + len(b), depth, spent), k)
        trie.fresh()
    x, y = np.array(trie.links, np.int64).reshape(-1, 2).T
    return trie.name[x], trie.name[y]


# ---------------------------------------------------------------- the subtries


def cut(counts: dict[int, int], leaves: int) -> list[tuple[int, int]]:
    """Subtries ``(first bits, depth)``, in order: nodes with more than
    ``leaves`` fingerprints are cut further, down to ``CUT_BITS``."""
    total = np.zeros(1 << CUT_BITS, np.int64)
    for k, n in counts.items():
        total[k] = n
    sums = np.concatenate(([0], np.cumsum(total)))
    out = []

    def walk(prefix: int, depth: int) -> None:
        lo, hi = prefix << (CUT_BITS - depth), (prefix + 1) << (CUT_BITS - depth)
        n = sums[hi] - sums[lo]
        if n and (n <= leaves or depth == CUT_BITS):
            out.append((prefix, depth))
        elif n:
            walk(2 * prefix, depth + 1)
            walk(2 * prefix + 1, depth + 1)

    walk(0, 0)
    return out


def met(nodes: list[tuple[int, int]], budget: int) -> list[tuple[int, int, int, int]]:
    """Every two subtries ``(i, j, depth, errors)``, ``i < j``, whose common
    first bits differ in at most ``budget``: a traversal of the trie above
    them, node pairs together."""
    first = np.array([p << (CUT_BITS - d) for p, d in nodes], np.int64)
    out = []
    stack = [(0, len(nodes), 0, len(nodes), 0, 0)]

    def halves(lo: int, hi: int, depth: int):
        if hi - lo == 1 and nodes[lo][1] <= depth:
            return None
        bit = 1 << (CUT_BITS - 1 - depth)
        mid = lo + int(np.searchsorted((first[lo:hi] & bit) != 0, True))
        return ((lo, mid, 0), (mid, hi, 1))

    while stack:
        a, b, x, y, depth, spent = stack.pop()
        left, right = halves(a, b, depth), halves(x, y, depth)
        if left is None or right is None:  # one is a subtrie: its depth is common
            if a != x:
                out.extend((min(i, j), max(i, j), depth, spent) for i in range(a, b) for j in range(x, y))
            continue
        for p, q, u in left:
            for r, s, v in right:
                if p < q and r < s and spent + (u != v) <= budget and (a != x or u <= v):
                    stack.append((p, q, r, s, depth + 1, spent + (u != v)))
    return out


# --------------------------------------------------------------------- the job


def _subtrie(rows: DataFrame, nodes: list[tuple[int, int]]) -> DataFrame:
    """``node, fps``: each task's fingerprints packed by subtrie."""
    at = np.full(1 << CUT_BITS, -1, np.int32)
    for i, (p, d) in enumerate(nodes):
        at[p << (CUT_BITS - d) : (p + 1) << (CUT_BITS - d)] = i

    def run(batches):
        for batch in batches:
            fp = np.unique(batch.column(0).to_numpy().view(np.uint64))
            node = at[(fp >> np.uint64(64 - CUT_BITS)).astype(np.int64)]
            cuts = np.flatnonzero(np.diff(node)) + 1  # in order, as the fingerprints are
            parts = [x for x in np.split(fp, cuts) if len(x)]
            own = [int(x[0]) for x in np.split(node, cuts) if len(x)]
            yield pa.table({"node": pa.array(own, pa.int32()), "fps": pa.array([x.tobytes() for x in parts], pa.binary())}).combine_chunks().to_batches()[0]

    return rows.where("fp is not null").mapInArrow(run, "node int, fps binary")


def _unpack(column: pa.ChunkedArray) -> np.ndarray:
    parts = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def subtries(prints: DataFrame, nodes: list[tuple[int, int]], budget: int = BUDGET) -> DataFrame:
    """``node, fps, labels``: each subtrie's distinct fingerprints with their
    components inside the subtrie."""

    def run(key, table):
        leaves = np.unique(_unpack(table.column("fps")))
        node = key[0].as_py()
        label = within(leaves, nodes[node][1], budget)
        parts = range(0, len(leaves), LEAVES)  # a row has a bounded size
        give_back()
        return pa.table(
            {
                "node": pa.array([node] * len(parts), pa.int32()),
                "fps": pa.array([leaves[i : i + LEAVES].tobytes() for i in parts], pa.binary()),
                "labels": pa.array([label[i : i + LEAVES].tobytes() for i in parts], pa.binary()),
            }
        )

    # few bytes, much work: tasks by number, not by size
    packed = _subtrie(prints.select("fp").distinct(), nodes).repartition(max(1, len(nodes)), "node")
    return packed.groupBy("node").applyInArrow(run, "node int, fps binary, labels binary")


def links_between(tries: DataFrame, nodes: list[tuple[int, int]], budget: int = BUDGET) -> DataFrame:
    """``a, b``: links that connect the components of different subtries."""
    pairs = met(nodes, budget)
    spark = tries.sparkSession
    sides = [(n, k, s, depth, errors) for k, (i, j, depth, errors) in enumerate(pairs) for s, n in ((0, i), (1, j))]
    sides = spark.createDataFrame(sides, "node int, pair int, side int, depth int, errors int")

    def run(key, table):
        both = []
        for side in (0, 1):
            rows = table.filter(pa.array(table.column("side").to_numpy() == side))
            fps, labels = _unpack(rows.column("fps")), _unpack(rows.column("labels"))
            order = np.argsort(fps)
            both += [fps[order], labels[order]]
        x, y = between(*both, key[1].as_py(), key[2].as_py(), budget)
        give_back()
        return pa.table({"a": pa.array(x.view(np.int64), pa.int64()), "b": pa.array(y.view(np.int64), pa.int64())})

    met_rows = tries.join(sides, "node").select("pair", "depth", "errors", "side", "fps", "labels")
    met_rows = met_rows.repartition(max(1, min(len(pairs), 4 * len(nodes))), "pair")
    return met_rows.groupBy("pair", "depth", "errors").applyInArrow(run, "a long, b long")


def _labelled(tries: DataFrame) -> DataFrame:
    """``a, b``: each fingerprint and the smallest of its component."""

    def run(batches):
        for batch in batches:
            for fps, labels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(x, np.int64)) for x in (fps, labels)], names=["a", "b"]
                )

    return tries.select("fps", "labels").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, budget: int = BUDGET) -> DataFrame:
    """``doc_id, fp, component_id`` of each row."""
    prints = materialize(fingerprints(docs, shingle, seed))
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    counts = own.groupBy(F.shiftrightunsigned("fp", 64 - CUT_BITS).alias("k")).agg(F.count("*").alias("n")).collect()
    counts = {r["k"]: r["n"] for r in counts}  # at most 2 ** CUT_BITS rows
    n = sum(counts.values())
    nodes = cut(counts, max(n // SUBTRIES, min(n // 16, 4 * LEAVES), 1))
    tries = materialize(subtries(prints, nodes, budget))
    # rows with equal ids are one document
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    same = prints.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("fp").alias("b"))
    edges = links_between(tries, nodes, budget).unionByName(_labelled(tries).where("a <> b")).unionByName(same)
    comps = components(edges).select(F.col("node").alias("fp"), "comp")
    known = own.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    known = materialize(known)
    least = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = known.join(least, "comp").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")
