"""Importance resampling, SimHash near-duplicates and hard negatives, against
brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SF_SMALL
from edge_cases import edge, empty  # noqa: F401  (fixtures)

from layerlens.llm import hardneg, importance, simhash
from layerlens.llm.queries import QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ---------------------------------------------------------- 11 importance


def brute_features(text, buckets=10_000):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    f = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    return len(w), Counter(zlib.crc32(x.encode()) % buckets for x in f)


def brute_importance(rows, target, percent=25, least=20, buckets=10_000):
    docs = [(d, *brute_features(t, buckets)) for d, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in docs:
        s += f
    for x in target:
        t += brute_features(x, buckets)[1]
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (big_s + buckets)) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for d, n, f in docs:
        total = sum(f.values())
        weight = sum(gain(b) * c for b, c in f.items()) // total if total else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, total, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = Counter()
    for i, x in enumerate(long[: len(long) * percent // 100]):
        drawn[(*x, i + 1)] += 1
    ranks = {}
    for x, r in ((k[:-1], k[-1]) for k in drawn):
        ranks.setdefault(x, []).append(r)
    got = []
    for x in out:
        mine = ranks.get(x)
        got.append((x[0], *x[2:], mine.pop(0) if mine else None))
    return sorted(got, key=repr)


def check_importance(docs, target, **kw):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = importance.resample(docs, target, **kw)
    got = sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()), key=repr)
    assert got == brute_importance(rows, [r["text"] for r in target.collect()], **kw_brute(kw))


def kw_brute(kw):
    return {{"least_words": "least"}.get(k, k): v for k, v in kw.items()}


def test_importance_edge_rows(spark, edge, empty):
    target = spark.createDataFrame([(1, "the river bank"), (2, None), (3, "")], "item_id long, text string")
    check_importance(edge, target, percent=60, least_words=2)
    check_importance(edge, empty)
    check_importance(empty, target)


@pytest.mark.parametrize("words, pairs", [(0, 0), (3, 2), (1000, 1000)])
def test_importance_does_not_depend_on_the_head(spark, monkeypatch, words, pairs):
    rng = random.Random(words)
    rows = [(i, " ".join(f"W{int(rng.paretovariate(0.7)) % 200}{rng.choice(['', ',', 'é', '-x'])}" for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    target = spark.createDataFrame([(i, rows[i][1]) for i in range(12)], "item_id long, text string")
    made = importance.head_of
    monkeypatch.setattr(importance, "head_of", lambda d, b: made(d, b, words, pairs))
    check_importance(docs, target, buckets=97)


# -------------------------------------------------------------- 12 SimHash


def brute_fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def brute_simhash(rows, budget=3):
    fps = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    return brute_components([d for d, _ in rows], fps, budget)


def brute_components(ids, fps, budget=3):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= budget
    for i, d in enumerate(ids):
        if d is not None:
            near[i] |= np.array([x == d for x in ids], bool)
    comp = np.arange(len(ids))
    while True:
        least = np.where(near, comp[None, :], len(ids)).min(axis=1)
        if (least == comp).all():
            break
        comp = least
    smallest = {}
    for d, c in zip(ids, comp.tolist()):
        if d is not None:
            smallest[c] = min(d, smallest.get(c, d))
    return sorted(((d, f"{int(f):016x}", smallest.get(c)) for d, f, c in zip(ids, fps, comp.tolist())), key=repr)


def digest(df):
    return sorted(((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in df.collect()), key=repr)


def test_simhash_edge_rows(edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert digest(simhash.near_duplicates(edge)) == brute_simhash(rows)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_near_copies(spark):
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"v{rng.randint(0, 500)}" for _ in range(rng.choice([40, 200, 400]))]
        for _ in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.2 else "\t".join(w)))
    rows += [(None, rows[5][1]), (3, rows[40][1]), (900, ""), (901, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_simhash(rows)
    assert digest(simhash.near_duplicates(df)) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})


def test_simhash_trie_joins_any_fingerprints(spark, monkeypatch):
    """Clumps whose members differ in first and last bits, cut into many
    subtries of different depth, also below the depth of the cut."""
    rng = random.Random(9)
    for leaves in (4, 60):
        fps = set()
        for _ in range(10):
            base = rng.getrandbits(64)
            for _ in range(rng.choice([1, 10, 120])):
                x = base
                for _ in range(rng.randint(0, 6)):
                    x ^= 1 << (rng.randint(52, 63) if rng.random() < 0.4 else rng.randint(0, 63))
                fps.add(x)
        fps = sorted(fps)
        ids = list(range(len(fps)))
        docs = spark.createDataFrame([(i, str(f)) for i, f in zip(ids, fps)], "doc_id long, text string")
        monkeypatch.setattr(simhash, "fingerprints", lambda d, *_: d.selectExpr("doc_id", "cast(cast(text as decimal(20,0)) - if(cast(text as decimal(20,0)) >= 9223372036854775808, 18446744073709551616, 0) as long) as fp"))
        monkeypatch.setattr(simhash, "SUBTRIES", max(1, len(fps) // leaves))
        got = digest(simhash.near_duplicates(docs))
        assert got == brute_components(ids, np.array(fps, np.uint64))


# -------------------------------------------------------- 13 hard negatives


def brute_hard(rows, every=7, positives=5, negatives=10, scale=256):
    last = lambda i: (i is None, i or 0)
    use = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(scale * x) for x in v):
            continue
        use.append((i, label, tuple(math.floor(scale * x) for x in v)))
    out = []
    for a in {u for u in use if u[0] is not None and u[0] % every == 0}:
        scored = sorted(((sum(x * y for x, y in zip(a[2], r[2])), r) for r in use if r[0] != a[0]), key=lambda s: (-s[0], last(s[1][0])))
        same = [(s, r[0]) for s, r in scored if r[1] == a[1]][:positives]
        for ps, p in same:
            hard = [(s, r[0]) for s, r in scored if r[1] != a[1] and 30 * ps <= 100 * s <= 90 * ps][:negatives]
            out += [(a[0], p, n + 1, r, ps, s) for n, (s, r) in enumerate(hard)]
    return sorted(out, key=repr)


def check_hard(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, label int, vector array<{kind}>").repartition(3)
    got = sorted(map(tuple, hardneg.mine(df, lambda i: i % 7 == 0).collect()), key=repr)
    assert got == brute_hard([tuple(r) for r in df.collect()])
    return got


def test_hard_negatives_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [0.5, 0.5]), (0, 1, [0.5, 0.5]), (7, 2, [0.5, -0.5]), (7, 2, [0.5, 0.4]), (14, None, [0.1, 0.2]),
        (21, 1, None), (28, 1, [nan, 0.1]), (35, 1, [inf, 0.1]), (42, 1, [None, 0.1]), (1, 1, [0.5, 0.5, 0.25]),
        (2, 2, [0.2, 0.1]), (3, 2, [0.2, 0.1]), (3, 2, [0.2, 0.1]), (4, 2, [0.3]), (5, 2, []), (None, 2, [0.2, 0.1]),
        (None, 1, [0.4, 0.4]), (6, 1, [0.6, 0.3]), (8, 3, [-0.3, 0.0]), (9, 3, [1.7e308, 0.1]),
    ]
    assert check_hard(spark, rows)
    assert hardneg.mine(spark.createDataFrame([], "vec_id long, label int, vector array<float>"), lambda i: i % 7 == 0).count() == 0


def test_hard_negatives_of_large_numbers(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, [rng.choice([3e5, -2e5, 0.1, 7.0]) * rng.random() for _ in range(5)]) for i in range(60)]
    check_hard(spark, rows)


@pytest.mark.parametrize("near", [0.0, 0.8])
def test_hard_negatives_random(spark, monkeypatch, near):
    monkeypatch.setattr(hardneg, "STEP_ROWS", 64)
    monkeypatch.setattr(hardneg, "STEP_ANCHORS", 16)
    monkeypatch.setattr(hardneg, "TILE_BYTES", 100 * 16 * 4)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 16))
    v = centre[rng.integers(0, 4, 700)] * near + rng.normal(size=(700, 16)) * (1 - near)
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, int(rng.integers(0, 3)) if rng.random() < 0.5 else 0, v[i % 690].tolist()) for i in range(700)]
    assert len(check_hard(spark, rows, "float")) > 500


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    v = np.floor(256 * rng.normal(size=(200, 64)) / 8)
    s = hardneg.summaries(v)
    exact = v @ v.T
    width = None
    for x, m, y in hardneg.levels(64):
        middle, spread = s[:, x:m] @ s[:, x:m].T, s[:, m:y] @ s[:, m:y].T
        assert (np.abs(exact - middle) <= spread + 1e-6 * np.abs(exact).max()).all()
        assert width is None or spread.mean() < width
        width = spread.mean()
    side = {"id": np.arange(200), "label": np.arange(200) % 2, "vector": v, "summary": s}
    wide = np.full((200, 1), hardneg.LIMIT)
    _, left = hardneg.mine_tile({**side, "low": -wide, "high": wide}, {**side, "vector": v}, 5, True, 64)
    assert left == sorted(left, reverse=True)
    floor = np.quantile(exact, 0.99, axis=1).astype(np.int64)[:, None]
    _, left = hardneg.mine_tile({**side, "low": floor, "high": wide}, side, 5, True, 64)
    assert left[-1] < 0.6 * left[0]


def test_queries_cover_the_whole_tables(spark):
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = QUERIES["op12_simhash"](spark, SF_SMALL)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()), key=repr) == brute_simhash(docs)
    assert QUERIES["op11_importance"](spark, SF_SMALL).count() == n
