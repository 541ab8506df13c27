"""Operators that look across documents, against brute force."""

import os
import random
import re
import sys
import time
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from conftest import SF_SMALL
from edge_cases import edge, empty  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from layerlens.llm import common, components, jaccard, mixing, substring
from layerlens.llm.oracles import ORACLES
from layerlens.llm.queries import QUERIES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string"


# -------------------------------------------------------- 5 substring dedup


def brute_substring(rows, size=13):
    first, out = {}, []
    key = lambda d: (d is None, d or 0)
    for d, t in sorted(rows, key=lambda r: key(r[0])):
        w = WORD.findall(t or "")
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j : j + size]), key(d))
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < key(d):
                gone.update(range(j, j + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def check_substring(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = substring.dedup(df)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect()), key=repr) == brute_substring(rows)
    return got


def test_substring_edge_rows(edge, empty):
    got = check_substring(edge)
    assert set(edge.columns) <= set(got.columns)
    spans = {r["doc_id"]: r["repeats"] for r in got.collect()}
    assert [(s["first"], s["end"]) for s in spans[9]] == [(3, 63)]
    whole = {r["doc_id"]: r["text"] for r in substring.dedup(edge, untouched=True).collect()}
    assert whole[4] == " \t\n\x0b " and whole[2] is None
    assert substring.dedup(empty).count() == 0


def test_substring_random_passages(spark):
    rng = random.Random(11)
    passages = [[f"p{i}_{j % 9}" for j in range(rng.choice([12, 13, 14, 30, 70]))] for i in range(6)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [f"v{rng.randint(0, 30)}" for _ in range(rng.randint(0, 20))]
            p = rng.choice(passages)
            lo = rng.randint(0, 5)
            w += p[lo : len(p) - rng.randint(0, 5)]
        rows.append((d, " ".join(w)))
    rows += [(500 + i, rows[7][1]) for i in range(40)] + [(600, "x y " * 300), (601, "x y " * 40)]
    check_substring(spark.createDataFrame(rows, DOC).repartition(5))


def test_substring_rows_without_an_id(spark):
    passage = " ".join(f"q{i}" for i in range(25))
    rows = [(None, f"{i} starts {passage} and ends {i % 3}") for i in range(60)] + [(None, None), (4, f"four {passage}")]
    check_substring(spark.createDataFrame(rows, DOC).repartition(5))
    check_substring(spark.createDataFrame(rows[:60], DOC))


# ------------------------------------------------------------ 8 Jaccard join


def brute_jaccard(rows, k, share):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, same_id = defaultdict(list), {}
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += 1
            holders[x].append(i)
        linked = [j for j, n in shared.items() if 100 * n >= share * (len(s) + len(sets[j]) - n)]
        if s and rows[i][0] is not None:
            linked += [same_id[rows[i][0]]] if rows[i][0] in same_id else []
            same_id[rows[i][0]] = i
        for j in linked:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def check_jaccard(df, shingle=4, share=85):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    found = jaccard.component_table(jaccard.join(df, shingle, share))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr)
    assert got == brute_jaccard(rows, shingle, share)


def copies(rng, n, length, edits):
    base = [f"b{rng.randint(0, 400)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w[: len(w) - rng.randint(0, edits)]))
    return out


def test_jaccard_edge_rows(edge, empty):
    check_jaccard(edge)
    check_jaccard(edge, 5, 80)
    assert jaccard.component_table(jaccard.join(empty)).count() == 0


@pytest.mark.parametrize("shingle, share", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_random_groups(spark, shingle, share):
    rng = random.Random(shingle * share)
    texts = []
    for _ in range(25):
        texts += copies(rng, rng.randint(1, 6), rng.choice([1, 2, 3, 4, 5, 7, 9, 12, 16, 25, 60, 200]), 2)
    texts += copies(rng, 60, 150, 4) + copies(rng, 50, 14, 1)  # lists longer than LIST_ALL
    texts += ["Same Text here " * 3] * 40 + ["the of and to in a is " * 5, "the of and to in a is was " * 5, "", None]
    rng.shuffle(texts)
    check_jaccard(spark.createDataFrame(list(enumerate(texts)), DOC).repartition(4), shingle, share)


def test_jaccard_long_list_of_unlinked_sets(spark):
    """One passage in many otherwise different documents, and two groups of
    near copies that share it."""
    rng = random.Random(5)
    passage = " ".join(f"common{i}" for i in range(8))
    texts = [passage + " " + " ".join(f"u{d}_{i}" for i in range(8 + d % 9)) for d in range(90)]
    texts += [passage + " " + x for x in copies(rng, 45, 80, 3)] + [passage + " " + x for x in copies(rng, 45, 80, 3)]
    check_jaccard(spark.createDataFrame(list(enumerate(texts)), DOC).repartition(4), 4, 50)


def test_jaccard_blocks_and_hubs(spark, monkeypatch):
    """Copies of copies, so that hubs link few of them directly."""
    monkeypatch.setattr(jaccard, "MORE_HUBS", 1)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    rng = random.Random(9)
    texts = []
    for _ in range(2):
        chain = [copies(rng, 1, 120, 0)[0].split()]
        for _ in range(70):
            w = list(rng.choice(chain[-25:]))
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
            chain.append(w)
        texts += [" ".join(w) for w in chain]
    rng.shuffle(texts)
    check_jaccard(spark.createDataFrame(list(enumerate(texts)), DOC).repartition(4))


def test_jaccard_link_that_no_hub_may_have(spark, monkeypatch):
    """y links to x only; x links to the copies, but is no hub of their lists."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(1083)]
    texts = []
    for _ in range(300):
        gone, at = rng.randint(1, 40), rng.randint(0, 1000)
        texts.append(" ".join(base[:at] + base[at + gone :]))
    x = base[:933]
    texts += [" ".join(x), " ".join(x + [f"new{i}" for i in range(130)])]
    compared, within = [], jaccard._within
    monkeypatch.setattr(jaccard, "_within", lambda *a: compared.append(1) or within(*a))
    check_jaccard(spark.createDataFrame(list(enumerate(texts)), DOC).repartition(4))
    assert compared


def near_copies(groups, copies_of_each, length=250):
    """Groups whose members each have one word of their own."""
    base = [[f"g{g}_{i}" for i in range(length)] for g in range(groups)]
    return [" ".join(b[: 10 * j] + [f"own{j}"] + b[10 * j :]) for b in base for j in range(copies_of_each)]


def on_disk(spark):
    """Bytes of shuffles, and of the shared folder of the session."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    shuffled = sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return shuffled + sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(top) for x in names)


def test_jaccard_leaves_no_shuffled_texts(spark):
    """What the steps of a join have shuffled or written does not add up."""
    texts = near_copies(120, 12)
    docs = jaccard.materialize(spark.createDataFrame(list(enumerate(texts)), DOC).repartition(4))
    common.release(spark)
    time.sleep(3)
    before = on_disk(spark)
    found = jaccard.join(docs)
    for _ in range(20):
        if (left := on_disk(spark) - before) < sum(map(len, texts)) / 4:
            break
        time.sleep(0.5)
    assert left < sum(map(len, texts)) / 4
    assert jaccard.component_table(found).select("component_id").distinct().count() == 120


def test_jaccard_texts_of_a_group_meet_once(spark):
    """Of 12 near copies 66 pairs may link; one chunk gets each text at most."""
    groups, n = 30, 16
    texts = near_copies(groups, 12)
    docs = spark.createDataFrame([(i, x, i % 7) for i, x in enumerate(texts)], "doc_id long, text string, _llm_chunk int")
    docs = docs.withColumn("_llm_chunk", jaccard.chunks.chunk_of(F.col("doc_id"), n))
    pairs = [(12 * g + i, 12 * g + j) for g in range(groups) for i in range(12) for j in range(i + 1, 12)]
    pairs = spark.createDataFrame(pairs, "a long, b long")
    lent = jaccard._lent(docs, docs, jaccard._placed(pairs, n), n).where("text is not null")
    assert lent.count() <= len(texts) - groups
    links = {(r.a, r.b) for r in jaccard._verify(docs, pairs, n, jaccard.Rule()).collect()}
    assert len(links) == 11 * groups and all(a // 12 == b // 12 for a, b in links)


def test_jaccard_pairs_of_equal_lists_are_counted_once(monkeypatch):
    """Lists of all lengths, in several buckets and places, against pairs counted one by one."""
    np, pa = jaccard.np, jaccard.pa
    monkeypatch.setattr(jaccard, "PLACE_SETS", 40)
    rng, rule, n = random.Random(4), jaccard.Rule(), 3
    size = {d: rng.choice([20, 21, 23, 30, 50]) for d in range(-40, 40)}
    lists = [rng.sample(range(-40, 40), rng.choice([1, 2, 3, 5, 12, jaccard.LIST_ALL])) for _ in range(60)]
    lists += [list(range(-30, -18))] * 200 + [list(range(-40, jaccard.LIST_ALL - 35))]
    want, rows = Counter(), []
    for key, members in enumerate(lists):
        pack = lambda x, t: [np.array(x, t).tobytes()]
        rows.append((key % 5, *pack([key] * len(members), "u8"), *pack(members, "i8"), *pack([size[d] for d in members], "u4"), *pack([1] * len(members), "u4")))
        if len(members) <= jaccard.LIST_ALL:
            for a in members:
                for b in members:
                    if (size[a], a) < (size[b], b) and rule.share * size[b] <= 100 * size[a]:
                        want[a, b] += 1
    scanned = []
    for bucket in range(5):
        mine = list(zip(*[r for r in rows if r[0] == bucket]))
        scanned.append(jaccard._scan_lists(pa.table(list(map(list, mine)), names=["bucket", "keys", "docs", "sizes", "lengths"]), rule, n))
    found = pa.concat_tables(scanned)
    assert sum(k == jaccard.LONG for k in found.column("kind").to_pylist()) == 1
    sums = [jaccard._pairs_at(found.filter(pa.array([k != jaccard.LONG and at == i for k, at in zip(found.column("kind").to_pylist(), found.column("at").to_pylist())])), rule, n) for i in range(n)]
    sent = sum(len(x) // 8 for t in sums for x in t.column("a").to_pylist())
    assert sent < sum(want.values()) / 2  # the 200 equal lists count as few
    none, got = pa.table({"doc": pa.array([], pa.int64()), "in_long": pa.array([], pa.int64())}), {}
    sums = pa.concat_tables(sums)
    for i in range(n):
        t = jaccard._counted(sums.filter(pa.array([c == i for c in sums.column("chunk").to_pylist()])), none, 1)
        got |= {(r["a"], r["b"]): r["s"] for r in t.to_pylist()}
        assert all(r["na"] == size[r["a"]] and r["nb"] == size[r["b"]] for r in t.to_pylist())
    assert got == dict(want)


def test_jaccard_blocks_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUND_SHINGLES", 12_000)
    monkeypatch.setattr(jaccard, "GROUP_PAIRS", 4)
    test_jaccard_blocks_and_hubs(spark, monkeypatch)


def over_another(df):
    """Python steps of a plan that read from another one in the same task,
    which then holds two workers."""
    held, found = [], []  # depth of the nodes above, and whether a task of theirs runs Python
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(re.match(r"[\s:+*|-]*", line)[0])
        held = [x for x in held if x[0] < depth]
        above = bool(held) and held[-1][1]
        name = line[depth:]
        if "InArrow" in name and above:
            found.append(name)
        held.append((depth, "Exchange" not in name and (above or "InArrow" in name)))
    return found


def test_jaccard_tasks_hold_one_worker(spark, monkeypatch):
    """Where some hubs and blocks are met too, so that every step runs."""
    chained, ran = [], []

    def watch(name):
        f = getattr(jaccard, name)

        def seen(df, *a):
            chained.extend(over_another(df))
            ran.append(name)
            return f(df, *a)

        monkeypatch.setattr(jaccard, name, seen)

    for name in ("materialize", "settled", "_asked"):
        watch(name)
    rng = random.Random(5)
    passage = " ".join(f"common{i}" for i in range(8))
    texts = [passage + " " + " ".join(f"u{d}_{i}" for i in range(8 + d % 9)) for d in range(90)]
    texts += [passage + " " + x for x in copies(rng, 45, 80, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(4)
    assert over_another(docs.mapInArrow(lambda x: x, DOC).mapInArrow(lambda x: x, DOC))
    jaccard.join(docs, 4, 50)
    assert {"materialize", "settled", "_asked"} <= set(ran) and not chained


def test_jaccard_rows_without_an_id_are_apart(spark):
    rng = random.Random(8)
    rows = []
    for g in range(12):  # some keys of texts are less than any id
        text = [f"g{g}_{i}" for i in range(60)]
        near = [" ".join(text + [f"n{g}_{j}"]) for j in range(3)]
        rows += [(None, x) for x in near]
        rows += [(5 + g, " ".join(text))] if g % 3 else []
    rows += [(None, rows[0][1]), (None, None), (None, ""), (None, "two words"), (42, "another text of some words")]
    rng.shuffle(rows)
    check_jaccard(spark.createDataFrame(rows, DOC).repartition(4))


def test_jaccard_sizes_of_texts_with_one_id(spark, monkeypatch):
    """The second id has a text that may not link with the first's, and one of
    another size that does; empty texts of linked ids change nothing."""
    rows, common = [], []
    for g in range(10):
        b = [f"b{g}_{i}" for i in range(100)]
        other = b[:20] + [f"o{g}_{i}" for i in range(80)]
        common += b + other
        rows += [(2 * g, " ".join(b)), (2 * g + 1, " ".join(other)), (2 * g + 1, " ".join(b + [f"n{g}_{i}" for i in range(17)]))]
    batch = jaccard.pa.RecordBatch.from_arrays([jaccard.pa.array([" ".join(common)])], names=["text"])
    known = jaccard.np.unique(jaccard._scan(batch)[1])
    monkeypatch.setattr(jaccard, "frequent_words", lambda docs: (known, jaccard.np.ones(len(known), jaccard.np.uint8)))
    check_jaccard(spark.createDataFrame(rows, DOC).repartition(4))


def test_jaccard_empty_texts_of_one_id_do_not_link(spark):
    share = " ".join(f"s{i}" for i in range(50))
    rows = [(d, share + " " + " ".join(f"u{d}_{i}" for i in range(12))) for d in (1, 2)] + [(1, ""), (2, " ")]
    check_jaccard(spark.createDataFrame(rows, DOC).repartition(2), 1, 70)


def test_jaccard_rule_covers_every_linked_pair():
    for rule in (jaccard.Rule(4, 85), jaccard.Rule(5, 80), jaccard.Rule(2, 50)):
        for a in range(1, 80):
            for b in range(a, 160):
                c = next((o for o in range(1, a + 1) if 100 * o >= rule.share * (a + b - o)), None)
                assert (rule.required(a, b) if rule.required(a, b) <= a else None) == c
                assert (c is not None) == (b in rule.partner_sizes(a) and rule.required(a, b) <= a)
                if c is not None:
                    assert a - rule.prefix_length(a) < c and b - rule.prefix_length(b) < c


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)]
    edges += [(1000, x) for x in range(1001, 1400)] + [(5, 5), (7, 3), (3, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


# -------------------------------------------------------------------- 7 mix


def water_fill(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]} if free else set()
        if not over:
            return {s: target[s] if s in target else left * weight[s] / total for s in names}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over


def check_mix(df, **settings):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in df.collect()]
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += size(t)
    want = water_fill(sizes) if rows else {}
    placed, mixed = mixing.mix(df, **settings)
    placed, mixed = placed.collect(), mixed.collect()
    assert sorted((repr(r["doc_id"]), repr(r["source"]), r["size"]) for r in placed) == sorted(
        (repr(d), repr(s), size(t)) for d, s, t in rows
    )
    for r in placed:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    taken, per_doc = defaultdict(int), defaultdict(int)
    for m in mixed:
        taken[m["source"]] += m["n_words"]
        per_doc[m["source"], m["pos"], m["doc_id"]] += m["n_words"]
    for s, t in want.items():
        assert taken[s] == int(t + 1e-6)
    of = {(r["source"], r["pos"], r["doc_id"]): r["size"] for r in placed if r["size"]}
    assert all(n <= 2 * of[k] for k, n in per_doc.items())
    return placed, mixed


def test_mix_edge_rows(edge, empty):
    check_mix(edge)
    check_mix(edge, block_words=3)
    check_mix(empty)
    taken = mixing.mixed_documents(edge)
    assert taken.columns == edge.columns
    words = taken.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    _, mixed = mixing.mix(edge)
    assert words == mixed.agg(F.sum("n_words")).first()[0]
    assert mixing.mixed_documents(empty).count() == 0


def test_mix_schedule_is_even_and_stable(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None]), "w " * rng.randint(0, 40)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    placed, mixed = check_mix(df, block_words=16)
    again = mixing.mix(df.repartition(3), block_words=16)[1].collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixed))
    slots = {m["slot"]: m["source"] for m in mixed}
    target = {r["source"]: r["target"] for r in placed}
    order = [slots[s] for s in sorted(slots)]
    for s, t in target.items():  # every tenth of the schedule has its share
        part = t / sum(target.values())
        for lo in range(0, len(order) - len(order) // 10, len(order) // 10):
            n = sum(x == s for x in order[lo : lo + len(order) // 10])
            assert abs(n - part * (len(order) // 10)) <= 6


def brute_mix(rows, target, block):
    """``(slot, source, r, doc_id, epoch, first_word, n_words)`` of the mix,
    slot by slot and word by word. ``rows``: doc_id, source, text."""
    xx = xxhash.xxh64_intdigest
    sources = sorted(target, key=lambda s: (s is None, s or ""))
    stream = defaultdict(list)
    for d, s, t in rows:
        key = xx(mixing.SEED.to_bytes(4, "little"), 42)
        if d is not None:
            key = xx(d.to_bytes(8, "little", signed=True), key)
        if t is not None:
            key = xx(xx(t.encode(), 42).to_bytes(8, "little"), key)
        stream[s].append((key, d, len(WORD.findall(t or ""))))
    words = {s: [(d, i) for _, d, n in sorted(stream[s]) for i in range(n)] for s in sources}
    need = {s: -(-int(target[s]) // block) for s in sources}
    slots, upto = sum(need.values()), 0.0
    span, whole = {}, sum(target.values())
    for s in sources:
        span[s] = (upto / whole, (upto + target[s]) / whole)
        upto += target[s]
    place, met = {}, dict.fromkeys(sources, 0)
    for slot in range(slots):
        u, step, x = 0.0, 0.5, slot
        while x:
            u, step, x = u + step * (x & 1), step / 2, x >> 1
        for s in sources:
            if span[s][0] <= u < span[s][1]:
                if met[s] < need[s]:
                    place[s, met[s]] = slot
                met[s] += 1
    for s in sources:
        for r in range(met[s], need[s]):
            place[s, r] = slots + r
    out = Counter()
    for s in sources:
        for at in range(int(target[s])):
            d, i = words[s][at % len(words[s])]
            out[place[s, at // block], s, at // block, d, at // len(words[s]), i] += 1
    return out


def test_mix_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None]), f"d{i} " + "w " * rng.randint(0, 30)) for i in range(240)]
    rows += [(500, "e", None), (501, "f", " "), (502, "g", "only these words")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    placed, mixed = check_mix(df, block_words=16)
    got = Counter()
    for m in mixed:
        for i in range(m["n_words"]):
            got[m["slot"], m["source"], m["r"], m["doc_id"], m["epoch"], m["first_word"] + i] += 1
    assert got == brute_mix(rows, {r["source"]: r["target"] for r in placed}, 16)


# ------------------------------------------------------- queries and stages


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, views, name):
    got = QUERIES[name](spark, SF_SMALL)
    want = views.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want.project(", ".join(cols)).fetchall()))


def test_op6_ids_equal_the_library(spark):
    import zlib

    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in QUERIES["op6_sentencepiece"](spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = sp.encode(d["text"] or "")
        r = got[d["doc_id"]]
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r["round_trip"]


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))


def test_op7_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = QUERIES["op7_source_mix"](spark, SF_SMALL)
    assert got.count() == docs.count()
    per = got.groupBy("source").agg(
        F.sum("size").alias("n"), F.first("source_size").alias("s"), F.first("target").alias("t"), F.sum("taken").alias("k")
    ).collect()
    assert all(r["n"] == r["s"] and r["k"] == int(r["t"] + 1e-6) for r in per)
    assert got.where("taken > 2 * size").count() == 0


def test_pipeline_stages(spark, tmp_path):
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[2]))
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, tables[-1], SF_SMALL).write.parquet(path)
        tables.append(spark.read.parquet(path))
    for t in tables[1:-1]:
        assert t.dtypes == docs.dtypes
    rows = [[(r["doc_id"], r["text"]) for r in t.select("doc_id", "text").collect()] for t in tables[:-1]]
    assert len(rows[1]) == len(rows[0])
    group = {d: c for d, _, c in brute_jaccard(rows[1], 5, 80)}
    assert sorted(d for d, _ in rows[2]) == sorted({c for c in group.values()})
    want = {d: (n, t) for d, _, n, t in brute_substring(rows[2])}
    before = dict(rows[2])
    assert dict(rows[3]) == {d: t if n else before[d] for d, (n, t) in want.items()}
    words = sum(len(WORD.findall(t or "")) for _, t in rows[3])
    mixed = sum(len(WORD.findall(t or "")) for _, t in rows[4])
    assert abs(mixed - 1.5 * words) <= 25
    last = tables[-1]
    assert last.count() == len(rows[4]) and last.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, SF_SMALL).count() == last.count()


def test_pipeline_keeps_clean_texts_that_share_an_id(spark):
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[2]))
    import corpus_pipeline

    text = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    stay = [(3, text("a")), (7, text("b")), (7, text("c")), (9, text("d")), (None, text("a")), (8, "")]
    gone = [(7, text("a") + " more"), (7, text("c")), (12, text("c") + " more"), (8, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in stay + gone], DOC + ", lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, docs, SF_SMALL).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(stay, key=repr)
