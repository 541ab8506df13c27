"""Operators that judge, count or encode each text by itself, against plain
Python over the same rows."""

import hashlib
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from conftest import SF_SMALL
from edge_cases import edge, empty  # noqa: F401  (fixtures)
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from layerlens.llm import chat, fingerprint, langid, quality, queries, records, spm, tokencount
from layerlens.llm.common import scan, text_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")
CLIP = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = st.text(
    alphabet=st.one_of(
        st.sampled_from(list("aabbthe 's,.!?<|>#\n\t\r\x0b\x1c\x85\xa0 ▁é́ßŐİ中€😀0123")),
        st.characters(blacklist_categories=("Cs",)),
    ),
    max_size=120,
)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ----------------------------------------------------------------- the scan


@given(st.lists(st.one_of(st.none(), AWKWARD), max_size=8))
@settings(max_examples=60, deadline=None)
def test_scan_finds_the_words(texts):
    arr = pa.array(texts, pa.string())
    w = scan(arr)
    data = w.data.tobytes()
    got = [[data[a:b].decode() for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first[:-1], w.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    words = [x for t in got for x in t]
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(words))
    assert dict(zip(words, h.tolist())) == {x: y for x, y in zip(words, h.tolist())}


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (i * 7 % 40) for i in range(50)])], ["i", "text"])
    parts = list(text_slices(batch, limit=64))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(50))


# ---------------------------------------------------------------- 1 quality


def base_counts(text):
    t = text or ""
    w = WORD.findall(t)
    win = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    n, covered = Counter(win), set()
    for j, x in enumerate(win):
        if n[x] > 1:
            covered.update(range(j, j + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_edge_rows(edge, empty):
    got = quality.judge(edge).collect()
    assert len(got) == edge.count()
    text = {r["doc_id"]: r["text"] for r in edge.collect()}
    for r in got:
        n = base_counts(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
    assert quality.judge(empty).count() == 0


def test_quality_line_rules(spark):
    good = "This line has plenty of ordinary words in it and says something."
    second = "Another sentence follows here with its own thought and a full stop."
    third = "Finally the last of these lines ends what the writer wanted to tell us."
    rows = [
        (1, "\n".join([good, second, "Home | About | Contact | Login | Help", third])),
        (2, "\n".join(["Home | About | Contact | Shop | Cart | Help"] * 2 + ["News | Sport | Weather | Video | Live", good])),
        (3, "\n".join(["BUY THIS NOW!! CHEAP OFFER!! TODAY ONLY!!", "LAST CHANCE!! CLICK NOW!! FREE STUFF!!", good])),
        (4, "word### other$$$ more%%% and&&& next*** some### last$$$ one%%% two&&& three***"),
        (5, "\n".join([good, second, "All rights reserved.", third])),
        (6, "aa aa bb bb cc cc dd dd ee ee ff ff gg gg"),
    ]
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r["kept"] for i, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}
    assert got[1]["n_bad_lines"] == 1 and "Login" not in got[1]["clean_text"]
    assert got[5]["n_bad_lines"] == 1


def test_quality_agrees_with_labels(spark):
    d = SF_SMALL.replace("0.001", "0.01")
    verdict = queries.QUERIES["op1_quality_rules"](spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").join(verdict, "doc_id")
    n = {(r["quality"], r["kept"]): r["n"] for r in labels.where("not base_failed").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert n.get((1, False), 0) == 0
    assert n.get((0, True), 0) <= 0.05 * n.get((0, False), 0)


# ------------------------------------------------------------ 2 language ID


def test_language_held_out_accuracy(spark):
    d = SF_SMALL.replace("0.001", "0.01")
    got = queries.QUERIES["op2_language_id"](spark, d).join(
        spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    assert got.where("lang_pred = 'und'").count() == 0
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.95
    low, high = got.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low and high <= 1


def test_language_edge_rows(spark, edge, empty):
    train = spark.createDataFrame(
        [("en", f"the thing with that other thing number {i} and then") for i in range(30)]
        + [("fr", f"une chose avec cette autre chose numéro {i} et alors") for i in range(30)]
        + [(None, "not learned")],
        "lang string, text string",
    )
    model = langid.fit(train, sample_rows=40, landmarks=16)
    got = langid.identify(edge, model)
    assert got.count() == edge.count() and got.columns[-2:] == ["lang_pred", "score"]
    und = {r["doc_id"] for r in got.where("lang_pred = 'und'").collect()}
    assert und == {2, 3, 4} and got.where("lang_pred = 'und' and score <> 0").count() == 0
    twins = {(r["lang_pred"], r["score"]) for r in got.where("doc_id in (1, 10)").collect()}
    assert len(twins) == 1
    assert langid.identify(empty, model).count() == 0
    none = langid.fit(empty)
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(edge, none).collect()} == {("und", 0.0)}
    only = langid.fit(train.where("lang = 'en'"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(edge.where("doc_id = 1"), only).collect()} == {("en", 1.0)}


def brute_presence(text):
    """Bins of the n-grams of letters, written out with whole numbers."""
    codes, after = [0], False
    for ch in text:
        if ch.isalpha():
            codes.append(ord(ch.lower()[0]))
        elif after:
            codes.append(0)
        after = ch.isalpha()
    codes.append(0)
    out = set()
    for n in range(1, langid.MAX_N + 1):
        for i in range(len(codes) - n + 1):
            g = 0
            for c in codes[i : i + n]:
                g = (g * 0x100000001B3 + c + 1) % 2**64
            out.add(((g + n) * 0x9E3779B97F4A7C15) % 2**64 * langid.BINS >> 64)
    return out


def test_language_equals_the_kernel_solution(spark):
    """Kernel matrix and ridge solution written out: all rows are landmarks,
    so the solution needs no decomposition of their kernel."""
    rng = np.random.default_rng(5)
    sounds = {"en": ["the", "and", "ing", "wh", "ck"], "fr": ["é", "eau", "oui", "que", "ai"], "de": ["sch", "ü", "ich", "und", "z"]}
    make = lambda x, n: " ".join("".join(rng.choice(sounds[x], 3)) for _ in range(n)) + rng.choice(["", ".", " 3!"])
    learn = [(x, make(x, int(rng.integers(3, 20)))) for x, n in (("en", 14), ("fr", 9), ("de", 5)) for _ in range(n)]
    tests = [make(x, 6) for x in sounds for _ in range(8)] + ["the", "É", "x y z", "und the eau"]
    model = langid.fit(spark.createDataFrame(learn, "lang string, text string"))
    assert model.landmarks.shape[1] == len(learn)

    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    sets = [brute_presence(t) for _, t in learn]
    assert all(set(langid.presence(t).tolist()) == s for (_, t), s in zip(learn, sets))
    names = sorted(sounds)
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.array([[1.0 if x == c else -1.0 for c in names] for x, _ in learn])
    count = Counter(x for x, _ in learn)
    w = np.array([1 / count[x] for x, _ in learn])
    base = (w[:, None] * y).sum(axis=0) / w.sum()
    middle = k.mean(axis=0)
    kc = k - middle
    ridge = langid.RIDGE * w.sum() / len(learn)
    alpha = np.linalg.solve(kc.T @ (w[:, None] * kc) + ridge * k, kc.T @ (w[:, None] * (y - base)))
    got, score = model.predict(tests)
    for t, name, s in zip(tests, got, score):
        m = base + (np.array([kernel(brute_presence(t), b) for b in sets]) - middle) @ alpha
        p = np.exp(langid.SHARPNESS * m)
        p /= p.sum()
        assert abs(s - p.max()) < 2e-3
        assert name == names[p.argmax()] or np.diff(np.sort(p)[-2:])[0] < 2e-3


# ------------------------------------------------------------ 3 fingerprints


def shingle_set(t):
    w = WORD.findall(t or "")
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprint_edge_rows(edge, empty):
    rows = sorted([(r["doc_id"], r["text"] or "") for r in edge.collect()], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = fingerprint.fingerprints(edge).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, (doc, t) in enumerate(rows):
        nxt, k = rows[(i + 1) % len(rows)][1], len(t) // 4
        want[(doc, len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    text = dict(rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[1] == prints[10] and prints[5] == prints[6]
    assert prints[2] == prints[3] == prints[4] == ""
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert len(set(map(len, prints.values()))) == 2
    assert text[7] and fingerprint.fingerprints(empty).count() == 0


def brute_fingerprint(t):
    """One-permutation MinHash with the same hashes and walks, in plain Python."""
    w = WORD.findall(t)
    if not w:
        return ""
    xx = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    word = [xx(x.encode(), 42).to_bytes(8, "little") for x in w]

    def shingle(part):
        h = 42
        for x in part:
            h = xx(x, h)
        return h

    shingles = [shingle(word[j : j + 5]) for j in range(len(w) - 4)] if len(w) >= 5 else [shingle(word)]
    bins = [None] * 256
    for h in shingles:
        signed = h - (1 << 64) if h >= 1 << 63 else h
        b = (signed >> 56) + 128
        bins[b] = signed if bins[b] is None else min(bins[b], signed)
    digits = []
    for i in range(256):
        order = sorted(range(256), key=lambda b: (fingerprint._rank(i, b), b))
        v = bins[i] if bins[i] is not None else next(bins[b] for b in order if bins[b] is not None)
        digits.append(f"{xx(i.to_bytes(4, 'little'), xx(v.to_bytes(8, 'little', signed=True), 42)) & 15:x}")
    return "".join(digits)


def test_fingerprint_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = ["", "one", "a b", "été 中文 😀 x y z", " \t\n"]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 900, n)) for n in (5, 6, 9, 40, 130, 700, 3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprint.fingerprint(F.col("t")).alias("f")).collect()
    assert [(r["t"], r["f"]) for r in rows] == [(t, brute_fingerprint(t)) for t in texts]
    near = lambda a, b: max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (1 - 1 / 16))
    prints = [(a, b) for a in (r["f"] for r in rows if r["f"]) for b in (r["f"] for r in rows if r["f"])]
    got = spark.createDataFrame(prints, "a string, b string").select("a", "b", fingerprint.likeness(F.col("a"), F.col("b")).alias("s"))
    for r in got.collect():
        assert abs(r["s"] - near(r["a"], r["b"])) < 1e-12


def test_fingerprint_rows_without_an_id_are_spread(spark):
    rows = [(None, f"text {i % 60} of many words without any id") for i in range(80)] + [(i, f"number {i} with an id") for i in range(30)]
    rows += [(None, None)]
    hashed = lambda t: (lambda h: h - (1 << 64) if h >= 1 << 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = sorted(
        ((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, hashed(x[1]) if x[0] is None else 0, x[1])
    )
    want = Counter()
    for i, (d, t) in enumerate(order):
        nxt, k = order[(i + 1) % len(order)][1], len(t) // 4
        want[(d, hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest())] += 1
    got = fingerprint.fingerprints(docs)
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got.collect()) == want
    alone = spark.createDataFrame(rows[:3], "doc_id long, text string")
    assert fingerprint.fingerprints(alone).count() == 3


def test_fingerprint_likeness_is_close(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 700)]
    rows = [(0, " ".join(base))]
    for i, part in enumerate((0.02, 0.05, 0.1, 0.2, 0.6), 1):
        w = list(base)
        at = int(len(w) * part)
        w[:at] = [f"z{i}{x}" for x in range(at)]
        rows.append((i, " ".join(w)))
    rows += [(6, "a b"), (7, "a c"), (8, "one two three four five six"), (9, "one two three four five seven")]
    df = spark.createDataFrame(rows, "i long, t string").select("*", fingerprint.fingerprint(F.col("t")).alias("f"))
    pairs = df.alias("a").join(df.alias("b"), F.col("a.i") < F.col("b.i")).select(
        F.col("a.t").alias("x"), F.col("b.t").alias("y"), fingerprint.likeness(F.col("a.f"), F.col("b.f")).alias("s")
    )
    for r in pairs.collect():
        x, y = shingle_set(r["x"]), shingle_set(r["y"])
        assert abs(r["s"] - len(x & y) / len(x | y)) < 0.13


# ------------------------------------------------------------ 4 token counts


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(BPE)


@given(st.lists(AWKWARD, max_size=6))
@settings(max_examples=80, deadline=None)
def test_token_counts_equal_the_library(texts):
    tok = Tokenizer.from_file(BPE)
    texts = texts + ["<|endoftext|>".join(texts), "  <|endoftext|>  x"]
    counter = tokencount.counter_of(BPE)
    assert counter.counts(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_runs_and_long_texts(bpe):
    counter = tokencount.TokenCounter(BPE, cache_chars=2000)
    texts = ["a" * 3001, "xyx" * 400, "\n" * 77 + " z", "ab " * 9000, "é" * 500, "!" * 333]
    assert counter.counts(texts) == [len(bpe.encode(t, add_special_tokens=False).ids) for t in texts]
    long = "".join(tokencount.pieces("word  and\nmore " * 500, 100))
    assert long == "word  and\nmore " * 500


def test_token_counts_edge_rows(edge, empty, bpe):
    text = {r["doc_id"]: r["text"] or "" for r in edge.collect()}
    got = tokencount.count_tokens(edge, BPE).collect()
    assert len(got) == edge.count()
    for r in got:
        t = text[r["doc_id"]]
        n = len(bpe.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)
    assert tokencount.count_tokens(empty, BPE).count() == 0


# ----------------------------------------------------------- 6 SentencePiece


@given(st.lists(AWKWARD, max_size=6))
@settings(max_examples=80, deadline=None)
def test_pieces_equal_the_library(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = spm.codec_of(PIECES)
    texts = [t.replace("\0", "") for t in texts] + ["    ", "a" * 90, "ab" * 70 + " x"]
    ids, size = codec.encode(pa.array(texts, pa.string()))
    ends = np.r_[0, np.cumsum(size)]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == sp.encode(texts)
    assert [b.decode() for b in codec.decode(ids, size)] == [t.replace("▁", " ") for t in texts]


def test_pieces_are_committed_within_the_window():
    lattice = spm.codec_of(PIECES).lattice
    text = "▁" + "information" * 400
    seen, held = 0, []
    for piece in lattice.segment(text):
        seen += len(piece)
        held.append(piece)
    assert "".join(held) == text
    asked = []

    class Watched(str):
        def __getitem__(self, k):
            if isinstance(k, slice):
                asked.append(k.stop)
            return str.__getitem__(self, k)

    first = next(lattice.segment(Watched(text)))
    assert first and max(asked) < 10 * lattice.longest


def test_pieces_edge_rows(edge, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = {r["doc_id"]: r["text"] or "" for r in edge.collect()}
    got = spm.encode(edge, PIECES)
    assert [c for c in got.columns if c not in ("ids", "n_ids", "round_trip")] == [c for c in edge.columns if c != "text"]
    rows = got.collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert r["ids"] == sp.encode(text[r["doc_id"]]) and r["n_ids"] == len(r["ids"])
        assert r["round_trip"] == ("▁" not in text[r["doc_id"]])
    assert spm.encode(empty, PIECES).count() == 0


# ---------------------------------------------------------- 9 binary records


@given(st.lists(AWKWARD, max_size=6))
@settings(max_examples=80, deadline=None)
def test_encoder_equals_the_library(texts):
    tok = Tokenizer.from_file(CLIP)
    texts = texts + ["<|endoftext|>x<|ENDOFTEXT|> É, it's e.g. 3.5, end.", "Àb, ÇD! H̱ ẖ. İx, İ ﬁ."]
    enc = records.encoder_of(CLIP)
    got = [np.frombuffer(b, enc.kind).tolist() for b in enc.encode(pa.array(texts, pa.string()), 2)]
    assert got == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_encoder_forgets_within_its_bound():
    tok = Tokenizer.from_file(CLIP)
    enc = records.Encoder(CLIP, cache_words=50)
    for lo in range(0, 400, 20):
        texts = [f"word{i} the of and thing{i % 7}." for i in range(lo, lo + 20)]
        got = [np.frombuffer(b, enc.kind).tolist() for b in enc.encode(pa.array(texts), 2)]
        assert got == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert len(enc.table.hash) <= 50 and len(enc.table.pool) < 70_000


def test_records_round_trip(spark, edge, empty, tmp_path):
    tok = Tokenizer.from_file(CLIP)
    path, index = str(tmp_path / "r"), str(tmp_path / "i")
    records.write_records(edge, path, CLIP, 2)
    records.write_index(spark, path, index)
    want = sorted(
        ((r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in edge.collect()),
        key=lambda x: (x[0] is not None, x[0] or 0),
    )
    ids = lambda b: np.frombuffer(bytes(b), "<u4").tolist()
    read = records.read_records(spark, path).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
    got = records.with_start(read, spark.read.parquet(index)).orderBy("start").collect()
    assert [(r["doc_id"], ids(r["ids"])) for r in got] == want
    assert [r["start"] for r in got] == np.r_[0, np.cumsum([len(x) for _, x in want])][:-1].tolist()
    # shuffled reads through the index, one record twice
    rows = spark.read.parquet(index)
    wanted = rows.where("doc_id % 3 = 0").unionByName(rows.where("doc_id = 9"))
    some = records.read_at(spark, path, wanted).collect()
    assert sorted((r["doc_id"], ids(r["ids"])) for r in some) == sorted(
        [x for x in want if x[0] is not None and x[0] % 3 == 0] + [x for x in want if x[0] == 9]
    )
    none = str(tmp_path / "none")
    records.write_records(empty, none, CLIP, 2)
    assert records.read_records(spark, none).count() == 0


def test_record_order_after_a_thousand_files(spark):
    rows = [(f"part-00000-4d6a-c{i:03d}.txt", 0, 0, i, 2) for i in (101, 999, 1000, 1001)] + [("part-00001-4d6a-c000.txt", 1, 0, 5000, 2)]
    table = spark.createDataFrame(rows, "shard string, part int, record long, doc_id long, n_tokens long")
    got = records.with_start(table, table).orderBy("start").collect()
    assert [(r["doc_id"], r["start"]) for r in got] == [(101, 0), (999, 2), (1000, 4), (1001, 6), (5000, 8)]


def test_damaged_records_are_noticed():
    whole = records.frame(5, np.array([1, 2, 3], "<u2").tobytes(), False) + b"\n"
    doc, ids = records._parse(memoryview(whole))
    assert doc == 5 and np.frombuffer(ids, "<u4").tolist() == [1, 2, 3]
    assert records._parse(memoryview(records.frame(None, b"", False) + b"\n")) == (None, b"")
    for at in range(8, len(whole)):
        bad = bytearray(whole)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records._parse(memoryview(bytes(bad)))
    bad = bytearray(whole)
    bad[0] ^= 1
    with pytest.raises(ValueError):
        list(records._walk(memoryview(bytes(bad))))


# ------------------------------------------------------------------- 10 chat


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid string")


def test_chat_round_trip_and_machine(spark):
    hard = "\\### Assistant: </turn> ok\\h\\\\l#<\n### User: x</turn>\n"
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", ""), (1, 4, "assistant", None),
        (2, 0, "user", "hi"),
        (3, 0, "assistant", "out of turn"), (3, 1, "user", "x"),
        (4, None, None, None), (4, 0, "user", "x"), (4, 0, "user", "x"),
        (5, 0, "user", "x"), (5, 1, "tool: <odd>\nrole", "y"), (5, 2, "assistant", "z"),
        (None, 0, "user", "q"), (None, 1, "assistant", "a"),
        *[(6, i, "user" if i % 2 == 0 else "assistant", f"t{i}#") for i in range(1000)],
    ]
    df = conversations(spark, [(*r, "clash") for r in rows])
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, None: True}
    want = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert got[c]["loss_text"] == "".join(t for r, t in turns if r == "assistant")
        assert got[c]["formatted"] == "".join(s["text"] for s in got[c]["segments"])
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_native_plans_have_no_python(spark):
    for name in ("op1_quality_rules", "op3_fingerprints", "op10_chat_format"):
        plan = queries.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_vocabularies_are_read_in_place():
    assert json.load(open(BPE))["model"]["type"] == "BPE"


def test_quality_lines_of_very_many_repeats(spark):
    """Distinct words and then one word over and over: the pattern must not
    recurse once for each repeat."""
    head = " ".join(f"u{i}" for i in range(3000))
    rows = [(1, f"{head}{' same' * 100_000}"), (2, f"{head}{' same' * 6000}"), (3, head)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_words"] for i in (1, 2, 3)] == [103_000, 9000, 3000]
    assert not got[1]["kept"] and not got[2]["kept"] and got[3]["kept"]


def test_labels_beyond_the_limit_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LABELS", 2)
    df = spark.createDataFrame([(f"l{i}", f"text {i}") for i in range(3)], "lang string, text string")
    with pytest.raises(ValueError):
        langid.fit(df)


@given(st.lists(st.text(alphabet="abeinorst▁ .,'é中😀́x", max_size=40), max_size=12))
@settings(max_examples=60, deadline=None)
def test_pieces_of_many_strings_equal_those_of_each(texts):
    lattice = spm.PieceLattice(PIECES, 500)  # the table of pairs is emptied now and then
    strings = [t.replace(" ", "▁") for t in texts] + ["", "😀", "ab" * 40]
    assert [x.tolist() for x in lattice.ids_many(strings)] == [lattice.ids(x) for x in strings]
    assert len(lattice.pair_key) <= 500 and len(lattice.pairs) <= 500


def test_pieces_summed_up_in_the_task(spark):
    rows = spark.createDataFrame([(1, "one two"), (2, None), (3, "été 😀")], "doc_id long, text string")

    def longest(batches):
        for b in batches:
            yield b.select(["doc_id", "n_ids"])

    got = spm.encode(rows, PIECES, then=(longest, "doc_id long, n_ids long")).collect()
    want = spm.encode(rows, PIECES).select("doc_id", "n_ids").collect()
    assert sorted(got) == sorted(want)


def test_a_group_gives_its_memory_back():
    from layerlens.llm.common import give_back, given_back

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def work(n):  # blocks too small for the system to take back one by one, and a late one above them
        held = [np.ones(8000, np.uint8) for _ in range(n)]
        return len(held), np.ones(8000, np.uint8)

    give_back()
    before = resident()
    out = given_back(work, 20_000)
    assert out[0] == 20_000 and resident() - before < 40 << 20


def test_powers_are_kept_for_slices_only():
    from layerlens.llm import common

    for n in (1, 1 << 16, (1 << 20) + 5000, (1 << 22) + 1):
        got = common._powers(common._BASE, n)
        assert len(got) == n and int(got[-1]) == pow(common._BASE, n - 1, 1 << 64)
    assert common._POWERS[common._BASE].nbytes <= 9 << 20
