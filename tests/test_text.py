"""Text operators against direct construction."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from layerlens.operators import text as X
from layerlens.plans import q_text

from conftest import SF_SMALL


def test_wordpiece_greedy_longest_match():
    vocab = {X.UNK: 1, "un": 2, "##aff": 3, "##able": 4, "u": 5, "##n": 6, "a": 7}
    assert X.wordpiece("unaffable", vocab) == [2, 3, 4]
    assert X.wordpiece("unx", vocab) == [1]          # unmatchable tail → whole word [UNK]
    assert X.wordpiece("a" * 101, vocab) == [1]      # longer than 100 characters
    assert X.normalize_word("Éçole") == "ecole"


def test_uncased_word_rules(spark):
    cases = {
        "中文 5€": ["中", "文", "5€"],
        "a\u00a0b\u200bc\u2003d\ue000e": ["a", "bc", "de"],
        "Don't, (stop)!\x07x\ty\r\nz": ["Don", "'", "t", ",", "(", "stop", ")", "!", "x", "y", "z"],
        "$5 ~ «q»…": ["$", "5", "~", "«", "q", "»", "…"],
        "": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.w for r in df.select("t", X.piece_words(F.col("t")).alias("w")).collect()}
    assert got == cases


def _one_at_a_time(nq, npp, max_len):
    t = max_len - 3
    while nq + npp > t:
        if nq > npp:
            nq -= 1
        else:
            npp -= 1
    return nq, npp


def test_kept_lengths_closed_form(spark):
    rows = [(a, b) for a in range(30) for b in range(30)]
    df = spark.createDataFrame(rows, "nq int, np int")
    for m in (8, 9, 20, 33):
        kq, kp = X.kept_lengths(F.col("nq"), F.col("np"), m)
        got = {(r.nq, r.np): (r.kq, r.kp) for r in df.select("nq", "np", kq.alias("kq"), kp.alias("kp")).collect()}
        for a, b in rows:
            assert got[(a, b)] == _one_at_a_time(a, b, m), (a, b, m)


def test_pair_encoding_and_realignment_match_direct_construction(spark):
    enc, vocab = q_text.encoded_pairs(spark, SF_SMALL, max_len=48)
    rows = enc.select("q_words", "p_words", "input_ids", "token_type_ids", "kept_q", "kept_p",
                      X.combined_offsets(F.col("q_pieces.offsets"), F.col("p_pieces.offsets")).alias("off"),
                      F.size("q_pieces.ids").alias("nq")).collect()
    assert rows
    for r in rows:
        q = [X.wordpiece(X.normalize_word(w), vocab) for w in r.q_words]
        p = [X.wordpiece(X.normalize_word(w), vocab) for w in r.p_words]
        qf = [i for ws in q for i in ws]
        pf = [i for ws in p for i in ws]
        kq, kp = _one_at_a_time(len(qf), len(pf), 48)
        ids = [vocab[X.CLS]] + qf[:kq] + [vocab[X.SEP]] + pf[:kp] + [vocab[X.SEP]]
        assert list(r.input_ids) == ids
        assert list(r.token_type_ids) == [0] * (kq + 2) + [1] * (kp + 1)
        # realignment of every one-word span against positions in the
        # untruncated encoded sequence
        words = q + p
        pos, start = [], 1
        for wi, pcs in enumerate(words):
            if wi == len(q):
                start += 1  # [SEP] between query and passage
            pos.append(start)
            start += len(pcs)
        for wi in range(len(words)):
            a = 1 + r.off[wi]
            if a > r.nq:
                a += 1
            assert a == pos[wi]


def test_explode_pieces_long_form(spark):
    vocab = {X.PAD: 0, X.UNK: 1, X.CLS: 2, X.SEP: 3, "ab": 4, "c": 5, "##d": 6, "a": 7, "##b": 8}
    df = spark.createDataFrame([(1, "ab cd")], "id long, text string")
    rows = X.explode_pieces(X.tokenize_texts(df, vocab), ["id"]).orderBy("word_idx", "piece_idx").collect()
    assert [(r.word_idx, r.word, r.piece_idx, r.token_id) for r in rows] == [(0, "ab", 0, 4), (1, "cd", 0, 5), (1, "cd", 1, 6)]


def test_corpus_vocab_matches_table_form(spark):
    docs = spark.createDataFrame([("Ab ab ab cd, éf!",), ("cd x",)], "text string")
    table = X.load_vocab(X.build_vocab(docs, "text", top_words=2))
    assert X.corpus_vocab(docs, "text", top_words=2) == table
    assert "ab" in table and "cd" in table and "##f" in table and "e" in table


def test_tokenizer_udf_matches_per_word_split(spark):
    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "a", "b", "##b"])}
    rows = [(0, ["unaffable", "a", "unaffable"]), (1, None), (2, []), (3, ["xyz", "bb", "a"]), (4, ["b"])]
    df = spark.createDataFrame(rows, "k int, words array<string>").repartition(2)
    out = {r.k: r for r in df.select("k", X.make_tokenizer(vocab)(F.col("words")).alias("p")).collect()}
    for k, ws in rows:
        split = [X.wordpiece(X.normalize_word(w), vocab) for w in (ws or [])]
        p = out[k].p
        assert p.ids == [i for s in split for i in s]
        assert p.n_pieces == [len(s) for s in split]
        running = [0]
        for s in split:
            running.append(running[-1] + len(s))
        assert p.offsets == running


def _random_vocab(rng, alphabet):
    tokens = {"[PAD]", "[UNK]", "[CLS]", "[SEP]"}
    for _ in range(rng.randint(1, 40)):
        piece = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5)))
        tokens.add(rng.choice(["", "##"]) + piece)
    return {t: i for i, t in enumerate(sorted(tokens))}


def test_trie_splits_as_longest_match_does():
    rng = random.Random(3)
    for alphabet in ("ab", "abc", "aé中😀"):
        for _ in range(150):
            vocab = _random_vocab(rng, alphabet)
            trie = X.PieceTrie(vocab, X.UNK, X.CONTINUATION, 100)
            words = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 5, 9, 14]))) for _ in range(60)] + ["a" * 100, "a" * 101]
            ids, n = trie.split(words)
            ends = n.cumsum().tolist()
            got = [ids[e - k : e].tolist() for e, k in zip(ends, n.tolist())]
            assert got == [X.wordpiece(w, vocab) for w in words]


def test_trie_reads_each_character_once(monkeypatch):
    """Work that grows with the characters, also for a word whose long
    matches fail at its last character again and again."""
    vocab = {X.UNK: 0, "a": 1, "##a": 2, "a" * 49 + "b": 3, "##" + "a" * 49 + "b": 4}
    trie = X.PieceTrie(vocab, X.UNK, X.CONTINUATION, 100)
    steps = 0
    goto = trie._goto

    def counted(node, code):
        nonlocal steps
        steps += len(node)
        return goto(node, code)

    trie._goto = counted
    ids, _ = trie.split(["a" * 100])
    assert len(ids) == 100 and steps <= 300


def test_word_scan_equals_the_rules(spark):
    rng = random.Random(5)
    hard = list("aZ9é中文 0 \t\n\r\x0b\x0c\x85  　​﻿�$€~`'«»…—_#&😀\U00020000́ัſΣ\x00\x7f")
    texts = ["".join(rng.choice(hard) for _ in range(rng.randint(0, 25))) for _ in range(800)] + ["", None, "plain words only", "é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    want = {r.i: r.w or [] for r in df.select("i", X.piece_words(F.col("t")).alias("w")).collect()}
    words, n = X.scan_words(pa.array(["not seen", *texts], pa.string()).slice(1))
    ends = n.cumsum().tolist()
    got = {i: words.to_pylist()[e - k : e] for i, (e, k) in enumerate(zip(ends, n.tolist()))}
    assert got == want
    vocab = X.corpus_vocab(df, "t", top_words=30)
    out = X.tokenize_texts(df, vocab, "t").select("i", "words", "pieces").collect()
    for r in out:
        split = [X.wordpiece(X.normalize_word(w), vocab) for w in want[r.i]]
        assert r.words == want[r.i]
        assert r.pieces.ids == [x for s in split for x in s] and r.pieces.n_pieces == [len(s) for s in split]


def test_tokenizer_memory_is_bounded_by_its_slices():
    import tracemalloc

    import pyarrow as pa

    from layerlens.operators import text as X

    vocab = {t: i for i, t in enumerate([X.PAD, X.UNK, X.CLS, X.SEP, "a", "b", "##a", "##b"])}
    texts = pa.array(["ab ba a b abab " * 200] * 2000)
    tokenize = X.make_text_tokenizer(vocab, keep_words=False).func
    tokenize(texts.slice(0, 1))
    tracemalloc.start()
    out = tokenize(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == len(texts) and len(out.field("n_pieces")[1999]) == 1000
    assert peak < 100 << 20, peak
