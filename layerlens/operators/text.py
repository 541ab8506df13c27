"""Text → word tokens → sub-word pieces, pair encoding and span realignment
(X1–X6).

* word split (X2) is ``regexp_extract_all`` on the JVM: runs of letters /
  digits / marks are words, every other non-blank character is its own
  token;
* WordPiece (X1, uncased: word rules of its own, lower-case, accents stripped, greedy longest match,
  ``##`` continuation, ``[UNK]`` for unmatchable words or words longer than
  100 characters) is one Arrow UDF over whole texts: a numpy scan of the bytes
  finds the words, a trie with failure links splits each distinct word of a
  batch, reading each character once (``wordscan``). Nothing is shuffled: a
  word that occurs in a third of all rows costs one look-up per occurrence,
  not a hot join key;
* the UDF also returns the per-word piece counts and their prefix sums, so
  pair encoding (X3), computed spans (X4) and span realignment (X5) are
  array arithmetic on the JVM, with no per-document window.

The vocabulary is a table ``(token, id)`` supplied by the user (the
pretrained vocabulary is not part of this repository); it is a model
artefact of bounded size and is shipped to the tasks with the UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerlens.operators.wordscan import PieceTrie, normalize_word, normalized, scan_words, text_slices  # noqa: F401

# Special tokens and limits of the uncased WordPiece scheme.
UNK, CLS, SEP, PAD = "[UNK]", "[CLS]", "[SEP]", "[PAD]"
CONTINUATION = "##"
MAX_CHARS_PER_WORD = 100

# Word = run of letters/digits/marks; anything else that is not blank is a
# token of its own. Blanks are spelled out so both regex engines agree.
WORD_PATTERN = r"[\p{L}\p{N}\p{M}]+|[^\t\n\x0B\f\r \p{L}\p{N}\p{M}]"

# The word rules of the uncased scheme: control characters go, every kind of
# blank parts words, punctuation (ASCII symbols and all of category P) and
# ideographs are tokens of their own. Other symbols, as currency signs, stay
# within words.
_BLANK = r"[\t\n\r\p{Z}]"
_DROPPED = r"[\p{Cc}\p{Cf}\p{Co}\x{FFFD}]"
_PUNCT = r"!-/:-@\[-`{-~\p{P}"
_IDEOGRAPH = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
)
PIECE_WORD_PATTERN = rf"[{_PUNCT}]|[{_IDEOGRAPH}]|[^ {_PUNCT}{_IDEOGRAPH}]+"

MAX_VOCAB_ROWS = 2_000_000


def piece_words(text: Column) -> Column:
    """The words that WordPiece splits, in order (array<string>)."""
    clean = F.regexp_replace(F.regexp_replace(text, _BLANK, " "), _DROPPED, "")
    return F.regexp_extract_all(clean, F.lit(PIECE_WORD_PATTERN), 0)


def words(text: Column) -> Column:
    """Word tokens of a text, in order (array<string>)."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0)


def wordpiece(word: str, vocab: dict[str, int]) -> list[int]:
    """Greedy longest-match-first split of one normalised word."""
    if len(word) > MAX_CHARS_PER_WORD:
        return [vocab[UNK]]
    out, start = [], 0
    while start < len(word):
        end, cur = len(word), None
        while start < end:
            sub = word[start:end]
            if start > 0:
                sub = CONTINUATION + sub
            if sub in vocab:
                cur = vocab[sub]
                break
            end -= 1
        if cur is None:
            return [vocab[UNK]]
        out.append(cur)
        start = end
    return out


PIECES_TYPE = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("n_pieces", T.ArrayType(T.IntegerType())),
    T.StructField("offsets", T.ArrayType(T.IntegerType())),
])


# Per-process tries, one per vocabulary (executors keep them across tasks).
_TRIES: dict[int, PieceTrie] = {}


def _trie(key: int, vocab: dict[str, int]) -> PieceTrie:
    if key not in _TRIES:
        _TRIES[key] = PieceTrie(vocab, UNK, CONTINUATION, MAX_CHARS_PER_WORD)
    return _TRIES[key]


def _split(trie: PieceTrie, words: pa.Array, n_words: np.ndarray) -> list[pa.Array]:
    """``ids, n_pieces, offsets`` of texts with ``n_words`` of ``words`` each.
    Each distinct word is split once; the lists are gathered with numpy."""

    def lists(bnd, vals):
        return pa.ListArray.from_arrays(pa.array(bnd, pa.int32()), pa.array(vals, pa.int32()))

    enc = pc.dictionary_encode(words)
    occ = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    u_flat, u_len = trie.split(normalized(enc.dictionary))
    u_start = np.cumsum(u_len) - u_len
    counts = u_len[occ]
    cum = np.concatenate([[0], np.cumsum(counts)])  # pieces before each word occurrence
    ids = u_flat[np.arange(int(cum[-1])) - np.repeat(cum[:-1] - u_start[occ], counts)]
    w_bounds = np.concatenate([[0], np.cumsum(n_words)])
    # offsets of row r: cum[b_r .. b_r + n_r] - cum[b_r] (n_r + 1 values)
    o_len = n_words + 1
    o_bounds = np.concatenate([[0], np.cumsum(o_len)])
    first = np.repeat(w_bounds[:-1], o_len)
    g = first + np.arange(int(o_bounds[-1])) - np.repeat(o_bounds[:-1], o_len)
    return [lists(cum[w_bounds], ids), lists(w_bounds, counts), lists(o_bounds, cum[g] - cum[first])]


def make_tokenizer(vocab: dict[str, int]):
    """Arrow UDF ``array<string> words → struct<ids, n_pieces, offsets>``;
    ``offsets[w]`` = pieces before word w (length n_words + 1)."""
    key = hash(frozenset(vocab.items()))

    @F.arrow_udf(PIECES_TYPE)
    def tokenize(ws: pa.Array) -> pa.Array:
        n_words = pc.fill_null(pc.list_value_length(ws), 0).to_numpy().astype(np.int64)
        return pa.StructArray.from_arrays(_split(_trie(key, vocab), ws.flatten(), n_words), names=["ids", "n_pieces", "offsets"])

    return tokenize


def make_text_tokenizer(vocab: dict[str, int], keep_words: bool = True):
    """Arrow UDF ``text → struct<ids, n_pieces, offsets[, words]>``: one scan
    of the text's bytes finds the words, and a trie splits them."""
    key = hash(frozenset(vocab.items()))
    words_field = [T.StructField("words", T.ArrayType(T.StringType()))] if keep_words else []

    @F.arrow_udf(T.StructType([*PIECES_TYPE.fields, *words_field]))
    def tokenize(texts: pa.Array) -> pa.Array:
        trie, out = _trie(key, vocab), []
        for part in text_slices(texts) if len(texts) else [texts]:
            words, n_words = scan_words(part)
            cols = _split(trie, words, n_words)
            names = ["ids", "n_pieces", "offsets"]
            if keep_words:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_words)]), pa.int32()), words))
                names.append("words")
            out.append(pa.StructArray.from_arrays(cols, names=names))
        return pa.concat_arrays(out)

    return tokenize


def load_vocab(vocab: DataFrame, token: str = "token", id_col: str = "id") -> dict[str, int]:
    """Vocabulary table → dict. A vocabulary is a model artefact; its size
    is checked after the (single) collect."""
    rows = vocab.select(token, id_col).limit(MAX_VOCAB_ROWS + 1).collect()
    if len(rows) > MAX_VOCAB_ROWS:
        raise ValueError(f"vocabulary has {len(rows)} rows")
    return {r[0]: int(r[1]) for r in rows}


def _word_counts(texts: DataFrame, text: str) -> DataFrame:
    """Normalised word → count over a corpus. Each task scans its texts and
    normalises the distinct words of a slice; counts are added up."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch.column(0)):
                found = pc.value_counts(scan_words(part)[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(normalized(found.field("values")), pa.string()), found.field("counts")], names=["w", "c"]
                )

    return texts.select(text).mapInArrow(run, "w string, c long").groupBy("w").agg(F.sum("c").alias("c"))


def build_vocab(texts: DataFrame, text: str = "text", top_words: int = 2000) -> DataFrame:
    """F9 vocabulary from a corpus: specials, every character (bare and as
    ``##`` continuation) and the ``top_words`` most frequent normalised words;
    ``id`` = position in (specials, then token order)."""
    return _vocab_from_counts(texts.sparkSession, _word_counts(texts, text), top_words)


def _characters(counted: DataFrame) -> DataFrame:
    """``ch``: the characters of all words, few from each task."""

    def run(batches):
        for batch in batches:
            codes = np.unique(np.frombuffer("".join(batch.column(0).to_pylist()).encode("utf-32-le"), np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(list(codes.tobytes().decode("utf-32-le")), pa.string())], names=["ch"])

    return counted.select("w").mapInArrow(run, "ch string").distinct()


def _vocab_from_counts(spark, counted: DataFrame, top_words: int) -> DataFrame:
    top = counted.orderBy(F.col("c").desc(), F.col("w")).limit(top_words).select(F.col("w").alias("token"))
    chars = _characters(counted)
    chars_all = chars.select(F.col("ch").alias("token")).unionByName(
        chars.select(F.concat(F.lit(CONTINUATION), F.col("ch")).alias("token"))
    )
    toks = top.unionByName(chars_all).distinct()
    specials = spark.createDataFrame([(t, i) for i, t in enumerate([PAD, UNK, CLS, SEP])], "token string, k int")
    ordered = toks.join(F.broadcast(specials.select("token")), "token", "left_anti")
    # ids by sorted token: one ordered window over the vocabulary, whose size
    # is bounded by top_words plus the character set
    w = Window.orderBy("token")
    body = ordered.select("token", (F.row_number().over(w) + 3).cast("int").alias("id"))
    return specials.select("token", F.col("k").alias("id")).unionByName(body)


def corpus_vocab(texts: DataFrame, text: str = "text", top_words: int = 2000) -> dict[str, int]:
    """``build_vocab`` as a dict. The word-count table is persisted for its
    two reads; the top words (≤ ``top_words`` rows) and the character set
    (an alphabet) are collected and numbered on the driver in the same
    order as ``build_vocab`` (UTF-8 byte order = code-point order)."""
    counted = _word_counts(texts, text).persist()
    try:
        top = [r[0] for r in counted.orderBy(F.col("c").desc(), F.col("w")).limit(top_words).select("w").collect()]
        chars = [r[0] for r in _characters(counted).collect()]
    finally:
        counted.unpersist()
    specials = [PAD, UNK, CLS, SEP]
    tokens = (set(top) | set(chars) | {CONTINUATION + c for c in chars}) - set(specials)
    vocab = {t: i for i, t in enumerate(specials)}
    for t in sorted(tokens):
        vocab[t] = len(vocab)
    if len(vocab) > MAX_VOCAB_ROWS:
        raise ValueError(f"vocabulary has {len(vocab)} rows")
    return vocab


def tokenize_texts(df: DataFrame, vocab: dict[str, int], text: str = "text", prefix: str = "", keep_words: bool = True) -> DataFrame:
    """Add ``{prefix}words`` and ``{prefix}pieces`` (struct of ids,
    per-word counts and offsets) for the whole text of every row; without
    ``keep_words`` the pieces alone."""
    out = df.withColumn(f"{prefix}pieces", make_text_tokenizer(vocab, keep_words)(F.col(text)))
    return out.withColumn(f"{prefix}words", F.col(f"{prefix}pieces.words")) if keep_words else out


def explode_pieces(tokenized: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """X1 long form ``(keys…, word_idx, piece_idx, token_id)``."""
    p = F.col(f"{prefix}pieces")
    return tokenized.select(
        *keys,
        F.posexplode(F.arrays_zip(F.col(f"{prefix}words").alias("w"), p["n_pieces"].alias("n"),
                                  F.slice(p["offsets"], 1, F.size(p["n_pieces"])).alias("o"))).alias("word_idx", "z"),
        p["ids"].alias("_ids"),
    ).select(
        *keys, "word_idx", F.col("z.w").alias("word"),
        F.posexplode(F.slice("_ids", F.col("z.o") + 1, F.col("z.n"))).alias("piece_idx", "token_id"),
    )


def kept_lengths(n_q: Column, n_p: Column, max_len: int = 512) -> tuple[Column, Column]:
    """X3 closed form of "longest side first" pair truncation: the pair
    keeps at most ``t = max_len - 3`` pieces; one piece at a time is removed
    from the longer side (ties: the passage)."""
    t = max_len - 3
    h = t // 2
    fits = (n_q + n_p) <= t
    q_short = n_q <= n_p
    kq = (
        F.when(fits, n_q)
        .when(q_short & (n_q <= h), n_q)
        .when(~q_short & (n_p <= h), F.lit(t) - n_p)
        .otherwise(F.lit(t - h))
    )
    kp = (
        F.when(fits, n_p)
        .when(q_short & (n_q <= h), F.lit(t) - n_q)
        .when(~q_short & (n_p <= h), n_p)
        .otherwise(F.lit(h))
    )
    return kq, kp


def pair_encoding(df: DataFrame, vocab: dict[str, int], max_len: int = 512) -> DataFrame:
    """``[CLS] q [SEP] p [SEP]`` ids, type ids (0 up to the first
    [SEP]), attention mask — with the pair truncation of the reference
    tokenizer. Needs ``query`` and ``passage`` columns."""
    t = tokenize_texts(tokenize_texts(df, vocab, "query", "q_"), vocab, "passage", "p_")
    n_q = F.size(F.col("q_pieces.ids"))
    n_p = F.size(F.col("p_pieces.ids"))
    kq, kp = kept_lengths(n_q, n_p, max_len)
    t = t.withColumn("n_q", n_q).withColumn("n_p", n_p).withColumn("kept_q", kq).withColumn("kept_p", kp)
    cls, sep = F.lit(vocab[CLS]), F.lit(vocab[SEP])
    ids = F.concat(F.array(cls), F.slice("q_pieces.ids", 1, F.col("kept_q")), F.array(sep),
                   F.slice("p_pieces.ids", 1, F.col("kept_p")), F.array(sep))
    total = F.col("kept_q") + F.col("kept_p") + 3
    types = F.concat(F.array_repeat(F.lit(0), F.col("kept_q") + 2), F.array_repeat(F.lit(1), F.col("kept_p") + 1))
    return (
        t.withColumn("input_ids", ids)
        .withColumn("token_type_ids", types)
        .withColumn("attention_mask", F.array_repeat(F.lit(1), total))
        .withColumn("truncated", (F.col("kept_q") < F.col("n_q")) | (F.col("kept_p") < F.col("n_p")))
    )


def computed_spans(kept_q: Column, kept_p: Column) -> tuple[Column, Column]:
    """X4 (card C2): query span ``[1, n_q+1)``, passage span
    ``[n_q+2, n_q+n_p+2)`` over the kept lengths; both exclude [SEP]."""
    q = F.struct(F.lit(1).alias("a"), (kept_q + 1).alias("b"))
    p = F.struct((kept_q + 2).alias("a"), (kept_q + kept_p + 2).alias("b"))
    return q, p


def combined_offsets(q_offsets: Column, p_offsets: Column) -> Column:
    """Prefix piece counts over ``query words ++ passage words``."""
    q_total = F.element_at(q_offsets, -1)
    return F.concat(q_offsets, F.transform(F.slice(p_offsets, 2, F.size(p_offsets) - 1), lambda x: x + q_total))


def realign_span(offsets: Column, n_q_pieces: Column, a: Column, b: Column) -> Column:
    """X5 (card C3): word span ``[a, b)`` over query+passage words →
    piece span ``(1 + P(a), 1 + P(b))``, shifted by one more when it starts
    after the query's pieces. ``offsets`` are the prefix piece counts over
    the concatenated word list. Spans are not clipped by truncation."""
    pa = F.element_at(offsets, a + 1)
    pb = F.element_at(offsets, b + 1)
    start, end = F.lit(1) + pa, F.lit(1) + pb
    shift = F.when(start > n_q_pieces, 1).otherwise(0)
    return F.struct((start + shift).alias("a"), (end + shift).alias("b"))


def padded_batches(df: DataFrame, rank: str, ids: str, batch_size: int, pad_id: int = 0) -> DataFrame:
    """Batches of consecutive ranks, each padded to its longest row:
    ``batch``, ``i``, ``padded`` (ids + pads), ``mask``. The window is one
    batch (``batch_size`` rows), bounded by the parameter."""
    b = df.withColumn("batch", F.floor(F.col(rank) / batch_size).cast("long")).withColumn(
        "i", (F.col(rank) % batch_size).cast("int")
    )
    w = Window.partitionBy("batch")
    b = b.withColumn("_len", F.size(ids)).withColumn("_max", F.max("_len").over(w))
    pad = F.array_repeat(F.lit(pad_id), F.col("_max") - F.col("_len"))
    return b.withColumn("padded", F.concat(F.col(ids), pad)).withColumn(
        "mask", F.concat(F.array_repeat(F.lit(1), F.col("_len")), F.array_repeat(F.lit(0), F.col("_max") - F.col("_len")))
    ).drop("_len", "_max")


def batch_targets(batches: DataFrame, targets: str = "targets") -> DataFrame:
    """The spans and labels of a batch as flat rows, each with the place
    of its text in the batch: ``batch, i, target_idx, span1_a, …, label``."""
    return batches.select("batch", "i", F.posexplode(targets).alias("target_idx", "t")).select(
        "batch", "i", "target_idx",
        F.col("t.span1.a").alias("span1_a"), F.col("t.span1.b").alias("span1_b"),
        F.col("t.span2.a").alias("span2_a"), F.col("t.span2.b").alias("span2_b"),
        F.col("t.label").alias("label"),
    )
