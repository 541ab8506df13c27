"""Registered text queries: word tokens (X2, SQL-checked), WordPiece pieces
(X1), pair encoding / computed spans / span realignment (X3–X5; checked in
tests against direct construction) and padded batches (X6, SQL-checked)."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerlens.operators import sampling as S
from layerlens.operators import text as X
from layerlens.plans.fixtures import f2_instances, f4_pairs
from layerlens.plans.q_dataset import _PERM
from layerlens.plans.registry import register
from layerlens.sources.tables import table

PAIR_MAX_LEN = 512
TOP_WORDS = 2000
BATCH_SIZE = 8
_WORD_ONLY = r"^[\p{L}\p{N}\p{M}]+$"


@register("word_tokens", oracle=f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{X.WORD_PATTERN}') AS w FROM documents)
SELECT doc_id, len(w) AS n_tokens,
       len(list_filter(w, lambda x: regexp_matches(x, '{_WORD_ONLY}'))) AS n_words,
       CAST(COALESCE(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS n_token_chars
FROM t
""")
def word_tokens(spark, sf_dir):
    """Word tokens of every document (whole texts), summarised per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("w"))
    return d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_tokens"),
        F.size(F.filter("w", lambda x: x.rlike(_WORD_ONLY))).cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("n_token_chars"),
    )


# texts with ideographs, a currency sign, a no-break and a zero-width space,
# an accent and a control character, put after every tenth document
_HARD = "中文 5€\u00a0x\u200by Éa\u0007b"


def hard_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hard = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" " + _HARD))).otherwise(F.col("text"))
    return docs.withColumn("text", hard)


def corpus_vocab(spark, sf_dir):
    return X.corpus_vocab(hard_documents(spark, sf_dir).select("text"), "text", top_words=TOP_WORDS)


# --- DuckDB form of the corpus vocabulary and of greedy WordPiece ----------
# With a vocabulary of specials, top words, characters and "##"+character,
# greedy longest-match WordPiece has a closed form per normalised word w:
# L = longest vocabulary entry that is a prefix of w; the word is [UNK] if
# it is longer than 100 characters, if L = 0, or if a character after the
# first L has no "##" entry; otherwise it has 1 + len(w) - L pieces.

def _words_sql(text: str) -> str:
    """The uncased word rules once more, by replacement only: drop control
    characters, put blanks around punctuation and ideographs, cut at blanks."""
    blank = rf"regexp_replace({text}, '[\t\n\r\pZ]', ' ', 'g')"
    clean = rf"regexp_replace({blank}, '\p{{Cc}}|\p{{Cf}}|\p{{Co}}|\x{{FFFD}}', '', 'g')"
    punct = rf"regexp_replace({clean}, '([[:punct:]]|\pP)', ' \1 ', 'g')"
    han = rf"regexp_replace({punct}, '([\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{20000}}-\x{{2CEAF}}\x{{F900}}-\x{{FAFF}}\x{{2F800}}-\x{{2FA1F}}])', ' \1 ', 'g')"
    return f"list_filter(string_split({han}, ' '), lambda part: part <> '')"


_HARD_DOCS = f"""
hard AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' {_HARD}' ELSE text END AS text FROM documents)"""

_VOCAB_SQL = f"""
{_HARD_DOCS},
dw0 AS (SELECT unnest({_words_sql('text')}) AS x FROM hard),
wcount AS (SELECT strip_accents(lower(x)) AS w, count(*) AS c FROM dw0 GROUP BY 1),
vw AS (SELECT w FROM wcount ORDER BY c DESC, w LIMIT {TOP_WORDS}),
vchars AS (SELECT DISTINCT unnest(regexp_extract_all(w, '.')) AS ch FROM wcount),
vtok AS (SELECT w AS tok FROM vw UNION SELECT ch FROM vchars)"""


def _pieces_sql(words_cte: str) -> str:
    """CTEs ending in ``wp(w, np, unk)`` for the distinct words of ``words_cte(w)``."""
    return f"""
wd AS (SELECT DISTINCT w FROM {words_cte}),
wchars AS (SELECT w, unnest(regexp_extract_all(w, '.')) AS ch,
                  generate_subscripts(regexp_extract_all(w, '.'), 1) AS pos FROM wd),
pre AS (SELECT wc.w, max(wc.pos) AS l FROM wchars wc JOIN vtok ON vtok.tok = left(wc.w, wc.pos) GROUP BY wc.w),
bad AS (SELECT wc.w, count(*) AS n_bad FROM wchars wc LEFT JOIN pre USING (w) LEFT JOIN vchars v ON v.ch = wc.ch
        WHERE wc.pos > COALESCE(pre.l, 0) AND v.ch IS NULL GROUP BY wc.w),
wp AS (SELECT wd.w,
         (length(wd.w) > 100 OR pre.l IS NULL OR COALESCE(bad.n_bad, 0) > 0) AS unk,
         CASE WHEN length(wd.w) > 100 OR pre.l IS NULL OR COALESCE(bad.n_bad, 0) > 0 THEN 1
              ELSE 1 + length(wd.w) - pre.l END AS np
       FROM wd LEFT JOIN pre USING (w) LEFT JOIN bad USING (w))"""


_DOC_WORDS = f"""
tw0 AS (SELECT doc_id, unnest({_words_sql('text')}) AS x FROM hard),
tw AS (SELECT doc_id, strip_accents(lower(x)) AS w FROM tw0)"""


@register("tokenize_pieces", oracle=f"""
WITH {_VOCAB_SQL}, {_DOC_WORDS}, {_pieces_sql('tw')},
per AS (SELECT doc_id, count(*) AS n_words, sum(np) AS n_pieces, sum(CASE WHEN unk THEN 1 ELSE 0 END) AS n_unk
        FROM tw JOIN wp USING (w) GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(n_words, 0) AS BIGINT) AS n_words, CAST(COALESCE(n_pieces, 0) AS BIGINT) AS n_pieces,
       CAST(COALESCE(n_unk, 0) AS BIGINT) AS n_unk
FROM documents d LEFT JOIN per USING (doc_id)
""")
def tokenize_pieces(spark, sf_dir):
    """WordPiece over every document with a vocabulary built from the
    corpus (characters + 2,000 most frequent words): words, pieces, [UNK]s."""
    vocab = corpus_vocab(spark, sf_dir)
    unk = vocab[X.UNK]
    t = X.tokenize_texts(hard_documents(spark, sf_dir), vocab, keep_words=False)
    return t.select(
        "doc_id",
        F.size("pieces.n_pieces").cast("long").alias("n_words"),
        F.size("pieces.ids").cast("long").alias("n_pieces"),
        F.size(F.filter("pieces.ids", lambda i: i == unk)).cast("long").alias("n_unk"),
    )



_PAIR_SQL = f"""
{_VOCAB_SQL},
pr AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS p
       FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user') u
       JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') a USING (conv_id, turn)),
qw0 AS (SELECT conv_id, turn, unnest({_words_sql('q')}) AS x,
               generate_subscripts({_words_sql('q')}, 1) AS i FROM pr),
pw0 AS (SELECT conv_id, turn, unnest({_words_sql('p')}) AS x,
               generate_subscripts({_words_sql('p')}, 1) AS i FROM pr),
qw AS (SELECT conv_id, turn, i, strip_accents(lower(x)) AS w FROM qw0),
pw AS (SELECT conv_id, turn, i, strip_accents(lower(x)) AS w FROM pw0),
allw AS (SELECT w FROM qw UNION ALL SELECT w FROM pw),
{_pieces_sql('allw')},
qs AS (SELECT conv_id, turn, count(*) AS nqw, sum(np) AS n_q FROM qw JOIN wp USING (w) GROUP BY ALL),
ps AS (SELECT conv_id, turn, count(*) AS npw, sum(np) AS n_p FROM pw JOIN wp USING (w) GROUP BY ALL),
lens AS (SELECT pr.conv_id, pr.turn, COALESCE(nqw, 0) AS nqw, COALESCE(npw, 0) AS npw,
                CAST(COALESCE(n_q, 0) AS INTEGER) AS n_q, CAST(COALESCE(n_p, 0) AS INTEGER) AS n_p
         FROM pr LEFT JOIN qs USING (conv_id, turn) LEFT JOIN ps USING (conv_id, turn)),
kept AS (SELECT *,
  CASE WHEN n_q + n_p <= {PAIR_MAX_LEN - 3} THEN n_q
       WHEN n_q <= n_p AND n_q <= {(PAIR_MAX_LEN - 3) // 2} THEN n_q
       WHEN n_q > n_p AND n_p <= {(PAIR_MAX_LEN - 3) // 2} THEN {PAIR_MAX_LEN - 3} - n_p
       ELSE {PAIR_MAX_LEN - 3 - (PAIR_MAX_LEN - 3) // 2} END AS kept_q,
  CASE WHEN n_q + n_p <= {PAIR_MAX_LEN - 3} THEN n_p
       WHEN n_q <= n_p AND n_q <= {(PAIR_MAX_LEN - 3) // 2} THEN {PAIR_MAX_LEN - 3} - n_q
       WHEN n_q > n_p AND n_p <= {(PAIR_MAX_LEN - 3) // 2} THEN n_p
       ELSE {(PAIR_MAX_LEN - 3) // 2} END AS kept_p
  FROM lens)"""

def encoded_pairs(spark, sf_dir, max_len=PAIR_MAX_LEN):
    vocab = corpus_vocab(spark, sf_dir)
    return X.pair_encoding(f4_pairs(spark, sf_dir), vocab, max_len), vocab


@register("pair_encoding", oracle=f"""
WITH {_PAIR_SQL}
SELECT conv_id, turn, n_q, n_p, kept_q, kept_p, kept_q + kept_p + 3 AS seq_len, kept_p + 1 AS n_type1,
       (kept_q < n_q OR kept_p < n_p) AS truncated
FROM kept
""")
def pair_encoding(spark, sf_dir):
    """Pair encodings with longest-side-first truncation (max 512)."""
    enc, _ = encoded_pairs(spark, sf_dir)
    return enc.select(
        "conv_id", "turn", "n_q", "n_p", "kept_q", "kept_p",
        F.size("input_ids").alias("seq_len"),
        F.aggregate("token_type_ids", F.lit(0), lambda a, x: a + x).alias("n_type1"),
        "truncated",
    )


@register("pair_spans", oracle=f"""
WITH {_PAIR_SQL}
SELECT conv_id, turn, 1 AS q_a, kept_q + 1 AS q_b, kept_q + 2 AS p_a, kept_q + kept_p + 2 AS p_b FROM kept
""")
def pair_spans(spark, sf_dir):
    """Query and passage spans computed from the kept lengths."""
    enc, _ = encoded_pairs(spark, sf_dir)
    q, p = X.computed_spans(F.col("kept_q"), F.col("kept_p"))
    return enc.select("conv_id", "turn", q.alias("q"), p.alias("p")).select(
        "conv_id", "turn", F.col("q.a").alias("q_a"), F.col("q.b").alias("q_b"),
        F.col("p.a").alias("p_a"), F.col("p.b").alias("p_b"),
    )


@register("realign_spans", oracle=f"""
WITH {_PAIR_SQL},
pa AS (SELECT k.conv_id, k.turn, k.n_q, k.kept_q, k.kept_p, k.n_p,
         COALESCE((SELECT sum(np) FROM qw JOIN wp USING (w) WHERE qw.conv_id = k.conv_id AND qw.turn = k.turn
                   AND qw.i <= greatest(k.nqw - 2, 0)), 0) AS p1a,
         k.n_q + COALESCE((SELECT sum(np) FROM pw JOIN wp USING (w) WHERE pw.conv_id = k.conv_id AND pw.turn = k.turn
                   AND pw.i <= least(k.npw, 3)), 0) AS p2b
       FROM kept k),
sp AS (SELECT *, 1 + p1a AS a1, 1 + n_q AS b1, 1 + n_q AS a2, 1 + p2b AS b2 FROM pa)
SELECT conv_id, turn,
  CAST(a1 + CASE WHEN a1 > n_q THEN 1 ELSE 0 END AS INTEGER) AS a,
  CAST(b1 + CASE WHEN a1 > n_q THEN 1 ELSE 0 END AS INTEGER) AS b,
  CAST(a2 + CASE WHEN a2 > n_q THEN 1 ELSE 0 END AS INTEGER) AS a2,
  CAST(b2 + CASE WHEN a2 > n_q THEN 1 ELSE 0 END AS INTEGER) AS b2,
  (kept_q < n_q OR kept_p < n_p) AS truncated
FROM sp
""")
def realign_spans(spark, sf_dir):
    """Word spans → piece spans. Two targets per pair over query+passage
    words: the last two query words, and the first three passage words."""
    enc, _ = encoded_pairs(spark, sf_dir)
    off = X.combined_offsets(F.col("q_pieces.offsets"), F.col("p_pieces.offsets"))
    nqw = F.size("q_words")
    npw = F.size("p_words")
    e = enc.withColumn("_off", off).withColumn("_nq", F.size("q_pieces.ids"))
    s1 = X.realign_span(F.col("_off"), F.col("_nq"), F.greatest(nqw - 2, F.lit(0)), nqw)
    s2 = X.realign_span(F.col("_off"), F.col("_nq"), nqw, nqw + F.least(npw, F.lit(3)))
    return e.select(
        "conv_id", "turn", s1.alias("s1"), s2.alias("s2"),
        (F.col("truncated")).alias("truncated"),
    ).select("conv_id", "turn", "s1.a", "s1.b", F.col("s2.a").alias("a2"), F.col("s2.b").alias("b2"), "truncated")


@register("padded_batches", oracle=f"""
WITH {_PAIR_SQL},
r AS (SELECT *, kept_q + kept_p + 3 AS len, {_PERM.format(id='k')} AS perm FROM (SELECT *, conv_id * 100 + turn AS k FROM kept))
SELECT conv_id, turn, perm // {BATCH_SIZE} AS batch, CAST(perm % {BATCH_SIZE} AS INTEGER) AS i,
       CAST(max(len) OVER (PARTITION BY perm // {BATCH_SIZE}) AS BIGINT) AS padded_len, CAST(len AS BIGINT) AS n_real
FROM r
""")
def padded_batches(spark, sf_dir):
    """Batches of 8 consecutive (seeded) encoded pairs, the input ids
    padded to the longest of the batch."""
    enc, vocab = encoded_pairs(spark, sf_dir)
    pairs = enc.withColumn("k", F.col("conv_id") * 100 + F.col("turn")).select("conv_id", "turn", "k", "input_ids")
    b = X.padded_batches(S.permute(pairs, "k"), S.PERM, "input_ids", BATCH_SIZE, vocab[X.PAD])
    return b.select(
        "conv_id", "turn", "batch", "i", F.size("padded").cast("long").alias("padded_len"),
        F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_real"),
    )


@register("batch_targets", oracle=f"""
WITH items AS (
  SELECT l_orderkey AS id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS target_idx,
    l_linenumber AS span1_a, l_linenumber + 1 + CAST(l_quantity % 5 AS INTEGER) AS span1_b, l_returnflag AS label
  FROM lineitem),
p AS (SELECT o_orderkey AS id, {_PERM.format(id='o_orderkey')} AS perm FROM orders)
SELECT perm // {BATCH_SIZE} AS batch, CAST(perm % {BATCH_SIZE} AS INTEGER) AS i, CAST(target_idx AS INTEGER) AS target_idx, span1_a, span1_b, label
FROM items JOIN p USING (id)
""")
def batch_targets(spark, sf_dir):
    """Spans and labels of seeded batches of F2, flattened, each with its
    text's place in the batch."""
    ranked = S.permute(f2_instances(spark, sf_dir))
    place = F.col(S.PERM)
    batches = ranked.withColumn("batch", F.floor(place / BATCH_SIZE).cast("long")).withColumn("i", (place % BATCH_SIZE).cast("int"))
    return X.batch_targets(batches).select("batch", "i", "target_idx", "span1_a", "span1_b", "label")
