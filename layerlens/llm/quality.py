"""Line-first quality rules, in SQL functions only.

Each line is judged by itself: punctuation (symbol runs, shouted words),
navigation (items between separators) and boilerplate (phrases of web
furniture, words said over and over or each one twice). Lines that fail are
removed, and a document that loses too large a share of its word characters is
rejected. Base counts of the whole text are returned beside the verdict.

Defined cases: a null or empty text has no words, so it fails the base rule
and is not kept; rows are judged one by one, so ties and repeated rows get
equal results; texts of any length are taken whole (work grows with
n log n of the words); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import WORD, let

# Phrases of web furniture, matched in lower case.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "accept cookies",
    "skip to content",
    "sign up for our newsletter",
    "subscribe to our",
    "enable javascript",
    "click here",
    "lorem ipsum",
)
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Shares are in percent."""

    symbols_per_word: int = 30
    shouted_words: int = 50
    shouted_min: int = 3
    separators_per_word: int = 20
    separators_min: int = 1
    distinct_words: int = 25
    distinct_min: int = 12
    stuttered: int = 20
    stuttered_min: int = 8
    lost_chars: int = 30


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(w: Column, k: int = 5) -> Column:
    """Words covered by windows of ``k`` words that occur twice or more.

    Window hashes keep their position in the low bits; sorted, equal windows
    are neighbours, and neighbours are compared word by word. The positions
    found cover min(k, gap to the next) words each."""

    def of(w: Column, h: Column) -> Column:
        m = F.size(w) - (k - 1)
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(m.cast("long")))) - 1

        def found(mask: Column) -> Column:
            hashed = F.transform(
                F.sequence(F.lit(0), m - 1),
                lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
                .bitwiseAND(F.bitwise_not(mask))
                .bitwiseOR(i.cast("long")),
            )

            def duplicated(s: Column) -> Column:
                def same(x: Column, y: Column) -> Column:
                    at = lambda v: F.slice(w, v.bitwiseAND(mask).cast("int") + 1, k)
                    close = x.bitwiseXOR(y) <= mask
                    return F.coalesce((x.bitwiseXOR(y) >= 0) & close & (at(x) == at(y)), F.lit(False))

                return F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))

            return let(F.sort_array(hashed), duplicated)

        positions = let(mask, lambda q: F.sort_array(F.transform(found(q), lambda x: x.bitwiseAND(q))))
        covered = let(
            positions,
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(k).cast("long"), F.coalesce(F.get(p, j + 1) - x, F.lit(k).cast("long")))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )
        return F.when(m > 1, covered).otherwise(F.lit(0).cast("long"))

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: of(w, h))


def line_fails(line: Column, n: Column, r: Rules) -> Column:
    """``n``: words of the line, 1 or more."""
    punctuation = (F.regexp_count(line, F.lit(SYMBOLS)) * 100 > n * r.symbols_per_word) | (
        (n >= r.shouted_min) & (F.regexp_count(line, F.lit(r"\p{Lu}{2,}")) * 100 > n * r.shouted_words)
    )
    separators = F.regexp_count(line, F.lit(r"(?:^|\s)[|>»•·](?=\s|$)"))
    navigation = (separators >= r.separators_min) & (separators * 100 > n * r.separators_per_word)
    low = F.lower(line)
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | low.contains(p)
    said_over = (n >= r.distinct_min) & (F.size(F.array_distinct(words(low))) * 100 < n * r.distinct_words)
    stutter = (n >= r.stuttered_min) & (
        F.regexp_count(low, F.lit(r"(?<!\S)(\S{1,40})(?:\s+\1(?!\S))++")) * 100 > n * r.stuttered
    )
    return punctuation | navigation | phrase | said_over | stutter


def judge(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``n_bad_lines``,
    ``kept`` and ``clean_text`` (the lines that passed; null where no line
    did)."""
    r = rules or Rules()
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        text.alias("text"),
        let(
            words(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        ).alias("_w"),
        F.filter(
            F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n"))),
            lambda x: x["n"] > 0,
        ).alias("_lines"),
    )
    judged = base.select(
        "doc_id",
        "text",
        "_w",
        let(
            F.col("_lines"),
            lambda l: F.struct(
                (F.size(l) - F.size(F.array_distinct(F.transform(l, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
                F.size(l).alias("n_lines"),
                F.filter(l, lambda x: ~line_fails(x["line"], x["n"], r)).alias("good"),
            ),
        ).alias("_l"),
    )
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    clean = F.array_join(F.transform(F.col("_l.good"), lambda x: x["line"]), "\n")
    left = F.length(F.regexp_replace(clean, r"[\x20\x09-\x0D]+", "")).cast("long")
    out = judged.select(
        "doc_id",
        F.col("_w.n_words").alias("n_words"),
        F.col("_w.word_chars").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.col("_l.n_dup_lines").alias("n_dup_lines"),
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        (F.col("_l.n_lines") - F.size("_l.good")).cast("long").alias("n_bad_lines"),
        left.alias("_left"),
        F.nullif(clean, F.lit("")).alias("clean_text"),
    )
    enough = (F.col("word_chars") - F.col("_left")) * 100 <= F.col("word_chars") * r.lost_chars
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        "n_bad_lines",
        (~failed & enough).alias("kept"),
        "clean_text",
    )
