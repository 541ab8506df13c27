"""Document fingerprints by one-permutation MinHash, in SQL functions only.

Each shingle (five words; a shorter text is one shingle) is hashed once; the
hash's top bits name its bin and each of the 256 bins keeps its smallest
value. An empty bin is filled by optimal densification: it walks its own
pseudo-random order of all bins to the first that is not empty. The low 4 bits
of each (value, bin) hash are stored, as one hex digit; equal digits by chance
are corrected for: likeness = (share of equal digits - 1/16) / (1 - 1/16), at least 0.

Defined cases: a null text is empty; a text without words has the empty
fingerprint, whose likeness is 1 to itself and 0 to all others; equal texts
have equal fingerprints; documents with equal ids follow each other in order
of their texts; null ids come first, in order of their texts' hashes; with one
document the next document is itself; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlens.llm.common import let
from layerlens.llm.quality import words

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 4
TRIES = 24
MAX_RANGES = 1 << 14  # the ranges' bounds are a constant of the plan
PRIME = (1 << 31) - 1


def _rank(i, b):
    """Place of bin ``b`` in the order that empty bin ``i`` walks; numbers or
    columns."""
    x = ((i * BINS + b + 1) * 1103515245) % PRIME
    return (x * (x + 40503)) % PRIME


def _walks() -> list[list[int]]:
    """The first bins of every bin's order, from the rule above."""
    return [sorted(range(BINS), key=lambda b: (_rank(i, b), b))[:TRIES] for i in range(BINS)]


def shingle_hashes(w: Column, k: int = SHINGLE) -> Column:
    def of(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(
            F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
        )
        return F.when(n >= k, runs).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(w, lambda x: F.xxhash64(x)), of)


def fingerprint(text: Column) -> Column:
    """256 hex digits, or the empty string for a text without words."""
    # one largest value per bin is added, so that after sorting every bin has
    # a first value, and a bin that has only that one is empty
    edge = [(b << (64 - BIN_BITS)) | ((1 << (64 - BIN_BITS)) - 1) for b in range(BINS)]
    edge = [e - (1 << 64) if e >= 1 << 63 else e for e in edge]
    edges = F.array(*[F.lit(e).cast("long") for e in edge])
    low = (1 << (64 - BIN_BITS)) - 1
    walk = F.array(*[F.array(*[F.lit(b) for b in row]) for row in _walks()])

    def digits(hashes: Column) -> Column:
        s = F.sort_array(F.concat(hashes, edges))
        firsts = let(
            s,
            lambda s: F.filter(
                s, lambda x, j: (j == 0) | (F.shiftrightunsigned(x.bitwiseXOR(F.get(s, j - 1)), 64 - BIN_BITS) != 0)
            ),
        )
        held = F.transform(
            firsts, lambda x: F.when(x.bitwiseAND(F.lit(low)) != F.lit(low), x)
        )
        return let(held, packed)

    def packed(v: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(v, b).isNotNull())

        def fill(full: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                def by_walk(row: Column) -> Column:
                    return F.coalesce(*[F.get(v, F.get(row, F.lit(t))) for t in range(TRIES)], farther(i))

                return F.when(x.isNotNull(), x).otherwise(let(F.get(walk, i), by_walk))

            def farther(i: Column) -> Column:
                ranked = F.transform(full, lambda b: F.struct(_rank(i.cast("long"), b.cast("long")).alias("r"), b.alias("b")))
                return F.get(v, F.array_min(ranked)["b"])

            return F.transform(v, one)

        # the stored bits are those of (value, bin), so that a value that
        # fills many bins does not agree by chance in all of them at once
        digit = F.transform(
            let(full, fill), lambda x, i: F.hex(F.xxhash64(x, i).bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("long")))
        )
        return F.lower(F.array_join(digit, ""))

    return let(
        shingle_hashes(words(F.coalesce(text, F.lit("")))),
        lambda h: F.when(F.size(h) > 0, digits(h)).otherwise(F.lit("")),
    )


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected resemblance of two fingerprints, 0 to 1."""
    equal = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x))
    chance = 1.0 / (1 << LOW_BITS)
    share = (equal / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1.0 - chance)
    return (
        F.when((a == "") & (b == ""), F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    )


def range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at most ``value`` (null: 0),
    found in two steps of about the square root of their number each."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
    inner = F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in blocks])
    at_most = lambda arr: F.size(F.filter(arr, lambda b: b <= value))
    place = let(at_most(heads), lambda k: F.when(k == 0, 0).otherwise((k - 1) * step + at_most(F.get(inner, k - 1))))
    return F.when(value.isNull(), 0).otherwise(place)


def with_next(docs: DataFrame, carried: list[str], ranges: int) -> DataFrame:
    """Add ``next_<c>`` of the following document (ascending ``doc_id``, after
    the last the first) for each column of ``carried``.

    Ids are cut into ranges by their quantiles; the first documents of a range
    are also sent to the range before it, so one shuffle by range brings every
    document together with its successor and no range needs another. Null ids
    have ranges of their own, by the hash of the text."""
    q = [i / ranges for i in range(1, ranges)]
    got = docs.agg(F.percentile_approx("doc_id", q, 10 * ranges).alias("b")).first()["b"] if q else []
    bounds = sorted(set(got or []))
    bits = (ranges - 1).bit_length()
    sign = F.lit(-(1 << 63)).cast("long")
    by_hash = F.shiftrightunsigned(F.col("_tie").bitwiseXOR(sign), 64 - bits).cast("int") if bits else F.lit(0)
    docs = docs.withColumn("_tie", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)))
    by_id = range_of(F.col("doc_id"), bounds) + F.lit(1 << bits)
    docs = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), by_hash).otherwise(by_id))
    least = docs.groupBy("_range").agg(F.min(F.struct("doc_id", "_tie")).alias("at")).orderBy("_range").collect()
    used = [r["_range"] for r in least]
    if not used:
        return docs.drop("_range", "_tie").select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    before = {r: used[i - 1] for i, r in enumerate(used)}
    slots = range((1 << bits) + len(bounds) + 1)
    heads = {r["_range"]: r["at"] for r in least}
    of_slot = lambda field: F.array(*[F.lit(heads[i][field] if i in heads else None).cast("long") for i in slots])
    previous = F.array(*[F.lit(before.get(i, 0)) for i in slots])
    to = lambda r, again: F.struct(r.alias("range"), F.lit(again).alias("again"))
    is_head = F.col("doc_id").eqNullSafe(F.get(of_slot("doc_id"), F.col("_range"))) & (
        F.col("_tie") == F.get(of_slot("_tie"), F.col("_range"))
    )
    sent = F.when(
        is_head, F.array(to(F.col("_range"), False), to(F.get(previous, F.col("_range")), True))
    ).otherwise(F.array(to(F.col("_range"), False)))
    w = Window.partitionBy("_to.range").orderBy("_to.again", "doc_id", "_tie", "text")
    rows = docs.withColumn("_to", F.explode(sent)).select(
        "*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]
    )
    return rows.where(~F.col("_to.again")).drop("_to", "_range", "_tie")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text (the last quarter
    replaced by the beginning of the next document), and their likeness."""
    ranges = min(MAX_RANGES, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("fingerprint", fingerprint(F.col("text")))
    rows = with_next(own, ["text", "fingerprint"], ranges)
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
