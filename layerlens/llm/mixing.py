"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a shuffled order (hash of id and text) and
seen as one endless stream of words, repeated from its start, cut into blocks
of equal size. Slots 0, 1, 2, ... take van der Corput points; a point falls
into the source whose span of the cumulative targets holds it; the r-th slot
of a source takes the r-th block of its stream. Slots beyond a source's target
are left out, and the few blocks that the points leave over (less than a
logarithm of the slots) follow at the end, so each source gives its target
rounded down to a word.

Defined cases: a null text or one without words has size 0 and nothing is
taken; a null source is a source of its own, sorted last; ties in the shuffled
order are broken by id, size and text hash; repeated rows are separate
documents with a place each; sources without words have target 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlens.llm.common import WORD
from layerlens.session import materialize

BLOCK_WORDS = 1024
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2.0
SEED = 20240607
BUCKET_BITS = 10
POINT_BITS = 40


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, thash``: the one pass that reads texts."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("thash"),
    )


def targets(
    rows: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    max_repeat: float = MAX_REPEAT,
) -> DataFrame:
    """``source, source_size, target`` and the span ``lo, hi`` of each source
    in the cumulative targets (0 to 1). Resharing what is above the cap until
    none is above ends at the level L with sum(min(cap, weight * L)) = total:
    sources sorted by cap / weight, the first ones capped. The windows run
    over one row per source."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    )
    per = per.select("*", weight.alias("w"), (F.col("source_size") * max_repeat).alias("cap"))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        (F.sum("source_size").over(everything) * total_share).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("free"),
    )
    # the level if this source and all after it share what the capped leave
    level = (F.col("total") - F.col("capped")) / F.col("free")
    per = per.withColumn("level", F.when(level * F.col("w") < F.col("cap"), level))
    first = F.min(F.when(F.col("level").isNotNull(), F.struct("capped", "level"))).over(everything)["level"]
    per = per.withColumn("target", F.least("cap", F.coalesce(F.col("w") * first, F.col("cap"))))
    ranked = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    upto, whole = F.sum("target").over(ranked), F.sum("target").over(everything)
    return per.select(
        "source",
        "source_size",
        "target",
        F.coalesce((upto - F.col("target")) / F.nullif(whole, F.lit(0.0)), F.lit(0.0)).alias("lo"),
        F.coalesce(upto / F.nullif(whole, F.lit(0.0)), F.lit(0.0)).alias("hi"),
    )


def shuffled_stream(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``pos``, the first word's place in the source's shuffled stream.
    Words before a hash bucket come from sums per (source, bucket); only rows
    of one bucket are ranked together, so a large source is split."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("thash"))
    rows = rows.withColumn("_key", key).withColumn("_bucket", F.shiftrightunsigned("_key", 64 - BUCKET_BITS))
    by = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_n")).select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(by), F.lit(0)).alias("_base")
    )
    inner = (
        Window.partitionBy("source", "_bucket")
        .orderBy("_key", "doc_id", "size", "thash")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = rows.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.select(
        *[c for c in rows.columns if not c.startswith("_")],
        (F.col("_base") + F.coalesce(F.sum("size").over(inner), F.lit(0))).alias("pos"),
    )


def schedule(per: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``source, r, slot``: the slot that each block of each source gets.

    The unit interval is cut into cells, every source is listed under the
    cells it meets, and points find their source by an equality join on the
    cell: work in proportion to slots and sources, whatever their number."""
    spark = per.sparkSession
    n_sources, n_slots = per.agg(
        F.count("*"), F.coalesce(F.sum(F.ceil(F.floor("target") / block_words)), F.lit(0))
    ).first()
    cells = 1 << max(5, int(n_sources).bit_length())
    last = F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1))
    listed = per.where("hi > lo").select(
        "source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), last)).alias("cell")
    )
    # van der Corput in base 2: the slot number's bits in reverse order
    bits = F.reverse(F.lpad(F.bin("slot"), POINT_BITS, "0"))
    point = F.conv(bits, 2, 10).cast("long") / F.lit(float(1 << POINT_BITS))
    points = spark.range(int(n_slots)).select(F.col("id").alias("slot")).withColumn("u", point)
    hit = points.withColumn("cell", F.floor(F.col("u") * cells)).join(listed, "cell")
    hit = hit.where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("source", "slot")
    ranked = _rank_in_source(hit, int(n_slots))
    need = per.select(
        "source", F.ceil(F.floor("target") / block_words).alias("n_blocks")
    ).where("n_blocks > 0")
    have = ranked.groupBy("source").agg(F.count("*").alias("have")).withColumnRenamed("source", "_s")
    given = ranked.withColumnRenamed("source", "_s").join(
        need, F.col("source").eqNullSafe(F.col("_s"))
    ).where(F.col("r") < F.col("n_blocks")).select("source", "r", "slot")
    short = need.join(have, F.col("source").eqNullSafe(F.col("_s")), "left").where(
        F.coalesce("have", F.lit(0)) < F.col("n_blocks")
    )
    tail = short.select(
        "source", F.explode(F.sequence(F.coalesce("have", F.lit(0)), F.col("n_blocks") - 1)).alias("r")
    ).select("source", "r", (F.lit(int(n_slots)) + F.col("r")).alias("slot"))
    return given.unionByName(tail)


def _rank_in_source(hit: DataFrame, n_slots: int) -> DataFrame:
    """Rank slots per source from 0. Slots are cut into runs; counts per
    (source, run) give each run's start, so a source with most of the slots
    is ranked by many tasks."""
    run_slots = max(1024, n_slots // 1024)
    hit = hit.withColumn("_run", F.floor(F.col("slot") / run_slots))
    by = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    base = hit.groupBy("source", "_run").agg(F.count("*").alias("_n")).select(
        F.col("source").alias("_s"), F.col("_run").alias("_q"), F.coalesce(F.sum("_n").over(by), F.lit(0)).alias("_base")
    )
    inner = Window.partitionBy("source", "_run").orderBy("slot")
    joined = hit.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_run") == F.col("_q")))
    return joined.select("source", "slot", (F.col("_base") + F.row_number().over(inner) - 1).alias("r"))


def mix(
    docs: DataFrame,
    block_words: int = BLOCK_WORDS,
    weights: tuple[float, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    max_repeat: float = MAX_REPEAT,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Returns the rows (``doc_id, source, size, thash, pos, source_size,
    target``) and the mix: ``slot, source, r, doc_id, thash, pos, epoch,
    first_word, n_words``, one row per part of a document that a slot's block
    takes, in order of (slot, epoch, pos)."""
    rows = materialize(sized(docs))
    per = materialize(targets(rows, weights, total_share, max_repeat))
    per_s = per.select(F.col("source").alias("_s"), "source_size", "target")
    placed = shuffled_stream(rows, seed).join(per_s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = materialize(placed)
    taken = F.floor("target")
    full = placed.where("size > 0 and target >= 1").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.floor((taken - 1) / F.col("source_size"))))
    )
    begin = F.col("epoch") * F.col("source_size") + F.col("pos")
    spans = full.withColumn("_from", begin).withColumn("_to", F.least(begin + F.col("size"), taken)).where("_to > _from")
    parts = spans.withColumn(
        "r", F.explode(F.sequence(F.floor(F.col("_from") / block_words), F.floor((F.col("_to") - 1) / block_words)))
    )
    first = F.greatest(F.col("_from"), F.col("r") * block_words)
    last = F.least(F.col("_to"), (F.col("r") + 1) * block_words)
    parts = parts.select(
        "source", "r", "doc_id", "thash", "pos", "epoch", (first - F.col("_from")).alias("first_word"), (last - first).alias("n_words")
    )
    slots = schedule(per, block_words).select(F.col("source").alias("_s"), F.col("r").alias("_r"), "slot")
    mixed = parts.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("r") == F.col("_r"))).drop("_s", "_r")
    return placed, mixed


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents that the mix takes, a row for each epoch that takes
    them, with the columns of ``docs``. The one document of a source at which
    its target ends is cut to the words taken, joined by one blank."""
    placed, mixed = mix(docs, **settings)
    same = Window.partitionBy("doc_id", "thash")
    places = placed.where("size > 0").select(
        "source", "pos", "doc_id", "thash", "size", F.row_number().over(same.orderBy("source", "pos")).alias("nth")
    )
    takes = mixed.groupBy(F.col("source").alias("_s"), F.col("pos").alias("_p"), "epoch").agg(F.sum("n_words").alias("n"))
    takes = places.join(takes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("pos") == F.col("_p"))).select(
        F.struct("doc_id", "thash", "nth", "size", "n").alias("_mix_take")
    )
    names = docs.columns
    keyed = docs.where(word_count(F.col("text")) > 0).select(
        "*", F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash")).alias("_mix_key")
    )
    # equal rows are told apart by number
    order = Window.partitionBy("_mix_key.id", "_mix_key.hash").orderBy(F.col("source").cast("string"))
    keyed = keyed.withColumn("_mix_row", F.row_number().over(order))
    on = (
        F.col("_mix_key.id").eqNullSafe(F.col("_mix_take.doc_id"))
        & (F.col("_mix_key.hash") == F.col("_mix_take.thash"))
        & (F.col("_mix_row") == F.col("_mix_take.nth"))
    )
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.when(F.col("_mix_take.n") >= F.col("_mix_take.size"), F.col("text")).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("_mix_take.n").cast("int")), " ")
    )
    return keyed.join(takes, on).withColumn("text", cut).select(*names)
