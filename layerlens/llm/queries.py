"""The registered queries of this subpackage and the SQL of those that SQL
can express. Each query applies its operator to the whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlens.llm import (
    chat, fingerprint, hardneg, importance, jaccard, langid, mixing, quality, records, simhash, spm, substring, tokencount,
)
from layerlens.llm.common import documents, prepare, shared_dir
from layerlens.llm.oracles import ORACLES  # noqa: F401  (read by the entry module)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


# ------------------------------------------------------------------------ 1


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    return quality.judge(documents(spark, sf_dir)).drop("clean_text")


# ------------------------------------------------------------------------ 2


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned off the held-out fold."""
    docs = documents(spark, sf_dir)
    learn = docs.where(~langid.held_out(F.col("doc_id"))).select("lang", "text")
    model = langid.fit(learn)
    rows = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.identify(rows, model).drop("text")


# ------------------------------------------------------------------------ 3


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.fingerprints(documents(spark, sf_dir))


# ------------------------------------------------------------------------ 4


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of every document."""
    return tokencount.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), 1024)


# ------------------------------------------------------------------------ 5


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document after repeats of 13 words or more."""
    cut = substring.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


# ------------------------------------------------------------------------ 6


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and whether they decode to it."""

    def digest(batches):
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            ids = batch.column(1).flatten().to_numpy().astype("<u4").tobytes()
            ends = 4 * np.cumsum(size, dtype=np.int64)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - 4 * size).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(crc, pa.int64()), batch.column(3)],
                names=["doc_id", "n_ids", "ids_crc32", "round_trip"],
            )

    return spm.encode(
        documents(spark, sf_dir).select("doc_id", "text"),
        vocabulary("piece_bpe_32k.model"),
        strings=1_500_000,
        pairs=800_000,
        then=(digest, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean"),
    )


# ------------------------------------------------------------------------ 7


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    placed, mixed = mixing.mix(documents(spark, sf_dir))
    taken = mixed.groupBy("source", "pos").agg(F.sum("n_words").alias("taken")).withColumnRenamed("source", "_s")
    taken = taken.withColumnRenamed("pos", "_p")
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("pos") == F.col("_p")) & (F.col("size") > 0)
    return placed.join(taken, on, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"
    )


# ------------------------------------------------------------------------ 8


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard 0.85 or more."""
    return jaccard.component_table(jaccard.join(documents(spark, sf_dir)))


# ------------------------------------------------------------------------ 9

END_ID = 2


@query
def op9_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as framed records, indexed, and read back."""
    path, index_path = shared_dir(spark, "records"), shared_dir(spark, "records-index")
    records.write_records(documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"), END_ID)
    records.write_index(spark, path, index_path)

    def digest(batches):
        for batch in batches:
            ids = batch.column(4)
            crc = [zlib.crc32(x.as_buffer()) for x in ids]
            n = [len(x.as_buffer()) // 4 for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(4)], pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                names=["shard", "part", "record", "doc_id", "n_tokens", "ids_crc32"],
            )

    read = records.read_records(spark, path).mapInArrow(
        digest, "shard string, part int, record long, doc_id long, n_tokens long, ids_crc32 long"
    )
    return records.with_start(read, spark.read.parquet(index_path)).select("doc_id", "start", "n_tokens", "ids_crc32")


# ----------------------------------------------------------------------- 10

PROBE_ID = -7
PROBE_TEXT = "\\### Assistant: </turn> ok"


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that holds control strings, formatted and
    read back."""
    probe = spark.createDataFrame(
        [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    back = chat.read_back(chat.format_conversations(table.unionByName(probe)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


# ----------------------------------------------------------------------- 11


@query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and draw of every document towards the benchmark."""
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = importance.resample(documents(spark, sf_dir), target)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


# ----------------------------------------------------------------------- 12


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ----------------------------------------------------------------------- 13

LABELS = 10


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the positives of every hundredth vector."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", shifted.alias("label"), F.col("embedding").alias("vector")
    )
    return hardneg.mine(vectors, lambda vec_id: vec_id % 100 == 0)
