"""Sources for probing data: JSONL / JSON-array instances (S1, S2), the label
dictionary text file (S3), TREC qrels (S4) and the ranking star schema (S5).
Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerlens.operators.targets import TARGET_TYPE
from layerlens.sources.jsonarray import read_json_array

# JSON spans are two-element arrays [a, b]; they are read as arrays and
# turned into struct<a, b> after the read.
_RAW_TARGET = T.StructType([
    T.StructField("span1", T.ArrayType(T.IntegerType())),
    T.StructField("span2", T.ArrayType(T.IntegerType())),
    T.StructField("label", T.StringType()),
])

INSTANCE_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("targets", T.ArrayType(_RAW_TARGET)),
])


def _span(c: F.Column) -> F.Column:
    return F.when(c.isNotNull(), F.struct(c[0].alias("a"), c[1].alias("b")))


def _normalise(raw: DataFrame) -> DataFrame:
    t = F.transform(
        "targets",
        lambda x: F.struct(_span(x["span1"]).alias("span1"), _span(x["span2"]).alias("span2"), x["label"].alias("label")),
    )
    return raw.withColumn("targets", F.coalesce(t, F.array().cast(f"array<{TARGET_TYPE}>")))


def read_jsonl_instances(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """JSONL instances; those with no targets are dropped. Labels are
    read as strings (numeric scores cast back with ``cast('double')``)."""
    df = _normalise(spark.read.schema(INSTANCE_SCHEMA).json(path))
    return df if keep_empty else df.filter(F.size("targets") > 0)


def read_json_array_instances(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of instances, read by as many tasks as the file has
    ranges (``jsonarray``)."""
    parsed = read_json_array(spark, path).select(F.from_json("element", INSTANCE_SCHEMA).alias("i"))
    return _normalise(parsed.select("i.*"))


def read_label_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``labels.txt`` → ``(label, id)`` with id = 0-based line number,
    trailing whitespace stripped. The file is one class per line (small)."""
    whole = spark.read.text(path, wholetext=True)
    parts = F.split(F.col("value"), "\\r?\n")
    # a file ending in a newline yields one empty trailing element
    kept = F.filter(parts, lambda x, i: ~((i == F.size(parts) - 1) & (x == "")))
    lines = whole.select(F.posexplode(kept).alias("id", "label"))
    return lines.select(F.regexp_replace("label", r"\s+$", "").alias("label"), F.col("id").cast("int").alias("id"))


def read_trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``qid _ docid grade`` separated by blanks or tabs, as
    ``q_id long, d_id string, grade int``. Blank lines are skipped; any other
    line without four fields, or whose query id or grade is no whole number,
    fails the read with the line in the message."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")).where("line <> ''")
    part = F.split("line", " ")
    q_id, grade = F.get(part, F.lit(0)).try_cast("long"), F.get(part, F.lit(3)).try_cast("int")
    good = (F.size(part) == 4) & q_id.isNotNull() & grade.isNotNull()
    bad = F.raise_error(F.concat(F.lit("not a qrels line: "), F.col("line")))
    return lines.select(
        F.when(good, q_id).otherwise(bad.cast("long")).alias("q_id"),
        F.when(good, F.get(part, F.lit(2))).otherwise(bad.cast("string")).alias("d_id"),
        F.when(good, grade).otherwise(bad.cast("int")).alias("grade"),
    )


def read_bounds(spark: SparkSession, path: str) -> tuple[float, float]:
    """K2 read back: ``(min_score, max_score)``."""
    row = spark.read.schema("max_score double, min_score double").json(path).first()
    return row["min_score"], row["max_score"]


def read_ranking_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The ranking star schema stored as parquet: ``pairs(q_idx, d_idx,
    label)``, ``queries(q_idx, orig_q_id, text)``, ``docs(d_idx, orig_d_id, text)``."""
    return {name: spark.read.parquet(f"{root}/{name}") for name in ("pairs", "queries", "docs")}
