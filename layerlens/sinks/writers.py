"""Sinks: split JSONL (K1), normalisation metadata (K2), label dictionary
(K3), TREC run files (K4) and generate-only-if-missing (K5)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def splits_missing(spark: SparkSession, output_dir: str) -> bool:
    """K5: true when any split is absent or the write did not finish (Spark
    leaves ``_SUCCESS`` when it has); then the splits are built."""
    done = _exists(spark, os.path.join(output_dir, "_SUCCESS"))
    return not (done and all(_exists(spark, os.path.join(output_dir, f"split={s}")) for s in SPLITS))


def write_splits(instances: DataFrame, output_dir: str, mode: str = "overwrite") -> None:
    """K1: one JSON-lines folder per split (``split=train`` …)."""
    instances.write.mode(mode).partitionBy("split").json(output_dir)


def write_bounds(bounds: DataFrame, path: str) -> None:
    """K2: ``{"max_score": …, "min_score": …}`` (one row, one file)."""
    bounds.select("max_score", "min_score").coalesce(1).write.mode("overwrite").json(path)


def write_label_dictionary(dictionary: DataFrame, path: str) -> None:
    """K3: labels one per line in id order (ids are the sorted positions).
    The class set is small; one output file keeps line number = id."""
    dictionary.orderBy("id").select("label").coalesce(1).write.mode("overwrite").text(path)


def write_trec_run(rows: DataFrame, path: str) -> None:
    """K4: tab-separated ``qid Q0 docid rank score name`` sorted by query
    and rank (a range-partitioned global sort, no single task)."""
    (
        rows.orderBy("q_id", "rank")
        .select(F.col("q_id").cast("string"), "q0", F.col("doc_id").cast("string"), F.col("rank").cast("string"),
                F.col("score").cast("string"), "name")
        .write.mode("overwrite").option("sep", "\t").csv(path)
    )
