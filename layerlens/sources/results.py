"""Experiment result CSVs whose headers differ from file to file.

All files are read by one scan of their lines. The first line of every file
names its columns: an aggregate finds it, and only the different spellings
(few, whatever the number of files) come to the driver, where the alias map
gives each column its place. Then every line is parsed once and its fields are
taken from the places that its file's header names; columns that a file lacks
are null. Blanks around quoted values are ignored. The task is taken from the
file's folder."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlens.operators.runlog import RESULT_COLUMN_ALIASES
from layerlens.session import materialize

NUMERIC = ("Runtime", "layer", "mdl", "compression")
MAX_SPELLINGS = 10_000
_FOLDER = r"([^/=]+)=([^/]*)/"


def _names(header: str, aliases: Mapping[str, str]) -> list[str]:
    """Column names of a header line, renamed where the new name is free."""
    names = [c.strip() for c in next(csv.reader([header], skipinitialspace=True), [])]
    for old, new in aliases.items():
        if old in names and new not in names:
            names = [new if c == old else c for c in names]
    return names


def read_result_csvs(spark: SparkSession, paths: Sequence[str],
                     aliases: Mapping[str, str] = RESULT_COLUMN_ALIASES, task_level: int | None = -2) -> DataFrame:
    """``task_level``: which path element (from the end) names the task:
    -2 for ``<task>/<model>.csv`` files, -3 for folders written by Spark;
    ``None`` when the paths are Spark-partitioned folders with ``task=…``
    subfolders (every such folder's name is a column, as text). Jobs: two, and
    the result's own."""
    lines = spark.read.option("recursiveFileLookup", True).text(list(paths)).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"), "value",
    )
    # a file's first line is in its first range, and lines of a range are in order
    first = lines.where("_start = 0").groupBy("_file").agg(F.min_by("value", "_line").alias("_header"))
    first = materialize(first)
    spelled = [r["_header"] for r in first.select("_header").distinct().limit(MAX_SPELLINGS + 1).collect()]
    if len(spelled) > MAX_SPELLINGS:
        raise ValueError(f"more than {MAX_SPELLINGS} different headers")
    names = {h: _names(h, aliases) for h in sorted(spelled)}
    columns = list(dict.fromkeys(c for own in names.values() for c in own))
    widest = max((len(own) for own in names.values()), default=0)
    rows = lines.join(first, "_file").where(~((F.col("_start") == 0) & (F.col("value") == F.col("_header"))))
    options = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    if widest:
        schema = ", ".join(f"c{i} string" for i in range(widest))
        # parsed once: the array is a value of its own in the plan
        fields = F.from_csv("value", schema, options)
        rows = rows.withColumn("_v", F.transform(F.array(fields), lambda f: F.array(*[f[f"c{i}"] for i in range(widest)]))[0])

    def column(c: str) -> F.Column:
        place = F.lit(None).cast("int")
        for header, own in names.items():
            if c in own:
                place = F.when(F.col("_header") == F.lit(header), own.index(c)).otherwise(place)
        value = F.when(place.isNotNull(), F.get("_v", place))
        if c == "layer":
            return value.cast("int").alias(c)
        return (value.cast("double") if c in NUMERIC or c.startswith(("test/", "val/")) else value).alias(c)

    out = [column(c) for c in columns]
    if task_level is not None:
        return rows.select(*out, F.element_at(F.split("_file", "/"), task_level).alias("task"))
    folders = first.select(F.explode(F.array_distinct(F.regexp_extract_all("_file", F.lit(_FOLDER), 1))).alias("k"))
    keys = sorted(r["k"] for r in folders.distinct().limit(MAX_SPELLINGS).collect() if r["k"] not in columns)
    named = [F.url_decode(F.regexp_extract("_file", rf"/\Q{k}\E=([^/]*)/", 1)).alias(k) for k in keys]
    return rows.select(*out, *named)
