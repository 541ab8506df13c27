"""Connected components of an edge table by alternating star operations:
every round links all larger neighbours of a node to its smallest neighbour,
then all smaller ones, until each component is one star around its smallest
node. A node with very many edges costs a grouped minimum and a join that
Spark may split; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlens.session import materialize

ROWS_A_TASK = 250_000


def settled(df: DataFrame) -> DataFrame:
    """Written once, and read by as many tasks as its rows are worth: a small
    table of links does not go on in thousands of nearly empty tasks."""
    written = materialize(df)
    return written.coalesce(tasks(written.count()))


def tasks(rows: int) -> int:
    return rows // ROWS_A_TASK + 1


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` (the smallest node) of every node of ``edges``
    (columns ``a, b``). Repeated edges and loops change nothing; an empty
    table gives an empty result."""
    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(e)
    while mark[0]:
        # both directions, and each join's result in tasks of a fair size
        n = tasks(2 * mark[0])
        e = e.coalesce(n)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).coalesce(n)
        low = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(n)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(n)
        e = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct().coalesce(n))
        now = _mark(e)
        if now == mark:
            break
        mark = now
    top = e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(top)
