"""Fixture frames derived from the driver tables (see FIXTURES.md, Part B).

Each fixture stands for one input shape of the probing/ranking workflow and
is a plain lazy DataFrame over the parquet tables, so everything built on it
scales with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlens.functions.columns import rotate_left
from layerlens.operators.scan import group_rank
from layerlens.operators.targets import TARGET_TYPE
from layerlens.sources.tables import table

# F6 document key: (l_suppkey, l_orderkey, l_partkey, l_linenumber) is unique in
# lineitem, and the query id is l_suppkey, so these three columns identify a
# document within a query and serve as the score tie-break.
F6_DOC = ["l_orderkey", "l_partkey", "l_linenumber"]


def f1_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1: scored instances — one float label per id."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("label")
    )


def f2_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """multi-target instances ``(id, targets)`` with single spans and
    string labels; orders without line items have an empty target list.

    A target list belongs to one instance (an order's line items), so it is
    built by a per-instance aggregate, like the JSON rows it stands for."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.struct(
            F.col("l_linenumber").alias("k1"),
            F.col("l_partkey").alias("k2"),
            F.col("l_suppkey").alias("k3"),
            F.struct(
                F.struct(
                    F.col("l_linenumber").alias("a"),
                    (F.col("l_linenumber") + 1 + (F.col("l_quantity") % 5).cast("int")).alias("b"),
                ).alias("span1"),
                F.lit(None).cast("struct<a:int,b:int>").alias("span2"),
                F.col("l_returnflag").alias("label"),
            ).alias("t"),
        ).alias("item"),
    )
    per_order = items.groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return orders.join(per_order, "id", "left").select(
        "id",
        F.coalesce(F.transform("items", lambda x: x["t"]), F.array().cast(f"array<{TARGET_TYPE}>")).alias("targets"),
    )


def f3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pooled vectors with classes ``(id, vector, label)``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label")
    )


def f4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query/passage pairs — a user turn followed by the assistant turn."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    q = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    p = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("passage")
    )
    return q.join(p, ["conv_id", "turn"])


def f5_hidden_states(spark: SparkSession, sf_dir: str, layers: int = 3) -> DataFrame:
    """token hidden states ``(seq, layer, pos, vector)``: 20 tokens per
    sequence; layer ``l`` is the vector rotated left by ``l``."""
    emb = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer")
    )
    return emb.select(
        (F.col("vec_id") / 20).cast("int").alias("seq"),
        "layer",
        (F.col("vec_id") % 20).cast("int").alias("pos"),
        rotate_left(F.col("embedding"), F.col("layer")).alias("vector"),
    )


def f5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 spans ``(seq, target_idx, a, b)``: ``[3,8)`` in every sequence,
    plus an empty span and one running past the end in sequence 0."""
    emb = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 20).cast("int").alias("seq")).distinct()
    main = emb.select("seq", F.lit(0).alias("target_idx"), F.lit(3).alias("a"), F.lit(8).alias("b"))
    extra = emb.filter(F.col("seq") == 0).select(
        "seq",
        F.explode(F.array(
            F.struct(F.lit(1).alias("target_idx"), F.lit(5).alias("a"), F.lit(5).alias("b")),
            F.struct(F.lit(2).alias("target_idx"), F.lit(17).alias("a"), F.lit(25).alias("b")),
        )).alias("s"),
    ).select("seq", "s.target_idx", "s.a", "s.b")
    return main.unionByName(extra)


def f6_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 qrels ``(q_id, doc key, grade)`` over all line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("q_id"),
        *F6_DOC,
        F.when(F.col("l_returnflag") == "R", (F.col("l_quantity") % 3 + 1).cast("int")).otherwise(F.lit(0)).alias("grade"),
    )


def f6_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 run ``(q_id, doc key, score)``: open line items scored by price."""
    li = table(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_linestatus") == "O").select(
        F.col("l_suppkey").alias("q_id"), *F6_DOC, F.col("l_extendedprice").alias("score")
    )


def f7_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 metric log before its steps are numbered:
    ``(run, metric, ts, event_id, value, n)``."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_type").alias("metric"),
        "ts",
        "event_id",
        "value",
        (F.col("event_id") % 32 + 1).alias("n"),
    )


def f7_metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 metric log ``(run, metric, step, ts, value, n)``; step numbers each
    (run, metric) series by (ts, event_id)."""
    ranked = group_rank(f7_events(spark, sf_dir), ["run", "metric"], ["ts", "event_id"], name="step")
    return ranked.select("run", "metric", F.col("step").cast("int").alias("step"), "ts", "value", "n", "event_id")


def f8_layer_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 layer→metric results ``(task, model, layer, value)``."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(
        F.col("event_type").alias("task"),
        (F.col("user_id") % 3).alias("model"),
        (F.col("user_id") % 13).alias("layer"),
    ).agg(F.avg("value").alias("value"))


def f4_star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """F4 as the ranking star schema: ``queries`` (user turns), ``docs``
    (assistant turns) and ``pairs`` — the answer to a turn is relevant (1),
    the assistant turn two answers later is a negative (0)."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    key = F.col("conv_id") * 100 + F.col("turn")
    orig = F.col("conv_id") * 1000 + F.col("turn")
    queries = conv.filter(F.col("role") == "user").select(key.alias("q_idx"), orig.alias("orig_q_id"), "text")
    docs = conv.filter(F.col("role") == "assistant").select(key.alias("d_idx"), orig.alias("orig_d_id"), "text")
    users = conv.filter(F.col("role") == "user").select("conv_id", "turn")
    assistants = conv.filter(F.col("role") == "assistant").select("conv_id", F.col("turn").alias("a_turn"))
    # two equi-joins on (conversation, turn offset): never all pairs of a conversation
    pairs = None
    for offset, label in ((1, 1), (3, 0)):
        u = users.select("conv_id", "turn", (F.col("turn") + offset).alias("a_turn"))
        part = u.join(assistants, ["conv_id", "a_turn"]).select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("q_idx"),
            (F.col("conv_id") * 100 + F.col("a_turn")).alias("d_idx"),
            F.lit(label).alias("label"),
        )
        pairs = part if pairs is None else pairs.unionByName(part)
    return {"pairs": pairs, "queries": queries, "docs": docs}
