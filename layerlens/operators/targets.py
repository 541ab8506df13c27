"""Edge-probing instances: targets, labels, score normalisation, buckets and
query/passage text (T1–T8, J1–J4).

An instance row is ``(id, text?, targets array<struct<span1, span2, label>>)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerlens.functions.columns import bucketize, one_hot
# Fixed value: the separator between query and passage in a pair text.
SEP = " [SEP] "

TARGET_TYPE = "struct<span1:struct<a:int,b:int>,span2:struct<a:int,b:int>,label:string>"


def drop_empty(instances: DataFrame) -> DataFrame:
    """S1 filter: instances without targets are dropped."""
    return instances.filter(F.size("targets") > 0)


def explode_targets(instances: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per (instance, target) with ``target_idx`` and flat span
    columns (null when the task computes spans itself)."""
    return instances.select(*keep, F.posexplode("targets").alias("target_idx", "t")).select(
        *keep,
        "target_idx",
        F.col("t.span1.a").alias("span1_a"),
        F.col("t.span1.b").alias("span1_b"),
        F.col("t.span2.a").alias("span2_a"),
        F.col("t.span2.b").alias("span2_b"),
        F.col("t.label").alias("label"),
    )


def label_dictionary(targets: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels as strings, sorted, id = position (0-based).

    The sort is over the distinct label set (the classes), which is small;
    its one-partition window is bounded by the number of classes."""
    labels = targets.select(F.col(label).cast("string").alias("label")).distinct()
    w = Window.orderBy("label")
    return labels.select("label", (F.row_number().over(w) - 1).cast("int").alias("id"))


def label_ids(targets: DataFrame, dictionary: DataFrame, label: str = "label") -> DataFrame:
    """Label string → id via the dictionary, which Spark broadcasts
    where it has measured it to be small; an unknown label fails the job."""
    d = dictionary.select(F.col("label").alias("_lbl"), F.col("id").alias("label_id"))
    j = targets.join(d, F.col(label).cast("string") == F.col("_lbl"), "left")
    return j.withColumn(
        "label_id",
        F.when(F.col("label_id").isNotNull(), F.col("label_id")).otherwise(
            F.raise_error(F.concat(F.lit("unknown label: "), F.col(label).cast("string"))).cast("int")
        ),
    ).drop("_lbl")


def label_onehot(with_ids: DataFrame, num_classes: int) -> DataFrame:
    """T2 option: the label as a row of the identity matrix."""
    return with_ids.withColumn("onehot", one_hot(F.col("label_id"), num_classes))


def train_bounds(scored: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """T4/K2: min and max of the train targets (one row)."""
    return scored.filter(F.col(split) == "train").agg(
        F.min(label).alias("min_score"), F.max(label).alias("max_score")
    )


def minmax_normalize(
    scored: DataFrame,
    label: str = "label",
    split: str = "split",
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """T4: clamp every split to the train range, then scale to [0, 1]
    (``bounds`` overrides the train range). Equal bounds raise."""
    if bounds is None:
        row = train_bounds(scored, label, split).first()  # two scalars
        bounds = (row["min_score"], row["max_score"])
    lo_v, hi_v = float(bounds[0]), float(bounds[1])
    if lo_v == hi_v:
        raise ValueError("max_score == min_score: cannot normalise")
    lo, hi = F.lit(lo_v), F.lit(hi_v)
    x = F.least(F.greatest(F.col(label), lo), hi)
    return scored.withColumn(label, (x - lo) / (hi - lo))


def bucketize_scores(df: DataFrame, num_buckets: int, label: str = "label", out: str = "bucket") -> DataFrame:
    """T5: bucket id of a score in [0, 1] (0..B-2)."""
    return df.withColumn(out, bucketize(F.col(label), num_buckets))


def split_pair(text: F.Column) -> F.Column:
    """Query and passage; a text without exactly one separator fails."""
    parts = F.split(text, r" \[SEP\] ", -1)
    return F.when(F.size(parts) == 2, parts).otherwise(
        F.raise_error(F.concat(F.lit("not a pair of query and passage: "), F.substring(text, 1, 80)))
    )


def compose_pair(query: F.Column, passage: F.Column) -> F.Column:
    """``query + ' [SEP] ' + passage``."""
    return F.concat(query, F.lit(SEP), passage)


def ranking_pairs(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Fact ``(q_idx, d_idx, label)`` → texts and original ids.

    Both dimensions are joined by key; AQE broadcasts whichever side its
    run-time size allows and shuffles otherwise."""
    q = queries.select("q_idx", "orig_q_id", F.col("text").alias("query"))
    d = docs.select("d_idx", "orig_d_id", F.col("text").alias("passage"))
    j = pairs.join(q, "q_idx").join(d, "d_idx")
    return j.select("orig_q_id", "orig_d_id", compose_pair(F.col("query"), F.col("passage")).alias("text"), "label")
