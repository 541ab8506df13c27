"""Classification quality over predictions ``(logits array<double>, label)``:
accuracy, macro F1, cross-entropy and batch-size weighted epoch means
(A1–A4, T9, T10). All metrics are aggregates with map-side partial
aggregation; the confusion table has at most C×C rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlens.functions.columns import argmax, cross_entropy, last_element, to_probabilities


def with_predictions(df: DataFrame, logits: str = "logits", label: str = "label", probs: str | None = "softmax") -> DataFrame:
    """Add ``pred`` (argmax), ``ce`` (nats), ``prob`` (T9) and ``score``
    (T10: probability of the last class)."""
    z = F.col(logits)
    out = df.withColumn("pred", argmax(z)).withColumn("ce", cross_entropy(z, F.col(label)))
    out = out.withColumn("prob", to_probabilities(z, probs))
    return out.withColumn("score", last_element(F.col("prob")))


def accuracy(pred: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """A1: micro accuracy of the argmax prediction."""
    return pred.groupBy(*by).agg(F.avg((F.col("pred") == F.col(label)).cast("double")).alias("accuracy"))


def macro_f1(pred: DataFrame, num_classes: int, by: Sequence[str] = (), label: str = "label", absent: str = "skip") -> DataFrame:
    """A2: mean over classes of ``2tp / (2tp + fp + fn)``. A class with no
    tp, fp or fn is left out (``absent='skip'``) or counted as 0 (``'zero'``)."""
    by = list(by)
    conf = pred.groupBy(*by, F.col(label).cast("int").alias("y"), F.col("pred").cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("c")
    )
    # every confusion cell (≤ C×C per group) seen from each of the C classes
    per = conf.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(num_classes - 1)))).groupBy(*by, "k").agg(
        F.sum(F.when((F.col("y") == F.col("k")) & (F.col("p") == F.col("k")), F.col("c")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("y") != F.col("k")) & (F.col("p") == F.col("k")), F.col("c")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("y") == F.col("k")) & (F.col("p") != F.col("k")), F.col("c")).otherwise(0)).alias("fn"),
    )
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(denom > 0, 2 * F.col("tp") / denom)
    if absent == "zero":
        f1 = F.coalesce(f1, F.lit(0.0))
    elif absent != "skip":
        raise ValueError("absent must be 'skip' or 'zero'")
    return per.groupBy(*by).agg(F.avg(f1).alias("macro_f1"))


def mean_cross_entropy(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A3: mean cross-entropy loss (nats)."""
    return pred.groupBy(*by).agg(F.avg("ce").alias("loss"))


def weighted_epoch_mean(values: DataFrame, by: Sequence[str], value: str = "value", n: str = "n") -> DataFrame:
    """A4: epoch mean of per-batch values weighted by batch size."""
    return values.groupBy(*by).agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("epoch_mean"))
