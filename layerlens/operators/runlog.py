"""Experiment-log analytics (L1–L10, A4, J7, S6 helpers).

A metric log is ``(run, metric, step, value[, n])``. Per-series ordered
computations (running bounds, early stopping) use the ordered scan, which
splits a long series over tasks; best checkpoints are cut to the first few
rows in every task before they are shuffled. Result tables
(layer → metric) hold one row per run and are handled with plain
aggregates, pivots and joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlens.operators.scan import segmented_scan
from layerlens.operators.scan import top_k as first_rows

# Display names of the probing tasks in the result analysis.
TASK_NAMES = {
    "bm25_small": "BM25 Score",
    "sem_sim": "Semantic Similarity",
    "term_freq": "Term Frequency",
    "ner": "Named Entity Recognition",
    "fact_check": "Fact Checking",
    "coref": "Coreference",
}

# Header spellings that name the same result column.
RESULT_COLUMN_ALIASES = {
    "model/subject_model/model_name": "model",
    "model/pooler/layer_to_probe": "layer",
    "test/trecmap": "test/trec_map",
    "test/trecndcgat10": "test/trec_ndcg@10",
    "test/trecndcgat20": "test/trec_ndcg@20",
    "test/precisionat10": "test/precision@10",
    "test/precisionat20": "test/precision@20",
}


def metric_name(split: F.Column, metric: F.Column, postfix: str = "") -> F.Column:
    """L1: ``split/metric`` plus the run postfix (e.g. ``/portion_03``);
    ``epoch`` is logged as is."""
    base = F.concat(split, F.lit("/"), metric)
    return F.when(metric == "epoch", metric).otherwise(F.concat(base, F.lit(postfix)))


def metric_bounds(log: DataFrame, keys: Sequence[str] = ("run", "name"), value: str = "value") -> DataFrame:
    """L2: min and max of every metric over all steps, as ``name/min`` and
    ``name/max`` rows."""
    keys = list(keys)
    name = keys[-1]
    agg = log.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    return agg.select(
        *keys[:-1],
        F.explode(F.array(
            F.struct(F.concat(F.col(name), F.lit("/min")).alias("name"), F.col("_min").alias("value")),
            F.struct(F.concat(F.col(name), F.lit("/max")).alias("name"), F.col("_max").alias("value")),
        )).alias("b"),
    ).select(*keys[:-1], "b.name", "b.value")


def running_bounds(log: DataFrame, series: Sequence[str] = ("run", "metric"), step: str = "step", value: str = "value") -> DataFrame:
    """L3: the bounds as they stood after every step."""
    out = segmented_scan(log, list(series), [step], mins=[value], maxs=[value], keys=log.select(*series, step))
    return out.withColumnRenamed(f"runmin_{value}", "run_min").withColumnRenamed(f"runmax_{value}", "run_max").drop("pos")


def best_checkpoints(log: DataFrame, monitor: str, top_k: int = 1, mode: str = "min",
                     run: str = "run", metric: str = "metric", step: str = "step", value: str = "value") -> DataFrame:
    """L4: the ``top_k`` best steps of the monitored metric per run (ties:
    earliest step), with their rank."""
    m = log.filter(F.col(metric) == monitor)
    return first_rows(m, [run], [value if mode == "min" else f"-{value}", step], top_k)


def early_stop(log: DataFrame, patience: int = 10, mode: str = "min",
               series: Sequence[str] = ("run", "metric"), step: str = "step", value: str = "value") -> DataFrame:
    """Per series, the step at which early stopping fires — the first
    step with ``patience`` checks in a row that did not strictly improve on
    the best so far (null if it never fires), and the best value.

    A step improves when it is below every step before it; the last
    improvement up to a step is a running maximum of the positions of
    improvements. A null or NaN never improves."""
    series = list(series)
    value_ = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    s = segmented_scan(log.withColumn("_v", value_ if mode == "min" else -value_), series, [step],
                       before_mins=["_v"], keys=log.select(*series, step))
    improves = F.col("prevmin__v").isNull() | (F.col("_v") < F.col("prevmin__v"))
    marked = s.withColumn("_at", F.col("pos")).withColumn("_imp", F.when(F.col("_v").isNotNull() & improves, F.col("pos")))
    waited = segmented_scan(marked.drop("pos"), series, [step], maxs=["_imp"], keys=log.select(*series, step))
    # before the first number every check waits since the start
    wait = F.col("_at") - F.coalesce("runmax__imp", F.lit(1.0))
    best_v = F.min(value_) if mode == "min" else F.max(value_)
    return waited.groupBy(*series).agg(
        F.min(F.when(wait >= patience, F.col(step))).alias("stop_step"),
        best_v.alias("best"),
        F.count(F.lit(1)).alias("n_steps"),
    )


def layer_curve(results: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("task", "model", "layer")) -> DataFrame:
    """Long form ``(task, model, layer, metric, value)`` ordered by
    task, model, layer (a range-partitioned sort)."""
    keys = list(keys)
    stack = "stack({n}, {body}) as (metric, value)".format(
        n=len(metrics), body=", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    )
    return results.selectExpr(*[f"`{k}`" for k in keys], stack).orderBy(*keys, "metric")


def baseline_lift(curve: DataFrame, baseline: DataFrame, on: Sequence[str] = ("task", "metric")) -> DataFrame:
    """Each curve point beside its task's baseline value and the
    difference (AQE broadcasts the baseline side when it is small)."""
    b = baseline.select(*on, F.col("value").alias("baseline"))
    return curve.join(b, list(on), "left").withColumn("lift", F.col("value") - F.col("baseline"))


def layer_pivot(curve: DataFrame, layers: Sequence[int], row: str | Sequence[str] = "task", value: str = "value") -> DataFrame:
    """Task × layer table (explicit layer list: no extra job to find
    the pivot values)."""
    rows = [row] if isinstance(row, str) else list(row)
    return curve.groupBy(*rows).pivot("layer", list(layers)).agg(F.first(value))


def task_display_names(df: DataFrame, task: str = "task", names: Mapping[str, str] = TASK_NAMES) -> DataFrame:
    """Display name of each task (literal map; unknown tasks get their
    identifier with the first letters capitalised)."""
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn("task_name", F.coalesce(F.element_at(m, F.col(task)),
                                                 F.initcap(F.regexp_replace(F.col(task), "_", " "))))


def metric_label(metric: F.Column, prefix: str = "test/") -> F.Column:
    """Axis label of a metric: the split prefix removed (a prefix, not a
    character set), then capitalised like ``str.capitalize``."""
    stripped = F.regexp_replace(metric, "^" + prefix.replace("/", "\\/"), "")
    return F.concat(F.upper(F.substring(stripped, 1, 1)), F.lower(F.substring(stripped, 2, 1 << 30)))
