"""Registered experiment-log queries over F7 (metric log from events) and
F8 (layer → metric results)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from layerlens.operators import classification as C
from layerlens.operators import runlog as L
from layerlens.plans.fixtures import f7_events, f7_metric_log, f8_layer_results
from layerlens.plans.registry import register
from layerlens.session import ensure_checkpoint_dir
from layerlens.sources.results import read_result_csvs as read_csvs

MONITOR = "error"
# Fixed value: early-stopping patience of the reference configuration.
PATIENCE = 10
LAYERS = list(range(13))

_F7 = """
f7 AS (SELECT user_id AS run, event_type AS metric,
         CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS step,
         ts, value, event_id % 32 + 1 AS n, event_id
       FROM events)"""

_F8 = """
f8 AS (SELECT event_type AS task, user_id % 3 AS model, user_id % 13 AS layer, avg(value) AS value
       FROM events GROUP BY ALL)"""

_SPLIT = "CASE WHEN event_id % 10 < 8 THEN 'train' ELSE 'val' END"


def _split(c):
    return F.when(c % 10 < 8, "train").otherwise("val")


@register("metric_names", oracle=f"""
WITH {_F7}
SELECT run, {_SPLIT} || '/' || metric || '/portion_00' AS name, count(*) AS n FROM f7 GROUP BY ALL
""")
def metric_names(spark, sf_dir):
    """L1: ``split/metric`` names with a run postfix; rows per name."""
    log = f7_events(spark, sf_dir)
    named = log.withColumn("name", L.metric_name(_split(F.col("event_id")), F.col("metric"), "/portion_00"))
    return named.groupBy("run", "name").agg(F.count(F.lit(1)).alias("n"))


@register("metric_minmax", oracle=f"""
WITH {_F7}
SELECT run, metric || '/min' AS name, min(value) AS value FROM f7 GROUP BY ALL
UNION ALL
SELECT run, metric || '/max' AS name, max(value) AS value FROM f7 GROUP BY ALL
""")
def metric_minmax(spark, sf_dir):
    """L2: min and max of every (run, metric) over all steps."""
    log = f7_events(spark, sf_dir).withColumnRenamed("metric", "name")
    return L.metric_bounds(log, ["run", "name"])


@register("running_bounds", oracle=f"""
WITH {_F7}
SELECT run, metric, step,
  min(value) OVER (PARTITION BY run, metric ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_min,
  max(value) OVER (PARTITION BY run, metric ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_max
FROM f7
""")
def running_bounds(spark, sf_dir):
    """L3: min/max of each series as they stood after every step."""
    rb = L.running_bounds(f7_metric_log(spark, sf_dir).select("run", "metric", "step", "value"))
    return rb.select("run", "metric", "step", "run_min", "run_max")


@register("best_checkpoint", oracle=f"""
WITH {_F7},
r AS (SELECT run, step, value, row_number() OVER (PARTITION BY run ORDER BY value, step) AS rank
      FROM f7 WHERE metric = '{MONITOR}')
SELECT run, step, value, rank FROM r WHERE rank <= 3
""")
def best_checkpoint(spark, sf_dir):
    """L4: the three best steps of the monitored metric per run (mode min)."""
    best = L.best_checkpoints(f7_metric_log(spark, sf_dir), MONITOR, top_k=3)
    return best.select("run", "step", "value", F.col("rank").cast("long").alias("rank"))


@register("early_stop", oracle=f"""
WITH {_F7},
b AS (SELECT run, metric, step, value,
        min(value) OVER (PARTITION BY run, metric ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best
      FROM f7),
i AS (SELECT *, max(CASE WHEN prev_best IS NULL OR value < prev_best THEN step END)
                  OVER (PARTITION BY run, metric ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp
      FROM b)
SELECT run, metric, min(CASE WHEN step - last_imp >= {PATIENCE} THEN step END) AS stop_step,
       min(value) AS best, count(*) AS n_steps
FROM i GROUP BY run, metric
""")
def early_stop(spark, sf_dir):
    """Step at which early stopping (patience 10, strict improvement)
    fires for every series, or null."""
    es = L.early_stop(f7_metric_log(spark, sf_dir), PATIENCE)
    return es.select("run", "metric", F.col("stop_step").cast("int").alias("stop_step"), "best", "n_steps")


@register("epoch_weighted_mean", oracle=f"""
WITH {_F7}
SELECT run, metric, CAST((step - 1) // 5 AS BIGINT) AS epoch, round(sum(value * n) / sum(n), 6) AS epoch_mean FROM f7 GROUP BY ALL
""")
def epoch_weighted_mean(spark, sf_dir):
    """A4: epoch means (5 logged batches per epoch) weighted by batch size."""
    log = f7_metric_log(spark, sf_dir).withColumn("epoch", F.floor((F.col("step") - 1) / 5).cast("long"))
    m = C.weighted_epoch_mean(log, ["run", "metric", "epoch"])
    return m.select("run", "metric", "epoch", F.round("epoch_mean", 6).alias("epoch_mean"))


@register("layer_curve", oracle=f"""
WITH {_F8}
SELECT task, model, layer, 'value' AS metric, round(value, 6) AS value FROM f8
""")
def layer_curve(spark, sf_dir):
    """Layer → metric curve per (task, model), long form, sorted."""
    c = L.layer_curve(f8_layer_results(spark, sf_dir), ["value"])
    return c.select("task", "model", "layer", "metric", F.round("value", 6).alias("value"))


@register("baseline_lift", oracle=f"""
WITH {_F8}, b AS (SELECT task, value AS baseline FROM f8 WHERE model = 0 AND layer = 0)
SELECT f8.task, model, layer, round(value, 6) AS value, round(baseline, 6) AS baseline,
       round(value - baseline, 6) AS lift
FROM f8 LEFT JOIN b USING (task)
""")
def baseline_lift(spark, sf_dir):
    """Every curve point beside the task's baseline (model 0, layer 0)."""
    curve = L.layer_curve(f8_layer_results(spark, sf_dir), ["value"])
    base = curve.filter((F.col("model") == 0) & (F.col("layer") == 0))
    out = L.baseline_lift(curve, base)
    return out.select("task", "model", "layer", F.round("value", 6).alias("value"),
                      F.round("baseline", 6).alias("baseline"), F.round("lift", 6).alias("lift"))


@register("layer_pivot", oracle=f"""
WITH {_F8}
SELECT task, model, {", ".join(f"round(max(CASE WHEN layer = {i} THEN value END), 6) AS l{i}" for i in LAYERS)}
FROM f8 GROUP BY task, model
""")
def layer_pivot(spark, sf_dir):
    """(task, model) × layer table of the results."""
    pv = L.layer_pivot(f8_layer_results(spark, sf_dir), LAYERS, row=["task", "model"])
    return pv.select("task", "model", *[F.round(F.col(str(i)), 6).alias(f"l{i}") for i in LAYERS])


_TASK_OF = {"click": "ner", "view": "bm25_small", "error": "fact_check"}


@register("task_names", oracle=f"""
WITH {_F8},
t AS (SELECT DISTINCT CASE task WHEN 'click' THEN 'ner' WHEN 'view' THEN 'bm25_small' WHEN 'error' THEN 'fact_check' ELSE task END AS task FROM f8)
SELECT task, CASE task WHEN 'ner' THEN 'Named Entity Recognition' WHEN 'bm25_small' THEN 'BM25 Score' WHEN 'fact_check' THEN 'Fact Checking'
       ELSE upper(left(task, 1)) || lower(substr(task, 2)) END AS task_name FROM t
""")
def task_names(spark, sf_dir):
    """Display names for the tasks: from the map where it has the task,
    else from the identifier."""
    name = F.col("task")
    for event, task in _TASK_OF.items():
        name = F.when(F.col("task") == event, task).otherwise(name)
    tasks = f8_layer_results(spark, sf_dir).select(name.alias("task")).distinct()
    return L.task_display_names(tasks).select("task", "task_name")


@register("read_result_csvs", oracle=f"""
WITH {_F8}
SELECT task, CAST(model AS VARCHAR) AS model, count(*) AS n_runs, round(avg(value), 6) AS mean_value,
       count(*) AS n_metric
FROM f8 GROUP BY task, model
""")
def read_result_csvs(spark, sf_dir):
    """F8 written as one CSV folder per (task, model) — model 0 and 2
    with the old header spellings — and read back through the alias map."""
    root = os.path.join(ensure_checkpoint_dir(spark), f"results-{uuid.uuid4().hex}")
    f8 = f8_layer_results(spark, sf_dir)
    # two header spellings (even models the old one), each written once,
    # partitioned into one folder per (task, run)
    paths = []
    for parity, metric in ((0, "test/trecmap"), (1, "test/trec_map")):
        part = f8.filter(F.col("model") % 2 == parity).select(
            "task",
            F.col("model").alias("run"),
            F.concat(F.lit("run-"), F.col("model").cast("string")).alias("Name"),
            F.col("model").cast("string").alias("model/subject_model/model_name"),
            F.col("layer").cast("string").alias("model/pooler/layer_to_probe"),
            F.col("value").alias(metric),
        )
        path = os.path.join(root, f"spelling{parity}")
        part.write.partitionBy("task", "run").option("header", True).csv(path)
        paths.append(path)
    res = read_csvs(spark, paths, task_level=None).drop("run")
    return res.groupBy("task", "model").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.round(F.avg("test/trec_map"), 6).alias("mean_value"),
        F.count("test/trec_map").alias("n_metric"),
    )
