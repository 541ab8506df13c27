"""Registered streaming queries: each replays data derived from the tables
as a file stream (availableNow) and must equal the batch result (the oracle
SQL is the batch computation)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from layerlens.operators import ranking as R
from layerlens.operators import codelength as L
from layerlens.operators import sampling as S
from layerlens.plans.fixtures import F6_DOC, f3_vectors, f6_qrels, f6_run, f7_metric_log
from layerlens.plans.q_dataset import F3_PORTIONS
from layerlens.plans.q_probe import _MDL, NUM_CLASSES
from layerlens.plans.q_ranking import KS
from layerlens.plans.registry import ORACLES, register
from layerlens.sources.tables import table
from layerlens.streaming import metric_streams as ST

N_FILES = 3


def _event_log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "ts", "value",
        (F.col("event_id") % 32 + 1).alias("n"),
    )


def _replay(spark, df, order_col, name):
    root = ST.scratch(spark, f"{name}-in")
    ST.stage_in_order(df, order_col, N_FILES, root)
    return ST.file_stream(spark, root, df.schema, ST.files_a_batch(spark, root, N_FILES))


@register("stream_minmax", oracle="""
SELECT user_id AS run, event_type AS metric, min(value) AS min_value, max(value) AS max_value, count(*) AS n
FROM events GROUP BY ALL
""")
def stream_minmax(spark, sf_dir):
    """ST1: live min/max per (run, metric) over a 3-batch replay of events."""
    stream = _replay(spark, _event_log(spark, sf_dir), "ts", "st1")
    sink, ck = ST.scratch(spark, "st1-out"), ST.scratch(spark, "st1-ck")
    ST.run_available(ST.live_minmax(stream), sink, ck, "update", ["run", "metric"], compact_every=2)
    return ST.latest_state(sink, spark, ["run", "metric"])


@register("stream_epoch_mean", oracle="""
SELECT user_id AS run, event_type AS metric, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS window_start,
       round(sum(value * (event_id % 32 + 1)) / sum(event_id % 32 + 1), 6) AS epoch_mean
FROM events GROUP BY ALL
""")
def stream_epoch_mean(spark, sf_dir):
    """ST2: batch-size weighted mean per (run, metric, 6-hour window)."""
    stream = _replay(spark, _event_log(spark, sf_dir), "ts", "st2")
    sink, ck = ST.scratch(spark, "st2-out"), ST.scratch(spark, "st2-ck")
    ST.run_available(ST.live_weighted_mean(stream), sink, ck, "update")
    out = ST.latest_state(sink, spark, ["run", "metric", "window_start"])
    return out.select("run", "metric", "window_start", F.round("epoch_mean", 6).alias("epoch_mean"))


@register("stream_epochs", oracle=ORACLES["epoch_weighted_mean"])
def stream_epochs(spark, sf_dir):
    """ST2/A4: the weighted mean of every epoch (5 logged batches) as the
    log arrives; equals the batch result."""
    log = f7_metric_log(spark, sf_dir).select(
        "run", "metric", "ts", "value", "n", F.floor((F.col("step") - 1) / 5).cast("long").alias("epoch")
    )
    stream = _replay(spark, log, "ts", "st2e")
    sink, ck = ST.scratch(spark, "st2e-out"), ST.scratch(spark, "st2e-ck")
    ST.run_available(ST.live_epoch_mean(stream), sink, ck, "update")
    out = ST.latest_state(sink, spark, ["run", "metric", "epoch"])
    return out.select("run", "metric", "epoch", F.round("epoch_mean", 6).alias("epoch_mean"))


@register("stream_codelength", oracle=f"""
WITH {_MDL}
SELECT CAST(portion_idx AS INTEGER) AS portion_idx, round(ce_sum, 6) AS ce_sum, n_scored FROM per
""")
def stream_codelength(spark, sf_dir):
    """ST3: code length accumulated per portion as scored chunks arrive (as
    many batches as portions); equals the batch online-coding sums."""
    out, _ = _streamed_code(spark, sf_dir)
    return out.select("portion_idx", F.round("ce_sum", 6).alias("ce_sum"), "n_scored")


def _streamed_code(spark, sf_dir):
    f3 = f3_vectors(spark, sf_dir)
    n = f3.count()
    permuted = S.permute(f3)
    scored = L.scored_chunks(permuted, S.portions_table(spark, n, F3_PORTIONS), NUM_CLASSES)
    scored = scored.select(F.col("portion_idx").cast("int"), "ce")
    # scored once; the portions then arrive one after the other
    root, copy, portions = ST.scratch(spark, "st3-in"), ST.scratch(spark, "st3-scored"), len(F3_PORTIONS) - 1
    scored.write.partitionBy("portion_idx").parquet(copy)
    arrived = spark.read.schema(scored.schema).parquet(copy).select(scored.columns)
    for k in range(portions):
        arrived.filter(F.col("portion_idx") == k).write.mode("overwrite").parquet(os.path.join(root, f"part-{k:04d}"))
    ST.drop_folder(spark, copy)
    stream = ST.file_stream(spark, root, scored.schema, ST.files_a_batch(spark, root, portions))
    sink, ck = ST.scratch(spark, "st3-out"), ST.scratch(spark, "st3-ck")
    ST.run_available(ST.live_code_length(stream), sink, ck, "update")
    return ST.latest_state(sink, spark, ["portion_idx"]), n


@register("stream_mdl", oracle=ORACLES["compression"])
def stream_mdl(spark, sf_dir):
    """ST3/A6/A7: description length and compression over the streamed code
    lengths; equals the batch result when all chunks have arrived."""
    out, n = _streamed_code(spark, sf_dir)
    rep = ST.live_mdl(spark, out, S.portion_sizes(n, F3_PORTIONS)[0], n, NUM_CLASSES)
    return rep.select(
        F.round("mdl", 6).alias("mdl"), F.round("compression", 6).alias("compression"),
        F.round("uniform_codelength", 6).alias("uniform_codelength"), "n_scored",
    )


@register("stream_predictions")
def stream_predictions(spark, sf_dir):
    """ST4: judged predictions appended to a sink as they arrive; the ranking
    bundle is then computed over the sink (equals ``ranking_report``)."""
    qrels = R.dedupe_qrels(f6_qrels(spark, sf_dir), "q_id", F6_DOC)
    judged = R.judge_run(f6_run(spark, sf_dir), qrels, "q_id", F6_DOC).drop("n_lines")
    stream = _replay(spark, judged, "q_id", "st4")
    sink, ck = ST.scratch(spark, "st4-out"), ST.scratch(spark, "st4-ck")
    ST.run_available(stream, sink, ck, "append")
    arrived = spark.read.parquet(sink).drop("batch_id")
    ranked = R.rank_run(arrived, "q_id", F6_DOC, "score")
    pq = R.per_query_metrics(ranked, "q_id", KS)
    trec = R.trec_metrics(pq, R.ideal_dcg(qrels, "q_id", "grade", KS), "q_id", KS)
    rep = R.ranking_report(trec, KS)
    return rep.select("metric", F.round("value", 6).alias("value"), F.col("n_queries").cast("long").alias("n_queries"))


ORACLES["stream_predictions"] = ORACLES["ranking_report"]
