"""Structured Streaming forms of the reference's incremental accumulators
(ST1–ST4).

* ST1 live min/max per (run, metric): stateful ``groupBy.agg(min, max)``;
* ST2 live batch-size weighted mean per (run, metric, epoch), or per
  event-time window, with a watermark if old windows may leave the state;
* ST3 accumulating code length per portion, and the description length as
  it stands (``live_mdl``);
* ST4 predictions appended as they arrive, metrics computed over the sink.

Sinks are ``foreachBatch`` writers that put every micro-batch into its own
``batch_id=N`` folder with overwrite, so a retried batch replaces its own
output (idempotent) and nothing is collected on the driver. ``compact`` merges
the folders of an update-mode sink into one state, so a read touches that and
the batches since. Stream state and
offsets live under the session's checkpoint folder. ``run_available`` drains
the source once (``availableNow``) — the same code runs continuously with a
processing-time trigger.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerlens.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stage_in_order(df: DataFrame, order_col: str, n_files: int, root: str) -> str:
    """Write ``df`` as ``n_files`` parquet folders holding consecutive ranges
    of ``order_col`` (written one after the other, so a file source reads
    them in that order; null keys are in the first). Used to replay a table as
    a stream. ``df`` is worked out once, into a copy that the ranges are cut
    from and that is then dropped."""
    spark, copy = df.sparkSession, f"{root.rstrip('/')}-copy"
    df.write.mode("overwrite").parquet(copy)
    try:
        return _stage(spark.read.schema(df.schema).parquet(copy), order_col, n_files, root)
    finally:
        drop_folder(spark, copy)


def _stage(df: DataFrame, order_col: str, n_files: int, root: str) -> str:
    b = df.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()
    lo, hi = b["lo"], b["hi"]
    if lo is None:  # no row has a key
        df.write.mode("overwrite").parquet(os.path.join(root, "part-0000"))
        return root
    step = (hi - lo) / n_files
    for i in range(n_files):
        start = lo + step * i
        cond = F.col(order_col) >= F.lit(start)
        if i < n_files - 1:
            cond = cond & (F.col(order_col) < F.lit(lo + step * (i + 1)))
        if i == 0:
            cond = cond | F.col(order_col).isNull()
        df.filter(cond).write.mode("overwrite").parquet(os.path.join(root, f"part-{i:04d}"))
    return root


def _folder(spark: SparkSession, path: str):
    """The path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_folder(spark: SparkSession, path: str) -> None:
    at, fs = _folder(spark, path)
    fs.delete(at, True)


def files_a_batch(spark: SparkSession, root: str, batches: int) -> int:
    """How many files of ``root`` a micro-batch takes so that all are read in
    at most ``batches``. Larger tables are written as more files; a batch a
    file would run the tasks of the whole state for every one of them."""
    at, fs = _folder(spark, root)
    found, n = fs.listFiles(at, True), 0
    while found.hasNext():
        n += not found.next().getPath().getName().startswith(("_", "."))
    return max(1, -(-n // batches))


def file_stream(spark: SparkSession, root: str, schema, files_per_batch: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .parquet(root)
    )


def batch_writer(sink: str, keys: Sequence[str] | None = None, every: int = 0) -> Callable[[DataFrame, int], None]:
    """Each batch into its own folder; with ``every``, all batches so far are
    merged after each so many (``compact``)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(sink, f"batch_id={batch_id}"))
        if every and (batch_id + 1) % every == 0:
            compact(sink, batch.sparkSession, keys)

    return write


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "update", keys: Sequence[str] | None = None,
                  compact_every: int = 0) -> None:
    """Process everything available, micro-batch by micro-batch, then stop."""
    q = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(batch_writer(sink, keys, compact_every))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def _children(spark: SparkSession, path: str, prefix: str, finished: bool = False) -> dict[int, str]:
    """Number → path of the folders ``prefix=N`` of ``path``; ``finished``
    leaves out those whose write has not ended."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    out = {}
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if name.startswith(f"{prefix}=") and (not finished or fs.exists(jvm.Path(f.getPath(), "_SUCCESS"))):
            out[int(name.split("=", 1)[1])] = str(f.getPath())
    return out


def _base(spark: SparkSession, sink: str) -> tuple[int, str | None]:
    """The last batch that is merged, and the folder of the merged state. Its
    ``_SUCCESS`` file, written last, is the mark of a merge that counts."""
    done = _children(spark, os.path.join(sink, "_base"), "upto", finished=True)
    last = max(done, default=-1)
    return last, done.get(last)


def _state_with_batch(sink: str, spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key with the batch that gave it, from the
    merged state and the batches after it."""
    upto, base = _base(spark, sink)
    open_ = [p for n, p in sorted(_children(spark, sink, "batch_id").items()) if n > upto]
    parts = []
    if open_:
        parts.append(spark.read.option("basePath", sink).parquet(*open_).withColumn("batch_id", F.col("batch_id").cast("long")))
    if base:
        parts.append(spark.read.parquet(base))
    if not parts:
        raise ValueError(f"no batch has been written to {sink}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    w = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    # one row per key and batch that updated it since the last merge
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1).drop("_k")


def latest_state(sink: str, spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    """Final value of every key of an update-mode sink: the row of the last
    micro-batch that touched the key. Reads the merged state and the batches
    that came after it."""
    return _state_with_batch(sink, spark, keys).drop("batch_id")


def compact(sink: str, spark: SparkSession, keys: Sequence[str]) -> int:
    """Merge all batches so far into one state and drop their folders; returns
    the last batch that is merged. The merged state is written beside the
    batches and counts from its mark on, so a merge that is cut short changes
    nothing and is made again; a batch that is replayed after its merge is
    passed over by its number. To be run by the stream's driver, between
    batches."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    upto, base = _base(spark, sink)
    batches = _children(spark, sink, "batch_id")
    last = max(batches, default=-1)
    if last > upto:
        target = os.path.join(sink, "_base", f"upto={last}")
        _state_with_batch(sink, spark, keys).write.mode("overwrite").parquet(target)
        upto, base = last, target
    fs = jvm.Path(sink).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [p for n, p in batches.items() if n <= upto]
    old += [p for n, p in _children(spark, os.path.join(sink, "_base"), "upto").items() if n < upto]
    for p in old:
        fs.delete(jvm.Path(p), True)
    return upto


def live_minmax(events: DataFrame) -> DataFrame:
    """ST1 over a metric-log stream ``(run, metric, value)``."""
    return events.groupBy("run", "metric").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"),
                                              F.count(F.lit(1)).alias("n"))


def event_time_utc(df: DataFrame, col: str = "ts") -> F.Column:
    """Event time as a ``TIMESTAMP`` (watermarks need one). A wall-clock
    ``TIMESTAMP_NTZ`` is read as UTC whatever the session time zone, so
    windows line up with UTC-aligned buckets everywhere."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.from_utc_timestamp(F.col(col).cast("timestamp"), F.current_timezone())
    return F.col(col)


def live_epoch_mean(events: DataFrame) -> DataFrame:
    """ST2: batch-size weighted mean per (run, metric, epoch) over a stream
    ``(run, metric, epoch, value, n)``; every row counts, however late."""
    g = events.groupBy("run", "metric", "epoch").agg(F.sum(F.col("value") * F.col("n")).alias("_vn"), F.sum("n").alias("_n"))
    return g.select("run", "metric", "epoch", (F.col("_vn") / F.col("_n")).alias("epoch_mean"))


def live_weighted_mean(events: DataFrame, window: str = "6 hours", watermark: str | None = None) -> DataFrame:
    """ST2 by event-time window. Without ``watermark`` no row is too late;
    with one, windows older than it leave the state and rows for them are
    dropped."""
    e = events.withColumn("event_time", event_time_utc(events))
    e = e.withWatermark("event_time", watermark) if watermark else e
    g = e.groupBy("run", "metric", F.window("event_time", window).alias("w")).agg(
        F.sum(F.col("value") * F.col("n")).alias("_vn"), F.sum("n").alias("_n")
    )
    return g.select("run", "metric", F.unix_timestamp(F.col("w.start")).alias("window_start"),
                    (F.col("_vn") / F.col("_n")).alias("epoch_mean"))


def live_code_length(scored: DataFrame) -> DataFrame:
    """ST3 over a stream of scored rows ``(portion_idx, ce)``."""
    return scored.groupBy("portion_idx").agg(F.sum("ce").alias("ce_sum"), F.count(F.lit(1)).alias("n_scored"))


def live_mdl(spark: SparkSession, code_lengths: DataFrame, first_portion_targets: int, total_targets: int, num_classes: int) -> DataFrame:
    """ST3 view: description length and compression of the code lengths that
    have arrived so far (``portion_idx, ce_sum, n_scored``)."""
    from layerlens.operators.codelength import mdl_and_compression

    rows = code_lengths.withColumn("n_missing_class", F.lit(0).cast("long"))
    return mdl_and_compression(spark, rows, first_portion_targets, total_targets, num_classes)
