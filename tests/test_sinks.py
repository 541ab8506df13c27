"""Merged state of update-mode sinks, and result files with many headers."""

import os

from pyspark.sql import functions as F

from layerlens.sources.results import read_result_csvs
from layerlens.streaming import metric_streams as ST


def state(spark, sink):
    return {r.k: r.v for r in ST.latest_state(sink, spark, ["k"]).collect()}


def test_merged_state_passes_over_replayed_batches(spark, tmp_path):
    sink = str(tmp_path / "sink")
    write = ST.batch_writer(sink)
    batch = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    write(batch(("a", 1), ("b", 1)), 0)
    write(batch(("a", 2)), 1)
    assert state(spark, sink) == {"a": 2, "b": 1}
    assert ST.compact(sink, spark, ["k"]) == 1
    assert state(spark, sink) == {"a": 2, "b": 1}
    assert not [d for d in os.listdir(sink) if d.startswith("batch_id=")]
    write(batch(("a", 77)), 1)  # replayed after its merge: no effect
    write(batch(("c", 3)), 2)
    assert state(spark, sink) == {"a": 2, "b": 1, "c": 3}
    # a merge that was cut short has no mark and does not count
    broken = os.path.join(sink, "_base", "upto=2")
    batch(("zzz", 9)).withColumn("batch_id", F.lit(2).cast("long")).write.parquet(broken)
    os.remove(os.path.join(broken, "_SUCCESS"))
    assert state(spark, sink) == {"a": 2, "b": 1, "c": 3}
    files = {os.path.basename(os.path.dirname(f)) for f in ST.latest_state(sink, spark, ["k"]).inputFiles()}
    assert files == {"upto=1", "batch_id=2"}
    assert ST.compact(sink, spark, ["k"]) == 2 and ST.compact(sink, spark, ["k"]) == 2
    assert state(spark, sink) == {"a": 2, "b": 1, "c": 3}
    assert os.listdir(os.path.join(sink, "_base")) == ["upto=2"]


def test_many_files_in_three_spellings_are_few_jobs(spark, tmp_path):
    spellings = ['"Name","mdl","test/trecmap"', 'Name , "test/trec_map", extra', "mdl,Name"]
    jobs = []
    for files in (9, 200):
        root = tmp_path / str(files)
        paths = []
        for i in range(files):
            folder = root / f"t{i % 4}"
            folder.mkdir(parents=True, exist_ok=True)
            line = [f'"r{i}", "{i}.5" ,"0.25"', f'r{i},0.5,"a, b"', f"{i},r{i}"][i % 3]
            (folder / f"{i}.csv").write_text(("\n" if i % 7 == 0 else "") + spellings[i % 3] + "\n" + line + "\n\n")
            paths.append(str(folder / f"{i}.csv"))
        spark.sparkContext.setJobGroup(f"csv-{files}", "csv")
        df = read_result_csvs(spark, paths)
        rows = {r.Name: r for r in df.collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"csv-{files}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(rows) == files and set(df.columns) == {"Name", "mdl", "test/trec_map", "extra", "task"}
        assert (rows["r0"].mdl, rows["r0"]["test/trec_map"], rows["r0"].extra, rows["r0"].task) == (0.5, 0.25, None, "t0")
        assert (rows["r1"].mdl, rows["r1"]["test/trec_map"], rows["r1"].extra) == (None, 0.5, "a, b")
        assert (rows["r2"].mdl, rows["r2"]["test/trec_map"], rows["r2"].task) == (2.0, None, "t2")
    assert jobs[1] <= jobs[0] + 1
