"""Sources and sinks: JSON instances with span arrays, qrels, label files,
result CSVs with header drift and blanks around quoted values."""

import os
import tempfile

import pytest

from layerlens.operators import runlog as RL
from layerlens.operators import targets as T
from layerlens.sinks import writers as K
from layerlens.sources import instances as S
from layerlens.sources.results import read_result_csvs


def _tmp():
    return tempfile.mkdtemp(prefix="layerlens-test-")


def test_jsonl_instances_spans_and_empty(spark):
    d = _tmp()
    with open(os.path.join(d, "train.jsonl"), "w") as f:
        f.write('{"text": "a b [SEP] c", "targets": [{"span1": [0, 1], "span2": [2, 3], "label": "x"}]}\n')
        f.write('{"text": "q [SEP] p", "targets": []}\n')
        f.write('{"text": "q [SEP] p", "targets": [{"label": 0.5}]}\n')
    rows = S.read_jsonl_instances(spark, d).collect()
    assert len(rows) == 2
    t = rows[0].targets[0]
    assert (t.span1.a, t.span1.b, t.span2.a, t.span2.b, t.label) == (0, 1, 2, 3, "x")
    assert rows[1].targets[0].span1 is None and float(rows[1].targets[0].label) == 0.5


def test_json_array_instances(spark):
    d = _tmp()
    with open(os.path.join(d, "raw.json"), "w") as f:
        f.write('[{"text": "a", "targets": [{"span1": [1, 2], "label": "y"}]},\n {"text": "b", "targets": []}]')
    assert S.read_json_array_instances(spark, d).count() == 2


def test_qrels_and_label_file(spark):
    d = _tmp()
    with open(os.path.join(d, "qrels.txt"), "w") as f:
        f.write("1 0 10 2\n1 0 11 0\n2 Q0 12 1\n")
    q = sorted(tuple(r) for r in S.read_trec_qrels(spark, d).collect())
    assert q == [(1, "10", 2), (1, "11", 0), (2, "12", 1)]
    d2 = _tmp()
    with open(os.path.join(d2, "labels.txt"), "w") as f:
        f.write("PER  \nLOC\nORG\n")
    assert sorted(tuple(r) for r in S.read_label_dictionary(spark, d2).collect()) == [("LOC", 1), ("ORG", 2), ("PER", 0)]


def test_result_csvs_header_drift_and_blanks(spark):
    root = _tmp()
    os.makedirs(os.path.join(root, "trec"))
    with open(os.path.join(root, "trec", "a.csv"), "w") as f:
        f.write('"Name","model/subject_model/model_name","model/pooler/layer_to_probe","mdl","test/trecmap"\n')
        f.write('"r1","m-a","12", "1234.5","0.43"\n')
        f.write('"r2","m-a","8" ,"2345.25","0.41"\n')
    with open(os.path.join(root, "trec", "b.csv"), "w") as f:
        f.write('"Name","model/subject_model/model_name","model/pooler/layer_to_probe","mdl","test/trec_map","test/f1score"\n')
        f.write('"r3","m-b","1","100.0","0.2","0.5"\n')
    df = read_result_csvs(spark, [os.path.join(root, "trec", "a.csv"), os.path.join(root, "trec", "b.csv")])
    rows = {r.Name: r for r in df.collect()}
    assert rows["r1"].layer == 12 and rows["r1"].mdl == 1234.5 and rows["r1"]["test/trec_map"] == 0.43
    assert rows["r2"].layer == 8
    assert rows["r3"]["test/f1score"] == 0.5 and rows["r1"]["test/f1score"] is None
    assert {r.task for r in rows.values()} == {"trec"}


def test_metric_label_prefix_not_charset(spark):
    df = spark.createDataFrame([("test/accuracy",), ("test/trec_map",), ("compression",)], "m string")
    got = [r.l for r in df.select(RL.metric_label(df.m).alias("l")).collect()]
    assert got == ["Accuracy", "Trec_map", "Compression"]


def test_label_file_with_other_line_ends(spark):
    d = _tmp()
    with open(os.path.join(d, "labels.txt"), "wb") as f:
        f.write(b"A\r\nB\t\r\nC \xc2\xa0x\n")
    assert sorted(tuple(r) for r in S.read_label_dictionary(spark, d).collect()) == [("A", 0), ("B", 1), ("C \u00a0x", 2)]


@pytest.mark.parametrize("line", ["1 0 D7", "x 0 D7 2", "1 0 D7 two", "1 0 D 7 2"])
def test_bad_qrels_lines_fail(spark, line):
    d = _tmp()
    with open(os.path.join(d, "qrels.txt"), "w") as f:
        f.write("1\t0\tD7\t2\n\n" + "3 Q0  D-8 0 \r\n")
    assert sorted(tuple(r) for r in S.read_trec_qrels(spark, d).collect()) == [(1, "D7", 2), (3, "D-8", 0)]
    with open(os.path.join(d, "qrels2.txt"), "w") as f:
        f.write(line + "\n")
    with pytest.raises(Exception, match="not a qrels line"):
        S.read_trec_qrels(spark, d).collect()


@pytest.mark.parametrize("text", ["no separator", "a [SEP] b [SEP] c"])
def test_texts_that_are_no_pairs_fail(spark, text):
    df = spark.createDataFrame([("q [SEP] p",)], "t string")
    assert df.select(T.split_pair(df.t)).first()[0] == ["q", "p"]
    with pytest.raises(Exception, match="not a pair"):
        bad = spark.createDataFrame([(text,)], "t string")
        bad.select(T.split_pair(bad.t)).collect()


def test_unfinished_splits_count_as_missing(spark):
    d = os.path.join(_tmp(), "splits")
    rows = [(s, "t") for s in K.SPLITS]
    K.write_splits(spark.createDataFrame(rows, "split string, text string"), d)
    assert not K.splits_missing(spark, d)
    os.remove(os.path.join(d, "_SUCCESS"))
    assert K.splits_missing(spark, d)
    bounds = spark.createDataFrame([(1.5, -2.0)], "max_score double, min_score double")
    K.write_bounds(bounds, os.path.join(d, "meta"))
    assert S.read_bounds(spark, os.path.join(d, "meta")) == (-2.0, 1.5)


def test_stage_in_order_keeps_null_keys(spark, tmp_path):
    from layerlens.streaming.metric_streams import stage_in_order

    for name, keys in (("some", [1, None, 5, 9, None]), ("nulls", [None, None]), ("none", [])):
        root = stage_in_order(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 3, str(tmp_path / name))
        got = spark.read.schema("k long").option("recursiveFileLookup", True).parquet(root)
        assert sorted((r["k"] for r in got.collect()), key=repr) == sorted(keys, key=repr)


def test_a_replay_has_as_many_batches_as_asked_for(spark, tmp_path):
    from layerlens.streaming import metric_streams as ST

    df = spark.range(90).selectExpr("id as k", "id % 7 as g").repartition(6)
    root = ST.stage_in_order(df, "k", 3, str(tmp_path / "in"))
    assert not os.path.exists(f"{root}-copy")
    stream = ST.file_stream(spark, root, df.schema, ST.files_a_batch(spark, root, 3))
    sink = str(tmp_path / "out")
    ST.run_available(stream.groupBy("g").count(), sink, str(tmp_path / "ck"))
    assert sorted(d for d in os.listdir(sink) if d.startswith("batch_id")) == ["batch_id=0", "batch_id=1", "batch_id=2"]
    got = {r["g"]: r["count"] for r in ST.latest_state(sink, spark, ["g"]).collect()}
    assert got == {g: len(range(g, 90, 7)) for g in range(7)}
