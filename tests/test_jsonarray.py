"""A JSON array cut anywhere: the maps of its ranges, and reads by many tasks."""

import json
import random

import numpy as np
import pytest

from layerlens.sources import instances as S
from layerlens.sources import jsonarray as J

HARD = [
    {"text": 'a,b],[ "x\\" , {"', "n": 1}, {"text": "\\\\", "n": 2}, {"text": '\\\\\\",', "t": [[1, 2], [], {"k": ["]", "}"]}]},
    {"text": "é中😀, \t", "n": None}, {"text": "", "t": {}}, 7, "lone, string]", [1, [2, 3]], None,
]


def cut_at_commas(data: bytes, places):
    """Ranges as Spark makes them: each begins after a comma."""
    bounds = sorted({0, len(data), *(data.find(b",", p) + 1 for p in places if data.find(b",", p) >= 0)})
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def parts_of(ranges):
    arrays = [np.frombuffer(r, np.uint8) for r in ranges]
    begin = J.compose([J.range_map(d) for d in arrays])
    pieces = {}
    for i, (d, (inside, depth, owner)) in enumerate(zip(arrays, begin)):
        got = J.elements(d, inside, depth)
        for n, x in enumerate(got):
            key = owner if n == 0 else (i, n) if n < len(got) - 1 else i
            pieces.setdefault(key, []).append(x)
    return [x for x in (b"".join(v) for v in pieces.values()) if x.strip()]


@pytest.mark.parametrize("indent", [None, 1])
def test_every_cut_gives_the_same_elements(indent):
    data = json.dumps(HARD, indent=indent, ensure_ascii=False).encode()
    want = sorted(json.dumps(x) for x in HARD)
    for at in range(len(data)):
        got = sorted(json.dumps(json.loads(x)) for x in parts_of(cut_at_commas(data, [at])))
        assert got == want, at
    rng = random.Random(4)
    for _ in range(100):
        places = [rng.randrange(len(data)) for _ in range(rng.randint(0, 9))]
        assert sorted(json.dumps(json.loads(x)) for x in parts_of(cut_at_commas(data, places))) == want


def test_arrays_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(6)
    marks = ['"', "\\", ",", "]", "}", "[", "{", "é", "😀", " ", "x"]
    items = [{"text": "".join(rng.choice(marks) for _ in range(rng.randint(0, 40))),
              "targets": [{"span1": [i, i + 1], "label": "a,b"}] * rng.randint(0, 3)} for i in range(3000)]
    items.append({"text": "long" * 20_000, "targets": []})
    (tmp_path / "one.json").write_text(json.dumps(items[:1700], ensure_ascii=False))
    (tmp_path / "two.json").write_text("\n " + json.dumps(items[1700:], indent=2) + "\n")
    (tmp_path / "empty.json").write_text("[ ]")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        assert J._ranges(spark, str(tmp_path)).rdd.getNumPartitions() > 30
        got = S.read_json_array_instances(spark, str(tmp_path)).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted((r.text, len(r.targets)) for r in got) == sorted((x["text"], len(x["targets"])) for x in items)
    assert all((t.span1.b, t.label) == (t.span1.a + 1, "a,b") for r in got for t in r.targets)


@pytest.mark.parametrize("text", ['[{"text": "a"}', '{"text": "a"}', '[1, 2]]', '["a'])
def test_files_that_are_no_array_fail(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="JSON array"):
        J.read_json_array(spark, str(tmp_path)).collect()


def test_small_files_are_read_in_one_pass(spark, tmp_path, monkeypatch):
    """A file of one small range takes no pass for its map and is not written
    again; a larger one beside it is not read whole."""
    (tmp_path / "hard.json").write_text(json.dumps(HARD, indent=1, ensure_ascii=False))
    (tmp_path / "empty.json").write_text(" [ \n] ")
    (tmp_path / "none.json").write_text("")
    want = sorted(json.dumps(x) for x in HARD)
    written = []
    monkeypatch.setattr(J, "materialize", lambda df, f=J.materialize: written.append(df) or f(df))
    got = [json.loads(r.element) for r in J.read_json_array(spark, str(tmp_path)).collect()]
    assert sorted(map(json.dumps, got)) == want and not written
    (tmp_path / "more.json").write_text(json.dumps(["x" * 5000] * 4))
    monkeypatch.setattr(J, "WHOLE_BYTES", 15_000)
    assert J._whole(spark, str(tmp_path / "more.json"), 15_000).rdd.getNumPartitions() == 0
    got = [json.loads(r.element) for r in J.read_json_array(spark, str(tmp_path)).collect()]
    assert sorted(map(json.dumps, got)) == sorted(want + [json.dumps("x" * 5000)] * 4) and len(written) == 1
