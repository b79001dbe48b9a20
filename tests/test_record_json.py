"""Record files: reading and writing are inverse, order and labels are kept, and JSON is compared by value."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import records
from tallyloom.sources import record_json

FIXTURE = [
    {"id": "r1", "state": {"ticket": "I was charged twice <decide> \"x\"\n", "b": [1, {"z": None, "a": "é"}]}, "questions": {"team": {"type": "choice", "instructions": "Which team?", "criteria": {"tech": "T", "billing": "B", "other": ""}}, "urgent": {"type": "noul", "instructions": "Urgent?"}, "anger": {"type": "score", "instructions": "How angry?", "criteria": ["calm", "annoyed", "furious"]}}, "targets": {"team": {"label": "billing"}, "urgent": {"label": "yes"}, "anger": {"label": "1", "probs": {"0": 0.2, "1": 0.7, "2": 0.1}}}, "images": ["a.png"], "media": [{"type": "video", "frames": ["1.jpg", "2.jpg"], "fps": 1.0, "duration": 4.0, "audio": "a.wav"}], "meta": {"source": "t", "split": "test", "area": "support", "k": "v"}},
    {"id": "r2", "state": "{not json", "questions": {"q": {"type": "noul", "instructions": "", "criteria": {"false": "wrong", "true": "right"}}}},
    {"id": "r3", "state": "{}", "questions": {"q": {"type": "choice", "instructions": " ", "criteria": {"{\"label\": 1}": "", "b": "\t"}}}, "targets": {"q": {"label": "{\"label\": 1}"}}},
    {"id": "r4", "state": [1, "two"], "questions": {"q": {"type": "noul", "instructions": "?"}}, "meta": {"n": "3"}},
    {"id": "r5", "state": 2.5, "questions": {"q": {"type": "noul", "instructions": "?"}}, "targets": {"q": {"label": "no"}}},
    {"id": "r6", "state": True, "questions": {"q": {"type": "noul", "instructions": "?"}}},
    {"id": "r7", "state": None, "questions": {"q": {"type": "noul", "instructions": "?"}}},
]


def test_read_write_read_is_the_identity(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=i % 2 == 0) for i, r in enumerate(FIXTURE)) + "\n\n  \n")
    read = record_json.read_lines(spark, str(tmp_path / "in.jsonl"))
    assert record_json.write_lines(read, str(tmp_path / "out")) == len(FIXTURE)
    written = [json.loads(line) for p in (tmp_path / "out").glob("*.txt") for line in p.read_text().split("\n") if line]
    assert sorted(map(json.dumps, written)) == sorted(map(json.dumps, FIXTURE)), "order of keys included"
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(record_json.read_lines(spark, str(tmp_path / "out"))) == key(read)
    assert read.schema.simpleString() == spark.createDataFrame([], records.RECORD).schema.simpleString()


def test_order_labels_and_kinds(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, FIXTURE)))
    got = {r.id: r for r in record_json.read_lines(spark, str(tmp_path / "in.jsonl")).collect()}
    assert [q.name for q in got["r1"].questions] == ["team", "urgent", "anger"]
    assert [o.key for o in got["r1"].questions[0].options] == ["tech", "billing", "other"]
    assert got["r1"].state == '{"ticket":"I was charged twice <decide> \\"x\\"\\n","b":[1,{"z":null,"a":"é"}]}'
    assert got["r1"].targets[2].probs == {"0": 0.2, "1": 0.7, "2": 0.1} and (got["r1"].split, got["r1"].area) == ("test", "support")
    assert got["r3"].targets[0].label == '{"label": 1}'
    assert [(r, got[r].state_kind) for r in sorted(got)] == [("r1", "object"), ("r2", "text"), ("r3", "text"), ("r4", "array"), ("r5", "number"), ("r6", "boolean"), ("r7", "null")]
    assert [o.description for o in got["r2"].questions[0].options] == ["wrong", "right"]
    assert got["r7"].state is None


def test_other_forms_of_targets(spark):
    q = '{"id": 5, "questions": {"u": {"type": "noul", "instructions": "?"}, "s": {"type": "score", "instructions": "?", "criteria": ["a", "b"]}}, "targets": %s, "family": "f", "split": "dev", "meta": {"family": "own"}}'
    forms = ['{"u": true, "s": 1}', '{"u": {"label": "FALSE"}, "s": {"label": 0}}', '{"u": {"probabilities": {"true": 0.75, "false": 0.25}}, "s": null}', "null"]
    got = [r.targets for r in record_json.records_of(spark.createDataFrame([(q % f,) for f in forms], "value string").coalesce(1)).collect()]
    assert [[t.label for t in ts] for ts in got] == [["yes", "1"], ["no", "0"], [None, None], []]
    assert got[2][0].probs == {"yes": 0.75, "no": 0.25}
    one = record_json.records_of(spark.createDataFrame([(q % "{}",)], "value string")).first()
    assert (one.state, one.split, one.meta) == ("", "dev", {"family": "own"})


@pytest.mark.parametrize("line", ['{"id": 1, ', "[1]", '{"questions": {}}'])
def test_broken_lines_are_errors(spark, line):
    with pytest.raises(Exception, match="MALFORMED|without an id"):
        record_json.records_of(spark.createDataFrame([(line,)], "value string")).collect()


def test_canonical_json(spark):
    same = [['{"b": {"y": 1, "x": [1, 2]}, "a": "\\u00e9"}', '{"a":"é","b":{"x":[1,2],"y":1.0}}'], ["[1, 2]", "[1,2]"], [" no json ", "no json"], ['"x"', ' "x"']]
    other = ["[2,1]", '{"a":1,"a":2}', "1", '"1"', "null", ""]
    df = spark.createDataFrame([(i, x) for i, xs in enumerate([*same, *[[x] for x in other]]) for x in xs], "i int, x string")
    keys = df.groupBy("i").agg(F.collect_set(record_json.canonical_json(F.col("x"))).alias("k")).collect()
    assert all(len(r.k) == 1 for r in keys) and len({r.k[0] for r in keys}) == len(same) + len(other)


def test_lines_are_numbered_by_file_across_blocks(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 3)):
        (tmp_path / f"{name}.txt").write_text("".join(f"line {i} of {name}\n" if i % 7 else "\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = record_json.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5003
    assert all(r.value == (f"line {r.line} of {r.file[-5]}" if r.line % 7 else "") for r in rows)


def test_first_of_states_goes_by_file_and_line(spark):
    rows = [("b", 1, '{"x": 1, "y": 2}'), ("a", 9, '{"y": 2, "x": 1}'), ("a", 2, '{"x": 2}'), ("c", 0, None), ("a", 10, '{"y":2.0,"x":1}')]
    df = spark.createDataFrame(rows, "file string, line int, state string")
    got = record_json.first_of_states(df, F.col("state"), "file", "line").collect()
    assert sorted((r.file, r.line, r.times) for r in got) == [("a", 2, 1), ("a", 9, 3), ("c", 0, 1)]
