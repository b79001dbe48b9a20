from pyspark.sql import functions as F

from tallyloom import catalog, cli
from tallyloom.operators import records
from tallyloom.sources import readers


def build(spark, split, cap):
    df = spark.createDataFrame([(str(i), f"text {i}", "ab"[i % 2]) for i in range(10)], "id string, state string, label string")
    return records.choice_records(df, source="tiny", state=F.col("state"), instructions="Which?", choices=[("a", "A"), ("b", "B")], label=F.col("label"), id_=F.col("id"), split=split)


def test_verbs(spark, tmp_path):
    catalog.DATASETS.clear()
    catalog.DATASETS.register("tiny", catalog.Dataset("tiny", build, splits=("train", "test")))
    folder = ["--folder", str(tmp_path / "r")]
    assert cli.main([*folder, "data", "list"])[0]["splits"] == "train,test"
    assert cli.main([*folder, "data", "prepare", "tiny"]) == {"records": 10}
    assert "A = a: A" in cli.main([*folder, "data", "show", "tiny", "-n", "1"])[0]["prompt"]
    held = str(tmp_path / "held.jsonl")
    readers.write_records(build(spark, "test", None).filter("id < '3'"), held)
    out = cli.main([*folder, "mix", "tiny", "--exclude", held, "--out", str(tmp_path / "mix")])
    assert out == [{"source": "tiny", "loaded": 10, "overlap_removed": 3, "used": 7}]
    assert readers.read_records(spark, str(tmp_path / "mix")).count() == 7
    cli.main([*folder, "mix", "tiny", "--exclude", held, "--out", str(tmp_path / "objects"), "--objects"])
    key = lambda where: sorted((r.id, r.state, r.targets[0].label, [o.key for o in r.questions[0].options]) for r in readers.read_records(spark, str(tmp_path / where)).collect())
    assert key("objects") == key("mix") and '"questions":{' in spark.read.text(str(tmp_path / "objects")).first().value


def test_eval(spark, tmp_path):
    df = spark.createDataFrame([("r", "q", "choice", [1.0, 0.0], i % 2, {"k": str(i % 2)}) for i in range(10)], "id string, name string, type string, logits array<double>, target int, meta map<string,string>")
    df.write.parquet(str(tmp_path / "s"))
    out = cli.main(["eval", str(tmp_path / "s"), "--keys", "k"])
    assert out["accuracy"] == 0.5 and len(out["breakdown"]) == 2
