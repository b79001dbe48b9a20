import pytest
from pyspark.sql import functions as F

from tallyloom import catalog, convert
from tallyloom.functions import loose
from tallyloom.operators import mixture, records
from tallyloom.sources import readers

ROWS = {
    "mnli": ("premise string, hypothesis string, label int", [("p", "h", 0), ("p", "h2", -1)], ["entailment"]),
    "rte": ("sentence1 string, sentence2 string, label int", [("p", "h", 1)], ["not_entailment"]),
    "ag_news": ("text string, label int", [("t", 2)], ["business"]),
    "sst5": ("text string, label int", [("t", 4), ("u", 7)], ["4"]),
    "stsb": ("sentence1 string, sentence2 string, score double", [("a", "b", 0.5)], ["2"]),
    "banking77": ("text string, label_text string", [("t", "x"), ("u", "y")], ["x", "y"]),
    "boolq": ("passage string, question string, answer boolean", [("p", "q", True)], ["yes"]),
    "mmlu": ("question string, choices array<string>, answer int", [("q", ["a", "b"], 1), ("q", ["a", "a"], 1)], ["opt_2"]),
    "arc": ("question string, choices struct<text: array<string>, label: array<string>>, answerKey string", [("q", (["a", "b", "c"], ["A", "B", "C"]), "C"), ("q", (["a", "b"], ["1", "2"]), "2"), ("q", (["a", "b"], ["A", "B"]), "Z")], ["opt_2", "opt_3"]),
    "hellaswag": ("ctx string, endings array<string>, label string", [("c", ["a", "b"], "0"), ("c", ["a", "b"], "")], ["opt_1"]),
    "winogrande": ("sentence string, option1 string, option2 string, answer string", [("s", "a", "b", "2")], ["opt_2"]),
    "race": ("article string, question string, options array<string>, answer string", [("a", "q", ["w", "x"], "B")], ["opt_2"]),
}


def test_converters(spark):
    for name, (schema, rows, labels) in ROWS.items():
        made = convert.CONVERTERS.find(name)(spark.createDataFrame(rows, schema))
        assert records.problems(made).filter("problem is not null").count() == 0, name
        assert sorted(r.label for r in records.decisions(made).collect()) == labels, name


def test_gold_follows_the_shuffle(spark):
    df = spark.createDataFrame([(f"q{i}", "s", "right", "x", "y", "z") for i in range(20)], "question string, support string, correct_answer string, distractor1 string, distractor2 string, distractor3 string")
    made = records.decisions(convert.CONVERTERS.find("sciq")(df)).collect()
    assert len({r.label for r in made}) > 1
    whole = convert.CONVERTERS.find("sciq")(df).collect()
    assert all(next(o.description for o in r.questions[0].options if o.key == r.targets[0].label) == "right" for r in whole)


def test_preference(spark):
    df = spark.createDataFrame([(f"p{i}", "good", "bad") for i in range(30)] + [("p", "same", "same")], "prompt string, chosen string, rejected string")
    made = convert.CONVERTERS.find("pairwise")(df)
    assert made.count() == 30 and {r.label for r in records.decisions(made).collect()} == {"a", "b"}
    assert made.filter(F.get_json_object("state", "$.answer_a") == F.when(F.col("targets")[0]["label"] == "a", "good").otherwise("bad")).count() == 30


def test_registered_dataset(spark, tmp_path):
    catalog.DATASETS.clear()
    spark.createDataFrame([("t", 0), ("u", 1), ("v", 2)], "text string, label int").write.parquet(str(tmp_path / "raw" / "train"))
    spec = convert.registered("imdb", str(tmp_path / "raw"))
    out = readers.materialised(spark, str(tmp_path / "r"), "imdb", "train", spec.version, 1, spec.build)
    assert out.count() == 1 and out.first().split == "train" and spec.area == "sentiment"


def test_benchmarks_by_rule(spark, tmp_path):
    """Every held-out split of a registered dataset is a benchmark with a name of its own; suites expand to them."""
    catalog.DATASETS.clear()
    catalog.BENCHMARKS.clear()
    convert.register_folder(str(tmp_path))
    assert len(catalog.DATASETS) == len(convert.CONVERTERS) > 90 and len(catalog.BENCHMARKS) > 100
    assert all(b.name == f"{b.dataset}:{b.split}" and b.split != "train" for b in catalog.BENCHMARKS.values())
    names = [b.name for b in catalog.expanded(["nli", "mnli:test", "nli"])]
    assert len(names) == len(set(names)) and "mnli:test" in names
    for split, text in (("test", "held out"), ("validation", "also held out")):
        spark.createDataFrame([(text, 0)], "text string, label int").write.parquet(f"{tmp_path}/imdb/{split}")
    found = convert.evaluation_records(spark, ["imdb:test", "imdb:validation"])
    assert sorted(r.state for r in found.collect()) == ["also held out", "held out"]
    train = convert.CONVERTERS.find("imdb")(spark.createDataFrame([("Held out!", 1), ("free", 1)], "text string, label int"))
    _, report = mixture.build_mixture([(mixture.Source("imdb"), train)], found)
    assert [tuple(r) for r in report.collect()] == [("imdb", 2, 1, 1)]
    catalog.DATASETS.clear()
    catalog.BENCHMARKS.clear()


def test_sources_of_a_config():
    text = readers.mixture_config({"b": 300, "a": 9}, {"b": {"key": "task", "values": 3}})
    got = mixture.sources_of(text)
    assert [s.name for s in got] == ["a", "b"] and (got[1].group_by, got[1].per_group, got[1].repeat_to) == ("task", 1000, 100)
    assert mixture.sources_of("x, y:test")[1].split == "test" and mixture.sources_of([{"name": "z", "weight": "0.5"}])[0].weight == 0.5
    with pytest.raises(ValueError, match="did you mean 'weight'"):
        mixture.sources_of([{"name": "z", "wieght": 1}])


def test_loose_formats(spark):
    df = spark.createDataFrame([("{'a': [1, None, True]}", 'tools: [{"n": 1}] and more', "a &amp; b &eacute;"), ('{"a": 1}', "no mark", None), ("nonsense(", "tools: {broken", "&lt;")], "x string, y string, z string")
    got = df.select(loose.json_or_literal("x").alias("a"), loose.embedded_json("y", F.lit("tools:")).alias("b"), loose.unescaped("z").alias("c")).collect()
    assert [tuple(r) for r in got] == [('{"a": [1, null, true]}', '[{"n": 1}]', "a & b é"), ('{"a": 1}', None, None), (None, None, "<")]
