import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import hashing as H
from tallyloom.functions import scores as S
from tallyloom.functions import text as X


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_hash_mod_is_that_of_the_whole_digest(spark):
    keys = [f"k{random.Random(i).random()}" for i in range(50)] + ["", "é"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", H.hash_mod(F.col("k"), 10).alias("a"), H.hash_mod(F.col("k"), 100).alias("b"), H.stable_id(F.col("k"), F.lit(None).cast("string")).alias("i"))
    for r in df.collect():
        whole = int(hashlib.sha1(r.k.encode()).hexdigest(), 16)
        assert (r.a, r.b) == (whole % 10, whole % 100)
        assert r.i == hashlib.sha1(f"{r.k}|None".encode()).hexdigest()[:16]


@pytest.mark.parametrize(("value", "number"), [("1,234.5", 1234.5), ("(7)", -7.0), ("$3", 3.0), ("-$12", -12.0), ("12%", 12.0), ("x", None), ("", None)])
def test_parsed_number(spark, value, number):
    assert one(spark, X.parsed_number(F.lit(value))) == number


def test_options(spark):
    opts = F.array(F.lit("Red"), F.lit("Blue"), F.lit("red ish"))
    assert one(spark, X.unique_index(F.lit("A. red "), opts)) == 0
    assert one(spark, X.unique_index(F.lit("green"), opts)) is None
    assert one(spark, X.letter_index(F.lit("(B) x"), 3)) == 1
    assert one(spark, X.letter_index(F.lit("E"), 3)) is None
    assert one(spark, X.listed_options(F.lit("Q?\nA. one\nB. two"))) == ["one", "two"]
    assert one(spark, X.listed_options(F.lit("A. one\nC. two"))) is None


def test_text(spark):
    assert one(spark, X.camel_split(F.lit("fooBarBaz"))) == "foo Bar Baz"
    assert one(spark, X.seconds(F.lit("01:02:03.5"))) == 3723.5
    assert one(spark, X.neutralised(F.lit("a <decide> b"))) == "a ‹decide> b"
    assert one(spark, X.filled(F.lit("the [x] of [y]"), F.array(F.lit("$1"), F.lit("b")))) == "the $1 of b"
    assert one(spark, X.media_tags(F.lit("<image:2> and <image:1>"), "image")) == [2, 1]
    assert one(spark, X.frame_count(F.lit(2.5), 1.0, 8)) == 2
    assert one(spark, X.even_picks(F.lit(10), 4)) == [1, 3, 6, 8]
    assert one(spark, X.kept_share(F.lit(9), F.lit(10)), X.kept_share(F.lit(0), F.lit(9)), X.kept_share(F.lit(1), F.lit(2)), X.kept_share(F.lit(0), F.lit(0))) == ("keep", "drop", "truncate", None)
    blob = '{"judge_response": {"correctness_score": 0.7}, "score": 1}'
    assert one(spark, X.json_score(F.lit(blob)), X.json_score(F.lit('{"score": "0.5"}')), X.json_score(F.lit("no"))) == (0.7, 0.5, None)


def test_scores(spark):
    p = one(spark, S.softmax(F.array(F.lit(2.0), F.lit(0.0), F.lit(-1.0))))
    assert abs(sum(p) - 1) < 1e-12 and p[0] > p[1] > p[2]
    assert one(spark, S.expected_level(F.array(F.lit(0.0), F.lit(0.5), F.lit(0.5)))) == 1.5
    assert one(spark, S.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert one(spark, S.confidence(F.array(F.lit(0.5), F.lit(0.5)))) == 0
    labels, probs = F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("b"), F.lit(2.0))
    assert one(spark, S.soft_target(labels, probs)) == [0.0, 1.0]
    assert one(spark, S.soft_target(labels, F.create_map(F.lit("c"), F.lit(2.0)))) is None
    q = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    assert one(spark, S.ranked_probability(q, q)) == 0
    assert one(spark, S.ranked_probability(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), q)) == 1
    assert [one(spark, S.confidence_bin(F.lit(c))) for c in (0.0, 0.1, 0.1001, 1.0)] == [0, 0, 1, 9]


def test_cloze_and_constraints(spark):
    from tallyloom.functions import text as X

    df = spark.createDataFrame([("a #x# b #x# c", ["one", "two"], 1), ("#x#", ["one", "two"], 0), ("#x#!", ["$1"], 5)], "t string, a array<string>, k int")
    assert [r[0] for r in df.select(X.cloze(F.col("t"), "#x#", F.col("a"), F.col("k"))).collect()] == ["a one b ____ c", None, "$1!"]
    df = spark.createDataFrame([("length:number_words", '{"n": 5, "relation": "at least", "x": null, "y": []}'), ("a:b", "{}"), ("a:b", None)], "n string, j string")
    assert [r[0] for r in df.select(X.constraint_text(F.col("n"), F.col("j"))).collect()] == ["length / number words (n=5, relation='at least')", "a / b", "a / b"]


def test_bands_and_elements(spark):
    df = spark.createDataFrame([(-1.0,), (-0.05,), (0.26,), (1.0,)], "x double")
    assert [tuple(r) for r in df.select(X.sentiment_level(F.col("x")), X.opinion_score((F.col("x") + 1) * 50), X.sign_band(F.col("x"))).collect()] == [(0, 0, "negative"), (2, 2, "neutral"), (3, 3, "positive"), (4, 4, "positive")]
    df = spark.createDataFrame([('{"title": "Go", "name": "go", "id": "Go"}', "a"), ("{}", "div")], "j string, tag string")
    told = df.select(X.element_text(F.col("j"), tag=F.col("tag")), X.element_text(F.col("j"), named=True, most=12)).collect()
    long = spark.createDataFrame([(f'{{"role": "button", "class": "{"c" * 60}", "aria_label": "Close"}}',)], "j string")
    assert long.select(X.element_text(F.col("j"))).first()[0] == "Close | button | " + "c" * 40
    assert [tuple(r) for r in told] == [("<a> Go | go", "title=Go | …"), ("<div>", "")]


def test_numbers_in_texts(spark):
    from tallyloom.functions import numbers as N

    text = "Revenue rose 12.5% to $3.2 million (2019: -$1,234.50), 4k users, v1.2.3, 2024-05-06, abc12, 7 of 10, €5bn, 3,45 and 12,345 m2; -8 degrees."
    got = [(r.value, r.decimals, r.unit) for r in one(spark, N.numbers_in(F.lit(text)))]
    assert got == [(12.5, 1, "%"), (3.2e6, 1, "$"), (2019.0, 0, ""), (-1234.5, 2, "$"), (4000.0, 0, ""), (7.0, 0, ""), (10.0, 0, ""), (5e9, 0, "€"), (12345.0, 0, ""), (-8.0, 0, "")]
    assert one(spark, N.numbers_in(F.lit(None).cast("string"))) == []
    found = N.numbers_in(F.lit("$90 then $200, $100, $0, $110, 95 and $90.00"))
    assert one(spark, N.related_to(F.lit(100.0), found, "$")) == [110.0, 90.0, 200.0, 0.0]
    assert one(spark, N.number_choices(F.lit(100.0), 0, 5, 1, related=N.related_to(F.lit(100.0), found, "$"), unit=" $"))[:4] == ["100 $", "110 $", "90 $", "200 $"]


def test_near_numbers_differ_and_look_alike(spark):
    from tallyloom.functions import numbers as N

    df = spark.createDataFrame([(3.0,), (1234.5,), (0.0,), (-7.25,), (1e6,)], "g double")
    for r in df.select("g", N.number_choices(F.col("g"), 1, 6, 3, F.col("g")).alias("o"), N.number_choices(F.col("g"), 1, 99, 3).alias("none")).collect():
        assert r.none is None
        if r.g == 0:
            assert r.o is None  # only steps of the last digit differ: five texts
            continue
        assert len(set(r.o)) == 6 and all(x[-2] == "." for x in r.o)
    assert one(spark, N.number_choices(F.lit(3.0), 1, 2, 3)) == ["3.0", "3.1"], "a small value's next step comes first"


def test_media_plan_and_inlining(spark):
    from tallyloom.functions import media as M

    counts = {"image": F.col("i"), "video": F.col("v"), "audio": F.col("a")}
    rows = [("see <video:2> and <image:1>, <video:2> again", 2, 2, 1), ("no tag", 1, 0, 1), ("", 0, 0, 0), (None, 0, 0, 1), ("<audio:1><audio:1>", 0, 0, 1), ("<image:01> <video:x> <sound:1>", 1, None, 0)]
    df = spark.createDataFrame(rows, "t string, i int, v int, a int")
    holder = lambda kind, at: F.concat(F.lit("{"), kind, at.cast("string"), F.lit("}"))
    got = [r.x for r in df.select(M.inlined(F.col("t"), counts, holder).alias("x")).collect()]
    assert [x.text for x in got] == ["{image1}{video0}{audio0}see {video1} and {image0}, [video 2] again", "{image0}{audio0}no tag", "", "{audio0}", "{audio0}[audio 1]", "{image0} <video:x> <sound:1>"]
    assert [[(o.kind, o.at) for o in x.order] for x in got][:2] == [[("image", 1), ("video", 0), ("audio", 0), ("video", 1), ("image", 0)], [("image", 0), ("audio", 0)]]
    for tag in ("<video:3>", "<image:0>"):
        bad = spark.createDataFrame([(tag, 2, 2, 1)], "t string, i int, v int, a int")
        with pytest.raises(Exception, match="the text names"):
            bad.select(M.plan(F.col("t"), counts)).collect()


def test_scores_inside_json_texts(spark):
    import json

    cells = [
        ({"judge_response": json.dumps({"correctness_score": 0.8}), "score": 1}, 0.8),
        ({"judge_response": {"correctness_score": "0.25"}}, 0.25),
        (json.dumps({"judge_response": json.dumps(json.dumps({"correctness_score": 0}))}), 0.0),
        ({"judge_response": "not json", "score": 0.5}, 0.5),
        ({"judge_response": {"correctness_score": None}, "score": True}, 1.0),
        ({"score": {"value": 1}}, None),
        ([1], None),
    ]
    df = spark.createDataFrame([(json.dumps(c),) for c, _ in cells] + [("nope",), (None,)], "x string")
    assert [r[0] for r in df.select(X.json_score(F.col("x"))).collect()] == [v for _, v in cells] + [None, None]
    deep = json.dumps({"runs": [{"out": json.dumps({"a.b": [1, {"s": "7e1"}]})}]})
    assert one(spark, X.number_at(F.lit(deep), "runs[0].out.none", "runs[1].out", "runs[0].out.a.b", "runs[0].out")) is None
    assert one(spark, X.number_at(F.lit(json.dumps({"runs": [{"out": json.dumps({"b": [1, {"s": "7e1"}]})}]})), "runs[0].out.b", "runs[0].out.b[1].s")) == 70.0


def test_tiers_of_names(spark):
    from tallyloom.functions.tiers import tier_of

    names = {"wxai-llama-3-2-1b-instruct": "fast", "Qwen__Qwen1.5-7B-Chat": "fast", "meta-llama__Llama-2-13b-chat-hf": "mid", "wxai-mixtral-8x7b-instruct-v01": "mid", "x_8 x 22 B": "strong", "wxai-llama-3-405b-instruct": "strong", "openai-gpt-4o-mini": "fast", "openai-gpt-4o": "strong", "aws-claude-3-5-sonnet-v1": "strong", "nameless": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.t for r in df.select("n", tier_of(F.col("n")).alias("t")).collect()} == names


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tags_of_a_text_are_looked_for_once(spark):
    from tallyloom.functions import media

    rows = spark.createDataFrame([("see <video:1> and <image:2>, <image:2>.", 2, 1), ("none", 1, 0), (None, 0, 0)], "t string, i int, v int")
    made = media.inlined(F.lower("t"), {"image": F.col("i"), "video": F.col("v")}, lambda kind, at: F.concat(F.lit("("), kind, at.cast("string"), F.lit(")")))
    out = rows.select(made.alias("m")).select("m.text", "m.order")
    assert _plan(out).count("regexp_extract_all(") == 1
    assert [r.text for r in out.collect()] == ["(image0)see (video0) and (image1), [image 2].", "(image0)none", ""]
    assert [[(o.kind, o.at) for o in r.order] for r in out.collect()] == [[("image", 0), ("video", 0), ("image", 1)], [("image", 0)], []]


def test_rows_of_a_small_file_are_dealt_over_tasks(spark, tmp_path):
    from tallyloom.session import spread

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    got = spread(spark.read.parquet(f"{tmp_path}/t"))
    assert got.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and got.count() == 1000
    assert spread(got).rdd.getNumPartitions() == got.rdd.getNumPartitions()


def test_numbers_are_matched_once_and_by_currency(spark):
    from tallyloom.functions import numbers

    texts = ["$3.2 million, -$1,234.50 and $-7k or 12%", "£5 $6% -€7.25bn x$8 9-$4 $$2 $1,23", "--$5, $5-$3.", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    out = df.select(numbers.numbers_in(F.col("t")).alias("n"))
    assert _plan(out).count("regexp_extract") == 1
    rows = [[tuple(x) for x in r.n] for r in out.collect()]
    assert rows[0] == [(3.2e6, 1, "$", "$3.2 million"), (-1234.5, 2, "$", "-$1,234.50"), (-7000.0, 0, "$", "$-7k"), (12.0, 0, "%", "12%")]
    for c in numbers.CURRENCIES:
        only = df.select(numbers.numbers_in(F.col("t"), c).alias("n")).collect()
        assert [[tuple(x) for x in r.n] for r in only] == [[x for x in each if x[2] == c] for each in rows]
    with pytest.raises(ValueError, match="not a currency"):
        numbers.numbers_in(F.col("t"), "%")
