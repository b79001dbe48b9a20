import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom import catalog
from tallyloom.functions import numbers
from tallyloom.functions.hashing import order_key
from tallyloom.operators import augment, distractors, history, intervals, metrics, mixture, records, sampling


def made(spark, rows, group=None):
    """Records of (id, state, label) that ask for a or b."""
    df = spark.createDataFrame(rows, "id string, state string, label string")
    meta = {"task": F.substring("id", 1, 1)} if group else None
    return records.choice_records(df, source="t", state=F.col("state"), instructions="Which?", choices=[("a", "A"), ("b", "B")], label=F.col("label"), id_=F.col("id"), meta=meta)


def test_records_drop_unknown_labels_and_validate(spark):
    out = made(spark, [("1", "x", "a"), ("2", "x", "z"), ("3", None, "a")])
    assert [r.id for r in out.collect()] == ["1"]
    assert records.valid(out).count() == 1
    assert out.schema.simpleString() == spark.createDataFrame([], records.RECORD).schema.simpleString()


def test_mcq(spark):
    df = spark.createDataFrame([(1, [" x ", "y"], 1), (2, ["x", "x "], 0), (3, ["x"], 0), (4, ["x", "y"], 2)], "i int, c array<string>, g int")
    out = records.mcq_records(df, source="t", state=F.col("i"), instructions="?", choices=F.col("c"), gold=F.col("g"))
    d = records.decisions(out).collect()
    assert [(r.label, r["index"], r.k) for r in d] == [("opt_2", 1, 2)]


def test_aliases_of_yes_and_no(spark):
    df = spark.createDataFrame([("True",), ("0",), ("YES",), ("maybe",)], "l string")
    out = records.noul_records(df, source="t", state=F.col("l"), instructions="?", label=F.col("l"))
    assert sorted(r.label for r in records.decisions(out).collect()) == ["no", "yes", "yes"]


@pytest.mark.parametrize(("sizes", "per", "to", "want"), [({"a": 500, "b": 120, "c": 40}, 100, 100, {"a": 100, "b": 100, "c": 100}), ({"a": 10}, None, 1000, {"a": 30}), ({"a": 7, "b": 3}, None, None, {"a": 7, "b": 3})])
def test_balance(spark, sizes, per, to, want):
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, i int")
    out = mixture.balanced(df, "g", F.concat("g", F.col("i").cast("string")), per, to)
    assert Counter(r.g for r in out.collect()) == want
    assert out.agg(F.max("copy")).first()[0] <= mixture.MOST_REPEATS - 1


def test_weights_round_half_even_and_repeat_without_limit(spark):
    df = spark.range(5).withColumn("k", F.col("id").cast("string"))
    assert [mixture.weighted(df, w, F.col("k")).count() for w in (0.5, 1.0, 0.3, 4.2)] == [2, 5, 2, 21]


def test_leaks_by_text_field_and_source(spark):
    long = "y" * 40
    evaluation = made(spark, [("e", '{"q": "' + long + '"}', "a"), ("f", "Some, text", "b")])
    evaluation = evaluation.withColumn("meta", F.when(F.col("id") == "f", F.create_map(F.lit("source_id"), F.lit('["s1", "s2"]'))).otherwise(F.col("meta")))
    train = made(spark, [("1", '{"other": "' + long + '", "z": 1}', "a"), ("2", "some TEXT!", "b"), ("3", "quite different", "a"), ("4", "again different", "a")])
    train = train.withColumn("meta", F.when(F.col("id") == "4", F.create_map(F.lit("source_id"), F.lit("s2"))).otherwise(F.col("meta")))
    assert [r.id for r in mixture.without_leaks(train, evaluation).collect()] == ["3"]
    _, report = mixture.build_mixture([(mixture.Source("t"), train)], evaluation)
    assert report.first().asDict() == {"source": "t", "loaded": 4, "overlap_removed": 3, "used": 1}


def test_sources_are_parsed():
    assert [(s.name, s.split) for s in mixture.parsed_sources("banking, boolq:validation,x.jsonl")] == [("banking", "train"), ("boolq", "validation"), ("x.jsonl", "train")]


def test_media_source_id(spark):
    paths = {"v/abcdefghijk.mp4": "yt:abcdefghijk", "v/abcdefghijk_3.5_7.mp4": "yt:abcdefghijk", "abcdefghijk/0001.jpg": "yt:abcdefghijk", "abcdefghijk/a.flac": "yt:abcdefghijk", "v/video_12345.mp4": None, "v/short.mp4": None}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    item = F.struct(F.col("p").alias("path"), F.lit(None).cast("array<string>").alias("frames"), F.lit(None).cast("string").alias("audio"))
    assert {r.p: r.s for r in df.select("p", mixture.media_source_id(item).alias("s")).collect()} == paths


def test_ranks_are_those_of_one_sort(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    ranked = sampling.hash_rank(df, ["g"], F.sha1(F.col("id").cast("string")), F.col("id")).collect()
    by = {}
    for r in sorted(ranked, key=lambda r: (r.g, r["rank"])):
        by.setdefault(r.g, []).append(r.id)
    import hashlib

    for g, ids in by.items():
        assert ids == sorted((i for i in range(1000) if i % 3 == g), key=lambda i: hashlib.sha1(str(i).encode()).hexdigest())


@pytest.mark.parametrize(("n", "fraction", "want"), [(100, 0.02, 2), (10, 0.02, 1), (10, 0.0, 0)])
def test_holdout(spark, n, fraction, want):
    assert sampling.holdout(spark.range(n), fraction, 0, F.col("id")).filter("held").count() == want


def test_fit_keeps_gold_and_order(spark):
    opts = records.options([(str(i), "") for i in range(100)])
    for seed in range(20):
        got = spark.range(1).select(F.transform(augment.fitted(opts, F.lit("42"), 10, seed), lambda o: o["key"]).alias("k")).first().k
        assert len(got) == 10 and "42" in got and got == sorted(got, key=int)


def test_none_option(spark):
    df = spark.range(400).select("id", F.lit("a").alias("label"), records.options([("a", ""), ("b", ""), ("c", "")]).alias("options"))
    two = df.withColumn("options", F.slice("options", 1, 2))
    got = augment.with_none(df, 1.0, 0.0, 0, F.col("id")).first()
    assert got.label == augment.NONE_KEY and [o.key for o in got.options] == ["b", "c", augment.NONE_KEY]
    got = augment.with_none(two, 1.0, 0.0, 0, F.col("id")).first()
    assert got.label == "a" and [o.key for o in got.options] == ["a", "b", augment.NONE_KEY]
    assert augment.with_none(df, 0.0, 0.0, 0, F.col("id")).first().label == "a"


def test_pack(spark):
    out = augment.packed(made(spark, [(str(i), "x", "a") for i in range(50)]), 2, 0)
    assert out.agg(F.sum(F.size("questions"))).first()[0] == 50
    assert out.filter("size(questions) = 2").first().meta["packed"] == "2"


def test_pack_by_coin(spark):
    rows = made(spark, [(str(i), "x", "a") for i in range(240)])
    assert augment.packed_by_coin(rows, 0.0, 4, 0).count() == 240
    out = augment.packed_by_coin(rows, 1.0, 4, 0)
    sizes = [r.n for r in out.select(F.size("questions").alias("n")).collect()]
    assert sum(sizes) == 240 and set(sizes) == {2, 3, 4}
    seeds = spark.createDataFrame([(["a", "b"],), (["b", "a"],), (["a", "b"],)], "ids array<string>").select(augment.batch_seed(1, F.col("ids")).alias("s")).collect()
    assert seeds[0].s == seeds[2].s != seeds[1].s


def test_next_different(spark):
    values = ["x", "x", "y", "z", "z", "z", "x"] * 9 + ["w"] * 30
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    for digits in (0, 1, 2):
        out = augment.next_different(df, "v", 1, F.col("i"), digits=digits).collect()
        import hashlib

        order = sorted(range(len(values)), key=lambda i: hashlib.sha1(f"1|{i}".encode()).hexdigest())
        want = {}
        for p, i in enumerate(order):
            want[i] = next(values[order[(p + d) % len(order)]] for d in range(1, len(order)) if values[order[(p + d) % len(order)]] != values[i])
        assert {r.i: r.other for r in out} == want
    same = spark.createDataFrame([(1, "x"), (2, "x")], "i int, v string")
    assert {r.other for r in augment.next_different(same, "v", 1, F.col("i")).collect()} == {None}


def test_ablations(spark):
    media = F.array(*[F.struct(F.lit(t).alias("type"), F.lit("p").alias("path"), F.lit(None).cast("array<string>").alias("frames"), F.lit(1.0).alias("fps"), F.lit(1.0).alias("duration"), F.lit("s").alias("audio"), F.lit(0.0).alias("start"), F.lit(False).alias("mute"), F.lit(False).alias("black")) for t in ("video", "audio")])
    muted, black = spark.range(1).select(augment.muted(media), augment.blacked(media)).first()
    assert [(m.type, m.audio, m.mute) for m in muted] == [("video", None, True)]
    assert [m.black for m in black] == [True, False]


def test_distractors(spark):
    pool = F.array(*map(F.lit, "abcdef"))
    got = spark.range(20).select(distractors.from_pool(pool, F.lit("c"), 4, 1, F.col("id")).alias("o")).collect()
    assert all(len(set(r.o)) == 4 and "c" in r.o for r in got) and len({tuple(r.o) for r in got}) > 1
    assert spark.range(1).select(distractors.from_pool(F.array(F.lit("c")), F.lit("c"), 4, 1)).first()[0] is None
    near = spark.range(1).select(numbers.number_choices(F.lit(1234.5), 1, 4, 0)).first()[0]
    assert near[0] == "1,234.5" and len(set(near)) == 4
    windows = spark.range(1).select(distractors.other_windows(F.lit(10.0), F.lit(15.0), F.lit(60.0), 3)).first()[0]
    assert len(windows) == 3 and all(abs(w - 10) >= 2 for w in windows)
    tools = spark.range(1).select(distractors.padded_tools(F.array(F.lit("x")), F.array(F.lit("x"), F.lit("y"), F.lit("z")), 3, 0)).first()[0]
    assert tools[0] == "x" and sorted(tools) == ["x", "y", "z"]


def test_intervals(spark):
    df = spark.createDataFrame([("g", 0.0, 1.0), ("g", 2.5, 4.0), ("g", 3.0, 3.5), ("g", 9.0, 10.0)], "k string, start double, end double")
    got = intervals.islands(df, ["k"], "start", "end", 2.0).orderBy("start").collect()
    assert [(r.start, r.end, r.n) for r in got] == [(0.0, 4.0, 3), (9.0, 10.0, 1)]
    assert intervals.overlapping(df, df, ["k"], 1.0).count() == 6


def test_history(spark):
    df = spark.createDataFrame([("e", i, f"s{i}") for i in range(6)], "e string, i int, s string")
    got = history.last_items(df, "e", ["i"], F.col("s"), 2).orderBy("i").collect()
    assert [r.history for r in got][:4] == [[], ["s0"], ["s0", "s1"], ["s1", "s2"]]


def test_breakdown(spark):
    rows = [([2.0, 1.0], 0, {"task": "a", "one": "x", "again": "p"}), ([2.0, 1.0], 1, {"task": "a", "one": "x", "again": "p"}), ([0.0, 1.0], 1, {"task": "b", "one": "x", "again": "q"}), ([0.0, 1.0], None, {"task": "b", "one": "x", "again": "q"})]
    df = spark.createDataFrame(rows, "logits array<double>, target int, meta map<string,string>")
    got = {(r.key, r.value): (r.n, r.accuracy) for r in metrics.breakdown(df, ["task", "one"]).collect()}
    assert got == {("task", "a"): (2, 0.5), ("task", "b"): (1, 1.0)}


def test_temperature_of_overconfident_logits(spark):
    df = spark.createDataFrame([([6.0, -6.0], int(i >= 70), "choice") for i in range(100)], "logits array<double>, target int, type string")
    best = metrics.fitted_temperature(df).first()
    nll = lambda t: -sum(math.log(1 / (1 + math.exp(-12 / t))) * 70 + math.log(1 / (1 + math.exp(12 / t))) * 30 for _ in (0,)) / 100
    assert best.temperature > 1.5 and abs(best.nll - min(map(nll, metrics.grid()))) < 1e-9
    assert metrics.temperatures_by_type(df) == {"choice": best.temperature, "default": best.temperature}


def test_catalog(spark):
    names = catalog.Registry("dataset")
    names.register("banking", catalog.Dataset("banking", build=None))
    with pytest.raises(KeyError, match="already"):
        names.register("banking", 1)
    with pytest.raises(KeyError, match="did you mean banking"):
        names.find("bankign")
    catalog.BENCHMARKS.clear()
    for n in ("x", "y"):
        catalog.BENCHMARKS.register(n, catalog.Benchmark(n, "d", suite="s"))
    assert [b.name for b in catalog.expanded(["y", "s"])] == ["y", "x"]
    assert catalog.catalog(spark, catalog.BENCHMARKS).count() == 2
    catalog.DATASETS.clear()
    catalog.DATASETS.register("e", catalog.Dataset("e", build=None, eval_only=True))
    with pytest.raises(ValueError, match="evaluation only"):
        catalog.check_trainable(["e"])


def test_ablated_records(spark):
    none = "cast(null as array<string>)"
    item = lambda kind, path, audio: f"named_struct('type', '{kind}', 'path', {path}, 'frames', {none}, 'fps', 1.0D, 'duration', 4.0D, 'audio', {audio}, 'start', 0.0D, 'mute', false, 'black', false)"
    base = made(spark, [(str(i), f"clip <audio:1> {i}", "a") for i in range(6)])
    kinds = F.when(F.col("id") == "0", F.col("media")).when(F.col("id") < "4", F.array(F.expr(item("video", "concat('v', id)", "concat('s', id)")))).otherwise(F.array(F.expr(item("audio", "concat('s', id)", "cast(null as string)"))))
    rows = base.withColumn("media", kinds)
    before = {r.id: r for r in rows.collect()}
    mute = {r.id: r for r in augment.ablated(rows, "mute").collect()}
    assert mute["0"].state == "clip <audio:1> 0" and "ablate" not in mute["0"].meta
    assert mute["5"].media == [] and mute["5"].state == "clip  5" and mute["5"].meta["ablate"] == "mute"
    assert mute["1"].media[0].audio is None and mute["1"].media[0].mute
    sounds = lambda r: [m.path if m.type == "audio" else m.audio for m in r.media]
    for seed in range(3):
        swapped = {r.id: r for r in augment.ablated(rows, "shuffle_audio", seed).collect()}
        assert all(sounds(swapped[i]) != sounds(before[i]) for i in "12345")
        assert {s for i in "12345" for s in sounds(swapped[i])} <= {f"s{i}" for i in range(1, 6)}
    with pytest.raises(ValueError, match="unknown ablation"):
        augment.ablated(rows, "loud")


def test_same_group_pairs_look_at_the_whole_group(spark):
    """One entity holds most of a group, and its last rows go on at the start."""
    rows = [(i, "g", "b" if i in (90, 150) else "c" if i == 40 else "a") for i in range(200)] + [(300, "h", "a"), (301, "h", "a"), (302, None, "a"), (303, None, "b"), (304, "g", None)]
    df = spark.createDataFrame(rows, "i int, g string, e string")
    key = {i: hashlib.sha1(f"1|{i}".encode()).hexdigest() for i, _, _ in rows}
    for n, part, block in ((1, 128, 1024), (2, 7, 1024), (2, 7, 3), (3, 2, 1), (2, 1000, 1)):
        want = {}
        for i, g, e in rows:
            order = sorted((key[j], x) for j, h, x in rows if h == g)
            at = order.index((key[i], e))
            want[i] = list(dict.fromkeys(x for _, x in order[at + 1 :] + order[:at] if x != e and x and e))[:n]
        out = history.same_group_pairs(df, "g", "e", order_key(1, F.col("i")), n, part, block)
        assert out.columns == ["i", "g", "e", "others"]
        assert {r.i: r.others for r in out.collect()} == want


def test_tiered_pool_draws_from_the_whole_tier(spark):
    rows = [(i, f"v{i:03d}", "big", "x") for i in range(150)] + [(200, "p", "small", "x"), (201, "q", "small", "y"), (202, "alone", None, "z"), (203, None, "big", "x")]
    df = spark.createDataFrame(rows, "i int, v string, a string, b string")
    out = {r.i: r for r in distractors.tiered_pool(df, "v", [F.col("a"), F.col("b")], 4, 0, F.col("i")).collect()}
    assert len(out) == len(rows)
    assert all((out[i].tier, out[i].others) == (0, 149) for i in range(150))
    assert all(len(set(out[i].pool)) == 3 and out[i].v not in out[i].pool for i in range(150))
    assert len({v for i in range(150) for v in out[i].pool}) > 100
    assert (out[200].tier, out[200].others, len(out[200].pool)) == (1, 150, 3)
    assert (out[201].tier, out[201].others, out[201].pool) == (0, 1, ["p"])
    assert [(out[i].tier, out[i].others) for i in (202, 203)] == [(None, 0)] * 2


def test_votes_and_files(spark):
    from tallyloom.operators import votes

    a, b = spark.createDataFrame([("t", 1), ("t", 2)], "x string, i int"), spark.createDataFrame([("u", 3)], "x string, i int")
    assert votes.first_filled([a.limit(0), a, b], "x").count() == 1 and votes.first_filled([a.limit(0), a.limit(0)], "x").count() == 0
    df = spark.createDataFrame([(1, "a"), (1, "z"), (1, "q"), (2, None)], "k int, v string")
    got = {r.k: (r.probs, r.winner) for r in votes.vote_targets(df, "k", F.col("v"), ["a", "b", "rest"]).collect()}
    assert got[1][1] == "rest" and abs(got[1][0][0] - 1 / 3) < 1e-9 and got[2] == ([0.0, 0.0, 1.0], "rest")


def test_breakdown_counts_each_value_of_a_list(spark):
    from tallyloom.operators import metrics

    rows = [(1, [2.0, 0.0], 0, {"kind": '["a", "b"]'}), (2, [2.0, 0.0], 1, {"kind": '["b", "b"]'}), (3, [0.0, 1.0], 1, {"kind": "c"})]
    df = spark.createDataFrame(rows, "id int, logits array<double>, target int, meta map<string, string>")
    assert sorted((r.value, r.n, r.accuracy) for r in metrics.breakdown(df, ["kind"]).collect()) == [("a", 1, 1.0), ("b", 2, 0.5), ("c", 1, 1.0)]


def test_take_by_rank_is_take_by_order(spark, monkeypatch):
    from tallyloom.operators import sampling

    df = spark.range(500)
    few = sorted(r.id for r in sampling.take(df, 120, 3, F.col("id")).collect())
    monkeypatch.setattr(sampling, "TOP_ROWS", 10)
    assert sorted(r.id for r in sampling.take(df, 120, 3, F.col("id")).collect()) == few and len(few) == 120


def test_members_that_are_hardly_active_do_not_count(spark):
    from tallyloom.operators import intervals

    df = spark.createDataFrame([("g", "a", 0.0, 10.0), ("g", "b", 0.0, 9.0), ("g", "c", 1.0, 1.2)], "g string, m string, start double, end double")
    got = intervals.busy_seconds(df, "g", "m", 1.0, shortest=1.0).first()
    assert got.members == 2 and intervals.busy_seconds(df, "g", "m", 1.0).first().members == 3


def test_same_type(spark):
    from tallyloom.operators import distractors

    pool = F.array(*map(F.lit, ["12", "3.5", "Paris", "New York", "red", "Rome"]))
    got = spark.range(1).select(distractors.same_type(pool, F.lit("7")).alias("n"), distractors.same_type(pool, F.lit("Oslo")).alias("c")).first()
    assert got.n == ["12", "3.5"] and got.c == ["Paris", "Rome"]


def test_typed_records(spark):
    rows = [("score", "good", {"bad": 0.2, "good": 0.8}), ("score", "0", {"0": 1.0}), ("choice", "a", {"a": 1.0}), ("noul", "True", {"true": 0.9, "false": 0.1})]
    df = spark.createDataFrame(rows, "kind string, expected string, probs map<string, double>")
    opts = F.when(F.col("kind") == "score", records.options([("0", "bad"), ("1", "good")])).otherwise(records.options([("a", ""), ("b", "")]))
    made = records.typed_records(df, source="t", state=F.lit("s"), kind=F.col("kind"), instructions=F.lit("?"), opts=opts, expected=F.col("expected"), probs=F.col("probs"))
    assert records.problems(made).filter("problem is not null").count() == 0
    got = [(r.label, r.probs) for r in records.decisions(made).collect()]
    assert got == [("1", {"0": 0.2, "1": 0.8}), ("0", {"0": 1.0}), ("a", {"a": 1.0}), ("yes", {"yes": 0.9, "no": 0.1})]
