"""Operators on groups hold for a group that has half of all rows, or a million."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import history, intervals


def merged(spans, gap):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
            out[-1][2] += 1
        else:
            out.append([s, e, 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_islands_are_those_of_a_scan(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g, n in (("hot", 400), ("a", 30), (None, 20), ("one", 1)):
        for _ in range(n):
            s = rng.randrange(300) if seed % 2 else rng.random() ** 3 * 5000
            rows.append((g, float(s), float(s + rng.choice([0, 1, 5, 5, 60, 900 if seed > 1 else 2]))))
    rows += [("point", 5.0, 5.0)] * 7
    df = spark.createDataFrame(rows, "g string, s double, e double").repartition(5)
    got = intervals.islands(df, ["g"], "s", "e", 3.0).collect()
    for g in {r[0] for r in rows}:
        own = sorted((r.island, r.start, r.end, r.n) for r in got if r.g == g)
        assert [x[1:] for x in own] == merged([(s, e) for k, s, e in rows if k == g], 3.0)
        assert [x[0] for x in own] == list(range(1, len(own) + 1))


def test_islands_without_rows_or_groups(spark):
    df = spark.createDataFrame([(1, 2), (5, 9), (6, 7)], "s int, e int")
    assert sorted((r.start, r.end) for r in intervals.islands(df, [], "s", "e", 1).collect()) == [(1, 2), (5, 9)]
    assert intervals.islands(df.limit(0), [], "s", "e", 1).count() == 0


def test_a_group_of_half_the_rows_takes_many_tasks(spark):
    """No stage has a task with more than twice the median of rows, though one group has 50,000 of 100,000."""
    df = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 500).alias("g"), (F.xxhash64("id") % 10**6).cast("double").alias("s"))
    df = df.withColumn("e", F.col("s") + 5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = intervals.islands(df, ["g"], "s", "e", 1.0)
        assert out.agg(F.sum("n")).first()[0] == 100_000
        span = 317  # parts: the square root of the rows
        parts = df.select("g", F.least(F.floor((F.col("s") + 10**6) / (2 * 10**6) * span), F.lit(span - 1)).alias("p")).repartition(16, "g", "p")
        rows = sorted(r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect())
        assert len(rows) == 16 and rows[-1] <= 2 * rows[8]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("most", [1, 7, 40])
def test_transcripts_are_those_of_joined_lines(spark, most):
    rng = random.Random(most)
    rows = []
    for g, n in (("a", 120), (None, 25), ("b", 1)):
        for i in range(n):
            line = rng.choice([None, "", "é", "ab", "x" * rng.randrange(1, 100)])
            rows.append((g, i, line))
    df = spark.createDataFrame(rows, "g string, t int, line string").repartition(3)
    got = {(r.g, r.t): r.transcript for r in history.running_transcript(df, "g", ["t"], F.col("line"), most=most).collect()}
    assert len(got) == len(rows)
    for g, t, _ in rows:
        whole = "\n".join(x for k, i, x in rows if k == g and i < t and x is not None)
        assert got[g, t] == whole[-most:], (g, t)


def test_a_conversation_of_a_million_turns(spark):
    n, most = 1_000_000, 60
    df = spark.range(n).select(F.lit(1).alias("g"), "id", F.concat(F.lit("turn "), F.col("id").cast("string")).alias("line"))
    out = history.running_transcript(df, "g", ["id"], F.col("line"), most=most)
    told = out.select("id", "transcript").filter("id % 9973 = 0 or id < 10").collect()
    assert out.agg(F.sum(F.length("transcript"))).first()[0] > 59 * n
    for r in told:
        assert r.transcript == "\n".join(f"turn {i}" for i in range(max(0, r.id - 20), r.id))[-most:]


def test_same_group_pairs_run_without_a_call_for_each_group(spark):
    """Groups are windows, whatever their number; a large one is cut into parts that see around its end."""
    rows = [(i, "hot" if i % 3 else f"g{i % 40}", "abcdefg"[(i * i) % 7]) for i in range(600)] + [(1000 + i, "one", "a") for i in range(40)]
    df = spark.createDataFrame(rows, "i int, g string, e string")
    key = F.sha1(F.col("i").cast("string"))
    cut = history.same_group_pairs(df, "g", "e", key, 2, 4, 5)
    assert "InPandas" not in cut._jdf.queryExecution().toString()
    whole = {r.i: r.others for r in history.same_group_pairs(df, "g", "e", key, 2).collect()}
    assert {r.i: r.others for r in cut.collect()} == whole and len(whole) == len(rows)
    assert whole[1000] == [] and len(whole[1]) == 2
