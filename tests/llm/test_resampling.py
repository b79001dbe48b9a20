"""Importance resampling against a loop over documents."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import resampling


def words_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, targets):
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = Counter(), Counter()
    for d in docs:
        s.update(map(bucket, words_of(d["text"])))
    for x in targets:
        t.update(map(bucket, words_of(x)))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(S + 10000) / ((s[b] + 1) * float(T + 10000))))
    rows = []
    for d in docs:
        own = words_of(d["text"])
        weight = sum(gain(bucket(w)) for w in own) // len(own) if own else 0
        key = "" if d["doc_id"] is None else d["doc_id"]
        h = int(hashlib.sha256(f"2024:{key}".encode()).hexdigest()[:8], 16)
        rows.append([d["doc_id"], len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    most = 10 * len(fit) // 100
    for k, r in enumerate(fit):
        r.append(k + 1 if k < most else None)
    return sorted((tuple([*r, None][:5]) for r in rows), key=repr)


def got_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("table", ["fixture", "odd", "ties"])
def test_against_a_loop(spark, data, odd_documents, table):
    docs = {"fixture": lambda: spark.read.parquet(f"{data}/documents.parquet"), "odd": lambda: odd_documents, "ties": lambda: odd_documents.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("doc_id", F.when(F.col("k") % 3 > 0, F.col("doc_id") * 100 + F.col("k") % 7)).repartition(6)}[table]()
    target = spark.read.parquet(f"{data}/benchmark.parquet")
    out = resampling.op13_importance_resampling(docs, target)
    assert got_of(out) == brute([r.asDict() for r in docs.collect()], [r.text for r in target.collect()])


def test_empty_tables(spark, no_documents, odd_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.op13_importance_resampling(no_documents, none).count() == 0
    got = resampling.op13_importance_resampling(odd_documents, none)
    assert got_of(got) == brute([r.asDict() for r in odd_documents.collect()], [])


def test_words_are_lower_case_only_within_ascii(spark):
    texts = ["Ünïted STATES, don't", "ÀB c", "İI", "\x80x", "a😀b C3PO", None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    assert {r.i: r.w for r in df.select("i", resampling.words_of(F.col("text")).alias("w")).collect()} == {i: words_of(x) for i, x in enumerate(texts)}


def test_runs_of_several_words(spark):
    df = spark.createDataFrame([("a b a b",), ("x",), ("",)], "text string")
    got = [r.b for r in df.select(resampling.buckets_of(resampling.words_of(F.col("text")), 3).alias("b")).collect()]
    runs = lambda w: [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    assert got == [[zlib.crc32(f.encode()) % 10000 for f in runs(words_of(t))] for t in ("a b a b", "x", "")]


def test_ranks_in_many_ranges(spark):
    """Ranks are gapless and in order whatever the number of ranges, with one score that half of all rows have."""
    rows = [(i, 50, 50, 0, 7 if i % 2 else i % 900) for i in range(5000)] + [(None, 50, 50, 0, 900)] * 300
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        got = resampling.drawn(df, percent=60).filter("rank is not null").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(r["rank"] for r in got) == list(range(1, 60 * 5300 // 100 + 1))
    want = sorted(rows, key=lambda r: (-r[4], r[0] is None, r[0] or 0))[: len(got)]
    assert [(r.score, r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [(r[4], r[0]) for r in want]


def test_scoring_neither_explodes_nor_joins(spark, odd_documents):
    buckets = resampling.buckets_of(resampling.words_of(F.col("text")))
    plan = odd_documents.select(buckets.alias("b")).select(resampling.weight_of(F.col("b"), [1] * 10000))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Exchange" not in plan and "Python" not in plan
