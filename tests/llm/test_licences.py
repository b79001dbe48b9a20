"""The licence scan against every block and every template."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import licences

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))


def brute_matches(words, templates):
    out = set()
    for i, t in enumerate(templates):
        half = t.span // 2
        for b in range(max(-(-len(words) // half) - 1, 1)):
            block = set(words[b * half : b * half + t.span])
            shared = len(block & set(t.words))
            if shared >= t.least:
                out.add((t.span, b, i, shared))
    return out


def mangled(rng, notices):
    """Notices in prose, some whole, some with words lost, changed or moved, at any place."""
    filler = "the of to and in software license under this work is permitted conditions xa xb xc xd".split()
    out = []
    for _ in range(rng.randrange(4)):
        out += [rng.choice(filler) for _ in range(rng.randrange(90))]
        own = rng.choice(notices)[1].split()
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(own))
            own[k : k + 1] = rng.choice([[], ["zz"], [own[k].upper()], [own[k], "yy"]])
            own = own or ["x"]
        out += own
    return rng.choice([" ", "\n", " -- ", ","]).join(out)


@pytest.mark.parametrize("percent", [60, 90, 100])
def test_every_block_is_found(spark, percent):
    rng = random.Random(percent)
    texts = [mangled(rng, licences.NOTICES) for _ in range(150)] + ["", None, "  ", "é" * 50]
    templates = licences.templates_of(licences.NOTICES, percent)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows, matches = licences.scanned(df, templates, keep=("doc_id",))
    key = {r.key: r.doc_id for r in rows.collect()}
    got = {}
    for r in matches.collect():
        assert r.score == r.overlap / len(templates[r.template].words)
        got.setdefault(key[r.key], []).append((r.span, r.block, r.template, r.overlap))
    assert all(len(v) == len(set(v)) for v in got.values())
    for i, text in enumerate(texts):
        assert set(got.get(i, [])) == brute_matches(words_of(text), templates), texts[i]
    assert sum(map(len, got.values())) > 100


def test_a_run_of_a_notice_lies_in_one_block_wherever_it_begins(spark):
    notice = licences.NOTICES[2][1]
    texts = [" ".join(["q"] * k) + " " + notice for k in range(0, 70, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licences.op12_license_scan(df).collect()
    assert all(r.labels == "bsd" and r.score == 1.0 for r in got)


def test_base_places_and_labels(spark):
    rows = [
        ("Released under the MIT License.", 1, 3, 3, "mit", "mit"),
        ("mit license MIT-LICENSE mit\nlicense mitlicense mit license2", 3, 0, 4, "mit", "mit"),
        ("Licensed under CC BY-NC 4.0.", 0, None, None, "", "cc-by-nc"),
        ("This work is licensed under the GNU General Public License, version 3. Apache license", 2, 7, 12, "apache,gpl", "apache,gpl"),
        ("general public general public license", 1, 2, 2, "gpl", "gpl"),
        ("mit", 0, None, None, "", ""),
        ("license mit", 0, None, None, "", ""),
        ("MİT license mit lıcense", 0, None, None, "", ""),
        (None, 0, None, None, "", ""),
        ("", 0, None, None, "", ""),
    ]
    df = spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(rows)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licences.op12_license_scan(df).collect()}
    for i, (text, n, first, last, base, labels) in enumerate(rows):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (len(words_of(text)), n, first, last, base, labels), text
        assert r.score == (1.0 if n or labels else 0.0)


def test_order_is_by_frequency_and_prefixes_are_rare(spark):
    templates = licences.templates_of([("a", "one two three four five"), ("b", "five six")], 80)
    df = spark.createDataFrame([("one one two three " * 3 + "four six",)], "text string")
    order = licences.word_order(df.select(licences.words_of(F.col("text")).alias("words")), templates)
    assert order == ["five", "four", "six", "three", "two", "one"]
    rank = {w: i for i, w in enumerate(order)}
    assert licences.prefix_of(templates[0], rank) == [0, 1] and licences.prefix_of(templates[1], rank) == [0]
    with pytest.raises(ValueError, match="no word"):
        licences.templates_of([("x", " - ")])
    with pytest.raises(ValueError, match="percentage"):
        licences.templates_of([("x", "y")], 0)


def test_odd_rows_and_long_texts(spark, odd_documents, no_documents):
    got = licences.op12_license_scan(odd_documents).collect()
    assert len(got) == odd_documents.count() and all(r.labels == "" and r.score == 0 for r in got)
    assert licences.op12_license_scan(no_documents).count() == 0
    long = spark.createDataFrame([(1, "word " * 400_000 + licences.NOTICES[1][1] + " word" * 400_000)], "doc_id long, text string")
    row = licences.op12_license_scan(long).first()
    assert row.labels == "apache" and row.first_word == 400_003 and row.n_words == 800_008


def test_no_python_on_the_main_path(spark, odd_documents):
    words = licences.words_of(F.col("text"))
    templates = licences.templates_of(licences.NOTICES)
    order = licences.word_order(odd_documents.select(words.alias("words")), templates)
    rows = odd_documents.select(F.monotonically_increasing_id().alias("key"), licences.blocks_of(words, templates, order).alias("blocks"))
    plan = licences.matched(rows, templates, order)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
