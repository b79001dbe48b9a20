import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import components, ngram_join


def brute(rows, size, percent):
    """Set sizes and components of (id, text) rows; rows by position."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def corpus(seed, n_words):
    """Groups of copies with more and more edits, chains of edits, shared passages, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = words(12), []
    for _ in range(5):
        base = words(n_words)
        for k in range(10):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        chain = list(base)
        for _ in range(6):
            chain[rng.randrange(len(chain))] = rng.choice(vocabulary)
            texts.append(" ".join(chain))
    texts += [" ".join(words(15) + passage) for _ in range(20)]
    texts += [" ".join(words(rng.randrange(0, 6))) for _ in range(15)] + ["a b", "A b", "a  b\n", "", " "]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "n_words", "size", "percent"), [(1, 60, 4, 85), (2, 120, 5, 80), (3, 30, 4, 85)])
def test_against_brute_force(spark, seed, n_words, size, percent):
    rows = corpus(seed, n_words) + [(1000, None), (None, "a b"), (None, "q r s t u v")]
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=size, percent=percent).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component) for r in got], key=repr) == brute(rows, size, percent)


def test_crowded_ngrams_and_hubs_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PARTNERS", 3)
    rows = corpus(4, 150)
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component) for r in got], key=repr) == brute(rows, 4, 85)


def test_every_set_is_cut_by_the_global_order(spark):
    """With the constants as shipped: fragments hold about as many n-grams each, all of a set together its n-grams, and the more common ones in later fragments."""
    df = spark.createDataFrame(corpus(5, 200), "doc_id long, text string")
    table = ngram_join.counted(df, "doc_id", "text", 4).cache()
    levels, fragment = ngram_join.global_order(table)
    assert all(levels[fragment == k].max() <= levels[fragment == k + 1].min() for k in range(ngram_join.FRAGMENTS - 1) if (fragment == k).any() and (fragment == k + 1).any())
    full = np.full(1, 2**64 - 1, np.uint64)
    cut = ngram_join.fragments(df, "text", 4, full, fragment, True).dropDuplicates(["class", "part"]).collect()
    sizes = {r["class"]: r.n for r in table.filter("class is not null").collect()}
    held, by_part = {}, [0] * ngram_join.FRAGMENTS
    for r in cut:
        held.setdefault(r["class"], []).extend(r.grams)
        by_part[r.part] += len(r.grams)
    assert {c: len(set(g)) for c, g in held.items()} == sizes and all(len(g) == len(set(g)) for g in held.values())
    assert min(by_part) > 0 and sum(len(held[c]) > 100 for c in held) > 50
    assert all(len({r.part for r in cut if r["class"] == c}) > 4 for c in held if len(held[c]) > 100)


def test_overlaps_are_sums_over_fragments(spark):
    rows = corpus(6, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = ngram_join.counted(df, "doc_id", "text", 4).cache()
    _, fragment = ngram_join.global_order(table)
    classes = table.filter("class is not null").select("class", "n").distinct().limit(25)
    pairs = classes.selectExpr("class AS a", "n AS na").crossJoin(classes.selectExpr("class AS b", "n AS nb")).filter("a < b")
    sets = {}
    for _, text in rows:
        for s in ngram_join.sets_of(ngram_join.texts_of(pa.array([text])), 4):
            if len(s):
                sets[ngram_join.class_of(s)] = set(s.tolist())
    exact = {(r.a, r.b): r.o for r in ngram_join.overlaps(df, "text", 4, fragment, pairs, True).collect()}
    rough = {(r.a, r.b): r.o for r in ngram_join.overlaps(df, "text", 4, fragment, pairs, False).collect()}
    for r in pairs.collect():
        want = len(sets[r.a] & sets[r.b])
        assert exact.get((r.a, r.b), 0) == want <= rough.get((r.a, r.b), 0)


def test_one_of_each(spark, odd_documents, no_documents):
    rows = odd_documents.collect()
    kept = ngram_join.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = sorted([r.doc_id for r in kept.collect()], key=repr)
    # 1, 2 and a null id (one more word) are linked; 8 and 9 differ in case only; texts without words stay.
    assert ids == sorted([1, 3, 4, None, 5, 6, 7, 8], key=repr) and len(rows) == 12
    assert ngram_join.one_of_each(no_documents).count() == 0
    twice = odd_documents.filter("doc_id = 2")
    assert ngram_join.one_of_each(twice).count() == 1


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, 300 + i) for i in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100} | {300 + i: 200 for i in range(50)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_full_filters_and_classes_of_many_pairs_change_nothing(spark, monkeypatch):
    """Filters of 64 bits, which let all through, and pairs that are split from two on."""
    rows = corpus(9, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BITS_EACH", 0)
    monkeypatch.setattr(ngram_join, "PARTNERS", 2)
    got = ngram_join.linked(df, size=4, percent=85).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component) for r in got], key=repr) == brute(rows, 4, 85)
