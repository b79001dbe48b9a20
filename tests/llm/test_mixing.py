import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import mixing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3)), min_size=1, max_size=4, unique_by=lambda x: x[0]), st.integers(0, 40))
def test_subset_is_the_best(kinds, budget):
    lengths, counts = zip(*kinds, strict=True)
    taken = mixing.subset(list(lengths), list(counts), budget)
    assert all(taken.get(n, 0) <= c for n, c in kinds)
    best = max(s for p in itertools.product(*[range(c + 1) for c in counts]) if (s := sum(n * k for n, k in zip(lengths, p, strict=True))) <= budget)
    assert sum(n * k for n, k in taken.items()) == best


def water(sizes, weights=(3, 1, 2), share=1.5):
    """Deal by weight again and again until no target is above twice its size."""
    w = {s: weights[i % 3] for i, s in enumerate(sizes)}
    left, target, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(docs):
    rows = docs.select("doc_id", "source", "text").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for s in sorted({r.source for r in rows}, key=lambda s: (s is None, s or "")):
        sizes[s] = sum(size(r.text) for r in rows if r.source == s)
    want = water(sizes)
    source = {r.doc_id: r.source for r in rows}
    out = mixing.op9_mixing(docs).collect()
    assert len(out) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    return taken, want, sorted((repr(r.doc_id), r.size, r.taken) for r in out)


def test_targets_are_met(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    taken, want, once = check(docs)
    # Few documents have few sums.
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 5 for s in want)
    assert check(docs.repartition(5))[2] == once


def test_uneven_sources(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(["a", "a", "a", "b", None])) for i in range(300)] + [(1000 + i, "w w w", "hot") for i in range(900)] + [(5000, "w", "z"), (5001, None, "empty")]
    taken, want, _ = check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert all(abs(taken[s] - want[s]) <= 3 for s in want)


def test_large_budgets():
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(1, 20_000, 3000))
    counts = rng.integers(1, 50, len(lengths))
    total = int((lengths * counts).sum())
    for part in (0.3, 1.0, 1.7, 2.0):
        epochs, extra = mixing.fit(lengths, counts, part * total)
        assert (extra <= counts).all() and abs(epochs * total + int((lengths * extra).sum()) - part * total) <= 1


def test_lengths_are_repeated_alike():
    """The rate at which documents are taken again is flat over length, whatever the distribution."""
    rng = np.random.default_rng(4)
    for lengths in (np.arange(1000, 20_000), np.unique(np.exp(rng.normal(6, 1.2, 30_000)).astype(np.int64) + 1)):
        counts = rng.integers(1, 4, len(lengths))
        total = int((lengths * counts).sum())
        for part in (1.4, 1.5, 0.7):
            epochs, extra = mixing.fit(lengths, counts, part * total)
            assert abs(epochs * total + int((lengths * extra).sum()) - part * total) <= 1
            cuts = np.searchsorted(np.cumsum(counts), np.arange(1, 10) * counts.sum() // 10)
            rates = [e.sum() / c.sum() for e, c in zip(np.split(extra, cuts), np.split(counts, cuts), strict=True)]
            assert max(abs(r - part % 1) for r in rates) < 0.02, rates


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.floats(0, 2))
def test_small_sources_come_as_close_as_they_can(kinds, part):
    lengths, counts = (np.array(x) for x in zip(*kinds, strict=True))
    total = int((lengths * counts).sum())
    epochs, extra = mixing.fit(lengths, counts, part * total)
    budget = int(round(part * total - epochs * total)) if epochs < 2 else 0
    best = max(s for p in itertools.product(*[range(c + 1) for c in counts]) if (s := int(np.dot(lengths, p))) <= budget)
    assert (extra <= counts).all() and int((lengths * extra).sum()) == best


def test_selection_against_plain_python(spark, data):
    """Which documents are taken: of each source and length, those whose hashes come first."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", mixing.word_count("text").alias("words"))
    rows = mixing.mix(docs).select("*", F.xxhash64(F.lit(1), F.struct("doc_id", "source", "words")).alias("at")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.source, {}).setdefault(r.size, []).append(r)
    for kinds in groups.values():
        sizes = sorted(kinds)
        epochs, extra = mixing.fit(np.array(sizes), np.array([len(kinds[n]) for n in sizes]), kinds[sizes[0]][0].target)
        for n, k in zip(sizes, extra, strict=True):
            few = len(kinds[n]) <= mixing.RANKED
            want = [epochs + (i < k) for i in range(len(kinds[n]))]
            assert not few or [r.copies for r in sorted(kinds[n], key=lambda r: r["at"])] == want


def test_repeated_keeps_columns(spark, odd_documents, no_documents):
    out = mixing.repeated(odd_documents)
    assert out.columns == odd_documents.columns and out.filter("text is null or trim(text) = ''").count() == 0
    assert mixing.repeated(no_documents).count() == 0
    assert mixing.op9_mixing(no_documents).count() == 0
    assert mixing.op9_mixing(odd_documents).count() == odd_documents.count()
