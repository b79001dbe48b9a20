"""The audit of filters against a loop over all orders and documents."""

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import audit


@pytest.mark.parametrize("n", range(1, 7))
def test_the_walk_swaps_neighbours_and_visits_every_order_once(n):
    orders, before = [], None
    for order, left in audit.plain_changes(n):
        if before is not None:
            swapped = list(before)
            swapped[left], swapped[left + 1] = swapped[left + 1], swapped[left]
            assert tuple(swapped) == order
        orders.append(order)
        before = order
    assert len(orders) == math.factorial(n) and set(orders) == set(permutations(range(n)))


def test_only_swapped_steps_are_computed(monkeypatch):
    """All steps of the first order, and two of each other one: 5 + 2 * 119."""
    calls = []
    stack = np.column_stack
    monkeypatch.setattr(np, "column_stack", lambda x: calls.append(1) or stack(x))
    audit.steps_of(np.ones((2, 32, 3), np.int64))
    assert len(calls) == 5 + 2 * 119


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute(docs, labels):
    """(part, order, step) -> the seven figures."""
    texts = [d["text"] or "" for d in docs]
    smallest = {}
    for d, t in zip(docs, texts, strict=True):
        if d["doc_id"] is not None:
            smallest[t] = min(smallest.get(t, d["doc_id"]), d["doc_id"])
    said = {}
    for r in labels:
        if r["doc_id"] is not None:
            q, x = said.get(r["doc_id"], (False, False))
            said[r["doc_id"]] = (q or r["quality"] == 1, x or r["toxic"] == 1)
    rows = []
    for d, t in zip(docs, texts, strict=True):
        w = words(t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d["doc_id"] is not None and d["doc_id"] > smallest[t],
        }
        rows.append((d["source"] or "", {k for k, v in fails.items() if v}, *said.get(d["doc_id"], (False, False))))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] and bool(set(order[:k]) & r[1]) for r in own)
                alone = sum(r[1] == {f} for r in own)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


COLUMNS = [*audit.STEP, "good_lost", "toxic_lost", "shapley"]


def held(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in df.collect()}


@pytest.mark.parametrize("table", ["fixture", "odd"])
def test_against_every_order(spark, data, odd_documents, table):
    docs = spark.read.parquet(f"{data}/documents.parquet") if table == "fixture" else odd_documents
    labels = spark.read.parquet(f"{data}/labels.parquet")
    if table == "odd":
        extra = [(1, 1, None), (1, 0, 1), (None, 1, 1), (2, None, None), (7, 1, 0), (7, 1, 0), (999, 1, 1)]
        labels = spark.createDataFrame(extra, "doc_id long, quality int, toxic int")
    got = held(audit.op11_filter_audit(docs, labels))
    assert got == brute([r.asDict() for r in docs.collect()], [r.asDict() for r in labels.collect()])


def test_hot_copies_and_parts(spark):
    """One text that most rows have, over many parts, with ids that repeat and null ids."""
    rows = [(i % 700 if i % 11 else None, "same text", "en", f"s{i % 9}") for i in range(2000)] + [(5000, "same text", "en", ""), (5001, "other", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2, i % 3) for i in range(0, 700, 5)], "doc_id long, quality int, toxic int")
    assert held(audit.op11_filter_audit(docs, labels)) == brute([r.asDict() for r in docs.collect()], [r.asDict() for r in labels.collect()])


def test_empty_tables_and_limits(spark, no_documents, odd_documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.op11_filter_audit(no_documents, labels).count() == 0
    assert audit.op11_filter_audit(odd_documents, labels).agg(F.sum("good_lost")).first()[0] == 0
    with pytest.raises(ValueError, match="1 to 7"):
        audit.audited(no_documents, list("ABCDEFGH"), [])


def test_other_filters_and_parts(spark):
    """The operator beside its query: any filters, parts and losses, by cells."""
    cells = spark.createDataFrame([("x", 0, 5), ("x", 1, 2), ("x", 3, 4), ("y", 2, 1)], "part string, mask int, docs long")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit.audited(cells, ["p", "q"], []).collect()}
    assert got == {("x", "pq", 1): (5, 6, 0, 2, 8), ("x", "pq", 2): (5, 0, 4, 0, 4), ("x", "qp", 1): (7, 4, 0, 0, 4), ("x", "qp", 2): (5, 2, 4, 2, 8), ("y", "pq", 1): (1, 0, 0, 0, 0), ("y", "pq", 2): (0, 1, 0, 1, 2), ("y", "qp", 1): (0, 1, 0, 1, 2), ("y", "qp", 2): (0, 0, 0, 0, 0)}
