"""Filter interaction audit: what each filter removes at each step of every order of the filters.

A document is reduced to the set of filters that it fails, as a bit mask, and documents are counted
by part and mask; all that follows needs these cells alone. Orders are visited by swaps of two
neighbours (plain changes), so that from one order to the next only the two swapped steps are
computed anew, and each filter's removals are added up along the walk (its Shapley sum).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.kit import marked, settled, written

#: Filters at most: 5,040 orders.
MOST = 7
#: Parts whose orders are worked on at once within a task.
PARTS_AT_ONCE = 64
#: What is counted at each step, before the losses.
STEP = ["kept", "removed", "redundant", "unique_fails"]


def plain_changes(n: int) -> Iterator[tuple[tuple[int, ...], int | None]]:
    """All orders of 0..n-1, each but the first by one swap of neighbours; with the place of the swap's left side."""
    order, leftward = list(range(n)), [True] * n
    yield tuple(order), None
    while True:
        place = {x: i for i, x in enumerate(order)}
        beside = {x: place[x] - 1 if leftward[x] else place[x] + 1 for x in order}
        moving = max((x for x in order if 0 <= beside[x] < n and order[beside[x]] < x), default=None)
        if moving is None:
            return
        left = min(place[moving], beside[moving])
        order[left], order[left + 1] = order[left + 1], order[left]
        for x in range(moving + 1, n):
            leftward[x] = not leftward[x]
        yield tuple(order), left


def steps_of(cells: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """Of cells (parts, masks, measures; documents first): the orders of the walk, the figures of each step (parts, orders, steps, STEP and losses), and each filter's removals over all orders (parts, filters)."""
    parts, masks, measures = cells.shape
    n = masks.bit_length() - 1
    mask = np.arange(masks)
    every = np.arange(n)

    def step(before: int, f: int) -> np.ndarray:
        reached = (mask & before) == 0
        failing = (mask >> f & 1) == 1
        removed = cells[:, reached & failing].sum(axis=1)
        kept = cells[:, reached & ~failing, 0].sum(axis=1)
        redundant = cells[:, ~reached & failing, 0].sum(axis=1)
        return np.column_stack([kept, removed[:, 0], redundant, cells[:, 1 << f, 0], removed[:, 1:]])

    orders, figures, now = [], [], np.zeros((parts, n, 3 + measures), np.int64)
    shapley = np.zeros((parts, n), np.int64)
    for order, left in plain_changes(n):
        for k in every if left is None else (left, left + 1):
            now[:, k] = step(sum(1 << f for f in order[:k]), order[k])
        shapley[:, order] += now[:, :, 1]
        orders.append(order)
        figures.append(now.copy())
    return orders, np.stack(figures, axis=1) if figures else np.zeros((parts, 0, n, 3 + measures), np.int64), shapley


def audited(cells: DataFrame, filters: list[str], losses: list[str]) -> DataFrame:
    """From cells (part, mask, docs and a count for each loss): a row for each part, order and step with STEP, `<loss>` counts and `shapley`.

    Bit k of a mask says that the k-th filter fails; a part has 2 ** filters cells at most, and
    lacking ones count zero. Without parts the result is empty.
    """
    if not 1 <= len(filters) <= MOST:
        raise ValueError(f"1 to {MOST} filters can be audited, not {len(filters)}")
    measures, n = ["docs", *losses], len(filters)
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *measures)).alias("cells"))
    columns = [*STEP, *losses, "shapley"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE)
                held = some.column("cells")
                flat, owner = held.flatten(), np.repeat(np.arange(len(some)), np.asarray(held.value_lengths()))
                table = np.zeros((len(some), 1 << n, len(measures)), np.int64)
                for k, m in enumerate(measures):
                    table[owner, np.asarray(flat.field("mask")), k] = np.asarray(flat.field(m))
                orders, figures, shapley = steps_of(table)
                name = ["".join(filters[f] for f in o) for o in orders]
                own = shapley[:, np.array(orders)]
                rows = np.concatenate([figures, own[..., None]], axis=3).reshape(-1, len(columns))
                part = some.column("part").take(pa.array(np.repeat(np.arange(len(some)), len(orders) * n)))
                order = pa.array(name).take(pa.array(np.tile(np.repeat(np.arange(len(orders)), n), len(some))))
                step = pa.array(np.tile(np.arange(1, n + 1), len(some) * len(orders)), pa.int32())
                yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(rows[:, k]) for k in range(len(columns)))], ["part", "filter_order", "step", *columns])

    return by_part.mapInArrow(walk, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns))


_SPACES = "[\\x20\\x09-\\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text: too short, too repetitive, too many capitals, symbols."""
    words = F.array_remove(F.split(text, _SPACES), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 50, "B": 100 * F.size(F.array_distinct(words)) < 65 * n, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike("[#$%&*|]")}


def masked(failures: dict[str, Column]) -> Column:
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures.values())), F.lit(0))


def copies_marked(rows: DataFrame, bit: int) -> DataFrame:
    """From rows (part, digest, mask, doc_id, n and flags): cells (part, mask, flags..., n), where `bit` is added to the mask of rows whose digest some smaller doc_id has.

    A null doc_id is neither smaller nor larger than others. Rows are added up by digest, part and
    flags before digests meet, so that a text that a third of all rows have is a few rows.
    """
    flags = [c for c in rows.columns if c not in ("part", "digest", "mask", "doc_id", "n")]
    known = F.col("doc_id").isNotNull()
    own = rows.groupBy("digest", "part", "mask", *flags).agg(F.sum("n").alias("n"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("n_null"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"))
    own = own.withColumn("smallest", F.min("first.doc_id").over(Window.partitionBy("digest")))
    free = F.col("n_null") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), free.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - free).alias("n")))
    cells = own.select("part", *flags, F.explode(both).alias("c")).select("part", *flags, "c.mask", "c.n")
    return cells.groupBy("part", "mask", *flags).agg(F.sum("n").alias("n"))


def op11_filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order and step of the five filters, by source; see `audited`.

    A null text is empty, a null source is the part of the empty name. Repeated rows each count, and
    those with the smallest doc_id of their text are no copies. A document is good or toxic if any of
    its labels says so; a null doc_id has none. Texts are read once and whole, and only digests of
    32 bytes are shuffled. Empty tables give no rows.
    """
    mark = marked()
    text = F.coalesce(F.col("text"), F.lit(""))
    # A row that repeats, id and all, is one row with a count before labels meet.
    rows = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), masked(text_failures(text)).alias("mask"))
    rows, _ = written(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")))
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    flags = labels.filter("doc_id is not null").groupBy("doc_id").agg(says("quality"), says("toxic"))
    told = lambda c: F.coalesce(c, F.lit(False))
    some = rows.filter("doc_id is not null").join(flags, "doc_id", "left").select("doc_id", "part", "digest", "mask", "n", told(F.col("quality")).alias("quality"), told(F.col("toxic")).alias("toxic"))
    none = rows.filter("doc_id is null").select("doc_id", "part", "digest", "mask", "n", F.lit(False).alias("quality"), F.lit(False).alias("toxic"))
    cells = copies_marked(some.unionByName(none), 1 << 4)
    lost = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    cells = cells.groupBy("part", "mask").agg(F.sum("n").alias("docs"), lost("quality").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    return settled(audited(cells, list("ABCDE"), ["good_lost", "toxic_lost"]), mark)


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
e AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f
  FROM d JOIN e USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, f),
o AS (SELECT o AS filter_order, unnest(range(1, 6)) AS step FROM (VALUES {_ORDERS}) v(o)),
s AS (SELECT part, filter_order, step::INT AS step, substr(filter_order, step, 1) AS own, docs, good, toxic,
    f[ord(substr(filter_order, step, 1)) - 64] AS fails, len(list_filter(range(1, step), lambda k: f[ord(substr(filter_order, k, 1)) - 64])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS many FROM c, o),
r AS (SELECT part, filter_order, step, own, coalesce(sum(docs) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(docs) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(docs) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(docs) FILTER (fails AND many = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
