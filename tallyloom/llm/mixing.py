"""Mixing sources to target weights by exact subset sums over document lengths.

Documents are counted by (source, length). Each source's target is met by whole epochs, then by an
even part of all lengths: along the order of lengths every n-th document is taken once more, so
that each range of lengths has its share to within one document. What the budget lacks or has too
much of then, a bounded knapsack over all counts that are left closes to the word where lengths
allow. The counts by length then select documents by a seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.kit import lookup, marked, packed, settled, unpacked, word_count, written

#: Bits that the knapsack keeps at once (64 MB); it stops at the best sum by then, which lies within one document of the target.
KNAPSACK_BITS = 1 << 29
#: Documents of one source and length that are ranked together.
RANKED = 256


def subset(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length make the largest sum not above the budget: bounded knapsack over bit sets, counts in binary parts."""
    parts, reach, limit = [], [1], (1 << (budget + 1)) - 1
    for n, c in zip(lengths, counts, strict=True):
        c, k = min(c, budget // n), 1
        while c > 0 and not reach[-1] >> budget & 1 and len(reach) * budget < KNAPSACK_BITS:
            k = min(k, c)
            more = (reach[-1] | reach[-1] << n * k) & limit
            if more != reach[-1]:
                parts.append((n, k))
                reach.append(more)
            c, k = c - k, 2 * k
    left, taken = reach[-1].bit_length() - 1, {}
    for i in range(len(parts) - 1, -1, -1):
        if not reach[i] >> left & 1:
            n, k = parts[i]
            taken[n] = taken.get(n, 0) + k
            left -= n * k
    return taken


def even_part(counts: np.ndarray, share: float, offset: float) -> np.ndarray:
    """Of each length, how many documents a walk over all of them takes at a rate of `share`; any run of lengths has its share to within one document."""
    upto = np.concatenate([[0], np.cumsum(counts)]) * share + offset
    return np.minimum(np.diff(np.floor(upto + 1e-9).astype(np.int64)), counts)


def fit(lengths: np.ndarray, counts: np.ndarray, target: float, seed: int = 1) -> tuple[int, np.ndarray]:
    """Whole epochs of a source, and how many documents of each length are taken once more. Lengths are distinct, in any order."""
    extra = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if total == 0:
        return 0, extra
    epochs = min(int(target // total), 2)
    budget = int(round(target - epochs * total)) if epochs < 2 else 0
    kinds = np.flatnonzero(lengths > 0)
    kinds = kinds[np.argsort(lengths[kinds], kind="stable")]
    size, held = lengths[kinds], counts[kinds]
    rng = np.random.default_rng([seed, len(kinds), total % (1 << 32)])
    some = even_part(held, budget / total, float(rng.random()))
    # Too much by a few documents at most: the smallest that is enough goes, or else the largest there is.
    while (over := int((size * some).sum()) - budget) > 0:
        there = np.flatnonzero(some > 0)
        enough = there[size[there] >= over]
        some[enough[0] if len(enough) else there[-1]] -= 1
    # The rest goes to the knapsack. Where it can't be met, documents that were taken are released, twice as many each time, up to all.
    step, best, order = int(np.gcd.reduce(size)), some, rng.permutation(len(kinds))
    released = 0
    while budget - int((size * best).sum()) >= step:
        freed = even_part(some, min(1.0, released / max(1, int(some.sum()))), 0.5) if released else np.zeros_like(some)
        open_, rest = some - freed, budget - int((size * (some - freed)).sum())
        fits = [int(i) for i in order if held[i] > open_[i] and size[i] <= rest]
        if rest // step > KNAPSACK_BITS // 64:
            break
        more = subset([int(size[i]) // step for i in fits], [int(held[i] - open_[i]) for i in fits], rest // step)
        found = open_.copy()
        for i in fits:
            found[i] += more.get(int(size[i]) // step, 0)
        if int((size * found).sum()) > int((size * best).sum()):
            best = found
        if released >= int(some.sum()):
            break
        released = max(16, 2 * released)
    extra[kinds] = best
    return epochs, extra


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    epochs, extra = fit(pdf["size"].to_numpy(np.int64), pdf["docs"].to_numpy(np.int64), float(pdf["target"].iloc[0]))
    return pdf.assign(epochs=epochs, extra=extra)[["source", "size", "docs", "source_size", "target", "epochs", "extra"]]


def targets(totals: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Each source's target: `share` of all words dealt by weight, none above `most` times its own words, the excess dealt again by weight.

    Sources stand in order of code points, null last, and the weights repeat along them. With
    sources in order of cap over weight, those below the level reached get their cap and the rest
    share what is left by weight, which is where dealing again and again ends.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    rows = totals.withColumn("weight", F.element_at(kinds, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * share - F.col("capped")) / F.col("weight_left"))
    # The first source that its level does not fill up sets the level of all after it.
    rows = rows.withColumn("free", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("at")))).over(everything))
    level = F.col("free.at")
    return rows.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight"))).alias("target"))


def mix(df: DataFrame, source: str = "source", words: str = "words", seed: int = 1, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """The rows with `size` (words), `source_size`, `target` (both of the source) and `copies` (0, 1 or 2) that the mix takes.

    Column `words` holds the length; null counts as 0, and rows of size 0 are never taken. A null
    source is a source. Repeated rows are separate documents; among equal rows, and rows whose
    hashes tie, it shows nowhere which is taken. A very long document is a length like others; no
    task sees more of a source than its distinct lengths. An empty table gives an empty table.
    Input columns with the new names are replaced. The order among documents of one length is a hash of seed and row, so that
    reruns agree.
    """
    sized = packed(df).withColumn("source", F.col("row").getField(source).cast("string")).withColumn("size", F.coalesce(F.col("row").getField(words).cast("long"), F.lit(0).cast("long")))
    sized = sized.withColumn("at", F.xxhash64(F.lit(seed), "row"))
    histogram, _ = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")))
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    goals = targets(totals, weights, share)
    plan = lookup(histogram, goals, ["source"]).groupBy("source").applyInPandas(_fit_source, "source string, size long, docs long, source_size long, target double, epochs long, extra long")
    plan, _ = written(plan)
    rows = lookup(sized, plan, ["source", "size"])
    # Large groups of one length are ranked in parts: all of the first parts are taken, and one part is ranked.
    rows = rows.withColumn("part", F.when((F.col("extra") > 0) & (F.col("extra") < F.col("docs")), F.pmod(F.col("at"), F.floor(F.col("docs") / RANKED) + 1)).otherwise(F.lit(-1).cast("long")))
    whole = rows.filter("part = -1").withColumn("more", F.when(F.col("extra") > 0, 1).otherwise(0))
    ranked = rows.filter("part >= 0")
    parts = ranked.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("source_"), F.col("size").alias("size_"), F.col("part").alias("part_"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    same = F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_")) & (F.col("part") == F.col("part_"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("at", "row"))
    chosen = ranked.withColumn("rank", rank).join(parts, same).withColumn("more", F.when(F.col("before") + F.col("rank") <= F.col("extra"), 1).otherwise(0))
    both = whole.unionByName(chosen, allowMissingColumns=True)
    return unpacked(both, df, F.col("size"), F.col("source_size"), F.col("target"), (F.col("epochs") + F.col("more")).alias("copies"), names=("size", "source_size", "target", "copies"))


def repeated(df: DataFrame, source: str = "source", text: str = "text", seed: int = 1) -> DataFrame:
    """The rows themselves, each as often as the mix of the sources takes it, with exactly their own columns."""
    rows = packed(df, "own").select("own", F.col("own").getField(source).alias("source"), word_count(F.col("own").getField(text)).alias("words"))
    mixed = mix(rows, seed=seed).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return mixed.select(*[F.col("own").getField(c).alias(c) for c in df.columns])


def op9_mixing(documents: DataFrame) -> DataFrame:
    """The mix of all documents; sizes only move, not texts."""
    mark = marked()
    out = mix(documents.select("doc_id", "source", word_count("text").alias("words")))
    return settled(out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")), mark)
