"""Options beside the gold answer: from pools, by likeness, by perturbation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.binding import bound
from tallyloom.functions.hashing import order_key
from tallyloom.functions.text import jaccard, word_set
from tallyloom.operators import sampling
from tallyloom.operators.intervals import plausible_box


def from_pool(pool: Column, gold: Column, n: int, seed: int, *key: Column) -> Column:
    """Gold and n - 1 others of a pool, in hash order; null if the pool has too few."""
    keyed = lambda x: F.struct(order_key(seed, *key, x).alias("h"), x.alias("x"))

    def few(others: Column) -> Column:
        chosen = F.sort_array(F.concat(F.slice(others, 1, n - 1), F.array(keyed(gold))))
        return F.when(F.size(others) >= n - 1, F.transform(chosen, lambda s: s["x"]))

    return bound(F.sort_array(F.transform(F.filter(pool, lambda x: x != gold), keyed)), few)


def tiered_pool(df: DataFrame, value: str, tiers: list[Column], n: int, seed: int = 0, *key: Column) -> DataFrame:
    """The rows with `tier`, `others` and `pool`: the first tier with n - 1 other distinct values, or else the first with any; how many others it has; n - 1 of them, or all.

    A row draws from the whole tier: the others that follow a start of its own, by seed and key, in
    the hash order of the tier key's values, around the end. A tier key that is null has none.
    """
    rows, all_keyed = df, None
    for i, t in enumerate(tiers):
        keyed = df.select(F.lit(i).alias("t__"), t.cast("string").alias("k__"), F.col(value).alias("v__")).dropna().distinct()
        sizes = keyed.groupBy(F.col("k__").alias(f"s{i}__")).agg(F.count(F.lit(1)).alias(f"c{i}__"))
        rows = rows.withColumn(f"k{i}__", t.cast("string")).join(sizes, F.col(f"k{i}__") == F.col(f"s{i}__"), "left").drop(f"s{i}__")
        rows = rows.withColumn(f"c{i}__", F.when(F.col(value).isNull(), 0).otherwise(F.coalesce(F.col(f"c{i}__") - 1, F.lit(0))))
        all_keyed = keyed if all_keyed is None else all_keyed.unionByName(keyed)
    enough, some = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i in reversed(range(len(tiers))):
        enough = F.when(F.col(f"c{i}__") >= n - 1, i).otherwise(enough)
        some = F.when(F.col(f"c{i}__") > 0, i).otherwise(some)
    rows = rows.withColumn("tier", F.coalesce(enough, some))
    of_tier = lambda c: F.coalesce(*[F.when(F.col("tier") == i, F.col(f"{c}{i}__")) for i in range(len(tiers))])
    rows = rows.withColumn("others", F.coalesce(of_tier("c"), F.lit(0)).cast("long")).withColumn("k__", of_tier("k"))
    start = F.pmod(F.xxhash64(F.lit(seed), F.col(value), *key), F.col("others") + 1) + 1
    rows = rows.withColumn("start__", F.when(F.col("tier").isNotNull(), start)).drop(*[f"{c}{i}__" for i in range(len(tiers)) for c in "ck"])
    # Each value stands in the draws of the n starts up to it; a draw has n values, of which a row's own may be one.
    totals = all_keyed.groupBy(F.col("t__").alias("u__"), F.col("k__").alias("l__")).agg(F.count(F.lit(1)).alias("all__"))
    ranked = sampling.hash_rank(all_keyed, ["t__", "k__"], order_key(seed, F.col("v__")), F.col("v__"), "r__")
    ranked = ranked.join(totals, (F.col("t__") == F.col("u__")) & (F.col("k__") == F.col("l__"))).withColumn("j__", F.explode(F.sequence(F.lit(0), (F.least(F.lit(n), F.col("all__")) - 1).cast("int"))))
    ranked = ranked.select("t__", F.col("k__").alias("key__"), (F.pmod(F.col("r__") - 1 - F.col("j__"), F.col("all__")) + 1).alias("at__"), "j__", "v__")
    draws = ranked.groupBy("t__", "key__", "at__").agg(F.transform(F.array_sort(F.collect_list(F.struct("j__", "v__"))), lambda s: s["v__"]).alias("draw__"))
    out = rows.join(draws, (F.col("tier") == F.col("t__")) & (F.col("k__") == F.col("key__")) & (F.col("start__") == F.col("at__")), "left")
    return out.withColumn("pool", F.slice(F.filter("draw__", lambda v: v != F.col(value)), 1, n - 1)).drop("k__", "start__", "t__", "key__", "at__", "draw__")


def lookalikes(labels: DataFrame, label: str, k: int = 6, words: Callable[[Column], Column] = word_set) -> DataFrame:
    """(label, other, similarity, rank): the k most similar other labels by shared words (`word_set`, or `stem_set` for stems without stop words), ties by name. Labels without a shared word are no pair."""
    words = labels.select(F.col(label).alias("label")).distinct().withColumn("words", words(F.col("label")))
    each = words.select("label", "words", F.explode("words").alias("w"))
    other = each.select(F.col("label").alias("other"), F.col("words").alias("words_"), "w")
    pairs = each.join(other, "w").filter("label <> other").select("label", "other", jaccard(F.col("words"), F.col("words_")).alias("similarity")).distinct()
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.col("similarity").desc(), "other")))
    return ranked.filter(F.col("rank") <= k)


#: Fixed value: the share of the smaller of two boxes from which one covers the other.
COVERED = 0.3


def spread_boxes(gold: Column, others: Column, most: int, width: Column, height: Column, seed: int, *key: Column) -> Column:
    """Gold and up to `most` other boxes (x, y, w, h, text) in hash order that are plausible marks beside it: taken one after the other, each with a text of its own and not covered by one taken before."""
    area = lambda b: b["w"] * b["h"]
    side = lambda a, b, at, by: F.greatest(F.least(a[at] + a[by], b[at] + b[by]) - F.greatest(a[at], b[at]), F.lit(0))
    covered = lambda a, b: side(a, b, "x", "w") * side(a, b, "y", "h") / F.greatest(F.least(area(a), area(b)), F.lit(1))
    pool = F.filter(others, lambda b: plausible_box(b["w"], b["h"], width, height) & (F.coalesce(b["text"], F.lit("")) != ""))
    ranked = F.transform(F.array_sort(F.transform(pool, lambda b: F.struct(order_key(seed, *key, b["text"], b["x"], b["y"]).alias("h"), b.alias("b")))), lambda s: s["b"])
    beside = lambda taken, b: (F.size(taken) <= most) & ~F.exists(taken, lambda t: (t["text"] == b["text"]) | (covered(t, b) >= COVERED))
    return F.aggregate(ranked, F.array(gold), lambda taken, b: F.when(beside(taken, b), F.concat(taken, F.array(b))).otherwise(taken))


def by_distance(options: Column, gold: Column) -> Column:
    """Other texts by how near they are to gold: the difference in words, and two more if only one of both holds a digit; ties by text."""
    words = lambda x: F.size(F.split(F.trim(x), r"\s+"))
    digit = lambda x: x.rlike("[0-9]")
    far = lambda x: F.abs(words(x) - words(gold)) + F.when(digit(x) != digit(gold), 2).otherwise(0)
    return F.transform(F.array_sort(F.transform(F.filter(options, lambda x: x != gold), lambda x: F.struct(far(x).alias("far"), x.alias("x")))), lambda s: s["x"])


def same_type(pool: Column, gold: Column) -> Column:
    """The values of a pool that look like gold: numbers if it is one, capitalised if it is, with as many words."""
    kind = lambda x: F.struct(x.rlike(r"^[-+$]?[0-9][0-9.,%]*$").alias("number"), x.rlike(r"^\p{Lu}").alias("name"), F.size(F.split(F.trim(x), r"\s+")).alias("words"))
    return F.filter(pool, lambda x: (x != gold) & (kind(x) == kind(gold)))


def integer_options(gold: Column, n: int = 4) -> Column:
    """n distinct sorted integers around gold."""
    near = F.array_distinct(F.array(gold, gold + 1, gold - 1, gold + 2, gold - 2, gold * 2, gold + 10))
    return F.array_sort(F.slice(near, 1, n))


def other_windows(start: Column, end: Column, duration: Column, n: int, step: float = 0.5) -> Column:
    """n starts of windows as long as (start, end) inside a duration that overlap neither it nor one another by over a third: greedy along a grid. Null if there are too few."""
    length = end - start
    grid = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((duration - length) / step).cast("int"), F.lit(0))), lambda i: i * F.lit(step))
    iou = lambda a, b: F.greatest(length - F.abs(a - b), F.lit(0.0)) / (length + F.abs(a - b))
    picked = F.aggregate(grid, F.array().cast("array<double>"), lambda acc, g: F.when((F.size(acc) < n) & (g + length <= duration) & (iou(g, start) <= 0.4) & ~F.exists(acc, lambda x: iou(g, x) > 0.4), F.concat(acc, F.array(g))).otherwise(acc))
    return F.when(F.size(picked) == n, picked)


def padded_tools(tools: Column, pool: Column, k: int, seed: int, *key: Column) -> Column:
    """A catalog of tool names filled up to k from a pool, without a name twice."""
    extra = F.array_sort(F.transform(F.array_except(pool, tools), lambda x: F.struct(order_key(seed, *key, x).alias("h"), x.alias("x"))))
    return F.concat(tools, F.transform(F.slice(extra, 1, F.greatest(k - F.size(tools), F.lit(0))), lambda s: s["x"]))
