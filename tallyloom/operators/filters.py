"""Filters of rows before they become records, and checked lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import jaccard, word_set


def within_budget(df: DataFrame, text: Column, most: int) -> DataFrame:
    """Rows whose text has at most `most` characters; longer ones go, they are not cut."""
    return df.filter(F.length(text) <= most)


def confident(value: Column, low: float, high: float) -> Column:
    """True from `high` on, false below `low`, null between: rows in the middle are no example."""
    return F.when(value >= high, True).when(value < low, False)


def apart(a: Column, b: Column, least: float, ratio: bool = False) -> Column:
    """Two scores differ enough: by `least`, or by that factor."""
    return (F.greatest(a, b) >= least * F.least(a, b)) if ratio else (F.abs(a - b) >= least)


def same_prompt(a: Column, b: Column, mark: str) -> Column:
    """Two conversations are equal up to the last mark (the start of the last answer), and not after it."""
    prompt = lambda c: F.substring_index(c, mark, -1)
    before = lambda c: F.left(c, F.length(c) - F.length(prompt(c)))
    return (before(a) == before(b)) & (prompt(a) != prompt(b))


def not_paraphrase(a: Column, b: Column, most: float = 0.5) -> Column:
    """Two texts share at most that part of their words."""
    return jaccard(word_set(a), word_set(b)) <= most


def allowed_pairs(pairs: DataFrame, first: str, second: str, groups: DataFrame) -> DataFrame:
    """Pairs of different classes of which none is in a confusable group (group, class) with the other."""
    other = groups.select(F.col("group").alias("g__"), F.col("class").alias("o__"))
    confused = groups.join(other, F.col("group") == F.col("g__")).select(F.col("class").alias("c__"), "o__").distinct()
    return pairs.filter(F.col(first) != F.col(second)).join(confused, (F.col(first) == F.col("c__")) & (F.col(second) == F.col("o__")), "left_anti")


def looked_up(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """An inner join by key in which a missing key is an error."""
    known = table.withColumn("known__", F.lit(True))
    joined = df.join(known, key, "left")
    missing = F.raise_error(F.concat(F.lit("no row for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return joined.filter(F.coalesce("known__", missing)).drop("known__")


def best_group_key(df: DataFrame, keys: list[str], low: int = 2, high: int = 60) -> DataFrame:
    """(key, values, rows) of the first key of a map column `meta` that every row has and that has `low` to `high` values."""
    pairs = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(k).alias("key"), F.try_element_at("meta", F.lit(k)).alias("value")) for i, k in enumerate(keys)])
    each = df.select(F.explode(pairs).alias("m"))
    told = each.groupBy("m.at", "m.key").agg(F.countDistinct("m.value").alias("values"), F.count("m.value").alias("rows"), F.count(F.lit(1)).alias("all"))
    good = told.filter((F.col("rows") == F.col("all")) & F.col("values").between(low, high))
    return good.agg(F.min(F.struct("at", "key", "values", "rows")).alias("m")).filter("m is not null").select("m.key", "m.values", "m.rows")


def window_means(df: DataFrame, order: str, value: str, size: int) -> DataFrame:
    """(window, mean, n): means over consecutive windows of `size` steps of a gapless step column."""
    return df.groupBy(F.floor(F.col(order) / size).alias("window")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def with_media(records: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """Records with the media item (path, type, duration, fps) of their key; those without one go."""
    from tallyloom.operators.records import MEDIA

    item = F.struct(F.col("type"), F.col("path"), F.lit(None).cast("array<string>").alias("frames"), F.col("fps"), F.col("duration"), F.lit(None).cast("string").alias("audio"), F.lit(0.0).alias("start"), F.lit(False).alias("mute"), F.lit(False).alias("black"))
    items = media.select(F.col(key).alias("k__"), F.array(item).cast(f"array<{MEDIA}>").alias("item__"))
    return records.join(items, F.col("meta")[key] == F.col("k__")).withColumn("media", F.col("item__")).drop("k__", "item__")
