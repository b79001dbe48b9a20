"""Rows in the context of those before them: histories, transcripts, later steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_items(df: DataFrame, group: str, order: list[str], item: Column, n: int, name: str = "history") -> DataFrame:
    """The rows with an array of the n items before them, oldest first."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-n, -1)
    return df.withColumn(name, F.collect_list(item).over(w))


def running_transcript(df: DataFrame, group: str, order: list[str], line: Column, most: int = 3500, name: str = "transcript") -> DataFrame:
    """The rows with the lines before them joined by line breaks, cut to the last `most` characters. A null line is none.

    A running sum of lengths tells where each line begins in its group's transcript. The transcript
    is kept in parts of `most` characters, each once with the tail of what comes before it, and a
    row cuts its own piece out of its part: work and traffic grow with rows times `most`, whatever
    the length of a group.
    """
    along = Window.partitionBy(group).orderBy(*order)
    size = F.coalesce(F.length("line__") + 1, F.lit(0)).cast("long")
    rows = df.withColumn("line__", line).withColumn("at__", F.coalesce(F.sum(size).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("part__", F.floor(F.col("at__") / most))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("line__").isNotNull(), F.struct("at__", "line__")))), lambda x: F.concat(x["line__"], F.lit("\n")))
    parts = rows.groupBy(F.col(group).alias("g__"), F.col("part__").alias("p__")).agg(F.array_join(lines, "").alias("text__"), F.min("at__").alias("from__"))
    # A part is one line at least, and two parts in a row are longer than `most`, so that two hold the tail.
    parts = parts.withColumn("end__", F.right("text__", F.lit(most + 1))).withColumn("text__", F.left("text__", F.lit(most)))
    before = Window.partitionBy("g__").orderBy("p__")
    tail = F.right(F.concat(F.coalesce(F.lag("end__", 2).over(before), F.lit("")), F.coalesce(F.lag("end__", 1).over(before), F.lit(""))), F.lit(most + 1))
    parts = parts.select("g__", "p__", "from__", tail.alias("tail__"), "text__")
    met = rows.join(parts, F.col(group).eqNullSafe(F.col("g__")) & (F.col("part__") == F.col("p__")), "left")
    upto = F.concat("tail__", F.left("text__", (F.col("at__") - F.col("from__")).cast("int")))
    cut = F.left(upto, F.greatest(F.length(upto) - 1, F.lit(0)))  # without the last line's break
    return met.withColumn(name, F.right(cut, F.lit(most))).drop("line__", "at__", "part__", "g__", "p__", "from__", "tail__", "text__")


def later_steps(df: DataFrame, episode: str, step: str, item: str, n: int) -> DataFrame:
    """The rows with an array of the n items after them in the episode: wrong answers for the next step."""
    w = Window.partitionBy(episode).orderBy(step).rowsBetween(1, n)
    return df.withColumn("later", F.collect_list(item).over(w))


def _first_entities(rows: DataFrame, groups: list[str], order: list[str], entity: str, n: int, name: str) -> DataFrame:
    """The rows with an array of the first n different entities from each row on, its own first, inside the groups.

    One more is found at a time: the entity after the first k of a row is the last of the next
    row's k, if the row's own entity is none of them, and else the same as the next row's. So each
    is a running value along the reversed order, and a row carries n entities at most.
    """
    back = Window.partitionBy(*groups).orderBy(*[F.desc(c) for c in order])
    out = rows.withColumn(name, F.array(entity))
    for k in range(1, n):
        after = out.withColumn("next__", F.lag(name).over(back))
        one = F.when((F.size("next__") == k) & ~F.array_contains("next__", F.col(entity)), F.element_at("next__", k))
        after = after.withColumn("one__", F.last(one, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
        out = after.withColumn(name, F.when(F.col("one__").isNotNull(), F.concat(name, F.array("one__"))).otherwise(F.col(name))).drop("next__", "one__")
    return out


def same_group_pairs(df: DataFrame, group: str, entity: str, seed_key: Column, n: int = 1, part: int = 128, block: int = 1024) -> DataFrame:
    """The rows with `others`: up to n other entities of the same group, as they follow in the order of a hexadecimal hash key, from the last row on to the first.

    A group of more than `part * block` rows is cut along its order into parts of about so many,
    each a task's; what follows a part, around the end, is found from the first n + 1 entities of
    each part. Both tables that are broadcast have a row for as many rows at most: one for a large
    group, and one for its part. A null entity is no other's and has none.
    """
    most = part * block
    large = df.groupBy(F.col(group).alias("g__")).agg(F.count(F.lit(1)).alias("rows__")).filter(F.col("rows__") > most)
    large = large.select("g__", F.ceil(F.col("rows__") / most).alias("parts__"))
    rows = df.withColumn("h__", seed_key).withColumn("none__", F.col(entity).isNull())
    rows = rows.join(F.broadcast(large), F.col(group).eqNullSafe(F.col("g__")), "left").drop("g__")
    at = F.shiftright(F.conv(F.substring("h__", 1, 8), 16, 10).cast("long") * F.col("parts__"), 32)
    rows = rows.withColumn("part__", F.when(F.col("parts__").isNull(), 0).otherwise(at))
    own = [group, "none__", "parts__", "part__"]
    rows = _first_entities(rows, own, ["h__", entity], entity, n + 1, "after__")
    whole = Window.partitionBy(*own).orderBy(F.desc("h__"), F.desc(entity)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("head__", F.last("after__").over(whole))
    # The first entities of all parts in order, twice around.
    heads = rows.filter(F.col("parts__").isNotNull()).groupBy(*own).agg(F.first("head__").alias("head__"))
    heads = heads.select(F.col(group).alias("g__"), F.col("none__").alias("z__"), F.col("part__").alias("p__"), F.explode(F.array(F.lit(0), F.lit(1))).alias("lap__"), "head__")
    heads = heads.select("g__", "z__", "p__", "lap__", F.posexplode("head__").alias("j__", "e__"))
    heads = _first_entities(heads, ["g__", "z__"], ["lap__", "p__", "j__"], "e__", n + 1, "beyond__").filter("j__ = 0")
    back = Window.partitionBy("g__", "z__").orderBy(F.desc("lap__"), F.desc("p__"))
    beyond = heads.withColumn("beyond__", F.lag("beyond__").over(back)).filter("lap__ = 0").select("g__", "z__", "p__", "beyond__")
    met = rows.join(F.broadcast(beyond), F.col(group).eqNullSafe(F.col("g__")) & (F.col("none__") == F.col("z__")) & (F.col("part__") == F.col("p__")), "left")
    reach = F.array_distinct(F.concat("after__", F.coalesce("beyond__", "head__")))
    others = F.slice(F.filter(reach, lambda e: e != F.col(entity)), 1, n)
    return met.select(*df.columns, others.alias("others"))
