"""Intervals and boxes: merging, overlap, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, groups: list[str], start: str, end: str, gap: Column | float) -> DataFrame:
    """(groups, island, start, end, n): intervals of a group merged where the gap is not above `gap`; islands are numbered from 1. Null starts come first.

    The range of starts is cut into as many parts as the square root of the number of rows. A part
    of a group is merged by itself; of it remain its own islands and how far they reach. Reaches
    are carried from part to part, and islands that they touch are merged again. So a group that
    holds most rows takes many tasks, and what meets in one is a row for each part.
    """
    span = df.agg(F.min(F.col(start).cast("double")).alias("low__"), F.max(F.col(start).cast("double")).alias("high__"), F.ceil(F.sqrt(F.count(F.lit(1)).cast("double"))).alias("parts__"))
    at = (F.col(start).cast("double") - F.col("low__")) / F.greatest(F.col("high__") - F.col("low__"), F.lit(1e-9)) * F.col("parts__")
    part = F.coalesce(F.least(F.floor(at), F.col("parts__") - 1), F.lit(-1))
    rows = df.crossJoin(F.broadcast(span)).withColumn("part__", part)  # one row
    rows = rows.withColumn("gap__", F.lit(gap) if isinstance(gap, int | float) else gap)
    by, along = [*groups, "part__"], [F.col(g).alias(f"{g}__r") for g in groups]
    same = [F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in by]
    first = Window.unboundedPreceding

    # Inside a part.
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(first, -1))
    rows = rows.withColumn("i__", F.sum(F.when(reach.isNull() | (F.col(start) > reach + F.col("gap__")), 1).otherwise(0)).over(order))
    own = rows.groupBy(*by, "i__").agg(F.min(start).alias("start__"), F.max(end).alias("end__"), F.count(F.lit(1)).alias("n__"), F.min_by("gap__", F.struct(start, end)).alias("gap__"))

    # From part to part: how far the parts before reach, then how many islands begin in them.
    across = Window.partitionBy(*[f"{g}__r" for g in groups]).orderBy("part____r").rowsBetween(first, -1)
    keyed = [*along, F.col("part__").alias("part____r")]
    carried = own.groupBy(*keyed).agg(F.max("end__").alias("reach__")).withColumn("carry__", F.max("reach__").over(across)).drop("reach__")
    own = own.join(carried, same, "left").drop(*[f"{c}__r" for c in by])
    before = F.greatest("carry__", F.max("end__").over(Window.partitionBy(*by).orderBy("i__").rowsBetween(first, -1)))
    own = own.withColumn("new__", F.when(before.isNull() | (F.col("start__") > before + F.col("gap__")), 1).otherwise(0))
    begun = own.groupBy(*keyed).agg(F.sum("new__").alias("begun__")).withColumn("offset__", F.coalesce(F.sum("begun__").over(across), F.lit(0))).drop("begun__")
    own = own.join(begun, same, "left").drop(*[f"{c}__r" for c in by])
    island = F.col("offset__") + F.sum("new__").over(Window.partitionBy(*by).orderBy("i__"))
    return own.withColumn("island", island).groupBy(*groups, "island").agg(F.min("start__").alias("start"), F.max("end__").alias("end"), F.sum("n__").alias("n"))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of intervals (start, end) of equal keys that overlap, each once: both are cut into bins of `width`, and a pair counts in the bin where it begins to overlap."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    x = a.withColumn("bin__", bins("start", "end"))
    y = b.withColumnsRenamed({"start": "start_b", "end": "end_b"}).withColumn("bin__", bins("start_b", "end_b"))
    met = x.join(y, [*keys, "bin__"]).filter((F.col("start") < F.col("end_b")) & (F.col("start_b") < F.col("end")))
    return met.filter(F.col("bin__") == F.floor(F.greatest("start", "start_b") / width)).drop("bin__")


def busy_seconds(df: DataFrame, group: str, member: str, step: float, least: int = 2, shortest: float = 0.0) -> DataFrame:
    """(group, members, busy): distinct members, and the time in which at least `least` of them are active, in bins of `step`. Members who are active for less than `shortest` in all do not count."""
    if shortest:
        active = df.groupBy(group, member).agg(F.sum(F.col("end") - F.col("start")).alias("a__")).filter(F.col("a__") >= shortest).select(group, member)
        df = df.join(active, [group, member], "left_semi")
    ticks = df.withColumn("tick", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor(F.col("end") / step))))
    each = ticks.groupBy(group, "tick").agg(F.countDistinct(member).alias("active"))
    busy = each.groupBy(group).agg((F.sum(F.when(F.col("active") >= least, 1).otherwise(0)) * step).alias("busy"))
    return df.groupBy(group).agg(F.countDistinct(member).alias("members")).join(busy, group)


def longest(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """The longest interval of each group, of equals the first."""
    best = F.max_by(F.struct(*df.columns), F.struct((F.col(end) - F.col(start)).alias("length"), (-F.col(start)).alias("first")))
    return df.groupBy(F.col(group).alias("g__")).agg(best.alias("row")).select("row.*")


def containing_box(df: DataFrame, boxes: str, x: Column, y: Column) -> Column:
    """Of an array of boxes (x, y, w, h), the smallest that holds a point, or null."""
    inside = F.filter(boxes, lambda b: (b["x"] <= x) & (x <= b["x"] + b["w"]) & (b["y"] <= y) & (y <= b["y"] + b["h"]))
    keyed = F.array_sort(F.transform(inside, lambda b: F.struct((b["w"] * b["h"]).alias("area"), b.alias("box"))))
    return F.try_element_at(keyed, F.lit(1))["box"]


#: The least width and height of a plausible box, and the share of the screen below which it is.
LEAST_SIDE, SCREEN_SHARE = 6, 0.3


def plausible_box(w: Column, h: Column, width: Column, height: Column) -> Column:
    """Neither too small nor too large a part of the screen."""
    return (w >= LEAST_SIDE) & (h >= LEAST_SIDE) & (w * h < SCREEN_SHARE * width * height)
