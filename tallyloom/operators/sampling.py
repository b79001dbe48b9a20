"""Deterministic sampling, splitting and balancing by hash order.

Ranks within a group are counted in parts of the hash space, so that a group of any size is
ranked by many tasks: rows of a part by a window, parts by a small table of their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.hashing import order_key

#: Hex digits of the hash that tell the part: 4,096 parts.
PART_DIGITS = 3


def hash_rank(df: DataFrame, groups: list[str], key: Column, tie: Column, name: str = "rank") -> DataFrame:
    """The rows with their 1-based rank within the groups by a hexadecimal hash key, then tie."""
    rows = df.withColumn("h__", key).withColumn("p__", F.substring("h__", 1, PART_DIGITS))
    sizes = rows.groupBy(*groups, "p__").agg(F.count(F.lit(1)).alias("n__"))
    before = Window.partitionBy(*groups).orderBy("p__").rowsBetween(Window.unboundedPreceding, -1) if groups else Window.orderBy("p__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("o__", F.coalesce(F.sum("n__").over(before), F.lit(0)))
    offsets = offsets.select(*[F.col(g).alias(f"{g}__r") for g in groups], F.col("p__").alias("q__"), "o__")
    inside = F.row_number().over(Window.partitionBy(*groups, "p__").orderBy("h__", tie))
    same = [F.col(g).eqNullSafe(F.col(f"{g}__r")) for g in groups] + [F.col("p__") == F.col("q__")]
    ranked = rows.withColumn("i__", inside).join(offsets, same)
    return ranked.withColumn(name, F.col("o__") + F.col("i__")).drop("h__", "p__", "q__", "o__", "i__", *[f"{g}__r" for g in groups])


#: Rows up to which the first ones are found by a top-n, for which each task sends so many.
TOP_ROWS = 10_000


def take(df: DataFrame, n: int, seed: int | str, *key: Column) -> DataFrame:
    """Exactly n rows, or all if there are fewer: the first in hash order. Many are found by rank."""
    if n <= TOP_ROWS:
        return df.orderBy(order_key(seed, *key), *key).limit(n)
    return hash_rank(df, [], order_key(seed, *key), F.struct(*key), "r__").filter(F.col("r__") <= n).drop("r__")


def capped(df: DataFrame, groups: list[str], n: int, seed: int, key: Column) -> DataFrame:
    """At most n rows of each group, the first in hash order."""
    return hash_rank(df, groups, order_key(seed, key), key).filter(F.col("rank") <= n)


def downsampled(df: DataFrame, group: str, seed: int, key: Column) -> DataFrame:
    """As many rows of each group as the smallest has."""
    least = df.groupBy(group).count().agg(F.min("count").alias("least__"))
    return hash_rank(df, [group], order_key(seed, key), key).crossJoin(F.broadcast(least)).filter(F.col("rank") <= F.col("least__")).drop("least__")  # one row


def round_robin(df: DataFrame, group: str, n: int, seed: int, key: Column) -> DataFrame:
    """n rows dealt from the groups in turn: all first rows, all second rows, and so on."""
    return capped(df, [group], n, seed, key).orderBy("rank", group).limit(n)


def equal_share(df: DataFrame, group: str, cap: int, groups: int, seed: int, key: Column) -> DataFrame:
    """cap // groups rows of each group, one at least."""
    return capped(df, [group], max(1, cap // groups), seed, key)


def holdout(df: DataFrame, fraction: float, seed: int, key: Column) -> DataFrame:
    """The rows with `held`: max(1, int(n * fraction)) of them in hash order; none if the fraction is 0."""
    if fraction <= 0:
        return df.withColumn("held", F.lit(False))
    total = df.agg(F.count(F.lit(1)).alias("n__"))
    ranked = hash_rank(df, [], order_key(seed + 1, key), key).crossJoin(F.broadcast(total))  # one row
    return ranked.withColumn("held", F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n__") * fraction))).drop("n__", "rank")


def cluster_sample(df: DataFrame, cluster: str, budget: int, seed: int) -> DataFrame:
    """Whole clusters in hash order until their rows reach a budget (the last may go over it)."""
    sizes = df.groupBy(F.col(cluster).alias("c__")).agg(F.count(F.lit(1)).alias("rows")).withColumn("h", order_key(seed, F.col("c__"))).withColumn("p", F.substring("h", 1, PART_DIGITS))
    first = Window.unboundedPreceding
    parts = sizes.groupBy("p").agg(F.sum("rows").alias("held")).select(F.col("p").alias("q"), F.coalesce(F.sum("held").over(Window.orderBy("p").rowsBetween(first, -1)), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("rows").over(Window.partitionBy("p").orderBy("h", "c__").rowsBetween(first, -1)), F.lit(0))
    chosen = sizes.withColumn("inside", inside).join(parts, F.col("p") == F.col("q")).filter(F.col("offset") + F.col("inside") < budget)
    return df.join(chosen.select("c__"), F.col(cluster).eqNullSafe(F.col("c__")), "left_semi")


def entity_holdout(df: DataFrame, stratum: str, entity: str, keep: int = 1) -> DataFrame:
    """The rows with `held`: those of the last `keep` entities of each stratum, so that no entity is on both sides."""
    entities = df.select(stratum, entity).distinct()
    last = entities.withColumn("r", F.row_number().over(Window.partitionBy(stratum).orderBy(F.col(entity).desc()))).filter(F.col("r") <= keep)
    chosen = last.select(F.col(entity).alias("e__")).distinct().withColumn("held", F.lit(True))
    return df.join(chosen, F.col(entity) == F.col("e__"), "left").drop("e__").withColumn("held", F.coalesce("held", F.lit(False)))


def first_of(df: DataFrame, key: str, seed: int, tie: Column) -> DataFrame:
    """One row of each key, the first in hash order."""
    best = F.min_by(F.struct(*df.columns), F.struct(order_key(seed, tie), tie))
    return df.groupBy(F.col(key).alias("k__")).agg(best.alias("row")).select("row.*")
