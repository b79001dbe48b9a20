"""Labels from counts: votes, modes, the cheapest success, the rarest label, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vote_targets(df: DataFrame, key: str, vote: Column, labels: list[str]) -> DataFrame:
    """(key, n, probs, winner) of each key's votes: the share of each label, others counted in the last, and the most voted one, of equals the first."""
    at = F.array_position(F.array(*map(F.lit, labels)), vote).cast("int")
    at = F.when(at > 0, at).otherwise(len(labels))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(at == i + 1) for i in range(len(labels))]).alias("c"))
    winner = F.element_at(F.array(*map(F.lit, labels)), F.array_position("c", F.array_max("c")).cast("int"))
    return counts.select(key, "n", F.transform("c", lambda c: c / F.col("n")).alias("probs"), winner.alias("winner"))


def cheapest(df: DataFrame, key: str, tier: Column, success: Column, tiers: list[str]) -> DataFrame:
    """(key, tier): the first of the tiers (by index) with a success, or the last tier if none has."""
    best = df.groupBy(key).agg(F.min(F.when(success, tier)).cast("int").alias("b"))
    return best.select(key, F.coalesce(F.element_at(F.array(*map(F.lit, tiers)), F.col("b") + 1), F.lit(tiers[-1])).alias("tier"))


def rarest(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, rarest): each key's label that is rarest in the whole table, ties by name."""
    counts = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(F.col(label).alias("l__")).agg(F.sum("n").alias("all"))
    each = counts.join(total, F.col(label) == F.col("l__"))
    return each.groupBy(key).agg(F.min(F.struct("all", label)).alias("m")).select(key, F.col("m")[label].alias("rarest"))


def modes(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """(key, mode): each key's most frequent label, of equals the one that comes first in order."""
    counts = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.max_by(label, F.struct("n", (-F.col("first")).alias("first"))).alias("mode"))


def vocabulary(df: DataFrame, label: str, least: int) -> DataFrame:
    """(label, n) of the labels that occur at least so often."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def answers_over_splits(splits: list[DataFrame], key: str, answer: str) -> DataFrame:
    """(key, answers): the sorted distinct answers of each key over all splits of a dataset, to be looked up from one of them."""
    every = splits[0].select(key, answer)
    for more in splits[1:]:
        every = every.unionByName(more.select(key, answer))
    return every.groupBy(key).agg(F.array_sort(F.collect_set(answer)).alias("answers"))


def first_filled(files: list[DataFrame], text: str) -> DataFrame:
    """The rows of the first of several tables that has any, once for each text."""
    for df in files:
        if not df.isEmpty():
            return df.dropDuplicates([text])
    return files[-1]
