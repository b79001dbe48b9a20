"""Metrics of scored decisions: (id, name, logits, target or soft, meta)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import scores as S

#: The temperatures that calibration tries, evenly spaced in the logarithm.
GRID_LOW, GRID_HIGH, GRID_SIZE = 0.25, 8.0, 161
#: Decisions that a question type needs for a temperature of its own.
LEAST_BY_TYPE = 50


def scored(df: DataFrame, temperature: Column | float = 1.0) -> DataFrame:
    """The decisions with probs, pred, conf, k and hit (null without a target)."""
    rows = df.withColumn("probs", S.softmax(F.col("logits"), temperature)).withColumn("k", F.size("logits"))
    rows = rows.withColumn("pred", S.argmax(F.col("logits"))).withColumn("conf", F.array_max("probs"))
    return rows.withColumn("hit", F.when(F.col("target").isNotNull(), F.col("pred") == F.col("target")))


def _ece(rows: DataFrame, conf: Column, right: Column) -> DataFrame:
    """One row: the mean gap of confidence and accuracy over ten bins, weighted by decisions."""
    bins = rows.groupBy(S.confidence_bin(conf).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.avg(right).alias("acc"), F.avg(conf).alias("conf"))
    return bins.agg((F.sum(F.col("c") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("c")).alias("ece"))


def summary(df: DataFrame, temperature: Column | float = 1.0) -> DataFrame:
    """One row: n, accuracy, chance, skill, ece, brier, nll of the decisions with a target."""
    rows = scored(df, temperature).filter(F.col("target").isNotNull())
    hit = F.col("hit").cast("double")
    one = F.col("probs"), S.one_hot(F.col("target"), F.col("k"))
    flat = rows.select(hit.alias("hit"), "conf", (1 / F.col("k")).alias("chance"), S.brier(*one).alias("brier"), S.nll(F.col("probs"), F.col("target")).alias("nll"))
    total = flat.agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"), F.avg("chance").alias("chance"), F.avg("brier").alias("brier"), F.avg("nll").alias("nll"))
    skill = F.greatest(F.lit(0.0), (F.col("accuracy") - F.col("chance")) / (1 - F.col("chance")))
    return total.crossJoin(_ece(flat, F.col("conf"), F.col("hit"))).withColumn("skill", skill)  # one row each


def macro_f1(df: DataFrame) -> DataFrame:
    """One row: the mean over question names of the mean F1 over classes that occur as gold or prediction."""
    rows = scored(df).filter(F.col("target").isNotNull())
    role = lambda c, gold, pred: F.struct(c.alias("class"), F.lit(gold).alias("gold"), F.lit(pred).alias("pred"))
    each = rows.select("name", (F.col("target") == F.col("pred")).alias("same"), F.explode(F.array(role(F.col("target"), 1, 0), role(F.col("pred"), 0, 1))).alias("r"))
    by = each.groupBy("name", "r.class").agg(F.sum("r.gold").alias("gold"), F.sum("r.pred").alias("pred"), F.sum(F.when(F.col("same"), F.col("r.gold")).otherwise(0)).alias("tp"))
    f1 = by.withColumn("f1", 2 * F.col("tp") / (F.col("gold") + F.col("pred")))
    return f1.groupBy("name").agg(F.avg("f1").alias("f1")).agg(F.avg("f1").alias("macro_f1"))


def case_exact(df: DataFrame) -> DataFrame:
    """One row: the share of records all of whose decisions are right."""
    rows = scored(df).filter(F.col("target").isNotNull())
    return rows.groupBy("id").agg(F.bool_and("hit").alias("all")).agg(F.avg(F.col("all").cast("double")).alias("case_exact"))


def soft_summary(df: DataFrame, temperature: Column | float = 1.0) -> DataFrame:
    """One row for soft targets: n, tvd, expected_brier, expected_ece (without confidence 0), score = 1 - tvd."""
    rows = df.withColumn("probs", S.softmax(F.col("logits"), temperature)).filter(F.col("soft").isNotNull())
    at = S.argmax(F.col("probs"))
    q = lambda s, i: F.element_at(s, i + 1)
    # The expected Brier score under q: sum of p² - 2 p q + q.
    brier = F.aggregate(F.zip_with("probs", "soft", lambda p, s: p * p - 2 * p * s + s), F.lit(0.0), lambda a, x: a + x)
    flat = rows.select(S.total_variation(F.col("probs"), F.col("soft")).alias("tvd"), brier.alias("b"), F.array_max("probs").alias("conf"), q(F.col("soft"), at).alias("acc"))
    total = flat.agg(F.count(F.lit(1)).alias("n"), F.avg("tvd").alias("tvd"), F.avg("b").alias("expected_brier"))
    return total.crossJoin(_ece(flat.filter("conf > 0"), F.col("conf"), F.col("acc")).withColumnRenamed("ece", "expected_ece")).withColumn("score", 1 - F.col("tvd"))  # one row each


def breakdown(df: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """(key, value, n, accuracy) by meta key; keys with one value go, and keys that repeat an earlier key's table."""
    rows = scored(df).filter(F.col("target").isNotNull())
    pairs = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(k).alias("key"), F.try_element_at("meta", F.lit(k)).alias("value")) for i, k in enumerate(keys[:most])])
    each = rows.select("hit", F.explode(pairs).alias("p")).filter("p.value is not null")
    # A decision counts for each value of a list (a JSON array), once for each distinct one.
    listed = F.when(F.ltrim(F.col("p.value")).startswith("["), F.from_json("p.value", "array<string>"))
    values = F.array_distinct(F.coalesce(listed, F.array("p.value")))
    each = each.select("hit", "p.at", "p.key", F.explode(values).alias("value")).select("hit", F.struct("at", "key", "value").alias("m")).filter("m.value is not null")
    table = each.groupBy("m.at", "m.key", "m.value").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"), F.sum(F.col("hit").cast("int")).alias("right"))
    # Two keys tell the same if the counts and hits of their values do.
    told = table.groupBy("at", "key").agg(F.count(F.lit(1)).alias("values"), F.array_sort(F.collect_list(F.struct("value", "n", "right"))).alias("told"))
    first = told.filter("values >= 2").withColumn("r", F.row_number().over(Window.partitionBy("told").orderBy("at"))).filter("r = 1").select("key")
    return table.join(first, "key", "left_semi").select("key", "value", "n", "accuracy")


def coverage(benchmarks: DataFrame, by_benchmark: DataFrame) -> DataFrame:
    """benchmarks (benchmark, metric, expected) with coverage, score (accuracy times coverage) and score_strict (any metric times coverage); no score without a decision."""
    rows = benchmarks.join(by_benchmark, "benchmark", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("coverage", F.when(F.col("expected") > 0, F.col("n") / F.col("expected")))
    value = F.when(F.col("n") > 0, F.col("value"))
    return rows.withColumn("score", F.when(F.col("metric") == "accuracy", value * F.col("coverage")).otherwise(value)).withColumn("score_strict", F.coalesce(value * F.col("coverage"), F.lit(0.0)))


def grid() -> list[float]:
    low, high = math.log10(GRID_LOW), math.log10(GRID_HIGH)
    return [10 ** (low + i * (high - low) / (GRID_SIZE - 1)) for i in range(GRID_SIZE)]


def fitted_temperature(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """The grid's temperature of the least mean NLL (the first of equals): (groups, step, temperature, nll, n).

    Each Arrow batch gives the sums of its decisions for all temperatures by group, and Spark adds
    them up: (groups, temperatures) rows are shuffled for a batch, no decision is.
    """
    by, values = groups or [], np.array(grid())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z, first = _flat(batch.column("z__"))
            sizes = np.diff(first)
            z = z - np.repeat(np.maximum.reduceat(z, first[:-1]), sizes)
            gold = z[first[:-1] + np.asarray(batch.column("t__"))]
            nll = np.stack([np.log(np.add.reduceat(np.exp(z / t), first[:-1])) - gold / t for t in values])
            code = pa.Table.from_batches([batch]).select(by).to_pandas().groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(batch.num_rows, np.int64)
            kinds, at, n = np.unique(code, return_index=True, return_counts=True)
            total = np.stack([np.bincount(code, row, len(kinds)) for row in nll], axis=1)
            held = [batch.column(c).take(pa.array(np.repeat(at, len(values)))) for c in by]
            yield pa.RecordBatch.from_arrays([*held, pa.array(np.tile(np.arange(len(values), dtype=np.int32), len(kinds))), pa.array(total.reshape(-1)), pa.array(np.repeat(n, len(values)))], [*by, "step", "total", "n"])

    t = F.col("target")
    rows = df.filter(t.isNotNull() & (t >= 0) & (t < F.size("logits"))).select(*by, F.col("logits").cast("array<double>").alias("z__"), t.cast("long").alias("t__"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(by)])
    parts = rows.mapInArrow(sums, kinds + "step int, total double, n long")
    means = parts.groupBy(*by, "step").agg((F.sum("total") / F.sum("n")).alias("nll"), F.sum("n").alias("n"))
    best = means.groupBy(*by).agg(F.min(F.struct("nll", "step", "n")).alias("b")).filter("b is not null")
    told = F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("b.step") + 1)
    return best.select(*by, "b.step", told.alias("temperature"), "b.nll", "b.n")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array column one after the other, and where each row's begin."""
    bounds = np.asarray(lists.offsets)
    return np.asarray(lists.values)[bounds[0] : bounds[-1]], bounds - bounds[0]


def temperatures_by_type(df: DataFrame, kind: str = "type") -> dict[str, float]:
    """Temperatures of the types with enough decisions, and of all as default (a few rows come to the driver)."""
    out = {r[kind]: r.temperature for r in fitted_temperature(df, [kind]).collect() if r.n >= LEAST_BY_TYPE}
    overall = fitted_temperature(df).first()
    return out | ({"default": overall.temperature} if overall else {})


def losses(df: DataFrame, loss: str = "ce", rps_weight: float = 0.0) -> DataFrame:
    """One row: the mean loss over decisions with a target (index or soft), plus the weighted ranked probability score of score questions; 0 without any."""
    q = F.coalesce(F.col("soft"), F.when(F.col("target").isNotNull(), S.one_hot(F.col("target"), F.size("logits"))))
    rows = df.withColumn("p", S.softmax(F.col("logits"))).withColumn("q", q).filter(F.col("q").isNotNull())
    each = S.LOSSES[loss](F.col("p"), F.col("q")) + F.when(F.col("type") == "score", rps_weight * S.ranked_probability(F.col("p"), F.col("q"))).otherwise(0.0)
    return rows.agg(F.coalesce(F.avg(each), F.lit(0.0)).alias("loss"))


def answers(df: DataFrame) -> DataFrame:
    """Decisions (type, labels, probs) as typed answers: label, value (expected level, or the probability of yes), confidence."""
    top = F.element_at("labels", S.argmax(F.col("probs")) + 1)
    value = F.when(F.col("type") == "score", S.expected_level(F.col("probs"))).when(F.col("type") == "noul", F.element_at("probs", 2))
    return df.withColumn("answer", top).withColumn("value", value).withColumn("confidence", S.confidence(F.col("probs")))


def leaderboard(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Rows by model, a column for each benchmark in the given order, and the mean of those present."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.first(value))
    present = F.filter(F.array(*[F.col(c) for c in columns]), lambda x: x.isNotNull())
    return wide.withColumn("average", F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))
