"""A batch scorer: requests in, typed answers or errors out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import scores as S
from tallyloom.operators.metrics import answers
from tallyloom.operators.prompts import CAPACITY
from tallyloom.operators.records import labels_of, problems

#: Status of a good request, of an invalid one, and of one that is too large.
OK, INVALID, TOO_LARGE = 200, 422, 413


def checked(requests: DataFrame, layout: str = "marker", most_chars: int = 100_000) -> DataFrame:
    """Records with `status` and `error`."""
    rows = problems(requests.withColumn("targets", F.slice("targets", 1, 0)))
    large = (F.length("state") > most_chars) | F.exists("questions", lambda q: F.size(q["options"]) > CAPACITY[layout])
    status = F.when(F.col("problem").isNotNull(), INVALID).when(large, TOO_LARGE).otherwise(OK)
    return rows.withColumn("status", status).withColumn("error", F.coalesce("problem", F.when(large, "too large"))).drop("problem")


def scored(requests: DataFrame, logits: DataFrame, temperatures: dict[str, float] | float | None = None) -> DataFrame:
    """(id, name, type, answer, value, confidence) of every question of good requests; logits is (id, name, logits)."""
    good = checked(requests).filter(F.col("status") == OK)
    each = good.select("id", F.explode("questions").alias("q")).select("id", F.col("q.name").alias("name"), F.col("q.type").alias("type"), labels_of(F.col("q")).alias("labels"))
    rows = each.join(logits, ["id", "name"])
    probs = S.softmax(F.slice("logits", 1, F.size("labels")), S.temperature_of(F.col("type"), temperatures))
    return answers(rows.withColumn("probs", probs)).select("id", "name", "type", "answer", "value", "confidence")
