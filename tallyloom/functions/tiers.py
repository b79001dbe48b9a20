"""Price tiers of models by their public names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tiers of parts of public model names.
NAMED = {
    "claude-2": "strong",
    "claude-3-5": "strong",
    "claude-3-haiku": "fast",
    "claude-3-opus": "strong",
    "claude-3-sonnet": "strong",
    "claude-3.5": "strong",
    "claude-instant": "fast",
    "gemini-1.5-flash": "fast",
    "gemini-flash": "fast",
    "gpt-3.5": "fast",
    "gpt-4": "strong",
    "gpt-4o": "strong",
    "gpt-4o-mini": "fast",
    "o1-mini": "strong",
    "o1-preview": "strong",
}
#: Billions of parameters from which a model, and a mixture of experts in all, is in a tier.
SIZES = [("fast", 0), ("mid", 8), ("strong", 40)]
MIXTURES = [("mid", 0), ("strong", 70)]


def _tier(size: Column, table: list[tuple[str, int]]) -> Column:
    """The last tier of a table that a size reaches; null without a size."""
    reached = F.filter(F.array(*[F.struct(F.lit(least).alias("least"), F.lit(tier).alias("tier")) for tier, least in table]), lambda t: t["least"] <= size)
    return F.when(size.isNotNull(), F.try_element_at(reached, F.lit(-1))["tier"])


def sizes_in(name: Column) -> Column:
    """(experts, billions) of each `7b` and `8x7b` in a lower-case name; experts are null for plain sizes."""
    form = r"(?:(\d+)\s*x\s*)?(\d+(?:\.\d+)?)\s*b"
    found = F.regexp_extract_all(name, F.lit(form), 0)
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, form, 1).try_cast("double").alias("experts"), F.regexp_extract(x, form, 2).cast("double").alias("billions")))


def tier_of(name: Column) -> Column:
    """fast, mid or strong: by the longest known name that it holds, else by experts times size, else by its first size; null if nothing tells."""
    plain = F.replace(F.lower(name), F.lit("_"), F.lit("-"))
    known = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in sorted(NAMED.items(), key=lambda x: -len(x[0]))]), lambda x: F.contains(plain, x["k"]))
    mixed = F.try_element_at(F.filter(sizes_in(plain), lambda s: s["experts"].isNotNull()), F.lit(1))
    first = F.try_element_at(sizes_in(plain), F.lit(1))
    return F.coalesce(F.try_element_at(known, F.lit(1))["t"], _tier(mixed["experts"] * mixed["billions"], MIXTURES), _tier(first["billions"], SIZES))
