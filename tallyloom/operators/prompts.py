"""Prompts: the text that a record becomes, with its options under symbols."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import neutralised
from tallyloom.operators.augment import shuffled

SYMBOLS = string.ascii_uppercase + string.ascii_lowercase + string.digits
#: Options that each layout can tell apart.
CAPACITY = {"marker": len(SYMBOLS), "slot": 255, "pointer": 255}
#: Keys that say nothing, whose description stands alone.
NEUTRAL = r"^(opt|option|element|choice)_\d+$"
#: Characters that an image counts for, and images that count.
IMAGE_CHARS, MOST_IMAGES = 1000, 8


#: Control tokens of each layout, which a text may not forge.
CONTROLS = {"marker": ("<decide>", "<decision>"), "slot": ("<decide>", "<option>"), "pointer": ("<decision>", "<option>", "<state>")}


def option_text(key: Column, description: Column) -> Column:
    """`key: description`; the description of a neutral key; the key without a description."""
    bare = F.coalesce(description, F.lit("")) == ""
    return F.when(bare, key).when(key.rlike(NEUTRAL), description).otherwise(F.concat(key, F.lit(": "), description))


def rendered(records: DataFrame, layout: str = "marker", seed: int = 0, controls: tuple[str, ...] | None = None) -> DataFrame:
    """The records with `prompt` and `fits`: state, then each question with its options. The slot layout shuffles options by a hash of record and question. Control tokens inside texts (those of all layouts, or the given ones) are neutralised."""
    plain = lambda x: neutralised(x, tuple(dict.fromkeys(t for c in CONTROLS.values() for t in c)) if controls is None else controls)
    symbol = lambda i: F.substring(F.lit(SYMBOLS), (i + 1).cast("int"), F.lit(1))
    mark = {"marker": lambda i: F.concat(symbol(i), F.lit(" = ")), "slot": lambda i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ")), "pointer": lambda i: F.lit("- ")}[layout]
    opts = lambda q: shuffled(q["options"], seed, F.col("id"), q["name"]) if layout == "slot" else q["options"]
    lines = lambda q: F.array_join(F.transform(opts(q), lambda o, i: F.concat(mark(i), plain(option_text(o["key"], o["description"])))), "\n")
    block = lambda q: F.concat(F.lit("### "), q["name"], F.lit(" ("), q["type"], F.lit(")\n"), plain(q["instructions"]), F.lit("\n"), lines(q), F.lit("\n"))
    text = F.concat(F.lit("## State\n"), plain(F.col("state")), F.lit("\n\n## Decision schema\n"), F.array_join(F.transform("questions", block), "\n"))
    fits = ~F.exists("questions", lambda q: F.size(q["options"]) > CAPACITY[layout])
    return records.withColumn("prompt", text).withColumn("fits", fits)


def length_proxy(state: Column, questions: Column, images: Column) -> Column:
    """Characters of state, instructions and descriptions, and a fixed number for each of the first images."""
    chars = F.aggregate(questions, F.lit(0), lambda a, q: a + F.length(q["instructions"]) + F.aggregate(q["options"], F.lit(0), lambda b, o: b + F.coalesce(F.length(o["description"]), F.lit(0))))
    return F.length(state) + chars + IMAGE_CHARS * F.least(F.size(images), F.lit(MOST_IMAGES))
