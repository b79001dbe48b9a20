"""Typed decision records: a state, named questions with options, and hard or soft targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.binding import bound
from tallyloom.functions.hashing import stable_id
from tallyloom.operators.sampling import take

OPTION = "struct<key: string, description: string>"
QUESTION = f"struct<name: string, type: string, instructions: string, options: array<{OPTION}>>"
TARGET = "struct<name: string, label: string, probs: map<string, double>>"
MEDIA = "struct<type: string, path: string, frames: array<string>, fps: double, duration: double, audio: string, start: double, mute: boolean, black: boolean>"
#: A record. Options are an array, as their order is that of the labels; the state keeps its text.
RECORD = f"id string, source string, split string, area string, state string, state_kind string, questions array<{QUESTION}>, targets array<{TARGET}>, images array<string>, media array<{MEDIA}>, meta map<string, string>"

# Other ways to say yes and no.
ALIASES = {"true": "yes", "false": "no", "1": "yes", "0": "no"}
YES_NO = [("no", "No"), ("yes", "Yes")]
#: The number of options of a choice and of levels of a score, least and most.
CHOICE_OPTIONS, SCORE_LEVELS = (2, 255), (2, 10)


def options(pairs: list[tuple[str, str]]) -> Column:
    """An option array of literals."""
    return F.array(*[F.struct(F.lit(k).alias("key"), F.lit(d).alias("description")) for k, d in pairs])


def keyed_options(descriptions: Column, prefix: str = "opt_") -> Column:
    """Options with neutral keys opt_1, opt_2, …"""
    return F.transform(descriptions, lambda d, i: F.struct(F.concat(F.lit(prefix), (i + 1).cast("string")).alias("key"), F.trim(d).alias("description")))


def question(name: str, kind: str, instructions: Column | str, opts: Column) -> Column:
    text = F.lit(instructions) if isinstance(instructions, str) else instructions
    return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), text.alias("instructions"), opts.alias("options"))


def target(name: str, label: Column | None = None, probs: Column | None = None) -> Column:
    label = F.lit(None).cast("string") if label is None else label.cast("string")
    probs = F.lit(None).cast("map<string, double>") if probs is None else probs
    return F.struct(F.lit(name).alias("name"), label.alias("label"), probs.alias("probs"))


def canonical_label(kind: Column, label: Column) -> Column:
    """yes or no for the aliases of a yes/no question, any case; other labels as they are."""
    def known(low: Column) -> Column:
        out = low
        for old, new in ALIASES.items():
            out = F.when(low == old, new).otherwise(out)
        return out

    return F.when(kind == "noul", bound(F.lower(label), known)).otherwise(label)


def labels_of(q: Column) -> Column:
    """Labels in order: keys of a choice, 0 to n - 1 of a score, no and yes."""
    return F.when(q["type"] == "noul", F.array(F.lit("no"), F.lit("yes"))).when(q["type"] == "score", F.transform(q["options"], lambda o, i: i.cast("string"))).otherwise(F.transform(q["options"], lambda o: o["key"]))


def record(df: DataFrame, *, source: str, state: Column, questions: list[Column], targets: list[Column], id_: Column | None = None, split: Column | str = "train", area: str = "", meta: dict[str, Column] | None = None) -> DataFrame:
    """One record for each row. The id comes from the content, not from a position."""
    split = F.lit(split) if isinstance(split, str) else split
    pairs = [x for k, v in (meta or {}).items() for x in (F.lit(k), v.cast("string"))]
    state_text = state.cast("string")
    kind = F.when(F.ltrim(state_text).startswith("{"), "object").when(F.ltrim(state_text).startswith("["), "array").otherwise("text")
    return df.select(
        (stable_id(F.lit(source), state_text) if id_ is None else id_).alias("id"),
        F.lit(source).alias("source"),
        split.alias("split"),
        F.lit(area).alias("area"),
        state_text.alias("state"),
        kind.alias("state_kind"),
        F.array(*questions).cast(f"array<{QUESTION}>").alias("questions"),
        F.array(*targets).cast(f"array<{TARGET}>").alias("targets"),
        F.array().cast("array<string>").alias("images"),
        F.array().cast(f"array<{MEDIA}>").alias("media"),
        (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string, string>").alias("meta"),
    )


def choice_records(df: DataFrame, *, source: str, state: Column, instructions: str, choices: list[tuple[str, str]], label: Column, name: str = "answer", **more) -> DataFrame:
    """A choice of fixed labels; rows with another label or without a state are dropped."""
    known = label.cast("string").isin([k for k, _ in choices]) & state.isNotNull()
    return record(df.filter(known), source=source, state=state, questions=[question(name, "choice", instructions, options(choices))], targets=[target(name, label)], **more)


def noul_records(df: DataFrame, *, source: str, state: Column, instructions: str, label: Column, name: str = "answer", **more) -> DataFrame:
    """A yes/no question; rows without a state or whose label means neither are dropped."""
    said = canonical_label(F.lit("noul"), label.cast("string"))
    return record(df.filter(said.isin("yes", "no") & state.isNotNull()), source=source, state=state, questions=[question(name, "noul", instructions, options(YES_NO))], targets=[target(name, said)], **more)


def score_records(df: DataFrame, *, source: str, state: Column, instructions: str, levels: list[str], level: Column, name: str = "score", **more) -> DataFrame:
    """An ordered scale; the label is the index of the level. Rows outside the scale are dropped."""
    inside = (level >= 0) & (level < len(levels)) & state.isNotNull()
    return record(df.filter(inside), source=source, state=state, questions=[question(name, "score", instructions, options([(str(i), d) for i, d in enumerate(levels)]))], targets=[target(name, level.cast("int"))], **more)


def mcq_records(df: DataFrame, *, source: str, state: Column, instructions: Column | str, choices: Column, gold: Column, name: str = "answer", **more) -> DataFrame:
    """A choice among each row's own texts, under neutral keys. Rows with fewer than two options, repeated ones, or gold outside them are dropped."""
    clean = F.transform(choices, lambda c: F.trim(c))
    good = (F.size(clean) >= 2) & (F.size(F.array_distinct(clean)) == F.size(clean)) & (gold >= 0) & (gold < F.size(clean)) & state.isNotNull()
    return record(df.filter(good), source=source, state=state, questions=[question(name, "choice", instructions, keyed_options(choices))], targets=[target(name, F.concat(F.lit("opt_"), (gold + 1).cast("string")))], **more)


def open_labels(df: DataFrame, column: str) -> list[str]:
    """The sorted distinct values of a column that is a label set: more than a choice may have is an error."""
    found = [r[0] for r in df.select(F.col(column).cast("string")).filter(F.col(column).isNotNull()).distinct().sort(column).limit(CHOICE_OPTIONS[1] + 1).collect()]
    if len(found) > CHOICE_OPTIONS[1]:
        raise ValueError(f"{column} has more than {CHOICE_OPTIONS[1]} labels")
    return found


def classification(df: DataFrame, *, source: str, state: Column, label: str, instructions: str, cap: int | None = None, seed: int = 0, **more) -> DataFrame:
    """A choice among the labels that a column holds, of at most `cap` rows in hash order."""
    choices = [(k, "") for k in open_labels(df, label)]
    if cap:
        df = take(df, cap, seed, state, F.col(label))
    return choice_records(df, source=source, state=state, instructions=instructions, choices=choices, label=F.col(label), **more)


def pair_records(df: DataFrame, *, source: str, first: Column, second: Column, names: tuple[str, str], instructions: str, choices: list[tuple[str, str]], label: Column, **more) -> DataFrame:
    """A choice about two texts, which are the two fields of a JSON state; rows with equal texts are dropped."""
    state = F.to_json(F.struct(first.alias(names[0]), second.alias(names[1])))
    return choice_records(df.filter(first != second), source=source, state=state, instructions=instructions, choices=choices, label=label, **more)


def typed_records(df: DataFrame, *, source: str, state: Column, kind: Column, instructions: Column, opts: Column, expected: Column, probs: Column | None = None, meta: dict[str, Column] | None = None, id_: Column | None = None) -> DataFrame:
    """Records of rows that tell the type of their question themselves. Of a scale, `expected` may be an index or a level's text; `probs` (a map by label or level) become the soft target."""
    levels = F.transform(opts, lambda o: F.coalesce(F.nullif(o["description"], F.lit("")), o["key"]))
    index = lambda x: F.when((kind == "score") & F.array_contains(levels, x), (F.array_position(levels, x) - 1).cast("string")).otherwise(canonical_label(kind, x))
    soft = None if probs is None else F.transform_keys(probs, lambda k, v: index(k))
    q = F.struct(F.lit("decision").alias("name"), kind.alias("type"), instructions.alias("instructions"), opts.alias("options"))
    return record(df, source=source, state=state, questions=[q], targets=[target("decision", index(expected), soft)], meta=meta, id_=id_)


def problems(records: DataFrame) -> DataFrame:
    """The records with `problem`, the first rule that they break, or null."""
    q = F.col("questions")
    bad_type = F.exists(q, lambda x: ~x["type"].isin("choice", "score", "noul") | x["type"].isNull())
    no_text = F.exists(q, lambda x: x["instructions"].isNull() | (F.trim(x["instructions"]) == ""))
    size = lambda kind, least, most: F.exists(q, lambda x: (x["type"] == kind) & ~F.size(x["options"]).between(least, most))
    twice = F.exists(q, lambda x: F.size(F.array_distinct(labels_of(x))) != F.size(labels_of(x)))
    names = F.transform(q, lambda x: x["name"])
    unnamed = F.exists("targets", lambda t: ~F.array_contains(names, t["name"]))
    of = lambda t: F.element_at(F.filter(q, lambda x: x["name"] == t["name"]), 1)
    outside = F.exists("targets", lambda t: t["label"].isNotNull() & ~F.array_contains(labels_of(of(t)), canonical_label(of(t)["type"], t["label"])))
    media = F.exists("media", lambda m: ~m["type"].isin("image", "video", "audio") | (m["path"].isNull() & (F.coalesce(F.size(m["frames"]), F.lit(0)) <= 0)))
    rules = [(F.col("state").isNull(), "no state"), (F.size(q) == 0, "no question"), (bad_type, "unknown type"), (no_text, "no instructions"), (size("choice", *CHOICE_OPTIONS), "number of options"), (size("score", *SCORE_LEVELS), "number of levels"), (twice, "repeated label"), (unnamed, "target without question"), (outside, "label not among options"), (media, "media without file")]
    out = F.lit(None).cast("string")
    for test, text in reversed(rules):
        out = F.when(test, text).otherwise(out)
    return records.withColumn("problem", out)


def valid(records: DataFrame) -> DataFrame:
    return problems(records).filter(F.col("problem").isNull()).drop("problem")


def decisions(records: DataFrame, *keep: str) -> DataFrame:
    """A row for each record and question: id, source, name, type, k, label, probs, index (of the label, null if soft), and the columns `keep` of the record."""
    # Of an inner explode Spark infers a filter on the array, which it moves below whatever makes it, so that records are made twice.
    each = records.select("id", "source", "meta", *keep, F.posexplode_outer("questions").alias("at__", "q"), "targets").filter("at__ is not null")
    t = F.get(F.filter("targets", lambda t: t["name"] == F.col("q")["name"]), 0)
    rows = each.withColumn("t", t).withColumn("labels", labels_of(F.col("q")))
    label = canonical_label(F.col("q.type"), F.col("t.label"))
    at = F.array_position("labels", label)
    return rows.select("id", "source", "meta", *keep, F.col("q.name").alias("name"), F.col("q.type").alias("type"), F.size("labels").alias("k"), "labels", label.alias("label"), F.col("t.probs").alias("probs"), F.when(at > 0, (at - 1).cast("int")).alias("index"))
