"""Records as lines of JSON objects: questions, criteria and targets are objects by name, whose order counts.

Objects are read as maps, which Spark fills in the order of the text, and become arrays of entries;
written lines are put together from the arrays, so that no step sorts names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.binding import bound
from tallyloom.functions.text import json_type
from tallyloom.operators.records import MEDIA, OPTION, QUESTION, TARGET, canonical_label, labels_of

_ASKED = "struct<type: string, instructions: string, criteria: string>"
_LINE = f"id string, state string, questions map<string, {_ASKED}>, targets map<string, string>, images array<string>, media array<{MEDIA}>, meta map<string, string>, category string, family string, split string, `group` string"
#: JSON parsers stop at texts of 20 million characters unless told.
_ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}
_SAID = "label string, probs map<string, double>, probabilities map<string, double>"
#: Fields beside meta that are meta of a record which lacks them there.
BESIDE = ("category", "family", "split", "group")
#: Columns of a record that lines hold under meta.
AS_META = ("source", "split", "area")
#: What the answers of a yes/no question mean without criteria, and the names of its criteria.
PLAIN = {"no": "no", "yes": "yes"}
NAMED = {"no": "false", "yes": "true"}


def _options(asked: Column) -> Column:
    """The options of one question (type, instructions, criteria) in order."""
    named = F.from_json(asked["criteria"], "map<string, string>", _ANY_LENGTH)
    text = lambda x: F.coalesce(x, F.lit(""))
    choice = F.transform(F.map_entries(named), lambda e: F.struct(e["key"].alias("key"), text(e["value"]).alias("description")))
    levels = F.transform(F.from_json(asked["criteria"], "array<string>", _ANY_LENGTH), lambda d, i: F.struct(i.cast("string").alias("key"), text(d).alias("description")))
    meant = lambda told, k: F.when(told[NAMED[k]] != "", told[NAMED[k]]).otherwise(PLAIN[k])
    answers = bound(F.when(asked["criteria"].isNotNull(), named), lambda told: F.array(*[F.struct(F.lit(k).alias("key"), meant(told, k).alias("description")) for k in PLAIN]))
    made = F.when(asked["type"] == "choice", choice).when(asked["type"] == "score", levels).when(asked["type"] == "noul", answers)
    return F.coalesce(made, F.array().cast(f"array<{OPTION}>"))


def _target(name: Column, raw: Column, q: Column) -> Column:
    """A target from its JSON: an object with a label and probabilities, or the label alone. A text that is one of the question's labels is a label, whatever it looks like."""
    some = lambda m: F.when(F.size(m) > 0, m)
    pair = lambda label, probs: F.struct(label.alias("label"), probs.cast("map<string, double>").alias("probs"))
    own = lambda k: canonical_label(q["type"], k)
    told = lambda said: pair(said["label"], F.transform_keys(F.coalesce(some(said["probs"]), some(said["probabilities"])), lambda k, _: own(k)))
    whole = raw.startswith("{") & ~F.coalesce(F.array_contains(labels_of(q), raw), F.lit(False))
    either = F.when(whole, bound(F.from_json(raw, _SAID), told)).otherwise(pair(raw, F.lit(None)))
    return bound(either, lambda x: F.struct(name.alias("name"), own(x["label"]).alias("label"), x["probs"].alias("probs")))


def records_of(lines: DataFrame, line: str = "value") -> DataFrame:
    """Records of a column of JSON lines. Blank and null lines are skipped; a line that is no JSON object, or has no id, is an error.

    Labels of yes/no questions become yes or no. A state that is no text keeps its order of keys and
    is written without spaces; a lacking state is empty, and null stays null. Values under meta are
    texts, but for source, split and area, which are columns.
    """
    full = lines.filter(F.trim(line) != "").select(F.col(line).alias("line"))
    rows = full.withColumn("r", F.from_json("line", _LINE, _ANY_LENGTH | {"mode": "FAILFAST"})).withColumn("v", F.from_json("line", "state variant", _ANY_LENGTH)["state"])
    kind = json_type(F.to_json("v"))
    begins = F.substring(F.ltrim("r.state"), 1, 1)
    guess = F.when(begins == "{", "object").when(begins == "[", "array").otherwise("text")  # beyond what a variant holds
    lacking = F.raise_error(F.concat(F.lit("a record without an id: "), F.left("line", F.lit(200)))).cast("string")
    named = F.map_filter(F.create_map(*[x for k in BESIDE for x in (F.lit(k), F.col("r")[k])]), lambda k, v: v.isNotNull())
    meta = F.coalesce("r.meta", F.create_map().cast("map<string, string>"))
    rows = rows.withColumn("meta", F.map_concat(meta, F.map_filter(named, lambda k, _: ~F.map_contains_key(meta, k))))
    asked = F.transform(F.map_entries("r.questions"), lambda e: F.struct(e["key"].alias("name"), e["value"]["type"].alias("type"), F.coalesce(e["value"]["instructions"], F.lit("")).alias("instructions"), _options(e["value"]).alias("options")))
    rows = rows.withColumn("questions", F.coalesce(asked, F.array().cast(f"array<{QUESTION}>")))
    of = lambda name: F.get(F.filter("questions", lambda q: q["name"] == name), 0)
    targets = F.transform(F.map_entries("r.targets"), lambda e: bound(of(e["key"]), lambda q: _target(e["key"], e["value"], q)))
    none = lambda x, t: F.coalesce(x, F.array().cast(f"array<{t}>"))
    return rows.select(
        F.coalesce("r.id", lacking).alias("id"),
        *[F.element_at("meta", k).alias(k) for k in AS_META],
        F.when(F.col("r.state").isNull() & F.col("v").isNull(), "").otherwise(F.col("r.state")).alias("state"),
        F.when(F.col("r.state").isNull(), F.when(F.col("v").isNull(), "text").otherwise("null")).otherwise(F.coalesce(kind, guess)).alias("state_kind"),
        "questions",
        none(targets, TARGET).alias("targets"),
        none(F.col("r.images"), "string").alias("images"),
        none(F.col("r.media"), MEDIA).alias("media"),
        F.map_filter("meta", lambda k, _: ~k.isin(*AS_META)).alias("meta"),
    )


def _quoted(x: Column) -> Column:
    """A text as JSON, quotes and all; null as null."""
    told = F.to_json(F.array(x), {"ignoreNullFields": "false"})
    return F.substring(told, F.lit(2), F.length(told) - 2)


def _object(pairs: Column) -> Column:
    """An object of texts `"name":value`."""
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _pair(name: Column | str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}"') if isinstance(name, str) else _quoted(name), F.lit(":"), value)


def _criteria(q: Column) -> Column:
    """The criteria of one question as JSON, or null for a yes/no question with the plain meanings."""
    by_key = _object(F.transform(q["options"], lambda o: _pair(o["key"], _quoted(o["description"]))))
    levels = F.concat(F.lit("["), F.array_join(F.transform(q["options"], lambda o: _quoted(o["description"])), ","), F.lit("]"))
    odd = F.filter(q["options"], lambda o: ~F.concat_ws("=", o["key"], o["description"]).isin([f"{k}={v}" for k, v in PLAIN.items()]))
    name = lambda o: F.when(o["key"] == "yes", NAMED["yes"]).otherwise(NAMED["no"])
    meant = F.when(F.size(odd) > 0, _object(F.transform(odd, lambda o: _pair(name(o), _quoted(o["description"])))))
    return F.when(q["type"] == "choice", by_key).when(q["type"] == "score", levels).otherwise(meant)


def _some(*parts: Column) -> Column:
    """An array of texts without nulls."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def lines_of(records: DataFrame) -> DataFrame:
    """Records as JSON lines (value), in the form that `records_of` reads: reading gives the same records again. What is empty is left out."""
    raw = F.col("state_kind").isin("object", "array", "number", "boolean") & F.try_parse_json("state").isNotNull()
    state = F.when(F.col("state").isNull(), "null").otherwise(F.when(raw, F.col("state")).otherwise(_quoted(F.col("state"))))
    asked = F.transform("questions", lambda q: _pair(q["name"], _object(_some(_pair("type", _quoted(q["type"])), _pair("instructions", _quoted(F.coalesce(q["instructions"], F.lit("")))), _pair("criteria", _criteria(q))))))
    said = F.transform("targets", lambda t: _pair(t["name"], _object(_some(_pair("label", F.when(t["label"].isNotNull(), _quoted(t["label"]))), _pair("probs", F.to_json(t["probs"]))))))
    columns = F.map_filter(F.create_map(*[x for k in AS_META for x in (F.lit(k), F.col(k))]), lambda _, v: v.isNotNull())
    meta = F.map_concat(columns, F.map_filter("meta", lambda k, _: ~k.isin(*AS_META)))
    full = lambda x, told: F.when(F.size(x) > 0, told)
    parts = _some(
        _pair("id", _quoted(F.col("id"))),
        _pair("state", state),
        _pair("questions", _object(asked)),
        _pair("targets", full("targets", _object(said))),
        _pair("images", full("images", F.to_json("images"))),
        _pair("media", full("media", F.to_json("media"))),
        _pair("meta", full(meta, F.to_json(meta, {"ignoreNullFields": "false"}))),
    )
    return records.select(_object(parts).alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of files of JSON lines; see `records_of`."""
    return records_of(spark.read.text(path))


def write_lines(records: DataFrame, path: str) -> int:
    """Write records as files of JSON lines and tell how many; the folder appears whole or not at all."""
    from pyspark.sql import Observation

    seen = Observation()
    lines_of(records.observe(seen, F.count(F.lit(1)).alias("n"))).write.mode("overwrite").text(path)
    return seen.get["n"]


def canonical_json(x: Column) -> Column:
    """A JSON text with the keys of objects sorted at every depth, numbers by value and no spaces, so that texts of equal JSON are equal. What is no JSON, names a key twice, or is larger than a variant may be, stays as it is without outer spaces."""
    return F.coalesce(F.to_json(F.try_parse_json(x)), F.trim(x))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files: lines are numbered from 0 within each file, blank ones included.

    Spark reads a file in blocks by several tasks. Lines are numbered inside their block, and the
    lines of the blocks before are added, so that no file is read by one task.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    held = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("held"))
    before = held.select("file", "block", F.coalesce(F.sum("held").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    return rows.withColumn("inside", inside).join(before, ["file", "block"]).select("file", (F.col("before") + F.col("inside")).alias("line"), "value")


def first_of_states(rows: DataFrame, state: Column, *precedence: str) -> DataFrame:
    """Of rows whose state is the same JSON, the first by the columns of precedence (such as file and line). Whole states are told apart by SHA-256; each task keeps its own first rows before they meet. Null states are one."""
    key = F.sha2(F.coalesce(canonical_json(state), F.lit("null")), 256)
    order = F.struct(*precedence)
    kept = rows.withColumn("state_key", key).groupBy("state_key").agg(F.min_by(F.struct(*rows.columns), order).alias("row"), F.count(F.lit(1)).alias("times"))
    return kept.select("row.*", "times")
