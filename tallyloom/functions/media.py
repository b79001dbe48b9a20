"""Tags of media items in texts, `<kind:N>`: the order of items, and texts with placeholders in place of tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.binding import bound

# Kinds of items in the order in which unmentioned ones come, and the form of a tag.
KINDS = ("image", "video", "audio")
TAG = rf"<({'|'.join(KINDS)}):(\d+)>"
_PLACE = "array<struct<kind: string, at: int>>"


def mentions(text: Column) -> Column:
    """(kind, at) of the tags of a text in order, repeated ones too; `at` counts from 0."""
    tags = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TAG), 0)
    kind = lambda t: F.substring_index(F.substring_index(t, ":", 1), "<", -1)
    number = lambda t: F.substring_index(F.substring_index(t, ":", -1), ">", 1).cast("int")
    return F.transform(tags, lambda t: F.struct(kind(t).alias("kind"), (number(t) - 1).alias("at"))).cast(_PLACE)


def _count(counts: dict[str, Column], kind: Column) -> Column:
    out = F.lit(0)
    for k, n in counts.items():
        out = F.when(kind == k, n).otherwise(out)
    return F.coalesce(out, F.lit(0))


def plan(text: Column, counts: dict[str, Column]) -> Column:
    """(kind, at) of all items of a record in the order in which they come: unmentioned ones in front, by kind and number, then each at its first mention. A tag beyond the record's items is an error."""
    return bound(mentions(text), lambda named: _planned(named, counts))


def _planned(named: Column, counts: dict[str, Column]) -> Column:
    """The plan of a text whose mentions are `named`, which is computed already."""
    beyond = lambda m: F.raise_error(F.concat(F.lit("the text names "), m["kind"], F.lit(" "), (m["at"] + 1).cast("string"), F.lit(" of "), _count(counts, m["kind"]).cast("string")))
    sure = F.array_distinct(F.transform(named, lambda m: F.when((m["at"] >= 0) & (m["at"] < _count(counts, m["kind"])), m).otherwise(beyond(m).cast("struct<kind: string, at: int>"))))
    every = lambda k, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit(k).alias("kind"), i.cast("int").alias("at")))).otherwise(F.array().cast(_PLACE))
    own = F.concat(*[every(k, F.coalesce(counts[k].cast("int"), F.lit(0))) for k in KINDS if k in counts])
    return bound(sure, lambda sure: F.concat(F.array_except(own.cast(_PLACE), sure), sure))


def inlined(text: Column, counts: dict[str, Column], placeholder: Callable[[Column, Column], Column]) -> Column:
    """(text, order): the text with `placeholder(kind, at)` at each item's first mention, those of unmentioned items in front, and further mentions as words, `[kind N]`; and the items in the order of their placeholders.

    Texts between tags, tags and their places go together as one array, so that each tag sees
    which ones stand before it. The text, its mentions and the plan are computed once each.
    """
    again = lambda m: F.concat(F.lit("["), m["kind"], F.lit(" "), (m["at"] + 1).cast("string"), F.lit("]"))

    def shown(named: Column, order: Column, between: Column) -> Column:
        each = F.transform(named, lambda m, i: F.when(F.array_position(named, m) == i + 1, placeholder(m["kind"], m["at"])).otherwise(again(m)))
        front = F.transform(F.slice(order, 1, F.size(order) - F.size(F.array_distinct(named))), lambda m: placeholder(m["kind"], m["at"]))
        body = bound(each, lambda each: F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(each, i), F.lit("")))))
        return F.struct(F.concat(F.array_join(front, ""), F.array_join(body, "")).alias("text"), order.alias("order"))

    def made(whole: Column) -> Column:
        return bound(mentions(whole), lambda named: bound(_planned(named, counts), lambda order: shown(named, order, F.split(whole, TAG))))

    return bound(F.coalesce(text, F.lit("")), made)
