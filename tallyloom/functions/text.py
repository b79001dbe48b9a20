"""Text functions of records, prompts and answers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(x: Column) -> Column:
    """Lower case, runs of anything but letters, digits and underscores as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]+", " "))


def fingerprint(x: Column) -> Column:
    return F.sha1(normalised(x))


def without_option_prefix(x: Column) -> Column:
    """`A. text`, `(B) text` or `C: text` without the letter."""
    return F.regexp_replace(F.trim(x), r"^\(?[A-Z][.):]\s*", "")


def letter_index(x: Column, options: int) -> Column:
    """The index of an answer letter, null outside the options."""
    letter = F.upper(F.regexp_extract(F.trim(x), r"^\(?([A-Za-z])(?:[).:\s]|$)", 1))
    at = F.when(letter != "", F.ascii(letter) - 65)
    return F.when(at < options, at)


def unique_index(x: Column, options: Column) -> Column:
    """The index of the only option equal to a text but for case, outer space and option letters; null if none or several are."""
    plain = lambda c: F.lower(F.trim(without_option_prefix(c)))
    same = F.transform(options, lambda o: plain(o) == plain(x))
    return F.when(F.size(F.filter(same, lambda s: s)) == 1, F.array_position(same, True).cast("int") - 1)


def humanised(x: Column) -> Column:
    """Runs of underscores and hyphens as spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(x, "[_-]+", " ")))


def camel_split(x: Column) -> Column:
    return F.regexp_replace(x, "(?<=[a-z0-9])(?=[A-Z])", " ")


def head(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def head_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(x), r"\s+"), 1, n), " ")


def tail(x: Column, n: int, mark: str = "…") -> Column:
    """The last n characters, marked if something was cut."""
    return F.when(F.length(x) > n, F.concat(F.lit(mark), F.right(x, F.lit(n)))).otherwise(x)


def excerpt(x: Column, n: int, pieces: int = 8, gap: str = " … ") -> Column:
    """Evenly spaced pieces of a long text, n characters together."""
    size = n // pieces
    step = (F.length(x) - size) / (pieces - 1)
    parts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(x, (F.floor(step * i) + 1).cast("int"), F.lit(size)))
    return F.when(F.length(x) > n, F.array_join(parts, gap)).otherwise(x)


def html_text(x: Column) -> Column:
    """Markup without scripts, styles, comments and tags; the commonest entities as characters; white space squeezed."""
    x = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</(script|style)\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def neutralised(x: Column, controls: tuple[str, ...] = ("<decide>", "<decision>", "<option>", "<state>")) -> Column:
    """Control tokens that a text forges, with another opening bracket."""
    for c in controls:
        x = F.replace(x, F.lit(c), F.lit("‹" + c[1:]))
    return x


def transcript(turns: Column) -> Column:
    """`role: text` lines of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")


def listed_options(x: Column) -> Column:
    """Options that stand on lines `A. …`, `B. …` in order; null if the letters do not go on from A."""
    letters = F.regexp_extract_all(x, F.lit(r"(?m)^\s*\(?([A-Z])[.)]\s+(.+?)\s*$"), 1)
    texts = F.regexp_extract_all(x, F.lit(r"(?m)^\s*\(?([A-Z])[.)]\s+(.+?)\s*$"), 2)
    wanted = F.transform(F.sequence(F.lit(0), F.size(letters) - 1), lambda i: F.char(i + 65))
    return F.when((F.size(letters) >= 2) & (letters == wanted), texts)


def filled(template: Column, slots: Column) -> Column:
    """A template with each `[…]` replaced, in order, by the slots."""
    return F.aggregate(slots, template, lambda acc, s: F.regexp_replace(acc, F.lit(r"^([^\[]*)\[[^\]]*\]"), F.concat(F.lit("$1"), F.regexp_replace(s, r"([\\$])", r"\\$1"))))


def word_set(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != ""))


#: Words of labels that tell nothing, the endings that a longer word loses, and the letters beyond which it is long.
LABEL_STOP_WORDS = ["a", "an", "and", "by", "from", "in", "of", "on", "playing", "the", "to", "with"]
ENDINGS, LONG_WORD = ["ing", "s"], 4


def stem_set(x: Column) -> Column:
    """The distinct words of letters of a label without their endings, but for stop words: `dogs barking` and `dog barks` are one."""
    kept = F.filter(F.split(F.lower(x), "[^a-z]+"), lambda w: (w != "") & ~w.isin(LABEL_STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.when(F.length(w) > LONG_WORD, F.regexp_replace(w, f"({'|'.join(ENDINGS)})$", "")).otherwise(w)))


def jaccard(a: Column, b: Column) -> Column:
    """The similarity of two arrays as sets, 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def parsed_number(x: Column) -> Column:
    """The value of `1,234.5`, `$3`, `12%` or `(7)` (negative); null if there is none."""
    text = F.trim(x)
    value = F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")
    negative = text.startswith("(") | text.contains("-")
    return F.when(text.rlike(r"^\(?-?\$?\s*-?[0-9,]*\.?[0-9]+\)?\s*%?$"), F.when(negative, -value).otherwise(value))


def seconds(x: Column) -> Column:
    """`HH:MM:SS.s` or `MM:SS` in seconds."""
    return F.aggregate(F.split(x, ":"), F.lit(0.0), lambda acc, p: acc * 60 + p.try_cast("double"))


def bucketised(x: Column, edges: list[float]) -> Column:
    """The number of edges not above a value."""
    return sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))


def even_picks(n: Column, m: int) -> Column:
    """m indices spread evenly over 0 to n - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.floor((i + 0.5) * n / m).cast("int"))


def frame_count(duration: Column, fps: float, most: int) -> Column:
    """Frames of a clip: its duration times the rate, rounded half to even, from 2 to `most`."""
    return F.greatest(F.lit(2), F.least(F.lit(most), F.bround(duration * fps).cast("int")))


def kept_share(kept: Column, lines: Column) -> Column:
    """keep from 85 % of the lines, drop up to 5 %, truncate between; null without lines."""
    share = kept / lines
    return F.when(lines > 0, F.when(share >= 0.85, "keep").when(share <= 0.05, "drop").otherwise("truncate"))


#: Where graders put a score, in order; see `number_at`.
GRADE_PATHS = ("judge_response.correctness_score", "score")


def value_at(x: Column, path: str) -> Column:
    """What a JSON text holds at a path of names and `[number]` steps, as text. A step also goes into a text that is JSON itself, at any depth. Null where there is nothing."""
    for step in re.findall(r"\[\d+\]|[^.\[\]]+", path):
        inner = F.get_json_object(x, f"${step}" if step.startswith("[") else f"$['{step}']")
        x = F.coalesce(inner, F.get_json_object(F.get_json_object(x, "$"), f"${step}" if step.startswith("[") else f"$['{step}']"))
    return x


def number_at(x: Column, *paths: str) -> Column:
    """The number at the first of the paths that has one, as a number or as its text; true and false are 1 and 0, and whatever else a path holds is passed over."""
    read = lambda v: F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(F.when(v.rlike(r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"), v.try_cast("double")))
    return F.coalesce(*[read(value_at(x, p)) for p in paths])


def json_score(x: Column, paths: tuple[str, ...] = GRADE_PATHS) -> Column:
    """A grader's score; see `number_at`."""
    return number_at(x, *paths)


def media_tags(x: Column, kind: str) -> Column:
    """The numbers of `<kind:N>` tags in order of appearance."""
    return F.transform(F.regexp_extract_all(x, F.lit(f"<{kind}:(\\d+)>"), 1), lambda n: n.cast("int"))


def without_tags(x: Column, kind: str) -> Column:
    return F.regexp_replace(x, f"<{kind}:\\d+>", "")


def banded(x: Column, edges: list[float], names: list[str]) -> Column:
    """The name of the band between ascending edges that a value is in; there is one more name than edges."""
    out = F.lit(names[0])
    for edge, name in zip(edges, names[1:], strict=True):
        out = F.when(x >= edge, name).otherwise(out)
    return F.when(x.isNotNull(), out)


#: Attributes that tell what a page element is, in order, and the characters that one may take.
ELEMENT_KEYS = ("aria_label", "aria-label", "title", "alt", "placeholder", "name", "value", "type", "role", "id", "class")
ATTRIBUTE_CHARS = 40


def element_text(attributes: Column, keys: tuple[str, ...] = ELEMENT_KEYS, tag: Column | None = None, named: bool = False, most: int | None = None, each: int = ATTRIBUTE_CHARS) -> Column:
    """A page element in words: its tag, if given, and the values of some attributes of a JSON object, in order, each once and cut to `each` characters, with `key=` if named; cut to `most` characters."""
    values = F.array(*[F.struct(F.lit(k).alias("k"), F.left(F.get_json_object(attributes, f"$['{k}']"), F.lit(each)).alias("v")) for k in keys])
    kept = F.transform(F.filter(values, lambda x: F.trim(x["v"]) != ""), lambda x: F.concat(x["k"], F.lit("="), x["v"]) if named else x["v"])
    out = F.array_join(F.array_distinct(kept), " | ")
    if tag is not None:
        out = F.when(out == "", F.concat(F.lit("<"), tag, F.lit(">"))).otherwise(F.concat(F.lit("<"), tag, F.lit("> "), out))
    return out if most is None else F.when(F.length(out) > most, F.concat(F.left(out, F.lit(most - 1)), F.lit("…"))).otherwise(out)


def sentiment_level(x: Column) -> Column:
    """A sentiment from -1 to 1 as one of five levels, 0 to 4: round halves to even."""
    return F.greatest(F.lit(0), F.least(F.lit(4), F.bround((x + 1) * 2).cast("int")))


def opinion_score(x: Column) -> Column:
    """A mean opinion score from 0 to 100 as one of five levels, 0 to 4."""
    return F.greatest(F.lit(0), F.least(F.lit(4), F.floor(x / 20).cast("int")))


def sign_band(x: Column, around: float = 0.1) -> Column:
    """negative, neutral or positive; values within `around` of 0 are neutral."""
    return F.when(x < -around, "negative").when(x > around, "positive").when(x.isNotNull(), "neutral")


def json_type(x: Column) -> Column:
    """object, array, text, number, boolean or null of a JSON text; null if it is none."""
    kind = F.schema_of_variant(F.try_parse_json(x))
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "text").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")


def clipped(start: Column, end: Column, low: Column, high: Column) -> Column:
    """The part of an interval inside a window, as (start, end), or null."""
    a, b = F.greatest(start, low), F.least(end, high)
    return F.when(a < b, F.struct(a.alias("start"), b.alias("end")))


def cloze(x: Column, mark: str, answers: Column, at: Column, gap: str = "____") -> Column:
    """A text whose marks (a pattern) are filled with answers in order, but for number `at` (from 0), which becomes a gap; null if marks and answers differ in number."""
    pieces = F.split(x, mark)
    fill = lambda i: F.when(i == at, gap).otherwise(F.get(answers, i))
    parts = F.transform(pieces, lambda p, i: F.when(i < F.size(pieces) - 1, F.concat(p, fill(i))).otherwise(p))
    return F.when(F.size(pieces) - 1 == F.size(answers), F.array_join(parts, ""))


def constraint_text(name: Column, arguments: Column) -> Column:
    """A constraint `group:some_rule` in words, with its arguments (a JSON object) by name; null, empty and [] are left out, text is quoted."""
    items = F.map_entries(F.from_json(arguments, "map<string, string>"))
    kept = F.filter(items, lambda e: e["value"].isNotNull() & ~e["value"].isin("", "[]", "null"))
    shown = lambda v: F.when(v.try_cast("double").isNotNull() | v.startswith("[") | v.isin("true", "false"), v).otherwise(F.concat(F.lit("'"), v, F.lit("'")))
    told = F.transform(F.array_sort(kept), lambda e: F.concat(e["key"], F.lit("="), shown(e["value"])))
    words = F.replace(F.replace(name, F.lit(":"), F.lit(" / ")), F.lit("_"), F.lit(" "))
    return F.when(F.size(told) > 0, F.concat(words, F.lit(" ("), F.array_join(told, ", "), F.lit(")"))).otherwise(words)
