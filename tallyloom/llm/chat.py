"""Chat formatting with DataFrame functions only.

A record is JSON text in any of several layouts. The hash of its nested field paths, of any depth
and with kinds, selects a declarative mapping to turns of (role, text). The template marks turns with control strings; the
same strings inside roles and texts are escaped so that they can be read back exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.kit import packed, unpacked

# The template's marks.
START, END = "<|turn_start|>", "<|turn_end|>\n"
# Control strings of this and other templates, and what stands for their first character.
ESCAPES = [
    ("%", "%25"),
    ("<|", "%3C|"),
    ("<s>", "%3Cs>"),
    ("</s>", "%3C/s>"),
    ("<<SYS>>", "%3C<SYS>>"),
    ("<</SYS>>", "%3C</SYS>>"),
    ("[INST]", "%5BINST]"),
    ("[/INST]", "%5B/INST]"),
]
# Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Listed:
    """A list of turns at a path, each with a role and a content field."""

    path: str
    role: str
    content: str

    def reads(self) -> tuple[str, ...]:
        return (f"{self.path}[].{self.role}", f"{self.path}[].{self.content}")


@dataclass(frozen=True)
class Said:
    """Fields that make one turn of a role; those that are not empty are joined by a blank line."""

    role: str
    fields: tuple[str, ...]

    def reads(self) -> tuple[str, ...]:
        return self.fields


@dataclass(frozen=True)
class Layout:
    """A name, the nested field paths (with kinds) that a record of this layout has, and the parts that its turns are read from, in order."""

    name: str
    paths: tuple[str, ...]
    parts: tuple[Listed | Said, ...]

    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.paths)).encode()).hexdigest()


def listed(name: str, path: str, role: str, content: str, kind: str = ":text", more: tuple[str, ...] = (), before: tuple = (), after: tuple = ()) -> Layout:
    """A layout around one list of turns."""
    of_kind = (f"{path}[].{content}[].text:text", f"{path}[].{content}[].type:text") if kind == "parts" else (f"{path}[].{content}{kind}",)
    return Layout(name, (f"{path}[].{role}:text", *of_kind, *more), (*before, Listed(path, role, content), *after))


def fields(name: str, *parts: Said) -> Layout:
    """A layout of text fields only."""
    return Layout(name, tuple(f"{f}:text" for p in parts for f in p.fields), parts)


_SYSTEM, _COMPLETION = Said("system", ("system",)), Said("assistant", ("completion",))
LAYOUTS = [
    listed("turns", "turns", "role", "text"),
    listed("messages", "messages", "role", "content"),
    listed("sharegpt", "conversations", "from", "value"),
    fields("instruction_input", Said("user", ("instruction", "input")), Said("assistant", ("output",))),
    fields("instruction", Said("user", ("instruction",)), Said("assistant", ("output",))),
    fields("system_prompt", _SYSTEM, Said("user", ("prompt",)), Said("assistant", ("response",))),
    fields("prompt_completion", Said("user", ("prompt",)), _COMPLETION),
    fields("prompt_response", Said("user", ("prompt",)), Said("assistant", ("response",))),
    fields("question_answer", Said("user", ("question",)), Said("assistant", ("answer",))),
    listed("message_parts", "messages", "role", "content", "parts"),
    listed("message_mixed", "messages", "role", "content", ":mixed"),
    listed("data_messages", "data.messages", "role", "content"),
    listed("data_message_parts", "data.messages", "role", "content", "parts"),
    listed("system_messages", "messages", "role", "content", more=("system:text",), before=(_SYSTEM,)),
    listed("system_message_parts", "messages", "role", "content", "parts", more=("system:text",), before=(_SYSTEM,)),
    listed("prompt_turns", "prompt", "role", "content", more=("completion:text",), after=(_COMPLETION,)),
    listed("prompt_turns_completion_turns", "prompt", "role", "content", more=("completion[].role:text", "completion[].content:text"), after=(Listed("completion", "role", "content"),)),
]

#: Bytes of a record beyond which its JSON is not taken apart, which is what Spark's variants hold.
MOST_BYTES = 128 << 20
_OPTIONS = {"maxStringLen": str(2**31 - 1)}
_TURN = "struct<role: string, text: string>"
_TOKENS = "`(?:[^`]|``)*`: |[A-Za-z0-9_]+: |OBJECT<>|OBJECT<|ARRAY<|>|[A-Z]+(?:\\([0-9, ]+\\))?"


def parsed(record: Column) -> Column:
    """A JSON text as a variant; null if it is none. A record beyond MOST_BYTES is an error."""
    large = F.raise_error(F.concat(F.lit("a record of "), F.octet_length(record).cast("string"), F.lit(" bytes is too large to be taken apart"))).cast("variant")
    return F.when(F.octet_length(record) > MOST_BYTES, large).otherwise(F.from_json(record, "variant", _OPTIONS))


def field_paths(value: Column) -> Column:
    """Sorted nested field paths of a variant, of any depth, with the kind of what is there: `a:text`, `a.b:number`, `a[].b:mixed`.

    Of arrays, those that any element has; kinds are text, number, boolean, null, object (an empty
    one) and mixed (elements differ). Names of other than letters, digits and underscores are in
    backquotes. The built-in schema of a variant is walked with a stack of the paths it is inside of.
    """
    state = "struct<inside: array<string>, at: string, paths: array<string>>"
    start = F.struct(F.array().cast("array<string>").alias("inside"), F.lit("").alias("at"), F.array().cast("array<string>").alias("paths")).cast(state)
    number = lambda t: t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    kind = lambda t: F.when(t == "OBJECT<>", "object").when(t == "VARIANT", "mixed").when(t == "VOID", "null").when(t == "BOOLEAN", "boolean").when(number(t), "number").otherwise("text")

    def step(s: Column, t: Column) -> Column:
        top = F.element_at(s["inside"], -1)
        name = F.left(t, F.length(t) - 2)
        entered = F.struct(F.concat(s["inside"], F.array(s["at"])).alias("inside"), s["at"].alias("at"), s["paths"].alias("paths"))
        repeated = F.concat(s["at"], F.lit("[]"))
        each = F.struct(F.concat(s["inside"], F.array(repeated)).alias("inside"), repeated.alias("at"), s["paths"].alias("paths"))
        left = F.struct(F.slice(s["inside"], 1, F.greatest(F.size(s["inside"]) - 1, F.lit(0))).alias("inside"), s["at"].alias("at"), s["paths"].alias("paths"))
        named = F.struct(s["inside"].alias("inside"), F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name)).alias("at"), s["paths"].alias("paths"))
        leaf = F.struct(s["inside"].alias("inside"), s["at"].alias("at"), F.concat(s["paths"], F.array(F.concat(s["at"], F.lit(":"), kind(t)))).alias("paths"))
        out = F.when(t == ">", left).when(t == "OBJECT<", entered).when(t == "ARRAY<", each).when(t.endswith(": "), named).otherwise(leaf)
        return out.cast(state)

    tokens = F.regexp_extract_all(F.schema_of_variant(value), F.lit(_TOKENS), 0)
    return F.array_sort(F.aggregate(tokens, start, step, lambda s: s["paths"]))


def fingerprint(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def _role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for old, new in ROLES.items():
        out = F.when(role == old, new).otherwise(out)
    return out


def _content(value: Column) -> Column:
    """The text of a turn's content: a text as it is, a list of parts joined by blank lines, nothing of null. A part is a text or has a text; one that has none (an image) is its type in brackets."""
    get = lambda v, path, t: F.try_variant_get(v, path, t)
    one = lambda v: F.coalesce(get(v, "$.text", "string"), F.concat(F.lit("["), get(v, "$.type", "string"), F.lit("]")), v.cast("string"))
    several = get(value, "$", "array<variant>")
    return F.coalesce(F.when(several.isNotNull(), F.array_join(F.transform(several, one), "\n\n")).otherwise(one(value)), F.lit(""))


def _turns(value: Column, layout: Layout) -> Column:
    def of(part: Listed | Said) -> Column:
        if isinstance(part, Listed):
            each = F.try_variant_get(value, f"$.{part.path}", "array<variant>")
            made = F.transform(each, lambda t: F.struct(_role(F.try_variant_get(t, f"$.{part.role}", "string")).alias("role"), _content(F.try_variant_get(t, f"$.{part.content}", "variant")).alias("text")))
            return F.coalesce(made.cast(f"array<{_TURN}>"), F.array().cast(f"array<{_TURN}>"))
        read = [F.try_variant_get(value, f"$.{f}", "string") for f in part.fields]
        return F.array(F.struct(F.lit(part.role).alias("role"), F.concat_ws("\n\n", *[F.when(x != "", x) for x in read]).alias("text"))).cast(f"array<{_TURN}>")

    return F.concat(*map(of, layout.parts))


def canonical_turns(df: DataFrame, record: str = "record", layouts: list[Layout] | None = None) -> DataFrame:
    """The rows with `layout` (its name), `turns` (array of role and text), `unread` (paths that the mapping does not read) and `problem`.

    The layout is that of the record's fingerprint. Without one, it is the layout all of whose
    paths the record has, where null stands for any kind; of two such layouts the one whose paths
    include the other's. If two remain, or none, layout and turns are null, and the problem says
    which; likewise for what is no JSON object. A null record has no problem. What a record has
    besides its layout's fields is told as unread, and never part of a turn. A turn without a role
    or content has an empty one. Input columns of the new names are replaced.
    """
    layouts = LAYOUTS if layouts is None else layouts
    rows = packed(df).withColumn("record", F.col("row").getField(record)).withColumn("value", parsed(F.col("record"))).withColumn("paths", field_paths(F.col("value")))
    exact = F.lit(None).cast("string")
    for x in reversed(layouts):
        exact = F.when(F.col("print") == x.fingerprint(), x.name).otherwise(exact)
    has = lambda p: F.array_contains("paths", p) | F.array_contains("paths", p.rpartition(":")[0] + ":null")
    candidates = F.filter(F.array(*[F.when(reduce(and_, map(has, x.paths)), x.name) for x in layouts]), lambda n: n.isNotNull())
    wider = {x.name: [y.name for y in layouts if set(x.paths) < set(y.paths)] for x in layouts}
    names = F.array(*[F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, v)).cast("array<string>").alias("wider")) for k, v in wider.items()])
    widest = F.filter("candidates", lambda n: F.size(F.array_intersect(F.filter(names, lambda w: w["name"] == n)[0]["wider"], F.col("candidates"))) == 0)
    rows = rows.withColumn("print", fingerprint(F.col("paths"))).withColumn("exact", exact).withColumn("candidates", candidates).withColumn("widest", widest)
    rows = rows.withColumn("layout", F.coalesce("exact", F.when(F.size("widest") == 1, F.get("widest", 0))))
    is_object = F.try_variant_get("value", "$", "map<string, variant>").isNotNull()
    why = F.when(F.col("record").isNull() | F.col("layout").isNotNull(), F.lit(None).cast("string")).when(~F.coalesce(is_object, F.lit(False)), "no JSON object").when(F.size("widest") > 1, F.concat(F.lit("ambiguous: "), F.array_join("widest", ", "))).otherwise("no layout")
    turns, reads = F.lit(None).cast(f"array<{_TURN}>"), F.lit(None).cast("array<string>")
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, _turns(F.col("value"), x)).otherwise(turns)
        reads = F.when(F.col("layout") == x.name, F.array(*[F.lit(r) for p in x.parts for r in p.reads()])).otherwise(reads)
    rows = rows.withColumn("turns", turns).withColumn("reads", reads).withColumn("problem", why)
    read = lambda p: F.exists("reads", lambda r: p.startswith(F.concat(r, F.lit(":"))) | p.startswith(F.concat(r, F.lit("[]"))) | p.startswith(F.concat(r, F.lit("."))))
    rows = rows.withColumn("unread", F.filter("paths", lambda p: ~read(p)))
    return unpacked(rows, df, F.col("layout"), F.col("turns"), F.when(F.col("layout").isNotNull(), F.col("unread")).alias("unread"), F.col("problem"), names=("layout", "turns", "unread", "problem"))


def escaped(text: Column) -> Column:
    for old, new in ESCAPES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescaped(text: Column) -> Column:
    for old, new in reversed(ESCAPES):
        text = F.replace(text, F.lit(new), F.lit(old))
    return text


def _role_escaped(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("%0A"))


def formatted(df: DataFrame, turns: str = "turns") -> DataFrame:
    """The rows with `formatted` (the conversation as one text) and `mask` (code points of each turn's header, body and end mark, and whether its body counts in the loss: assistants' do).

    Null turns count as none and give an empty text. Input columns of these names are replaced.
    """
    rows = packed(df).withColumn("turns", F.coalesce(F.col("row").getField(turns), F.expr("cast(array() as array<struct<role: string, text: string>>)")))
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), _role_escaped(F.coalesce(t["role"], F.lit(""))), F.lit("\n")).alias("header"), escaped(F.coalesce(t["text"], F.lit(""))).alias("body"), (F.coalesce(t["role"], F.lit("")) == "assistant").alias("loss")))
    rows = rows.withColumn("parts", parts)
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["header"], p["body"], F.lit(END))), "")
    mask = F.transform("parts", lambda p: F.struct(F.length(p["header"]).alias("header"), F.length(p["body"]).alias("body"), F.lit(len(END)).alias("end"), p["loss"].alias("loss")))
    return unpacked(rows.withColumn("formatted", whole).withColumn("mask", mask), df, F.col("formatted"), F.col("mask"), names=("formatted", "mask"))


def read_back(df: DataFrame) -> DataFrame:
    """From `formatted` and `mask` alone: `turns_read` (array of role and text) and `loss_text` (all text under the mask, unescaped)."""
    end = END.replace("|", "\\|")
    pieces = F.split("formatted", end)
    rows = df.withColumn("pieces", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))))
    head = lambda p: F.substring_index(p, "\n", 1)
    role = lambda p: F.replace(F.substring(head(p), F.lit(len(START) + 1), F.length(head(p))), F.lit("%0A"), F.lit("\n"))
    rows = rows.withColumn("turns_read", F.transform("pieces", lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(F.substring(p, F.length(head(p)) + 2, F.length(p))).alias("text"))))
    under = F.transform(F.arrays_zip("pieces", "mask"), lambda z: F.when(z["mask"]["loss"], unescaped(F.substring(z["pieces"], z["mask"]["header"] + 1, z["mask"]["body"]))).otherwise(""))
    return rows.withColumn("loss_text", F.array_join(under, "")).drop("pieces")


def records_of_turns(conversations: DataFrame) -> DataFrame:
    """Rows by turn as one JSON record of layout `turns` for each conversation, in order of turn, then role and text. A null text or role is empty."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("ordered"))
    return grouped.select("conv_id", F.to_json(F.struct(F.transform("ordered", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))).alias("record"))


def op8_chat_format(conversations: DataFrame) -> DataFrame:
    """Every conversation formatted and read back; conversation -1 holds control strings."""
    spark = conversations.sparkSession
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(formatted(canonical_turns(records_of_turns(rows))))
    line = F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select("conv_id", F.size("turns_read").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_LISTS = [x.name for x in LAYOUTS if any(isinstance(p, Listed) for p in x.parts)]
_FIELDS = [x.name for x in LAYOUTS if x.name not in _LISTS]


def _records(conversations: DataFrame) -> DataFrame:
    """Conversations as records of all layouts, which the ids choose: (conv_id, turn, record). Layouts of lists get all turns (turn -1), layouts of fields each turn and the next one."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.select("conv_id", "turn", text("role"), text("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    each = lambda role, content, of=lambda t, i: t["text"]: F.transform("t", lambda t, i: F.struct(t["role"].alias(role), of(t, i).alias(content)))
    parts = lambda t, i: F.array(F.struct(F.lit("text").alias("type"), t["text"].alias("text")))
    quoted = lambda x: F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    mixed = lambda t, i: F.concat(F.lit('{"role":'), quoted(t["role"]), F.lit(',"content":'), F.when(i % 2 == 0, F.to_json(parts(t, i))).otherwise(quoted(t["text"])), F.lit("}"))
    named = lambda x: F.when(x == "user", "human").when(x == "assistant", "gpt").otherwise(x)
    brief, done = F.lit("be brief").alias("system"), F.lit("done")
    forms = {
        "turns": F.struct(each("role", "text").alias("turns")),
        "messages": F.struct(each("role", "content").alias("messages")),
        "sharegpt": F.struct(F.transform("t", lambda t: F.struct(named(t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations")),
        "message_parts": F.struct(each("role", "content", parts).alias("messages")),
        "message_mixed": F.concat(F.lit('{"messages":['), F.array_join(F.transform("t", mixed), ","), F.lit("]}")),
        "data_messages": F.struct(F.struct(each("role", "content").alias("messages")).alias("data")),
        "data_message_parts": F.struct(F.struct(each("role", "content", parts).alias("messages")).alias("data")),
        "system_messages": F.struct(brief, each("role", "content").alias("messages")),
        "system_message_parts": F.struct(brief, each("role", "content", parts).alias("messages")),
        "prompt_turns": F.struct(each("role", "content").alias("prompt"), done.alias("completion")),
        "prompt_turns_completion_turns": F.struct(each("role", "content").alias("prompt"), F.array(F.struct(F.lit("assistant").alias("role"), done.alias("content"))).alias("completion")),
        "instruction_input": F.struct(F.col("q").alias("instruction"), F.lit("as told").alias("input"), F.col("a").alias("output")),
        "instruction": F.struct(F.col("q").alias("instruction"), F.col("a").alias("output")),
        "system_prompt": F.struct(brief, F.col("q").alias("prompt"), F.col("a").alias("response")),
        "prompt_completion": F.struct(F.col("q").alias("prompt"), F.col("a").alias("completion")),
        "prompt_response": F.struct(F.col("q").alias("prompt"), F.col("a").alias("response")),
        "question_answer": F.struct(F.col("q").alias("question"), F.col("a").alias("answer")),
    }

    def chosen(names: list[str], by: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, x in enumerate(names):
            told = forms[x] if x == "message_mixed" else F.to_json(forms[x])
            out = F.when(F.pmod(by, F.lit(len(names))) == k, told).otherwise(out)
        return F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('{"id":'), F.col("conv_id").cast("string"), F.lit(","), F.substring(out, 2, 2**31 - 1))).otherwise(out)

    lists = whole.select("conv_id", F.lit(-1).cast("long").alias("turn"), chosen(_LISTS, F.col("conv_id")).alias("record"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pairs = rows.select("conv_id", "turn", F.row_number().over(order).alias("r"), F.col("text").alias("q"), F.lead("text").over(order).alias("a")).filter("a is not null")
    return lists.unionByName(pairs.select("conv_id", F.col("r").cast("long").alias("turn"), chosen(_FIELDS, F.col("conv_id") + F.col("r")).alias("record")))


def layouts_to_turns(conversations: DataFrame) -> DataFrame:
    """All turns of all conversations, cast into records of all layouts and read by fingerprint: layout, turns and their digest, and how many fields were not read."""
    read = canonical_turns(_records(conversations))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select("conv_id", "turn", "layout", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"), F.size("unread").cast("long").alias("n_unread"))


_DONE = "('prompt_turns', 'prompt_turns_completion_turns')"
LAYOUTS_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
w AS (SELECT conv_id, [{", ".join(f"'{x}'" for x in _LISTS)}][conv_id % {len(_LISTS)} + 1] AS made, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told FROM t GROUP BY conv_id),
p AS (SELECT conv_id, row_number() OVER o AS r, text AS q, lead(text) OVER o AS a FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (SELECT *, [{", ".join(f"'{x}'" for x in _FIELDS)}][(conv_id + r) % {len(_FIELDS)} + 1] AS layout FROM p WHERE a IS NOT NULL)
SELECT conv_id, -1::BIGINT AS turn, CASE WHEN made = 'message_mixed' AND n = 1 THEN 'message_parts' ELSE made END AS layout,
  n + CASE WHEN made LIKE 'system%' OR made IN {_DONE} THEN 1 ELSE 0 END AS n_turns,
  sha256(CASE WHEN made LIKE 'system%' THEN 'system' || chr(10) || 'be brief' || chr(10) ELSE '' END || told || CASE WHEN made IN {_DONE} THEN 'assistant' || chr(10) || 'done' || chr(10) ELSE '' END) AS turns_sha256,
  CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_unread FROM w
UNION ALL SELECT conv_id, r, layout, CASE layout WHEN 'system_prompt' THEN 3 ELSE 2 END,
  sha256(CASE layout WHEN 'system_prompt' THEN 'system' || chr(10) || 'be brief' || chr(10) ELSE '' END || 'user' || chr(10) || q
    || CASE WHEN layout <> 'instruction_input' THEN '' WHEN q = '' THEN 'as told' ELSE chr(10) || chr(10) || 'as told' END || chr(10) || 'assistant' || chr(10) || a || chr(10)),
  CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END FROM f
"""


OP8_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (
  SELECT *, {"replace(" * len(ESCAPES)}text{"".join(f", '{a}', '{b}')" for a, b in ESCAPES)} AS body,
    replace({"replace(" * len(ESCAPES)}role{"".join(f", '{a}', '{b}')" for a, b in ESCAPES)}, chr(10), '%0A') AS head FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START)} + length(head) + 1 + length(body) + {len(END)})::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""
