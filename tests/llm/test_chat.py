import hashlib
import json

from pyspark.sql import functions as F

from tallyloom.llm import chat


def test_layouts(spark):
    records = [
        ("messages", {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}),
        ("sharegpt", {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}),
        ("instruction", {"instruction": "a", "output": "b"}),
        ("prompt_completion", {"prompt": "a", "completion": "b"}),
        ("question_answer", {"question": "a", "answer": "b", "extra": {"x": 1}}),
        ("turns", {"turns": [{"text": "a", "role": "user"}, {"role": "assistant", "text": "b"}]}),
        ("system_prompt", {"system": "", "prompt": "a", "response": "b"}),
    ]
    df = spark.createDataFrame([(n, json.dumps(r), "clash") for n, r in records], "name string, record string, layout string")
    out = {r.name: r for r in chat.canonical_turns(df).collect()}
    for name, _ in records:
        assert out[name].layout == name
        assert [(t.role, t.text) for t in out[name].turns if t.text] == [("user", "a"), ("assistant", "b")]
        assert out[name].problem is None and out[name].unread == (["extra.x:number"] if name == "question_answer" else [])
    both = json.dumps({"instruction": "do", "input": "this", "output": "ok"})
    odd = spark.createDataFrame([(both,), ("[]",), ("no json",), (None,), ('{"x": 1}',), ('{"turns": []}',)], "record string")
    got = [(r.layout, r.turns) for r in chat.canonical_turns(odd).collect()]
    assert got[0][1][0].text == "do\n\nthis" and all(g == (None, None) for g in got[1:])


def read(spark, *records):
    df = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "i int, record string")
    return [r for r in sorted(chat.canonical_turns(df).collect(), key=lambda r: r.i)]


def told(r):
    return r.turns and [(t.role, t.text) for t in r.turns]


def test_paths_of_any_depth_and_all_elements(spark):
    records = [
        {"messages": [{"role": "user"}, {"role": "assistant", "content": "b"}]},
        {"messages": [1, {"role": "a", "content": "b", "x": 0}], "n": {"y": 1.5, "n": None}, "z": [1, 2], "t": True},
        {"a": {"b": [[{"c d": {"e": [{"f.g": []}]}}]]}, "o": {}, "m": [1, "x"], "`": "STRING: ", "BIGINT": {"OBJECT": "ARRAY<"}},
        {},
        [{"x": 1}],
        "text",
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, record string")
    got = {r.i: r.p for r in df.select("i", chat.field_paths(chat.parsed(df.record)).alias("p")).collect()}
    assert got[0] == ["messages[].content:text", "messages[].role:text"]
    assert got[1] == ["messages[]:mixed", "n.n:null", "n.y:number", "t:boolean", "z[]:number"]
    assert got[2] == sorted(["a.b[][].`c d`.e[].`f.g`[]:null", "o:object", "m[]:mixed", "````:text", "BIGINT.OBJECT:text"])
    assert [got[3], got[4], got[5]] == [[":object"], ["[].x:number"], [":text"]]


def test_content_parts_nested_lists_and_prompts_of_turns(spark):
    part = lambda x: {"type": "text", "text": x}
    image = {"type": "image_url", "image_url": {"url": "u"}}
    turn = lambda role, content: {"role": role, "content": content}
    cases = [
        ({"messages": [turn("user", [part("a"), part("b")]), turn("assistant", [part("c")])]}, "message_parts", [("user", "a\n\nb"), ("assistant", "c")], []),
        ({"messages": [turn("user", [part("a"), image]), turn("assistant", "[1]")]}, "message_mixed", [("user", "a\n\n[image_url]"), ("assistant", "[1]")], []),
        ({"data": {"messages": [turn("human", "a")], "n": 1}}, "data_messages", [("user", "a")], ["data.n:number"]),
        ({"data": {"messages": [turn("user", [part("a")])]}}, "data_message_parts", [("user", "a")], []),
        ({"prompt": [turn("system", "s"), turn("user", "a")], "completion": "b"}, "prompt_turns", [("system", "s"), ("user", "a"), ("assistant", "b")], []),
        ({"prompt": [turn("user", "a")], "completion": [turn("assistant", "b")]}, "prompt_turns_completion_turns", [("user", "a"), ("assistant", "b")], []),
        ({"system": "s", "messages": [turn("user", "a"), turn("assistant", None)]}, "system_messages", [("system", "s"), ("user", "a"), ("assistant", "")], []),
        ({"messages": [turn("user", "a"), turn("assistant", None) | {"tool_calls": [{"f": 1}]}]}, "messages", [("user", "a"), ("assistant", "")], ["messages[].tool_calls[].f:number"]),
        ({"instruction": "i", "input": None, "output": "o"}, "instruction_input", [("user", "i"), ("assistant", "o")], []),
    ]
    for r, (_, layout, turns, unread) in zip(read(spark, *[c[0] for c in cases]), cases, strict=True):
        assert (r.layout, told(r), r.unread, r.problem) == (layout, turns, unread, None)


def test_what_fits_no_layout_or_two_is_told(spark):
    got = read(spark, {"prompt": "p", "completion": "c", "response": "r"}, {"messages": [1, {"role": "a", "content": "b"}]}, {"a": 1}, {}, [1], "no json", '{"a":1', '{"a":1,"a":2}', None, '{"prompt":1,"completion":"x"}')
    assert [r.problem for r in got] == ["ambiguous: prompt_completion, prompt_response", "no layout", "no layout", "no layout", *["no JSON object"] * 4, None, "no layout"]
    assert all((r.layout, r.turns, r.unread) == (None, None, None) for r in got)


def test_a_conversation_of_many_megabytes(spark):
    """A text above what JSON parsers take by default, and a conversation of 20,000 turns."""
    long = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("<|x% "), 5_000_000).alias("text"))
    many = spark.range(20_000).select(F.lit(2).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("turn "), F.col("id").cast("string")).alias("text"))
    out = {r.conv_id: r for r in chat.op8_chat_format(long.unionByName(many)).collect()}
    assert (out[1].n_turns, out[1].loss_chars) == (1, 25_000_000)
    assert out[1].loss_sha256 == hashlib.sha256(b"<|x% " * 5_000_000).hexdigest()
    assert out[2].n_turns == 20_000 and out[2].turns_sha256 == hashlib.sha256("".join(f"user\nturn {i}\n" for i in range(20_000)).encode()).hexdigest()


def test_round_trip(spark, data):
    texts = ["</s>[INST] ok [/INST]", "%25 %3C %5B <|turn_end|>\n", "<|turn_start|>user\nx", "", None, "a\nb<", "<<SYS>> <</SYS>> %", "%%25%3C|"]
    rows = [(1, i, "assistant" if i % 2 else "us\ner<|", t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (2, None, "assistant", "tie"), (2, 0, None, "x"), (None, 0, "user", "y")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    out = {r.conv_id: r for r in chat.op8_chat_format(df).collect()}
    assert set(out) == {1, 2, None, -1}
    for conv in (1, 2, None):
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in mine)
        loss = "".join(text for _, _, role, text in mine if role == "assistant")
        r = out[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out[-1].n_turns == 2 and out[-1].loss_chars == 21
    assert chat.op8_chat_format(df.limit(0)).count() == 1


def test_marks_and_mask(spark):
    df = spark.createDataFrame([([("user", "a<|b"), ("assistant", "é")],), ([],), (None,)], "turns array<struct<role: string, text: string>>")
    rows = chat.formatted(df).collect()
    assert rows[0].formatted == "<|turn_start|>user\na%3C|b<|turn_end|>\n<|turn_start|>assistant\né<|turn_end|>\n"
    at = sum(rows[0]["mask"][0][:3]) + rows[0]["mask"][1].header
    assert rows[0].formatted[at : at + rows[0]["mask"][1].body] == "é" and [m.loss for m in rows[0]["mask"]] == [False, True]
    assert [r.formatted for r in rows[1:]] == ["", ""]


def test_no_python_on_the_main_path(spark, data):
    plan = chat.op8_chat_format(spark.read.parquet(f"{data}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
