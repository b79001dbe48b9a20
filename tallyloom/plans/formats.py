"""Queries of record files, JSON, media and archives; see `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import media, numbers
from tallyloom.functions import text as X
from tallyloom.functions.hashing import stable_id
from tallyloom.operators import distractors, mixture, records
from tallyloom.plans.registry import PRINT, order_sql, query
from tallyloom.session import spread
from tallyloom.sources import readers, record_json, row_groups

_LEVELS = ["urgent", "high", "medium", "not specified", "low"]


@query("""
SELECT '{"id":"' || substr(sha1('orders|' || o_orderkey), 1, 16) || '","state":{"z":' || o_orderkey || ',"a":"' || o_orderpriority || '"},"questions":{'
  || '"status":{"type":"choice","instructions":"Which \\"status\\"?","criteria":{"P":"pending","F":"done\\nfully","O":""}},'
  || '"urgency":{"type":"score","instructions":"How urgent?","criteria":["urgent","high","medium","not specified","low"]},'
  || '"dear":{"type":"noul","instructions":"Dear?","criteria":{"true":"over 100000"}}},"targets":{"status":{"label":"' || o_orderstatus || '"},"urgency":{"label":"' || (left(o_orderpriority, 1)::INT - 1)
  || '","probs":{"0":0.25,"4":0.75}},"dear":{"label":"' || CASE WHEN o_totalprice > 100000 THEN 'yes' ELSE 'no' END || '"}},"meta":{"source":"orders","split":"train","area":"trade","customer":"' || o_custkey || '"}}' AS value FROM orders""")
def record_lines(t):
    """Orders as records of three questions, written as lines of the record format."""
    level = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    state = F.concat(F.lit('{"z":'), F.col("o_orderkey").cast("string"), F.lit(',"a":"'), F.col("o_orderpriority"), F.lit('"}'))
    ask = [
        records.question("status", "choice", 'Which "status"?', records.options([("P", "pending"), ("F", "done\nfully"), ("O", "")])),
        records.question("urgency", "score", "How urgent?", records.options([(str(i), d) for i, d in enumerate(_LEVELS)])),
        records.question("dear", "noul", "Dear?", records.options([("no", "no"), ("yes", "over 100000")])),
    ]
    probs = F.create_map(F.lit("0"), F.lit(0.25), F.lit("4"), F.lit(0.75))
    said = [records.target("status", F.col("o_orderstatus")), records.target("urgency", level, probs), records.target("dear", F.when(F.col("o_totalprice") > 100000, "yes").otherwise("no"))]
    made = records.record(t("orders"), source="orders", state=state, questions=ask, targets=said, id_=stable_id(F.lit("orders"), F.col("o_orderkey")), area="trade", meta={"customer": F.col("o_custkey")})
    return record_json.lines_of(made)


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus AS s, left(o_orderpriority, 1)::INT - 1 AS level, o_totalprice > 100000 AS dear, o_custkey FROM orders)
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '{"b":[' || o_orderkey || ',{"y":null,"x":"é"}],"a":true}' WHEN 1 THEN '{"looks": "like"} JSON' ELSE '' END AS state,
  CASE o_orderkey % 3 WHEN 0 THEN 'object' ELSE 'text' END AS state_kind, o_custkey::VARCHAR AS customer, 'trade' AS family,
  unnest(['status', 'urgency', 'dear']) AS name, unnest(['choice', 'score', 'noul']) AS type, unnest([3, 5, 2]) AS k,
  unnest([s, CASE WHEN o_orderkey % 2 = 0 THEN level::VARCHAR END, CASE WHEN dear THEN 'yes' ELSE 'no' END]) AS label,
  unnest([list_position(['P', 'F', 'O'], s) - 1, CASE WHEN o_orderkey % 2 = 0 THEN level END, dear::INT]) AS index,
  unnest(['P,F,O', '0,1,2,3,4', 'no,yes']) AS labels, unnest([NULL, CASE WHEN o_orderkey % 2 = 1 THEN 0.75::DOUBLE END, NULL]) AS p4 FROM o""")
def record_lines_read(t):
    """Lines of the record format, with targets as objects, as bare values and as probabilities, read and flattened."""
    o = spread(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    o = o.withColumn("key", F.col("o_orderkey").cast("string")).withColumn("level", F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    way = F.col("o_orderkey") % 3
    state = F.when(way == 0, F.concat(F.lit('"state": {"b": ['), F.col("key"), F.lit(', {"y": null, "x": "\\u00e9"}], "a": true}, '))).when(way == 1, '"state": "{\\"looks\\": \\"like\\"} JSON", ').otherwise("")
    asked = '"questions": {"status": {"type": "choice", "instructions": "Which?", "criteria": {"P": "pending", "F": null, "O": 3}}, "urgency": {"type": "score", "instructions": null, "criteria": ["a", "b", "c", "d", "e"]}, "dear": {"type": "noul", "instructions": "Dear?"}}, '
    urgency = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"label": '), F.col("level").cast("string"), F.lit("}"))).otherwise('{"label": null, "probabilities": {"0": 0.25, "4": 0.75}}')
    dear = F.when(F.col("o_totalprice") > 100000, "true").otherwise('{"label": false}')
    line = F.concat(F.lit('{"id": '), F.col("key"), F.lit(", "), state, F.lit(asked), F.lit('"targets": {"status": "'), F.col("o_orderstatus"), F.lit('", "urgency": '), urgency, F.lit(', "dear": '), dear, F.lit('}, "family": "trade", "meta": {"customer": '), F.col("o_custkey").cast("string"), F.lit("}}"))
    rows = records.decisions(record_json.records_of(o.select(line.alias("value"))), "state", "state_kind")
    meta = lambda k: F.col("meta")[k].alias(k)
    return rows.select(F.col("id").cast("long").alias("id"), "name", "type", "k", "label", "index", F.array_join("labels", ",").alias("labels"), F.col("probs")["4"].alias("p4"), "state", "state_kind", meta("customer"), meta("family"))


@query("""
SELECT o_orderstatus AS file, o_orderkey AS line, times FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderstatus, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS times FROM orders) WHERE r = 1""")
def canonical_states(t):
    """Orders whose states are the same JSON, whatever the order of keys, spaces and forms of numbers at any depth: the first by file and line, and how many there are."""
    way, c, p = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string"), F.col("o_orderpriority")
    first = F.concat(F.lit('{"who": {"id": '), c, F.lit(', "tags": ["x", {"b": 1, "a": null}]}, "urgency": "'), p, F.lit('"}'))
    second = F.concat(F.lit('{"urgency":"'), p, F.lit('","who":{"tags":["x",{"a":null,"b":1.0}],"id":'), c, F.lit("}}"))
    third = F.concat(F.lit(' { "urgency" : "'), p, F.lit('" , "who" : { "tags" : [ "\\u0078" , { "a" : null , "b" : 1 } ] , "id" : '), c, F.lit(" } } "))
    rows = t("orders").select(F.col("o_orderstatus").alias("file"), F.col("o_orderkey").alias("line"), F.when(way == 0, first).when(way == 1, second).otherwise(third).alias("state"))
    return record_json.first_of_states(rows, F.col("state"), "file", "line").select("file", "line", "times")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem WHERE l_orderkey % 500 = 3 AND l_returnflag = 'R'""")
def late_columns(t):
    """Wide columns of chosen order lines, fetched by file and row: the choice reads two columns, and the rest is read of row groups with a chosen row."""
    lines = t("lineitem")
    chosen = readers.with_address(lines.select("l_orderkey", "l_returnflag", "_metadata")).filter("l_orderkey % 500 = 3 and l_returnflag = 'R'")
    wide = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
    path = lines.inputFiles()[0]
    path = path if path.count(".parquet") == 1 else path[: path.index(".parquet") + len(".parquet")]
    return row_groups.fetched(lines.sparkSession, path, chosen.select("file", "row"), wide).select(*wide)


# ---- numbers, media and scores inside texts ---------------------------------------------------


@query(f"""
WITH p AS (SELECT DISTINCT o_orderkey, o_totalprice AS gold, round(l_extendedprice, 2) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE round(l_extendedprice, 2) <> o_totalprice),
r AS (SELECT o_orderkey, 0 AS class, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(ln(v / gold)), v) || '' AS h, v FROM p),
f AS (SELECT o_orderkey, 2 AS class, {order_sql(8, "o_orderkey", "s")} AS h, o_totalprice * f AS v FROM orders, (VALUES (0.9, '0.9'), (1.1, '1.1'), (0.95, '0.95'), (1.05, '1.05'), (0.8, '0.8'), (1.2, '1.2'), (0.5, '0.5'), (2.0, '2.0')) x(f, s) WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
c AS (SELECT o_orderkey, format('{{:,.2f}}', v) AS t, min((class, CASE class WHEN 0 THEN lpad(h, 4, '0') ELSE h END)) AS k FROM (SELECT * FROM r UNION ALL SELECT * FROM f) GROUP BY ALL)
SELECT o_orderkey, format('{{:,.2f}}', o_totalprice) || ';' || array_to_string((SELECT list(t ORDER BY k) FROM c WHERE c.o_orderkey = o.o_orderkey AND t <> format('{{:,.2f}}', o_totalprice))[1:4], ';') AS options
FROM orders o WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def related_numbers(t):
    """The price of each order among five amounts: amounts of dollars in the text of its lines first, those nearest by ratio in front, then near values. Quantities, shares and codes in the text are of other units."""
    line = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(": "), F.col("l_quantity").cast("string"), F.lit(" pieces of code x"), F.col("l_partkey").cast("string"), F.lit("9 for $"), F.format_number("l_extendedprice", 2), F.lit(", "), F.col("l_discount").cast("string"), F.lit("% off."))
    texts = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    rows = t("orders").select("o_orderkey", "o_totalprice").join(texts, "o_orderkey")
    found = numbers.related_to(F.col("o_totalprice"), numbers.numbers_in(F.col("text"), "$"), "$")
    return rows.select("o_orderkey", F.array_join(numbers.number_choices(F.col("o_totalprice"), 2, 5, 8, F.col("o_orderkey"), related=found), ";").alias("options"))


@query("""
WITH p AS (SELECT p_partkey, (p_partkey % 4)::INT AS images, (p_size % 3)::INT AS videos, (p_partkey % 2)::INT AS audios, p_name FROM part),
m AS (SELECT *, list_filter([('image', 2), ('video', 1), ('image', 1), ('image', 2), ('audio', 1), ('video', 1)], lambda x: x[2] <= CASE x[1] WHEN 'image' THEN images WHEN 'video' THEN videos ELSE audios END) AS named FROM p),
a AS (SELECT *, list_filter(list_concat(list_transform(range(1, images + 1), lambda i: ('image', i::INT)), list_transform(range(1, videos + 1), lambda i: ('video', i::INT)), list_transform(range(1, audios + 1), lambda i: ('audio', i::INT))), lambda x: NOT list_contains(named, x)) AS front FROM m)
SELECT p_partkey, array_to_string(list_transform(front, lambda x: '(' || x[1] || x[2] || ')'), '') || p_name || array_to_string(list_transform(named, lambda x, i: ' ' || CASE WHEN list_position(named, x) = i THEN '(' || x[1] || x[2] || ')' ELSE '[' || x[1] || ' ' || x[2] || ']' END), '') || '.' AS text,
  array_to_string(list_transform(list_concat(front, list_filter(named, lambda x, i: list_position(named, x) = i)), lambda x: x[1] || x[2]), ',') AS items FROM a""")
def media_inlining(t):
    """Parts with up to three images, two videos and a sound, which their texts name in part and more than once: texts with placeholders, and the order of items."""
    counts = {"image": F.col("p_partkey") % 4, "video": F.col("p_size") % 3, "audio": F.col("p_partkey") % 2}
    tags = [("image", 2), ("video", 1), ("image", 1), ("image", 2), ("audio", 1), ("video", 1)]
    text = F.concat(F.col("p_name"), *[F.when(counts[k] >= n, f" <{k}:{n}>").otherwise("") for k, n in tags], F.lit("."))
    name = lambda kind, at: F.concat(kind, (at + 1).cast("string"))
    made = media.inlined(text, {k: n.cast("int") for k, n in counts.items()}, lambda kind, at: F.concat(F.lit("("), name(kind, at), F.lit(")")))
    rows = spread(t("part").select("p_partkey", "p_name", "p_size")).select("p_partkey", made.alias("m"))
    return rows.select("p_partkey", "m.text", F.array_join(F.transform("m.order", lambda o: name(o["kind"], o["at"])), ",").alias("items"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN l_quantity / 50 WHEN 1 THEN l_quantity / 50 WHEN 2 THEN l_discount WHEN 3 THEN NULL ELSE l_discount END AS score FROM lineitem""")
def nested_scores(t):
    """Scores of graders: in an object, in JSON that is a text in JSON, beside a text that is none, in nothing, and two texts deep."""
    grade, outer = (F.col(c).cast("string") for c in ("l_quantity", "l_discount"))
    inner = F.concat(F.lit('{"correctness_score": '), (F.col("l_quantity") / 50).cast("string"), F.lit("}"))
    as_text = lambda x: F.get_json_object(F.to_json(F.struct(F.to_json(F.struct(x.alias("x"))).alias("y"))), "$.y")
    quoted = lambda x: F.regexp_extract(as_text(x), "^.\"x\":(.*).$", 1)
    forms = [
        F.concat(F.lit('{"judge_response": '), inner, F.lit(', "score": 9}')),
        F.concat(F.lit('{"judge_response": '), quoted(inner), F.lit(', "score": {"of": 1}}')),
        F.concat(F.lit('{"judge_response": "grade '), grade, F.lit('", "score": "'), outer, F.lit('"}')),
        F.concat(F.lit('{"judge_response": null, "score": {"value": '), outer, F.lit("}}")),
        quoted(F.concat(F.lit('{"judge_response": "{}", "score": '), outer, F.lit("}"))),
    ]
    way = F.col("l_partkey") % 5
    cell = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        cell = F.when(way == k, form).otherwise(cell)
    return t("lineitem").select("l_orderkey", "l_linenumber", X.json_score(cell).alias("score"))


@query("""
WITH l AS (SELECT DISTINCT lower(CASE p_size % 3 WHEN 0 THEN p_type || 's of the Part' WHEN 1 THEN 'Playing ' || p_type || 'ing' ELSE p_type END) AS label FROM part),
w AS (SELECT label, list_distinct(list_transform(list_filter(regexp_split_to_array(label, '[^a-z]+'), lambda x: x <> '' AND NOT list_contains(['a', 'an', 'and', 'by', 'from', 'in', 'of', 'on', 'playing', 'the', 'to', 'with'], x)),
    lambda x: CASE WHEN length(x) > 4 THEN regexp_replace(x, '(ing|s)$', '') ELSE x END)) AS w FROM l),
p AS (SELECT a.label, b.label AS other, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS s FROM w a JOIN w b ON a.label <> b.label WHERE len(list_intersect(a.w, b.w)) > 0)
SELECT label, other, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, other)::INT AS rank FROM p) WHERE rank <= 6""")
def stemmed_lookalikes(t):
    """The six labels most like each one by stems: plurals and forms in -ing are their word."""
    kind = F.col("p_type")
    label = F.when(F.col("p_size") % 3 == 0, F.concat(kind, F.lit("s of the Part"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Playing "), kind, F.lit("ing"))).otherwise(kind)
    return distractors.lookalikes(t("part").select(F.lower(label).alias("label")), "label", words=X.stem_set).withColumn("similarity", F.round("similarity", 6))


@query(f"""
WITH b AS (SELECT {{NORM}} AS k FROM benchmark),
d AS (SELECT doc_id, source, {{NORM}} IN (SELECT k FROM b) AS bad FROM documents),
c AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {order_sql(0, "substr(sha1('documents|' || doc_id), 1, 16)")}) AS r, count(*) OVER (PARTITION BY source) AS n FROM d WHERE NOT bad),
g AS (SELECT source, least(max(n), 30) AS n FROM c GROUP BY source),
l AS (SELECT {{NORM}} IN (SELECT k FROM b) AS bad FROM labels JOIN documents USING (doc_id)),
t AS (SELECT count(*) AS n FROM l WHERE NOT bad)
SELECT 'documents' AS source, (SELECT count(*) FROM d) AS loaded, (SELECT count(*) FROM d WHERE bad) AS overlap_removed, least((SELECT sum(greatest(n, least(25, 3 * n))) FROM g), 700)::BIGINT AS used
UNION ALL SELECT 'labels', (SELECT count(*) FROM l), (SELECT count(*) FROM l WHERE bad), round_even(least(n, 200) * 1.5, 0)::BIGINT FROM t
UNION ALL SELECT 'again', (SELECT count(*) FROM l), (SELECT count(*) FROM l WHERE bad), greatest(n, least(2000, 3 * n))::BIGINT FROM t""".replace("{NORM}", PRINT.format("text")))
def mixture_of_all_kinds(t):
    """A mixture whose sources ask for different things: groups cut at 30, repeated to 25 and cut at 700 in all; 200 records one and a half times; and the same ids again, repeated to 2,000."""
    labelled = t("labels").join(t("documents"), "doc_id")
    toxic = lambda name: records.noul_records(labelled, source=name, state=F.col("text"), instructions="Is the text toxic?", label=F.col("toxic"), id_=stable_id(F.lit("labels"), F.col("doc_id")))
    docs = records.noul_records(t("documents"), source="documents", state=F.col("text"), instructions="?", label=F.lit("yes"), id_=stable_id(F.lit("documents"), F.col("doc_id")), meta={"task": F.col("source")})
    items = records.noul_records(t("benchmark"), source="benchmark", state=F.col("text"), instructions="-", label=F.lit("yes"), id_=stable_id(F.lit("benchmark"), F.col("item_id")))
    sources = [
        (mixture.Source("documents", max_samples=700, group_by="task", per_group=30, repeat_to=25), docs),
        (mixture.Source("labels", max_samples=200, weight=1.5), toxic("labels")),
        (mixture.Source("again", repeat_to=2000), toxic("again")),
    ]
    return mixture.build_mixture(sources, items)[1]
