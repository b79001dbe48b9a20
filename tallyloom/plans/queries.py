"""The library's queries over the fixture tables, each with its SQL: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.convert import CONVERTERS
from tallyloom.functions import numbers
from tallyloom.functions import scores as S
from tallyloom.functions import text as X
from tallyloom.functions import tiers
from tallyloom.functions.hashing import hash_bucket, hash_mod, order_key, split_of, stable_id
from tallyloom.operators import augment, distractors, filters, history, intervals, metrics, mixture, prompts, records, sampling, scorer, votes
from tallyloom.plans.registry import HEX8, NORM, PRINT, QUERIES, SQL, mod_sql, order_sql, query
from tallyloom.session import spread
from tallyloom.streaming.slices import tumbling

__all__ = ["QUERIES", "SQL"]

# ---- leakage and mixtures ---------------------------------------------------------------------


def _fields(text):
    """A document or item as fields: its whole text and its lines."""
    return mixture.content_keys(text, F.split(text, "\n"))


@query(f"""
WITH d AS (SELECT doc_id, source, text FROM documents), f AS (
  SELECT doc_id, source, {PRINT.format("text")} AS k FROM d
  UNION SELECT doc_id, source, {PRINT.format("l")} FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM d) WHERE length(l) >= 40),
b AS (SELECT {PRINT.format("text")} AS k FROM benchmark UNION SELECT {PRINT.format("l")} FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark) WHERE length(l) >= 40),
bad AS (SELECT DISTINCT doc_id FROM f SEMI JOIN b USING (k))
SELECT source, count(*) AS loaded, count(*) FILTER (doc_id IN (SELECT doc_id FROM bad)) AS overlap_removed, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM bad)) AS used
FROM d GROUP BY source""")
def leak_report(t):
    """Documents that share a fingerprint of their text or of a long line with the benchmark, by source."""
    docs = t("documents").select(F.col("doc_id").alias("id"), "source", _fields(F.col("text")).alias("keys"))
    banned = t("benchmark").select(F.explode(_fields(F.col("text"))).alias("key"))
    bad = mixture.overlapping(docs.select("id", F.explode("keys").alias("key")), banned).withColumn("bad", F.lit(1))
    joined = t("documents").select(F.col("doc_id").alias("id"), "source").join(bad, "id", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("loaded"), F.count("bad").alias("overlap_removed"), (F.count(F.lit(1)) - F.count("bad")).alias("used"))


@query(f"""
SELECT doc_id, item_id FROM (SELECT doc_id, {NORM.format("text")} AS t FROM documents) d
JOIN (SELECT item_id, {NORM.format("text")} AS i FROM benchmark) b ON contains(t, i)""")
def leak_contains(t):
    """Documents whose normalised text contains a whole benchmark item, by characters: pairs meet by words inside the item, then the containment is checked.

    An item may begin and end inside words of the document, so it is met by up to six words after
    its first and before its last; an item of fewer than three words by the begin of its first.
    """
    n = 6
    items = t("benchmark").select("item_id", X.normalised(F.col("text")).alias("item")).filter("item is not null").withColumn("w", F.split("item", " "))
    items = items.withColumn("words", F.greatest(F.least(F.size("w") - 2, F.lit(n)), F.lit(0)))
    items = items.withColumn("chars", F.when(F.col("words") > 0, 0).otherwise(F.least(F.length(F.element_at("w", 1)), F.lit(n))))
    gram = F.when(F.col("words") > 0, F.array_join(F.slice("w", 2, F.col("words")), " ")).otherwise(F.substring(F.element_at("w", 1), 1, F.col("chars")))
    items = items.select("item_id", "item", "words", "chars", F.xxhash64("words", "chars", gram).alias("g"))

    def grams(words: int, chars: int):
        key = lambda x: F.xxhash64(F.lit(words), F.lit(chars), x)
        if words:
            return F.when(F.size("w") >= words, F.transform(F.sequence(F.lit(0), F.size("w") - words), lambda i: key(F.array_join(F.slice("w", i + 1, words), " "))))
        some = F.filter(F.array_distinct("w"), lambda x: F.length(x) >= chars)
        return F.flatten(F.transform(some, lambda x: F.transform(F.sequence(F.lit(0), F.length(x) - chars), lambda i: key(F.substring(x, i + 1, F.lit(chars))))))

    none = F.array().cast("array<bigint>")
    sizes = items.select("words", "chars").distinct().collect()  # 2 n + 1 rows at most
    texts = t("documents").select("doc_id", X.normalised(F.col("text")).alias("t"))
    docs = texts.select("doc_id", F.split("t", " ").alias("w"))
    docs = docs.select("doc_id", F.explode(F.array_distinct(F.concat(none, *[F.coalesce(grams(r.words, r.chars), none) for r in sizes]))).alias("g"))
    pairs = docs.join(items, "g").select("doc_id", "item_id", "item")
    return texts.join(pairs, "doc_id").filter(F.contains("t", "item")).select("doc_id", "item_id").distinct()


@query("""
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1""")
def exact_dedupe_state(t):
    """The first row, by source and id, of each whole text."""
    docs = t("documents").select("doc_id", "source", F.sha2("text", 256).alias("k"))
    return docs.groupBy("k").agg(F.min(F.struct("source", "doc_id")).alias("f")).select("f.doc_id", "f.source")


@query(f"""
WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {order_sql(0, "doc_id")}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS c FROM documents),
g AS (SELECT * FROM d WHERE r <= 40), n AS (SELECT source, count(*) AS c FROM g GROUP BY source)
SELECT g.source, g.doc_id, j AS copy FROM g JOIN n USING (source), range(0, 3) x(j) WHERE g.r + j * n.c <= least(60, 3 * n.c)""")
def per_group_cap_repeat(t):
    """At most 40 documents of each source, smaller samples repeated cyclically up to 60, three times at most."""
    docs = t("documents").select("doc_id", "source")
    capped = sampling.capped(docs, ["source"], 40, 0, F.col("doc_id")).drop("rank")
    return mixture.repeated_to(capped, ["source"], 60, F.col("doc_id")).select("source", "doc_id", "copy")


@query(f"""
WITH n AS (SELECT count(*) AS n FROM documents), d AS (SELECT doc_id, row_number() OVER (ORDER BY {order_sql(0, "doc_id")}, doc_id) AS r FROM documents)
SELECT doc_id, count(*) AS copies FROM d, n, range(0, 3) x(j) WHERE r + j * n <= round_even(n * 1.25, 0) GROUP BY doc_id""")
def weighted_source(t):
    """A source with weight 1.25: every document once, and a quarter twice."""
    return mixture.weighted(t("documents").select("doc_id"), 1.25, F.col("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))


_LANGS = [("de", "German"), ("en", "English"), ("es", "Spanish"), ("fr", "French")]


def _doc_records(t) -> DataFrame:
    """Documents as records: which language is it?"""
    return records.choice_records(t("documents"), source="documents", state=F.col("text"), instructions="Which language is the text in?", choices=_LANGS, label=F.col("lang"), id_=stable_id(F.lit("documents"), F.col("doc_id")), meta={"task": F.col("source")})


@query(f"""
WITH d AS (SELECT doc_id, {PRINT.format("text")} AS k FROM documents), b AS (SELECT {PRINT.format("text")} AS k FROM benchmark),
l AS (SELECT substr(sha1('labels|' || doc_id), 1, 16) AS id, {PRINT.format("text")} AS k FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) AS n FROM d), cc AS (SELECT count(*) AS n FROM d ANTI JOIN b USING (k)), lc AS (SELECT count(*) AS n FROM l), lk AS (SELECT count(*) AS n FROM l ANTI JOIN b USING (k))
SELECT 'documents' AS source, c.n AS loaded, c.n - cc.n AS overlap_removed, least(cc.n, 300)::BIGINT AS used FROM c, cc
UNION ALL SELECT 'labels', lc.n, lc.n - lk.n, round_even(lk.n * 0.5, 0)::BIGINT FROM lc, lk""")
def mixture_report(t):
    """A mixture of two sources: 300 documents, and half of the labelled ones."""
    labelled = t("labels").join(t("documents"), "doc_id")
    toxic = records.noul_records(labelled, source="labels", state=F.col("text"), instructions="Is the text toxic?", label=F.col("toxic"), id_=stable_id(F.lit("labels"), F.col("doc_id")))
    items = records.noul_records(t("benchmark"), source="benchmark", state=F.col("text"), instructions="-", label=F.lit("yes"), id_=stable_id(F.lit("benchmark"), F.col("item_id")))
    sources = [(mixture.Source("documents", max_samples=300), _doc_records(t)), (mixture.Source("labels", weight=0.5), toxic)]
    return mixture.build_mixture(sources, items)[1]


def _clips(df: DataFrame, id_, clip, forms: list) -> DataFrame:
    """Records about clips, which tell their source in several ways."""
    made = records.record(df, source="clips", state=F.concat(F.lit("about "), id_), questions=[], targets=[], id_=id_, meta={"source_id": forms[0](clip)})
    path, frames = forms[1](clip), forms[2](clip)
    item = F.struct(F.lit("video").alias("type"), path.alias("path"), frames.alias("frames"), F.lit(1.0).alias("fps"), F.lit(4.0).alias("duration"), F.lit(None).cast("string").alias("audio"), F.lit(0.0).alias("start"), F.lit(False).alias("mute"), F.lit(False).alias("black"))
    return made.join(df.select(id_.alias("id"), F.array(item).cast(f"array<{records.MEDIA}>").alias("told")), "id").withColumn("media", F.col("told")).drop("told")


@query("""
WITH e AS (SELECT DISTINCT s_suppkey * 7 % 400 AS clip FROM supplier)
SELECT c_custkey, c_custkey % 4 <> 3 AND c_custkey % 400 IN (SELECT clip FROM e) AS leak FROM customer""")
def leak_sources(t):
    """Records about the same clip as an evaluation record: told as an id or a list of ids, by the name of the file, or of the frames' folder."""
    clip_of = lambda n: F.substring(F.sha1(F.concat(F.lit("clip"), n.cast("string"))), 1, 11)
    key = F.col("c_custkey")
    way = key % 4
    train = _clips(t("customer"), F.concat(F.lit("c"), key.cast("string")), clip_of(key % 400), [lambda c: F.when(way == 0, F.concat(F.lit("yt:"), c)), lambda c: F.when(way == 1, F.concat(F.lit("/train/"), c, F.lit("_10.mp4"))).when(way == 3, F.concat(F.lit("/x/video_"), key.cast("string"), F.lit(".mp4"))).otherwise(F.when(way == 0, F.concat(F.lit("/y/"), key.cast("string")))), lambda c: F.when(way == 2, F.array(F.concat(F.lit("/f/"), c, F.lit("_3_9/0001.jpg"))))])
    sup = F.col("s_suppkey")
    held = _clips(t("supplier"), F.concat(F.lit("s"), sup.cast("string")), clip_of(sup * 7 % 400), [lambda c: F.when(sup % 2 == 0, F.concat(F.lit('["yt:other", "yt:'), c, F.lit('"]'))), lambda c: F.concat(F.lit("/eval/"), F.when(sup % 2 == 0, F.lit("z")).otherwise(c), F.lit(".mp4")), lambda c: F.lit(None).cast("array<string>")])
    bad = mixture.overlapping(mixture.record_keys(train), mixture.record_keys(held)).withColumn("leak", F.lit(True))
    ids = t("customer").select("c_custkey", F.concat(F.lit("c"), key.cast("string")).alias("id"))
    return ids.join(bad, "id", "left").select("c_custkey", F.coalesce("leak", F.lit(False)).alias("leak"))


# ---- splits and samples -----------------------------------------------------------------------


@query(f"""SELECT doc_id, {mod_sql("doc_id::VARCHAR", 100)} AS percent, CASE {mod_sql("doc_id::VARCHAR", 10)} WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM documents""")
def split_80_10_10(t):
    """Splits by the whole SHA-1 of the id."""
    key = F.col("doc_id").cast("string")
    return t("documents").select("doc_id", hash_mod(key, 100).alias("percent"), split_of(key).alias("split"))


@query(f"""SELECT c_custkey, {HEX8.format("sha1('customer|' || c_custkey)")} % 100 AS bucket, {HEX8.format("sha1('customer|' || c_custkey)")} % 100 < 12 AS held FROM customer""")
def bucket_split(t):
    """Buckets by the first digits of the SHA-1, 12 % held out."""
    b = hash_bucket(F.lit("customer"), F.col("c_custkey"))
    return t("customer").select("c_custkey", b.alias("bucket"), (b < 12).alias("held"))


@query(f"SELECT doc_id, lang FROM documents ORDER BY {order_sql(7, 'doc_id')}, doc_id LIMIT 100")
def take_cap(t):
    """Exactly 100 documents in hash order."""
    return sampling.take(t("documents").select("doc_id", "lang"), 100, 7, F.col("doc_id"))


@query(f"""
SELECT doc_id, lang, r AS rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {order_sql(3, "doc_id")}, doc_id) AS r FROM documents) ORDER BY r, lang LIMIT 90""")
def balanced_round_robin(t):
    """90 documents dealt from the languages in turn."""
    return sampling.round_robin(t("documents").select("doc_id", "lang"), "lang", 90, 3, F.col("doc_id"))


@query(f"""
WITH m AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM labels GROUP BY quality))
SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {order_sql(5, "doc_id")}, doc_id) AS r FROM labels), m WHERE r <= m""")
def balanced_downsample(t):
    """As many labels of each quality as the rarer has."""
    return sampling.downsampled(t("labels").select("doc_id", "quality"), "quality", 5, F.col("doc_id")).select("doc_id", "quality")


@query(f"""
WITH n AS (SELECT count(*) AS n FROM orders)
SELECT o_orderkey, r <= greatest(1, floor(n * 0.02)) AS held FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {order_sql(1, "o_orderkey")}, o_orderkey) AS r FROM orders), n""")
def holdout(t):
    """2 % of the orders held out, exactly."""
    return sampling.holdout(t("orders").select("o_orderkey"), 0.02, 0, F.col("o_orderkey"))


@query(f"""
WITH s AS (SELECT source, count(*) AS n, {order_sql(2, "source")} AS h FROM documents GROUP BY source),
c AS (SELECT source, coalesce(sum(n) OVER (ORDER BY h, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM c WHERE before < 300)""")
def cluster_sample(t):
    """Whole sources until 300 documents are reached."""
    return sampling.cluster_sample(t("documents").select("doc_id", "source"), "source", 300, 2)


@query("""
WITH e AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer), l AS (SELECT DISTINCT c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment DESC) AS r FROM e) WHERE r = 1)
SELECT c_custkey, c_mktsegment IN (SELECT c_mktsegment FROM l) AS held FROM customer""")
def entity_disjoint_split(t):
    """Customers of the last segment of each nation are held out, wherever they occur."""
    return sampling.entity_holdout(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_nationkey", "c_mktsegment").select("c_custkey", "held")


@query(f"""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {order_sql(4, "o_orderkey")}, o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_per_key(t):
    """One order of each customer."""
    return sampling.first_of(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", 4, F.col("o_orderkey"))


@query(f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {order_sql(6, "doc_id")}, doc_id) AS r FROM documents) WHERE r <= 25""")
def equal_share(t):
    """A hundred documents, a quarter for each of four languages."""
    return sampling.equal_share(t("documents").select("doc_id", "lang"), "lang", 100, 4, 6, F.col("doc_id")).select("doc_id", "lang")


# ---- records ----------------------------------------------------------------------------------


@query("""SELECT substr(sha1('documents|' || doc_id), 1, 16) AS id, 'answer' AS name, 'choice' AS type, 4 AS k, lang AS label, list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS index FROM documents""")
def choice_records(t):
    """Documents as choices among languages, flattened."""
    return records.decisions(_doc_records(t)).select("id", "name", "type", "k", "label", "index")


@query("""SELECT substr(sha1('labels|' || doc_id), 1, 16) AS id, CASE toxic WHEN 1 THEN 'yes' ELSE 'no' END AS label, toxic AS index FROM labels JOIN documents USING (doc_id)""")
def noul_records(t):
    """Toxicity labels as yes/no questions on their documents."""
    rows = t("labels").join(t("documents").select("doc_id", "text"), "doc_id")
    made = records.noul_records(rows, source="labels", state=F.col("text"), instructions="Is the text toxic?", label=F.col("toxic"), id_=stable_id(F.lit("labels"), F.col("doc_id")))
    return records.decisions(made).select("id", "label", "index")


@query("""SELECT substr(sha1('orders|' || o_orderkey), 1, 16) AS id, 5 AS k, (left(o_orderpriority, 1)::INT - 1)::VARCHAR AS label, left(o_orderpriority, 1)::INT - 1 AS index FROM orders""")
def score_records(t):
    """Order priorities as a scale of five levels."""
    level = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    state = F.to_json(F.struct("o_orderkey", "o_totalprice", "o_orderstatus"))
    made = records.score_records(t("orders"), source="orders", state=state, instructions="How urgent is the order?", levels=["urgent", "high", "medium", "not specified", "low"], level=level, id_=stable_id(F.lit("orders"), F.col("o_orderkey")))
    return records.decisions(made).select("id", "k", "label", "index")


@query("""
SELECT doc_id, name, CASE v WHEN 1 THEN 'yes' ELSE 'no' END AS label FROM (
  SELECT doc_id, unnest(['quality', 'toxic']) AS name, unnest([quality, toxic]) AS v FROM labels JOIN documents USING (doc_id))""")
def multi_question_records(t):
    """Two questions on one state."""
    rows = t("labels").join(t("documents").select("doc_id", "text"), "doc_id")
    ask = [records.question(n, "noul", i, records.options(records.YES_NO)) for n, i in (("quality", "Is the text good?"), ("toxic", "Is the text toxic?"))]
    said = [records.target(n, records.canonical_label(F.lit("noul"), F.col(n).cast("string"))) for n in ("quality", "toxic")]
    made = records.record(rows, source="labels", state=F.col("text"), questions=ask, targets=said, id_=F.col("doc_id").cast("string"))
    return records.decisions(made).select(F.col("id").cast("long").alias("doc_id"), "name", "label")


@query("""
WITH l AS (SELECT list_sort(list(DISTINCT p_brand)) AS l FROM part)
SELECT p_partkey, p_brand AS label, list_position(l, p_brand) - 1 AS index, len(l)::INT AS k FROM part, l""")
def open_label_set(t):
    """A choice among the labels that the column holds."""
    made = records.classification(t("part"), source="part", state=F.col("p_name"), label="p_brand", instructions="Which brand?", id_=F.col("p_partkey").cast("string"))
    return records.decisions(made).select(F.col("id").cast("long").alias("p_partkey"), "label", "index", "k")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN 'no state' WHEN trim(p_name) = '' OR p_partkey % 11 = 10 THEN 'no instructions' WHEN p_size % 5 < 2 THEN 'number of options'
  WHEN p_size % 5 = 4 AND p_partkey % 2 = 0 THEN 'repeated label' WHEN p_partkey % 3 >= p_size % 5 THEN 'label not among options' END AS problem FROM part""")
def validation_report(t):
    """Parts as choices of none to four options, some without a state or instructions, some with a label twice or outside."""
    n, key = F.col("p_size") % 5, F.col("p_partkey")
    opts = F.transform(F.slice(F.array(*map(F.lit, ("o0", "o1", "o2", "o3"))), 1, n), lambda k, i: F.struct(F.when((n == 4) & (key % 2 == 0) & (i == 3), "o0").otherwise(k).alias("key"), F.lit("").alias("description")))
    ask = records.question("q", "choice", F.when(key % 11 == 10, "  ").otherwise(F.col("p_name")), opts)
    made = records.record(t("part"), source="part", state=F.when(key % 7 != 6, F.col("p_name")), questions=[ask], targets=[records.target("q", F.concat(F.lit("o"), (key % 3).cast("string")))], id_=key.cast("string"))
    return records.problems(made).select(F.col("id").cast("long").alias("p_partkey"), "problem")


@query("""
SELECT row_number() OVER () AS case_id, problem FROM (VALUES (NULL), ('number of options'), ('label not among options'), ('repeated label'), ('target without question'), ('no state'), ('unknown type'), ('number of levels')) v(problem)""")
def validation_rules(t):
    """A record for each rule that it breaks, and a good one (constants: a smoke test of the rules' names)."""
    two, one = records.options([("a", "A"), ("b", "B")]), records.options([("a", "A")])
    ask = lambda kind="choice", opts=two, name="q": records.question(name, kind, "Which?", opts)
    cases = [("s", ask(), "q", "a"), ("s", ask(opts=one), "q", "a"), ("s", ask(), "q", "z"), ("s", ask(opts=records.options([("a", "A"), ("a", "B")])), "q", "a"), ("s", ask(), "other", "a"), (None, ask(), "q", "a"), ("s", ask("text"), "q", "a"), ("s", ask("score", one), "q", "0")]
    out = None
    for i, (state, q, name, label) in enumerate(cases, 1):
        row = records.record(t("region").limit(1), source="case", state=F.lit(state).cast("string"), questions=[q], targets=[records.target(name, F.lit(label))], id_=F.lit(str(i)))
        out = row if out is None else out.unionByName(row)
    return records.problems(out).select(F.col("id").cast("long").alias("case_id"), "problem")


@query("""SELECT doc_id, (length(text) + length('Which language is the text in?') + length('GermanEnglishSpanishFrench'))::INT AS proxy,
  '## State' || chr(10) || text || chr(10) || chr(10) || '## Decision schema' || chr(10) || '### answer (choice)' || chr(10) || 'Which language is the text in?' || chr(10) || 'A = de: German' || chr(10) || 'B = en: English' || chr(10) || 'C = es: Spanish' || chr(10) || 'D = fr: French' || chr(10) AS prompt FROM documents""")
def prompt_rendering(t):
    """Documents as prompts, and the length proxy."""
    made = prompts.rendered(_doc_records(t).withColumn("doc_id", F.lit(0)).drop("doc_id"))
    ids = t("documents").select("doc_id", stable_id(F.lit("documents"), F.col("doc_id")).alias("id"))
    return made.join(ids, "id").select("doc_id", prompts.length_proxy(F.col("state"), F.col("questions"), F.col("images")).alias("proxy"), "prompt")


# ---- options ----------------------------------------------------------------------------------


@query(f"""
WITH p AS (SELECT DISTINCT p_brand AS x FROM part),
o AS (SELECT p_partkey, p_brand, x, row_number() OVER (PARTITION BY p_partkey ORDER BY {order_sql(9, "p_partkey", "x")}) AS r FROM part, p WHERE x <> p_brand),
c AS (SELECT p_partkey, p_brand, x FROM o WHERE r <= 3 UNION ALL SELECT p_partkey, p_brand, p_brand FROM part)
SELECT p_partkey, string_agg(x, ';' ORDER BY {order_sql(9, "p_partkey", "x")}) AS options, list_position(list(x ORDER BY {order_sql(9, "p_partkey", "x")}), first(p_brand)) - 1 AS gold FROM c GROUP BY p_partkey""")
def mcq_options(t):
    """The brand and three others, in hash order, with the index of gold."""
    pool = records.open_labels(t("part"), "p_brand")
    rows = spread(t("part").select("p_partkey", "p_brand")).withColumn("o", distractors.from_pool(F.array(*map(F.lit, pool)), F.col("p_brand"), 4, 9, F.col("p_partkey")))
    return rows.select("p_partkey", F.array_join("o", ";").alias("options"), (F.array_position("o", F.col("p_brand")).cast("int") - 1).alias("gold"))


@query("""
WITH k AS (SELECT p_partkey, p_name, array_to_string(string_split(p_name, ' ')[1:2], ' ') AS k0, string_split(p_name, ' ')[1] AS k1, p_type AS k2 FROM part),
d AS (SELECT DISTINCT k0 AS key, 0 AS tier, p_name AS v FROM k UNION SELECT DISTINCT k1, 1, p_name FROM k UNION SELECT DISTINCT k2, 2, p_name FROM k),
c AS (SELECT tier, key, count(*) AS n FROM d GROUP BY ALL),
s AS (SELECT p_partkey, tier, n - 1 AS n FROM k JOIN c ON (tier = 0 AND key = k0 OR tier = 1 AND key = k1 OR tier = 2 AND key = k2) WHERE n > 1),
z AS (SELECT p_partkey, coalesce(min(tier) FILTER (n >= 3), min(tier)) AS tier FROM s GROUP BY p_partkey)
SELECT k.p_partkey, z.tier, coalesce(s.n, 0) AS n FROM k LEFT JOIN z USING (p_partkey) LEFT JOIN s ON s.p_partkey = k.p_partkey AND s.tier = z.tier""")
def tiered_distractors(t):
    """Other names from the first tier with three: equal first two words, first word, type."""
    words = F.split("p_name", " ")
    tiers = [F.array_join(F.slice(words, 1, 2), " "), F.element_at(words, 1), F.col("p_type")]
    rows = distractors.tiered_pool(t("part").select("p_partkey", "p_name", "p_type"), "p_name", tiers, 4, 0, F.col("p_partkey"))
    return rows.select("p_partkey", "tier", F.col("others").alias("n"))


@query("""
WITH l AS (SELECT DISTINCT p_type AS label, list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM part),
j AS (SELECT a.label, b.label AS other, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS similarity FROM l a JOIN l b ON a.label <> b.label AND len(list_intersect(a.w, b.w)) > 0)
SELECT label, other, round(similarity, 6) AS similarity, rank FROM (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY similarity DESC, other))::INT AS rank FROM j) WHERE rank <= 6""")
def jaccard_hard_negatives(t):
    """The six most similar types by shared words."""
    return distractors.lookalikes(t("part"), "p_type").withColumn("similarity", F.round("similarity", 6))


@query(f"""
WITH f AS (SELECT o_orderkey, o_totalprice AS g, unnest([0.9, 1.1, 0.95, 1.05, 0.8, 1.2, 0.5, 2.0]) AS f, unnest(['0.9', '1.1', '0.95', '1.05', '0.8', '1.2', '0.5', '2.0']) AS s FROM orders)
SELECT o_orderkey, format('{{:,.2f}}', first(g)) || ';' || array_to_string(list(format('{{:,.2f}}', g * f) ORDER BY h)[1:3], ';') AS options FROM (SELECT *, {order_sql(8, "o_orderkey", "s")} AS h FROM f) GROUP BY o_orderkey""")
def numeric_distractors(t):
    """A price and three near ones, as texts with thousands separators."""
    rows = t("orders").select("o_orderkey", numbers.number_choices(F.col("o_totalprice"), 2, 4, 8, F.col("o_orderkey")).alias("o"))
    return rows.select("o_orderkey", F.array_join("o", ";").alias("options"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct([p_size, p_size + 1, p_size - 1, p_size + 2])), ';') AS options FROM part""")
def integer_perturbation(t):
    """A size and three near ones, sorted."""
    return t("part").select("p_partkey", F.array_join(F.transform(distractors.integer_options(F.col("p_size")), lambda x: x.cast("string")), ";").alias("options"))


@query(f"""
WITH o AS (SELECT p_partkey, unnest(['size', 'brand', 'type', 'name']) AS key FROM part)
SELECT p_partkey, string_agg(key, ';' ORDER BY {order_sql(1, "p_partkey", "key")}) AS shuffled,
  (SELECT string_agg(k, ';' ORDER BY i) FROM (SELECT unnest(['size', 'brand', 'type', 'name']) AS k, unnest([0, 1, 2, 3]) AS i) x
    WHERE k = 'type' OR k IN (SELECT key FROM (SELECT key, {order_sql(2, "o.p_partkey", "key")} AS h FROM (SELECT unnest(['size', 'brand', 'name']) AS key)) ORDER BY h LIMIT 2)) AS fitted
FROM o GROUP BY p_partkey""")
def shuffle_and_fit_options(t):
    """Four options in hash order, and three of them that keep the gold one."""
    opts = records.options([(k, "") for k in ("size", "brand", "type", "name")])
    keys = lambda c: F.array_join(F.transform(c, lambda o: o["key"]), ";")
    return t("part").select("p_partkey", keys(augment.shuffled(opts, 1, F.col("p_partkey"))).alias("shuffled"), keys(augment.fitted(opts, F.lit("type"), 3, 2, F.col("p_partkey"))).alias("fitted"))


@query(f"""
WITH u AS (SELECT doc_id, lang, {HEX8.format(order_sql(4, "doc_id"))} / 4294967296.0 AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.05 THEN 'none_of_the_above' ELSE lang END AS label, CASE WHEN u < 0.05 THEN 4 WHEN u < 0.15 THEN 5 ELSE 4 END AS k FROM u""")
def none_option(t):
    """None of the above in place of gold for 5 %, beside it for 10 %."""
    rows = t("documents").select("doc_id", F.col("lang").alias("label"), records.options(_LANGS).alias("options"))
    return augment.with_none(rows, 0.05, 0.1, 4, F.col("doc_id")).select("doc_id", "label", F.size("options").alias("k"))


@query(f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {order_sql(3, "doc_id")}, doc_id::VARCHAR) - 1 AS r FROM documents)
SELECT string_agg(doc_id, '+' ORDER BY r) AS id, count(*)::INT AS questions, count(*)::VARCHAR AS packed FROM r GROUP BY r // 3""")
def pack_records(t):
    """Three records in one."""
    made = records.choice_records(t("documents"), source="documents", state=F.col("text"), instructions="Which language?", choices=_LANGS, label=F.col("lang"), id_=F.col("doc_id").cast("string"))
    return augment.packed(made, 3, 3).select("id", F.size("questions").alias("questions"), F.col("meta")["packed"].alias("packed"))


@query(f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {order_sql(5, "doc_id")}, doc_id::VARCHAR) - 1 AS r FROM documents),
c AS (SELECT *, {HEX8.format(order_sql("5:coin", "r // 12"))} / 4294967296.0 < 0.5 AS coin, 2 + floor({HEX8.format(order_sql("5:size", "r // 12"))} / 4294967296.0 * 3)::INT AS size FROM r),
p AS (SELECT *, CASE WHEN coin THEN (r // 12) * 12 + (r % 12) // size ELSE 1000000000 + r END AS pack FROM c)
SELECT string_agg(doc_id, '+' ORDER BY r) AS id, count(*)::INT AS questions FROM p GROUP BY pack""")
def pack_by_coin(t):
    """Half of the runs of twelve records packed two to four at a time."""
    made = records.choice_records(t("documents"), source="documents", state=F.col("text"), instructions="Which language?", choices=_LANGS, label=F.col("lang"), id_=F.col("doc_id").cast("string"))
    return augment.packed_by_coin(made, 0.5, 4, 5).select("id", F.size("questions").alias("questions"))


@query(f"""
WITH r AS (SELECT doc_id, n_chars, {order_sql(1, "doc_id")} AS h, row_number() OVER (ORDER BY {order_sql(1, "doc_id")}, doc_id) AS r FROM documents),
c AS (SELECT *, (r - 1) // 64 AS chunk FROM r), b AS (SELECT *, (row_number() OVER (PARTITION BY chunk ORDER BY n_chars, h, doc_id) - 1) // 8 AS batch FROM c)
SELECT doc_id, chunk, batch FROM (SELECT *, count(*) OVER (PARTITION BY chunk, batch) AS n FROM b) WHERE n = 8""")
def length_batches(t):
    """Batches of eight documents of like length, inside chunks of 64."""
    return augment.length_batches(t("documents").select("doc_id", "n_chars"), F.col("n_chars"), 8, 1, F.col("doc_id"), chunk=8).select("doc_id", "chunk", "batch")


@query(f"""
WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY {order_sql(6, "doc_id")}, doc_id) AS r, count(*) OVER () AS n FROM documents),
p AS (SELECT a.doc_id, a.source, min_by(b.source, (b.r - a.r + a.n) % a.n) AS other FROM r a JOIN r b ON a.source <> b.source GROUP BY ALL)
SELECT doc_id, source, other FROM p""")
def shuffle_audio_ablation(t):
    """Every document gets the next different source in hash order, around the end."""
    return augment.next_different(t("documents").select("doc_id", "source"), "source", 6, F.col("doc_id"), digits=2).select("doc_id", "source", "other")


# ---- context ----------------------------------------------------------------------------------


@query("""
SELECT conv_id, turn, coalesce(array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), ','), '') AS history,
  right(coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 200) AS transcript FROM conversations""")
def dialogue_prefix(t):
    """The four roles before each turn, and the last 200 characters of what was said."""
    rows = history.last_items(t("conversations"), "conv_id", ["turn"], F.col("role"), 4)
    rows = history.running_transcript(rows, "conv_id", ["turn"], F.concat("role", F.lit(": "), "text"), most=200)
    return rows.select("conv_id", "turn", F.array_join("history", ",").alias("history"), "transcript")


@query("""SELECT conv_id, turn, coalesce(array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ','), '') AS later FROM conversations""")
def later_steps(t):
    """The three roles after each turn."""
    return history.later_steps(t("conversations"), "conv_id", "turn", "role", 3).select("conv_id", "turn", F.array_join("later", ",").alias("later"))


@query(f"""
WITH p AS (SELECT conv_id, max(text) FILTER (turn = 0) AS a, max(text) FILTER (turn = 1) AS b FROM conversations GROUP BY conv_id)
SELECT conv_id, {HEX8.format(order_sql(2, "conv_id"))} % 2 = 1 AS swapped, sha1(CASE WHEN {HEX8.format(order_sql(2, "conv_id"))} % 2 = 1 THEN b ELSE a END) AS first_sha1 FROM p WHERE a <> b""")
def preference_swap(t):
    """Two answers in the order of a coin by hash; equal ones go."""
    first = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    pairs = t("conversations").groupBy("conv_id").agg(first(0).alias("a"), first(1).alias("b")).filter("a <> b")
    coin = F.conv(F.substring(order_key(2, F.col("conv_id")), 1, 8), 16, 10).cast("long") % 2 == 1
    return pairs.select("conv_id", coin.alias("swapped"), F.sha1(F.when(coin, F.col("b")).otherwise(F.col("a"))).alias("first_sha1"))


@query("""
WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, a / n AS p_click, b / n AS p_view, (n - a - b) / n AS p_other, CASE WHEN a >= b AND a >= n - a - b THEN 'click' WHEN b >= n - a - b THEN 'view' ELSE 'other' END AS winner FROM c""")
def vote_soft_targets(t):
    """Votes as soft targets; of equal counts the first option wins."""
    labels = ["click", "view", "other"]
    rows = votes.vote_targets(t("events"), "user_id", F.col("event_type"), labels)
    return rows.select("user_id", *[F.col("probs")[i].alias(f"p_{k}") for i, k in enumerate(labels)], "winner")


@query("""
WITH s AS (SELECT l_partkey, s_nationkey % 3 AS tier, l_quantity / 50 AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT l_partkey, coalesce(['fast', 'mid', 'strong'][1 + min(tier) FILTER (score >= 0.8)], 'strong') AS tier FROM s GROUP BY l_partkey""")
def cheapest_success(t):
    """The cheapest tier that reaches 0.8 for each part, strong if none does."""
    rows = t("lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return votes.cheapest(rows, "l_partkey", F.col("s_nationkey") % 3, F.col("l_quantity") / 50 >= 0.8, ["fast", "mid", "strong"])


@query("""
WITH f AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT user_id, min_by(event_type, (n, event_type)) AS rarest FROM (SELECT DISTINCT user_id, event_type FROM events) JOIN f USING (event_type) GROUP BY user_id""")
def rarest_label(t):
    """Each user's type that is rarest of all, ties by name."""
    return votes.rarest(t("events"), "user_id", "event_type")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, event_type AS mode FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def mode_first_wins(t):
    """Each user's most frequent type, of equals the one that came first."""
    return votes.modes(t("events"), "user_id", "event_type", "event_id")


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING count(*) >= 20""")
def vocabulary(t):
    """Types with a least count."""
    return votes.vocabulary(t("events"), "event_type", 20)


@query("""
WITH s AS (SELECT * FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 = 2)
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS answers FROM s WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY o_custkey""")
def lookup_over_splits(t):
    """For the customers of one split, the answers that any of three splits gives."""
    splits = [t("orders").filter(F.col("o_orderkey") % 3 == k) for k in range(3)]
    found = votes.answers_over_splits(splits, "o_custkey", "o_orderpriority")
    return splits[0].select("o_custkey").distinct().join(found, "o_custkey").select("o_custkey", F.array_join("answers", ";").alias("answers"))


@query("""
SELECT user_id, event_type, epoch_us(ts) // 1000000 AS "start", epoch_us(ts) // 1000000 + event_id % 7 * 60 AS "end" FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7 DESC, ts, event_id) AS r FROM events) WHERE r = 1""")
def longest_interval(t):
    """Each user's longest interval, of equals the first."""
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    rows = t("events").select("user_id", "event_type", start.alias("start"), (start + F.col("event_id") % 7 * 60).alias("end"))
    return intervals.longest(rows, "user_id", "start", "end")


@query("""
WITH p AS (SELECT p_partkey, p_type AS gold, unnest(list_distinct([p_name, p_brand, p_type || ' x', 'size ' || p_size, p_brand || ' 12 ' || p_name])) AS x FROM part),
d AS (SELECT p_partkey, x, abs(len(regexp_split_to_array(trim(x), '\\s+')) - len(regexp_split_to_array(trim(gold), '\\s+'))) + CASE WHEN regexp_matches(x, '[0-9]') <> regexp_matches(gold, '[0-9]') THEN 2 ELSE 0 END AS far FROM p WHERE x <> gold)
SELECT p_partkey, string_agg(x, ';' ORDER BY far, x) AS options FROM d GROUP BY p_partkey""")
def nearest_by_length(t):
    """Texts about a part, those most like its type in length and kind first."""
    texts = F.array_distinct(F.array("p_name", "p_brand", F.concat("p_type", F.lit(" x")), F.concat(F.lit("size "), F.col("p_size").cast("string")), F.concat("p_brand", F.lit(" 12 "), "p_name")))
    return t("part").select("p_partkey", F.array_join(distractors.by_distance(texts, F.col("p_type")), ";").alias("options"))


@query(f"""
WITH b AS (SELECT p_partkey, unnest(range(1, 9)) AS i FROM part),
g AS (SELECT p_partkey, i, (p_partkey * 31 + i * i * 47) % 300 AS x, (p_partkey * 17 + i * 71) % 200 AS y, 4 + (p_partkey + i * 13) % 60 AS w, 5 + (p_partkey * 3 + i * 7) % 40 AS h, 'el' || (i % 6) AS text FROM b),
m AS (SELECT p_partkey, i, x, y, w, h, text, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN i = 8 THEN 0 ELSE 1 END, {order_sql(2, "p_partkey", "text", "x", "y")}) AS r FROM g WHERE i = 8 OR w >= 6 AND h >= 6 AND w * h < 0.3 * 320 * 240),
l AS (SELECT p_partkey, list({{'x': x, 'y': y, 'w': w, 'h': h, 't': text}} ORDER BY r) AS l FROM m GROUP BY p_partkey)
SELECT p_partkey, array_to_string(list_transform(list_reduce(list_prepend([l[1]], list_transform(l[2:], lambda b: [b])), lambda a, n: CASE WHEN len(a) <= 3 AND len(list_filter(a, lambda t: t.t = n[1].t
    OR greatest(least(t.x + t.w, n[1].x + n[1].w) - greatest(t.x, n[1].x), 0) * greatest(least(t.y + t.h, n[1].y + n[1].h) - greatest(t.y, n[1].y), 0) >= 0.3 * greatest(least(t.w * t.h, n[1].w * n[1].h), 1))) = 0 THEN list_concat(a, n) ELSE a END), lambda b: b.t), ';') AS marks FROM l""")
def spread_boxes(t):
    """A box and up to three others that lie apart, each with a text of its own."""
    box = lambda i: F.struct(((F.col("p_partkey") * 31 + i * i * 47) % 300).alias("x"), ((F.col("p_partkey") * 17 + i * 71) % 200).alias("y"), (4 + (F.col("p_partkey") + i * 13) % 60).alias("w"), (5 + (F.col("p_partkey") * 3 + i * 7) % 40).alias("h"), F.lit(f"el{i % 6}").alias("text"))
    made = distractors.spread_boxes(box(8), F.array(*[box(i) for i in range(1, 8)]), 3, F.lit(320), F.lit(240), 2, F.col("p_partkey"))
    return t("part").select("p_partkey", F.array_join(F.transform(made, lambda b: b["text"]), ";").alias("marks"))


# ---- intervals --------------------------------------------------------------------------------

_SPANS = "SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 60 * (1 + event_id % 5) AS e FROM events"


def _spans(t) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t("events").select("user_id", "event_id", start.alias("start"), (start + 60 * (1 + F.col("event_id") % 5)).alias("end"))


@query(f"""
WITH s AS ({_SPANS}), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s),
i AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS island FROM m)
SELECT user_id, island::BIGINT AS island, round(min(s), 3) AS "start", round(max(e), 3) AS "end", count(*) AS n FROM i GROUP BY user_id, island""")
def merge_windows(t):
    """Intervals of a user merged over gaps up to an hour."""
    out = intervals.islands(_spans(t), ["user_id"], "start", "end", 3600)
    return out.withColumn("start", F.round("start", 3)).withColumn("end", F.round("end", 3))


@query(f"""
WITH s AS ({_SPANS})
SELECT a.event_id AS a, b.event_id AS b, round(least(a.e, b.e) - greatest(a.s, b.s), 3) AS overlap FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e""")
def interval_overlap(t):
    """Pairs of overlapping intervals of a user."""
    s = _spans(t)
    met = intervals.overlapping(s, s.withColumnRenamed("event_id", "other"), ["user_id"], 300.0).filter("event_id < other")
    return met.select(F.col("event_id").alias("a"), F.col("other").alias("b"), F.round(F.least("end", "end_b") - F.greatest("start", "start_b"), 3).alias("overlap"))


@query("""
WITH s AS (SELECT event_type, user_id % 5 AS member, unnest(range((epoch_us(ts) / 1e6 / 600)::BIGINT, (epoch_us(ts) / 1e6 / 600)::BIGINT + 3)) AS tick FROM events),
c AS (SELECT event_type, tick, count(DISTINCT member) AS a FROM s GROUP BY ALL)
SELECT c.event_type, first(m) AS members, (count(*) FILTER (a >= 2) * 600)::DOUBLE AS busy FROM c JOIN (SELECT event_type, count(DISTINCT user_id % 5) AS m FROM events GROUP BY 1) USING (event_type) GROUP BY c.event_type""")
def busy_seconds(t):
    """Time in which two members at least are active, in bins of ten minutes."""
    tick = F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 600) * 600
    s = t("events").select("event_type", (F.col("user_id") % 5).alias("member"), tick.alias("start"), (tick + 1200).alias("end"))
    return intervals.busy_seconds(s, "event_type", "member", 600.0)


@query("""
WITH p AS (SELECT p_partkey, (p_partkey * 37) % 100 AS x, (p_partkey * 53) % 100 AS y FROM part),
b AS (SELECT i, (i * 10) % 70 AS bx, (i * 7) % 60 AS by_, 20 + i AS w, 15 + (i * 3) % 20 AS h FROM range(0, 12) r(i))
SELECT p_partkey, min_by(i, (w * h, bx)) AS box FROM p LEFT JOIN b ON bx <= x AND x <= bx + w AND by_ <= y AND y <= by_ + h GROUP BY p_partkey""")
def smallest_box(t):
    """The smallest box that holds each point."""
    box = lambda i: F.struct(*[F.lit(v).cast("long").alias(n) for n, v in (("x", i * 10 % 70), ("y", i * 7 % 60), ("w", 20 + i), ("h", 15 + i * 3 % 20), ("i", i))])
    rows = t("part").select("p_partkey", (F.col("p_partkey") * 37 % 100).alias("px"), (F.col("p_partkey") * 53 % 100).alias("py"), F.array(*[box(i) for i in range(12)]).alias("boxes"))
    return rows.select("p_partkey", intervals.containing_box(rows, "boxes", F.col("px"), F.col("py"))["i"].alias("box"))


# ---- scores -----------------------------------------------------------------------------------


def _scored(t) -> DataFrame:
    """Vectors as logits of eight options, with labels as targets."""
    kind = F.when(F.col("vec_id") % 3 == 0, "score").otherwise("choice")
    meta = F.create_map(F.lit("parity"), (F.col("label") % 2).cast("string"), F.lit("third"), (F.col("vec_id") % 3).cast("string"), F.lit("one"), F.lit("x"), F.lit("again"), F.concat((F.col("label") % 2).cast("string")))
    logits = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 4)
    return t("embeddings").select("vec_id", (F.floor(F.col("vec_id") / 4)).cast("string").alias("id"), (F.col("vec_id") % 4).cast("string").alias("name"), kind.alias("type"), logits.alias("logits"), (F.col("label") % 8).alias("target"), F.lit(None).cast("array<double>").alias("soft"), meta.alias("meta"))


_Z = "list_transform(embedding[1:8], lambda x: x::DOUBLE * 4)"
_SCORED = f"""z AS (SELECT vec_id, label % 8 AS label, {_Z} AS z FROM embeddings),
e AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z),
p AS (SELECT vec_id, label, z, list_transform(e, lambda x: x / list_sum(e)) AS p, list_position(z, list_max(z)) - 1 AS pred FROM e)"""
_BIN = "CASE " + " ".join(f"WHEN conf > {b / 10} THEN {b}" for b in range(9, 0, -1)) + " ELSE 0 END"


@query(f"""
WITH {_SCORED}
SELECT vec_id, pred::VARCHAR AS answer, round(list_max(p), 6) AS top, round((list_max(p) - 1.0 / 8) / (1 - 1.0 / 8), 6) AS confidence,
  CASE WHEN vec_id % 3 = 0 THEN round(list_sum(list_transform(range(8), lambda i: p[i + 1] * i)), 6) END AS value FROM p""")
def probs_answers(t):
    """Probabilities and typed answers."""
    rows = _scored(t).withColumn("probs", S.softmax(F.col("logits"))).withColumn("labels", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i.cast("string")))
    out = metrics.answers(rows)
    return out.select("vec_id", "answer", F.round(F.array_max("probs"), 6).alias("top"), F.round("confidence", 6).alias("confidence"), F.round("value", 6).alias("value"))


@query(f"""
WITH {_SCORED}, m AS (SELECT (pred = label)::INT AS hit, list_max(p) AS conf,
    list_sum(list_transform(range(8), lambda i: (p[i + 1] - (i = label)::INT) * (p[i + 1] - (i = label)::INT))) AS brier, -ln(greatest(p[label + 1], 1e-12)) AS nll FROM p),
b AS (SELECT {_BIN} AS bin, count(*) AS c, avg(hit) AS acc, avg(conf) AS cf FROM m GROUP BY 1), c AS (SELECT sum(c * abs(acc - cf)) / sum(c) AS ece FROM b)
SELECT count(*) AS n, round(avg(hit), 6) AS accuracy, 0.125::DOUBLE AS chance, round(avg(brier), 6) AS brier, round(avg(nll), 6) AS nll, round(first(ece), 6) AS ece, round(greatest(0, (avg(hit) - 0.125) / 0.875), 6) AS skill FROM m, c""")
def summary_metrics(t):
    """The headline metrics."""
    out = metrics.summary(_scored(t))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "chance", "brier", "nll", "ece", "skill")])


@query(f"""
WITH {_SCORED}, r AS (SELECT vec_id % 4 AS name, label AS c, 1 AS g, 0 AS q, (label = pred)::INT AS tp FROM p UNION ALL SELECT vec_id % 4, pred, 0, 1, 0 FROM p),
f AS (SELECT name, c, 2 * sum(tp) / (sum(g) + sum(q)) AS f1 FROM r GROUP BY ALL)
SELECT round(avg(f1), 6) AS macro_f1 FROM (SELECT name, avg(f1) AS f1 FROM f GROUP BY name)""")
def macro_f1(t):
    """Macro F1 over question names."""
    return metrics.macro_f1(_scored(t)).select(F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""WITH {_SCORED} SELECT round(avg(a::INT), 6) AS case_exact FROM (SELECT vec_id // 4 AS id, bool_and(pred = label) AS a FROM p GROUP BY 1)""")
def case_exact(t):
    """The share of records without a wrong decision."""
    return metrics.case_exact(_scored(t)).select(F.round("case_exact", 6).alias("case_exact"))


@query(f"""
WITH {_SCORED} SELECT 'parity' AS key, (label % 2)::VARCHAR AS value, count(*) AS n, round(avg((pred = label)::INT), 6) AS accuracy FROM p GROUP BY 1, 2
UNION ALL SELECT 'third', (vec_id % 3)::VARCHAR, count(*), round(avg((pred = label)::INT), 6) FROM p GROUP BY 1, 2""")
def breakdown(t):
    """Accuracy by meta key; a key with one value and one that repeats another go."""
    return metrics.breakdown(_scored(t), ["parity", "third", "one", "again"]).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""
WITH z AS (SELECT label % 8 AS label, {_Z} AS z FROM embeddings), g AS (SELECT i, 10 ** (log10(0.25) + i * (log10(8) - log10(0.25)) / 160) AS t FROM range(161) r(i)),
n AS (SELECT i, t, avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / t)))) - (z[label + 1] - list_max(z)) / t) AS nll FROM z, g GROUP BY i, t)
SELECT min_by(i, (nll, i))::INT AS step, round(min_by(t, (nll, i)), 6) AS temperature, round(min(nll), 6) AS nll FROM n""")
def temperature_fit(t):
    """The temperature of the least NLL on the grid."""
    out = metrics.fitted_temperature(_scored(t))
    return out.select("step", F.round("temperature", 6).alias("temperature"), F.round("nll", 6).alias("nll"))


@query(f"""
WITH {_SCORED}, q AS (SELECT vec_id, label, p, list_transform(range(8), lambda i: (i = label)::INT::DOUBLE) AS q FROM p),
c AS (SELECT vec_id, p, q, list_transform(range(1, 8), lambda j: list_sum(p[1:j]) - list_sum(q[1:j])) AS d FROM q)
SELECT vec_id, round(-ln(greatest(list_sum(list_transform(range(1, 9), lambda i: p[i] * q[i])), 1e-12)), 6) AS ce,
  round(list_sum(list_transform(range(1, 9), lambda i: (p[i] - q[i]) * (p[i] - q[i]))), 6) AS brier,
  round(list_sum(list_transform(range(1, 9), lambda i: -(q[i] * 0.9 + 0.1 / 8) * ln(greatest(p[i], 1e-12)))), 6) AS ce_smooth,
  round(list_sum(list_transform(d, lambda x: x * x)) / 7, 6) AS rps FROM c""")
def losses_rps(t):
    """Losses of each decision by name."""
    rows = _scored(t).withColumn("p", S.softmax(F.col("logits"))).withColumn("q", S.one_hot(F.col("target"), F.size("logits")))
    return rows.select("vec_id", *[F.round(S.LOSSES[k](F.col("p"), F.col("q")), 6).alias(k) for k in ("ce", "brier", "ce_smooth", "rps")])


@query(f"""
WITH {_SCORED}, s AS (SELECT p, list_transform(range(8), lambda i: CASE WHEN i = label THEN 0.65 ELSE 0.05 END) AS q FROM p),
m AS (SELECT list_sum(list_transform(range(1, 9), lambda i: abs(p[i] - q[i]))) / 2 AS tvd, list_sum(list_transform(range(1, 9), lambda i: p[i] * p[i] - 2 * p[i] * q[i] + q[i])) AS b, list_max(p) AS conf, q[list_position(p, list_max(p))] AS acc FROM s),
x AS (SELECT {_BIN} AS bin, count(*) AS c, avg(acc) AS a, avg(conf) AS f FROM m GROUP BY 1), y AS (SELECT sum(c * abs(a - f)) / sum(c) AS ece FROM x)
SELECT count(*) AS n, round(avg(tvd), 6) AS tvd, round(avg(b), 6) AS expected_brier, round(first(ece), 6) AS expected_ece, round(1 - avg(tvd), 6) AS score FROM m, y""")
def soft_metrics(t):
    """Metrics against soft targets."""
    soft = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == F.col("target"), 0.65).otherwise(0.05))
    out = metrics.soft_summary(_scored(t).withColumn("soft", soft))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("tvd", "expected_brier", "expected_ece", "score")])


@query(f"""
WITH {_SCORED}, b AS (SELECT 'b' || (vec_id % 3) AS benchmark, count(*) AS n, avg((pred = label)::INT) AS value FROM p GROUP BY 1),
w AS (SELECT unnest(['b0', 'b1', 'b2', 'b3']) AS benchmark, unnest(['accuracy', 'accuracy', 'macro_f1', 'accuracy']) AS metric, 1000 AS expected)
SELECT benchmark, metric, coalesce(n, 0) AS n, round(coalesce(n, 0) / expected, 6) AS coverage, round(CASE metric WHEN 'accuracy' THEN value * n / expected ELSE value END, 6) AS score, round(coalesce(value * n / expected, 0), 6) AS score_strict FROM w LEFT JOIN b USING (benchmark)""")
def coverage_scores(t):
    """Scores times coverage by benchmark."""
    by = metrics.scored(_scored(t)).groupBy(F.concat(F.lit("b"), (F.col("vec_id") % 3).cast("string")).alias("benchmark")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("value"))
    bench = t("region").filter("r_regionkey < 4").select(F.concat(F.lit("b"), F.col("r_regionkey").cast("string")).alias("benchmark"), F.when(F.col("r_regionkey") == 2, "macro_f1").otherwise("accuracy").alias("metric"), F.lit(1000).alias("expected"))
    out = metrics.coverage(bench, by)
    return out.select("benchmark", "metric", "n", *[F.round(c, 6).alias(c) for c in ("coverage", "score", "score_strict")])


@query(f"""
WITH {_SCORED}, s AS (SELECT 'm' || (vec_id % 2) AS model, vec_id % 3 AS b, avg((pred = label)::INT) AS a FROM p GROUP BY ALL)
SELECT model, round(max(a) FILTER (b = 0), 6) AS b0, round(max(a) FILTER (b = 1), 6) AS b1, round(max(a) FILTER (b = 2), 6) AS b2, round(avg(a), 6) AS average FROM s GROUP BY model""")
def pivot_leaderboard(t):
    """A row for each model, a column for each benchmark, and the mean."""
    s = metrics.scored(_scored(t)).groupBy(F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model"), F.concat(F.lit("b"), (F.col("vec_id") % 3).cast("string")).alias("b")).agg(F.avg(F.col("hit").cast("double")).alias("a"))
    out = metrics.leaderboard(s, "model", "b", "a", ["b0", "b1", "b2"])
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("b0", "b1", "b2", "average")])


# ---- text, JSON, streams ----------------------------------------------------------------------


@query("""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")
def html_text(t):
    """Pages as plain text."""
    return t("pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@query("""SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, (props::JSON ->> 'k')::BIGINT // 10 AS band FROM events""")
def json_props(t):
    """A number in JSON, and its band."""
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").select("event_id", k.alias("k"), F.floor(k / 10).alias("band"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS "start", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling(t):
    """Counts by hour and type; the same function runs on a stream with a watermark."""
    return tumbling(t("events")).withColumn("total", F.round("total", 4))


@query("""
SELECT p_partkey, lower(trim(regexp_replace(p_name, '[_-]+', ' ', 'g'))) AS human, array_to_string(regexp_split_to_array(trim(p_name), '\\s+')[1:2], ' ') AS two,
  CASE WHEN length(p_name) > 8 THEN '…' || right(p_name, 8) ELSE p_name END AS tail, CASE WHEN p_size >= 10 THEN 1 ELSE 0 END + CASE WHEN p_size >= 30 THEN 1 ELSE 0 END AS band,
  round_even(p_retailprice / 7, 0)::BIGINT AS half_even, array_to_string(list_transform(range(4), lambda i: floor((i + 0.5) * p_size / 4)::INT), ',') AS picks FROM part""")
def scalar_functions(t):
    """Text and number functions side by side."""
    name = F.col("p_name")
    picks = F.array_join(F.transform(X.even_picks(F.col("p_size"), 4), lambda x: x.cast("string")), ",")
    return t("part").select("p_partkey", X.humanised(name).alias("human"), X.head_words(name, 2).alias("two"), X.tail(name, 8).alias("tail"), X.bucketised(F.col("p_size"), [10, 30]).alias("band"), F.bround(F.col("p_retailprice") / 7).cast("long").alias("half_even"), picks.alias("picks"))


@query("""
WITH m AS (SELECT p_partkey, p_size, p_partkey % 9 + 1 AS k, p_partkey % 6 AS form FROM part),
n AS (SELECT *, ['llama-' || p_size || 'b-chat', 'Mixtral_' || k || 'x' || p_size || 'B', 'gpt-4-part' || p_partkey, 'GPT-3.5_' || p_size, 'nameless-' || p_size, 'claude-3-haiku-' || p_size || 'b'][form + 1] AS name FROM m)
SELECT p_partkey, name, CASE form WHEN 0 THEN CASE WHEN p_size < 8 THEN 'fast' WHEN p_size < 40 THEN 'mid' ELSE 'strong' END WHEN 1 THEN CASE WHEN k * p_size < 70 THEN 'mid' ELSE 'strong' END WHEN 2 THEN 'strong' WHEN 4 THEN NULL ELSE 'fast' END AS tier FROM n""")
def model_tiers(t):
    """Tiers of model names: by size, by experts times size, by name, and of none."""
    size, k = F.col("p_size").cast("string"), (F.col("p_partkey") % 9 + 1).cast("string")
    forms = F.array(F.concat(F.lit("llama-"), size, F.lit("b-chat")), F.concat(F.lit("Mixtral_"), k, F.lit("x"), size, F.lit("B")), F.concat(F.lit("gpt-4-part"), F.col("p_partkey").cast("string")), F.concat(F.lit("GPT-3.5_"), size), F.concat(F.lit("nameless-"), size), F.concat(F.lit("claude-3-haiku-"), size, F.lit("b")))
    return t("part").select("p_partkey", F.element_at(forms, (F.col("p_partkey") % 6 + 1).cast("int")).alias("name")).withColumn("tier", tiers.tier_of(F.col("name")))


@query(f"""
SELECT lang, source, count(*) AS n FROM (SELECT lang, source, {PRINT.format("text")} AS k FROM documents) GROUP BY lang, source HAVING count(*) > count(DISTINCT k)
UNION ALL SELECT lang, NULL, count(*) FROM documents GROUP BY lang""")
def repeated_texts(t):
    """Languages and sources with texts that repeat, and all languages."""
    rows = t("documents").select("lang", "source", X.fingerprint(F.col("text")).alias("k"))
    dup = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("d")).filter("n > d").select("lang", "source", "n")
    return dup.unionByName(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", F.lit(None).cast("string").alias("source"), "n"))


# ---- filters, lookups, the batch scorer -------------------------------------------------------


@query("""SELECT doc_id, n_chars FROM documents WHERE length(text) <= 5000""")
def length_budget(t):
    """Documents within a budget of characters."""
    return filters.within_budget(t("documents"), F.col("text"), 5000).select("doc_id", "n_chars")


@query("""SELECT event_id, value >= 50 AS positive FROM events WHERE value >= 50 OR value < 10""")
def confidence_band(t):
    """Events of clear value; those between are no example."""
    return t("events").select("event_id", filters.confident(F.col("value"), 10, 50).alias("positive")).filter("positive is not null")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE greatest(l_quantity, l_tax * 100) >= 2 * least(l_quantity, l_tax * 100) AND abs(l_discount - l_tax) >= 0.02""")
def clear_differences(t):
    """Lines whose two numbers differ by a factor, and two others by a gap."""
    far = filters.apart(F.col("l_quantity"), F.col("l_tax") * 100, 2.0, ratio=True) & filters.apart(F.col("l_discount"), F.col("l_tax"), 0.02)
    return t("lineitem").filter(far).select("l_orderkey", "l_linenumber")


@query("""
WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, string_split(a.p_name, ' ') AS x, string_split(b.p_name, ' ') AS y FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey),
w AS (SELECT a, b, list_distinct(list_filter(regexp_split_to_array(lower(array_to_string(x, ' ')), '[^a-z0-9]+'), lambda v: v <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(array_to_string(y, ' ')), '[^a-z0-9]+'), lambda v: v <> '')) AS y FROM p)
SELECT a, b FROM w WHERE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) <= 0.5""")
def paraphrase_rejection(t):
    """Neighbouring names that are no paraphrase of one another."""
    p = t("part").select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"))
    q = t("part").select(F.col("p_partkey").alias("b"), (F.col("p_partkey") - 1).alias("a"), F.col("p_name").alias("y"))
    return p.join(q, "a").filter(filters.not_paraphrase(F.col("x"), F.col("y"))).select("a", "b")


@query("""
SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_nationkey % 3 = y.n_nationkey % 3 AND x.n_nationkey <> y.n_nationkey WHERE x.n_regionkey <> y.n_regionkey""")
def confusable_exclusion(t):
    """Pairs of nations, but for those of one region."""
    n = t("nation").select("n_nationkey", (F.col("n_nationkey") % 3).alias("k"))
    pairs = n.withColumnRenamed("n_nationkey", "a").join(n.withColumnRenamed("n_nationkey", "b"), "k").select("a", "b")
    groups = t("nation").select(F.col("n_regionkey").alias("group"), F.col("n_nationkey").alias("class"))
    return filters.allowed_pairs(pairs, "a", "b", groups)


@query("""SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def strict_lookup(t):
    """Orders with their customer's segment; a missing customer would be an error."""
    customers = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return filters.looked_up(t("orders").select("o_orderkey", "o_custkey"), customers, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("""WITH k AS (SELECT unnest([0, 1, 2, 3, 4]) AS i, unnest(['one', 'id', 'some', 'source', 'lang']) AS key, unnest(['x', doc_id::VARCHAR, CASE WHEN doc_id % 2 = 0 THEN lang END, source, lang]) AS value FROM documents),
t AS (SELECT i, key, count(DISTINCT value) AS values, count(value) AS rows, count(*) AS all_ FROM k GROUP BY i, key)
SELECT key, values, rows FROM t WHERE rows = all_ AND values BETWEEN 2 AND 60 ORDER BY i LIMIT 1""")
def group_key_choice(t):
    """The first key that all rows have and that has neither too few nor too many values."""
    rows = t("documents").select(F.create_map(F.lit("one"), F.lit("x"), F.lit("id"), F.col("doc_id").cast("string"), F.lit("some"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")).alias("meta"))
    return filters.best_group_key(rows, ["one", "id", "some", "source", "lang"])


@query("""SELECT event_id // 100 AS "window", round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1""")
def window_means(t):
    """Means over windows of a hundred steps."""
    return filters.window_means(t("events"), "event_id", "value", 100).withColumn("mean", F.round("mean", 6))


@query("""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN 422 WHEN length(text) > 2000 THEN 413 ELSE 200 END AS s FROM documents)
SELECT s AS status, CASE s WHEN 413 THEN 'too large' WHEN 422 THEN 'no state' END AS error, count(*) AS n FROM d GROUP BY s""")
def request_checks(t):
    """Requests by status: good, invalid, too large."""
    return scorer.checked(_doc_records(t), most_chars=2000).groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_SCORED}, q AS (SELECT list_transform(z[1:4], lambda x: exp(x - list_max(z[1:4]))) AS e, z[1:4] AS z, substr(sha1('documents|' || doc_id), 1, 16) AS id FROM p JOIN documents ON vec_id = doc_id)
SELECT id, ['de', 'en', 'es', 'fr'][list_position(z, list_max(z))] AS answer, round((list_max(e) / list_sum(e) - 0.25) / 0.75, 6) AS confidence FROM q""")
def batch_scores(t):
    """Answers to the questions of good requests."""
    logits = _scored(t).join(t("documents").select("doc_id"), F.col("vec_id") == F.col("doc_id")).select(stable_id(F.lit("documents"), F.col("doc_id")).alias("id"), F.lit("answer").alias("name"), "logits")
    out = scorer.scored(_doc_records(t), logits)
    return out.select("id", "answer", F.round("confidence", 6).alias("confidence"))


@query("""SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band,
  CASE json_type(j::JSON) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind
FROM (SELECT *, [props, '[' || event_id || ']', '"' || event_type || '"', event_id::VARCHAR, value::VARCHAR, 'true', 'null'][event_id % 7 + 1] AS j FROM events)""")
def bands_and_types(t):
    """Bands of a value, and the type of a JSON text: an object, an array, a text, numbers, a truth value, null."""
    texts = F.array("props", F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")), F.concat(F.lit('"'), "event_type", F.lit('"')), F.col("event_id").cast("string"), F.col("value").cast("string"), F.lit("true"), F.lit("null"))
    return t("events").select("event_id", X.banded(F.col("value"), [10, 50], ["low", "mid", "high"]).alias("band"), X.json_type(F.element_at(texts, (F.col("event_id") % 7 + 1).cast("int"))).alias("kind"))


@query("""
WITH a AS (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_totalprice > 100000)
SELECT 'union' AS op, p FROM (SELECT p FROM a UNION SELECT p FROM b) UNION ALL SELECT 'intersect', p FROM (SELECT p FROM a INTERSECT SELECT p FROM b) UNION ALL SELECT 'except', p FROM (SELECT p FROM a EXCEPT SELECT p FROM b)""")
def set_operations(t):
    """Union, intersection and difference of two key sets: each key is told once which sets it is in, so that no rows of a frequent key meet in a join."""
    among = lambda those: F.coalesce(F.bool_or(F.expr(those)), F.lit(False))
    keys = t("orders").groupBy(F.col("o_orderpriority").alias("p")).agg(among("o_orderkey % 3 = 0").alias("a"), among("o_totalprice > 100000").alias("b"))
    a, b = F.col("a"), F.col("b")
    ops = F.array(F.when(a | b, "union"), F.when(a & b, "intersect"), F.when(a & ~b, "except"))
    return keys.select(F.explode(F.filter(ops, lambda op: op.isNotNull())).alias("op"), "p")


@query(f"""
WITH h AS (SELECT user_id, event_id, event_type, {order_sql(3, "event_id")} AS h FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h, event_type) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM h)
SELECT a.event_id, min_by(b.event_type, (b.r - a.r + a.n) % a.n) AS other FROM r a JOIN r b ON a.user_id = b.user_id AND a.event_type <> b.event_type GROUP BY a.event_id""")
def same_group_pairs(t):
    """For each event, the type of the user's next event of another type in hash order, around the end."""
    rows = history.same_group_pairs(t("events"), "user_id", "event_type", order_key(3, F.col("event_id")))
    return rows.filter("size(others) > 0").select("event_id", F.element_at("others", 1).alias("other"))


# ---- templates of converters over fixture tables ----------------------------------------------


@query("""
WITH u AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS tools, min_by(event_type, event_id) AS tool FROM events GROUP BY user_id)
SELECT 'user ' || user_id AS request, tool AS label, least(len(tools), 8)::INT AS k FROM u WHERE len(tools) >= 2""")
def template_tools(t):
    """Which tool does a request need? A user's first event among all kinds of theirs."""
    rows = t("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("tools"), F.min_by("event_type", "event_id").alias("tool"))
    made = CONVERTERS.find("toolace")(rows.withColumn("query", F.concat(F.lit("user "), F.col("user_id").cast("string"))))
    return made.select(F.col("state").alias("request"), F.col("targets")[0]["label"].alias("label"), F.size(F.col("questions")[0]["options"]).alias("k"))


@query(f"""
WITH w AS (SELECT conv_id, turn, role, list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS later FROM conversations),
x AS (SELECT conv_id, turn, role, list_filter(later, lambda r, i: r <> role AND list_position(later, r) = i) AS wrong FROM w WHERE later IS NOT NULL),
o AS (SELECT conv_id, turn, role, unnest(list_prepend(role, wrong[1:3])) AS x FROM x WHERE len(wrong) > 0)
SELECT substr(sha1('mind2web|' || conv_id || '|' || turn), 1, 16) AS id, string_agg(x, ';' ORDER BY {order_sql(0, "conv_id", "turn", "x")}) AS options, first(role) AS gold FROM o GROUP BY conv_id, turn""")
def template_steps(t):
    """What comes next? Roles of a conversation as the steps of an episode."""
    made = CONVERTERS.find("mind2web")(t("conversations").select(F.col("conv_id").alias("task"), F.col("turn").alias("step"), F.col("role").alias("action")))
    opts = F.transform(F.col("questions")[0]["options"], lambda o: o["description"])
    at = F.substring(F.col("targets")[0]["label"], 5, 3).cast("int")
    return made.select("id", F.array_join(opts, ";").alias("options"), F.element_at(opts, at).alias("gold"))


@query(f"""
WITH p AS (SELECT p_partkey, floor({HEX8.format(order_sql(0, "'part ' || p_partkey || ' is #idiom# of type #idiom#'"))} / 4294967296.0 * 2)::INT AS gap, p_brand, p_type FROM part)
SELECT 'part ' || p_partkey || ' is ' || CASE gap WHEN 0 THEN '____' ELSE p_brand END || ' of type ' || CASE gap WHEN 1 THEN '____' ELSE p_type END AS state, CASE gap WHEN 0 THEN 'opt_1' ELSE 'opt_2' END AS label FROM p WHERE p_brand <> p_type""")
def template_gaps(t):
    """Which candidate fits the gap? The other gap is filled."""
    rows = t("part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string"), F.lit(" is #idiom# of type #idiom#")).alias("content"), F.array("p_brand", "p_type").alias("answers"), F.array("p_brand", "p_type", F.lit("neither")).alias("candidates"))
    return CONVERTERS.find("chid")(rows).select("state", F.col("targets")[0]["label"].alias("label"))


@query("""
WITH s AS (SELECT l_partkey, ['gpt-4o-mini', 'llama-8b', 'gpt-4o', 'nameless'][s_nationkey % 4 + 1] AS model, l_quantity / 50 AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
b AS (SELECT l_partkey, min(CASE model WHEN 'gpt-4o-mini' THEN 0 WHEN 'llama-8b' THEN 1 ELSE 2 END) FILTER (score >= 0.8) AS b FROM s WHERE model <> 'nameless' GROUP BY l_partkey)
SELECT 'part ' || l_partkey AS state, ['fast', 'mid', 'strong'][coalesce(b, 2) + 1] AS label FROM b""")
def template_routing(t):
    """Which tier of models does a request need? Quantities as scores of models."""
    model = F.element_at(F.array(*map(F.lit, ("gpt-4o-mini", "llama-8b", "gpt-4o", "nameless"))), (F.col("s_nationkey") % 4 + 1).cast("int"))
    rows = t("lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("prompt"), model.alias("model"), (F.col("l_quantity") / 50).alias("score"))
    return CONVERTERS.find("router")(rows).select("state", F.col("targets")[0]["label"].alias("label"))


@query("""SELECT doc_id, CASE lang WHEN 'de' THEN 'opt_1' WHEN 'en' THEN 'opt_2' ELSE 'opt_3' END AS label FROM documents WHERE length(text) <= 24000""")
def template_long_documents(t):
    """A choice about documents within a budget of characters."""
    rows = t("documents").select(F.col("text").alias("article"), F.col("doc_id").cast("string").alias("question"), F.array(*map(F.lit, ("German", "English", "another"))).alias("options"), F.when(F.col("lang") == "de", 1).when(F.col("lang") == "en", 2).otherwise(3).alias("gold_label"))
    made = CONVERTERS.find("quality")(rows)
    return made.select(F.get_json_object("state", "$.question").cast("long").alias("doc_id"), F.col("targets")[0]["label"].alias("label"))


@query("""
SELECT doc_id, unnest(['assignment', 'exclusivity', 'renewal']) AS name, unnest([CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END]) AS label FROM labels""")
def template_extraction(t):
    """Several yes/no questions on one state."""
    rows = t("labels").select(F.col("doc_id").cast("string").alias("clause"), F.col("quality").alias("assignment"), F.col("toxic").alias("exclusivity"), (F.col("doc_id") % 2 == 0).alias("renewal"))
    made = CONVERTERS.find("contract_terms")(rows)
    return records.decisions(made.withColumn("id", F.col("state"))).select(F.col("id").cast("long").alias("doc_id"), "name", "label")


@query("""
WITH d AS (SELECT doc_id, text, lang, crc FROM (SELECT doc_id, text, lang, doc_id % 5 AS crc FROM documents))
SELECT crc AS part, count(*) AS rows, count(DISTINCT lang) AS langs FROM d WHERE text IS NOT NULL GROUP BY crc""")
def mapped_rows(t):
    """Rows made by a Python function, by Arrow batches; a row that raises is left out."""
    from tallyloom.sources.readers import mapped_rows as mapped

    def one(row):
        return {"part": row["doc_id"] % 5, "lang": row["lang"], "chars": len(row["text"])}

    made = mapped(t("documents").select("doc_id", "text", "lang"), one, "part long, lang string, chars long")
    return made.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("lang").alias("langs"))


@query("""
SELECT o_orderkey, replace(replace('rule:max_' || lower(o_orderstatus), ':', ' / '), '_', ' ') || ' (' || CASE WHEN o_orderkey % 2 = 0 THEN 'level=' || left(o_orderpriority, 1) || ', ' ELSE '' END || 'status=' || chr(39) || o_orderstatus || chr(39) || ')' AS text FROM orders""")
def constraint_texts(t):
    """Constraints with their arguments in words."""
    args = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.substring("o_orderpriority", 1, 1)).otherwise("").alias("level"), F.array().cast("array<int>").alias("none")))
    return t("orders").select("o_orderkey", X.constraint_text(F.concat(F.lit("rule:max_"), F.lower("o_orderstatus")), args).alias("text"))


from tallyloom.plans import formats, groups  # noqa: E402, F401  register their queries
