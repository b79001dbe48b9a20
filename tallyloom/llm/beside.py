"""Parts of the operators' results that SQL can express, where it can't express the whole: each is taken from its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import hmm, langid, mixing, pii

_WORD = "[^\\x20\\x09-\\x0D]+"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 1, 2, 3, 4, 5, 6, 7], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"


def pii_base_spans(documents: DataFrame) -> DataFrame:
    """Counts and digest of the base spans."""
    return pii.op1_pii(documents).select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256")


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(reverse({_DIGITS}), i, 1)::INT + 1] END)) % 10 = 0"
_CHECKS = [
    "true",
    "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR substr('00' || x, -3)::INT > 255)) = 0",
    f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}",
    f"length({_DIGITS}) BETWEEN 8 AND 15",
]
_MATCHES = " UNION ALL ".join(
    f"SELECT id, {k} AS kind, '{name}' AS name, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gaps FROM d"
    for k, (name, pattern) in enumerate(zip(pii.KINDS, pii.PATTERNS, strict=True))
)
PII_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT * FROM ({_MATCHES}) WHERE len(ms) > 0),
e AS (SELECT id, kind, name, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM a),
s AS (SELECT id, kind, name, ms[i] AS m, coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS start FROM e),
g AS (SELECT id, kind, name, start::BIGINT AS start, (start + length(m))::BIGINT AS stop FROM s WHERE CASE kind {" ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(_CHECKS))} END),
t AS (SELECT id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(pii.KINDS))}, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY kind, start) AS told FROM g GROUP BY id)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in pii.KINDS)}, sha256(coalesce(told, '')) AS base_sha256 FROM d LEFT JOIN t USING (id)
"""


def language_undetermined(documents: DataFrame) -> DataFrame:
    """Which documents are held out and which have no letter."""
    return langid.op4_language_id(documents).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("undetermined"))


LANGUAGE_SQL = f"SELECT doc_id, coalesce({_CRC} % 4 = 2, false) AS held_out, NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS undetermined FROM documents"


def mix_targets(documents: DataFrame) -> DataFrame:
    """Each source's words and target, and the documents of it."""
    out = mixing.op9_mixing(documents).join(documents.select("doc_id", "source"), "doc_id")
    return out.groupBy("source").agg(F.max("source_size").alias("source_size"), F.round(F.max("target"), 3).alias("target"), F.count(F.lit(1)).alias("docs"))


MIX_SQL = f"""
WITH RECURSIVE d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
deal AS (
  SELECT 0 AS round, source, w, 2.0::DOUBLE * source_size AS cap, NULL::DOUBLE AS fixed, 1.5::DOUBLE * sum(source_size) OVER () AS left_ FROM s
  UNION ALL
  SELECT round + 1, source, w, cap, CASE WHEN fixed IS NOT NULL THEN fixed WHEN level * w > cap THEN cap END, left_ - coalesce(sum(CASE WHEN fixed IS NULL AND level * w > cap THEN cap END) OVER (), 0)
  FROM (SELECT *, left_ / sum(CASE WHEN fixed IS NULL THEN w END) OVER () AS level FROM deal WHERE round < 60)),
l AS (SELECT source, coalesce(fixed, w * left_ / sum(CASE WHEN fixed IS NULL THEN w END) OVER ()) AS target FROM deal WHERE round = (SELECT max(round) FROM deal))
SELECT s.source, source_size, round(target, 3) AS target, docs FROM s JOIN l ON s.source IS NOT DISTINCT FROM l.source
"""


def lm_base_scores(documents: DataFrame) -> DataFrame:
    """Tokens, known tokens and the base score of every document, by the steps of op10 that count words; they need no model."""
    return hmm.base_scores(documents).withColumn("base_score", F.round("base_score", 3))


LM_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce({_CRC} % 7 = 2, false) AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), chr(10)) AS t FROM documents),
t AS (SELECT id, held_out, unnest(t) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c),
s AS (SELECT id, count(*) AS n_tokens, count(c) AS n_known, sum(log10(coalesce(c, 0) + 1)) AS plain FROM t LEFT JOIN c USING (w) GROUP BY id)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(plain - n_tokens * log10(n + v + 1), 3) AS base_score FROM d JOIN s USING (id), n
"""

QUERIES = {"pii_base_spans": (pii_base_spans, PII_SQL), "language_undetermined": (language_undetermined, LANGUAGE_SQL), "mix_targets": (mix_targets, MIX_SQL), "lm_base_scores": (lm_base_scores, LM_SQL)}
