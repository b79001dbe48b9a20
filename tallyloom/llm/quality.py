"""Quality rules with thresholds from mergeable quantile sketches per language and source.

A sketch counts documents by logarithmic bucket of a feature, which merges by addition and gives
every quantile within about 1 %. A ratio (characters a word) has limits REACH spreads from the
group's median, where the spread is that of the other side of the median: what a limit is to reject
can't move it far. Of events (symbols, lines and words that repeat) a sketch holds the rates of
the documents that have any, beside the number of those that have none, so that no limit depends
on how long texts are. The limit lies at FACTOR times the usual rate, which is the lower quartile of
documents with events, their clean end, within what is usual anywhere (USUAL), or the median of all
documents where most have events. So a source full of junk does not lift its own limits, and one
without events has the lowest. Values of a group are drawn to those of its language, and these to
everyone's, as if the parent gave PRIOR documents more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyloom.llm.kit import Texts, lookup, marked, mix, named, packed, settled, shingle_hashes, slices, texts_of, unpacked, word_bounds, word_hashes, written

#: Buckets of a sketch for each e-fold.
RESOLUTION = 50
#: Spreads (from the median to the tenth or ninetieth percentile) between the median of a ratio and a limit.
REACH = 3.5
#: Times the usual rate (of shares, their odds) that a text may have.
FACTOR = 16.0
#: Documents that a group's parent counts for.
PRIOR = 50
#: Features: what is counted, out of what, and how. A ratio has a low and a high limit; a rate is events for each unit; a share is part of the whole and compared by its odds.
FEATURES = {"chars_per_word": ("word_chars", "n_words", "ratio"), "symbols_per_word": ("n_symbols", "n_words", "rate"), "dup_line_share": ("n_dup_lines", "n_lines", "share"), "repeat_word_share": ("n_repeat_words", "n_words", "share")}
#: Least and most usual rates or odds among texts that have events at all.
USUAL = {"symbols_per_word": (0.001, 0.01), "dup_line_share": (0.02, 0.2), "repeat_word_share": (0.005, 0.05)}
#: The bucket of documents without events, below all others.
NONE = -(2**30)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

_AS_IS = np.arange(256, dtype=np.uint8)
_SYMBOL = np.isin(_AS_IS, np.frombuffer(b"#*$%&|<>", np.uint8))
_NEWLINE = _AS_IS == 0x0A
_SPACELESS = ~np.isin(_AS_IS, [0x20, *range(0x09, 0x0E)])
_BEGINS = (_AS_IS & 0xC0) != 0x80


def _by_text(flags: np.ndarray, texts: Texts) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[texts.ends] - sums[texts.starts]


def _groups(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys made different between owners."""
    return mix(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def counts_of(texts: Texts) -> np.ndarray:
    """COUNTS of each text, one row for each."""
    starts, ends, first = word_bounds(texts)
    n_words = np.diff(first)
    word_chars = _by_text(_BEGINS[texts.data] & _SPACELESS[texts.data], texts)
    n_symbols = _by_text(_SYMBOL[texts.data], texts)
    # Lines with a word, and those equal to an earlier one.
    a, b, at = word_bounds(texts, _NEWLINE)
    full = np.searchsorted(starts, a) < np.searchsorted(starts, b)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))[full]
    lines = _groups(word_hashes(texts.data, a, b, _AS_IS)[full], owner)
    n_lines = np.bincount(owner, minlength=len(texts))
    _, seen = np.unique(lines, return_index=True)
    n_dup = n_lines - np.bincount(owner[seen], minlength=len(texts))
    # Words in a window of three words that the text has again.
    windows, bounds = shingle_hashes(word_hashes(texts.data, starts, ends, _AS_IS), first, 3)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), sizes)
    keys = _groups(windows, owner)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at_word = np.arange(len(keys)) + np.repeat(first[:-1] - bounds[:-1], sizes)
    inside = np.zeros(len(starts) + 3, bool)
    for k in range(3):
        inside[at_word[again] + k] = True
    sums = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(inside[: len(starts)], out=sums[1:])
    return np.stack([n_words, word_chars, n_symbols, n_dup, sums[first[1:]] - sums[first[:-1]], n_lines], axis=1)


@F.arrow_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def quality_counts(texts: pa.Array) -> pa.Array:
    found = [counts_of(part) for _, _, part in slices(texts_of(texts))]
    table = np.concatenate(found) if found else np.zeros((0, len(COUNTS)), np.int64)
    return pa.StructArray.from_arrays([pa.array(table[:, i], pa.int64()) for i in range(len(COUNTS))], COUNTS)


#: So that a filter on the counts does not count again.
quality_counts = quality_counts.asNondeterministic()


def _bucket(counts: Column, name: str) -> Column:
    """The bucket of a feature's logarithm; NONE without events. A share of the whole counts as if half a unit were not in it."""
    part, whole, kind = FEATURES[name]
    a, b = counts[part].cast("double"), counts[whole].cast("double")
    x = F.log(a / F.greatest(b - a, F.lit(0.5))) if kind == "share" else F.log(a / b)
    return F.when(a > 0, F.floor(x * RESOLUTION).cast("int")).otherwise(F.lit(NONE))


def _base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def sketches(counted: DataFrame) -> DataFrame:
    """Documents by (level, lang, source, feature, bucket) of those that pass the base rules: level 2 is a language and source, 1 a language, 0 everything."""
    c = F.col("counts")
    values = F.array(*[F.struct(F.lit(k).alias("feature"), _bucket(c, k).alias("bucket")) for k in FEATURES])
    each = counted.filter(~_base_failed(c)).select("lang", "source", F.explode(values).alias("v"))
    fine = each.groupBy("lang", "source", "v.feature", "v.bucket").agg(F.count(F.lit(1)).alias("docs"))
    levels = F.array(F.struct(F.lit(2).alias("level"), F.col("lang"), F.col("source")), F.struct(F.lit(1).alias("level"), F.col("lang"), F.lit(None).cast("string").alias("source")), F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")))
    wide = fine.select(F.explode(levels).alias("g"), "feature", "bucket", "docs")
    return wide.groupBy("g.level", "g.lang", "g.source", "feature", "bucket").agg(F.sum("docs").alias("docs"))


def measures_of(sketch: DataFrame) -> DataFrame:
    """For each (level, lang, source, feature): documents held and with events (all, of a ratio); median of all (null if that has no events); how far the tenth percentile lies below it and the ninetieth above it, a bucket at least; and the lower quartile of those with events within the usual (null without any)."""
    group = Window.partitionBy("level", "lang", "source", "feature")
    some = F.when(F.col("bucket") > NONE, F.col("docs")).otherwise(0)
    rows = sketch.withColumn("upto", F.sum("docs").over(group.orderBy("bucket"))).withColumn("all", F.sum("docs").over(group)).withColumn("upto_some", F.sum(some).over(group.orderBy("bucket"))).withColumn("some", F.sum(some).over(group))
    quantile = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bucket")))
    early = F.min(F.when((F.col("bucket") > NONE) & (F.col("upto_some") >= F.col("some") * 0.25), F.col("bucket")))
    rows = rows.groupBy("level", "lang", "source", "feature").agg(F.max("all").alias("held"), F.max("some").alias("some"), quantile(0.1).alias("b1"), quantile(0.5).alias("b5"), quantile(0.9).alias("b9"), early.alias("e"))
    at = lambda b: (F.col(b) + 0.5) / F.lit(float(RESOLUTION))
    step = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(1)) / F.lit(float(RESOLUTION))
    usual = F.lit(None).cast("double")
    for k, (least, most) in USUAL.items():
        usual = F.when(F.col("feature") == k, F.least(F.greatest(at("e"), F.log(F.lit(least))), F.log(F.lit(most)))).otherwise(usual)
    mid = F.when(F.col("b5") > NONE, at("b5"))
    return rows.select("level", "lang", "source", "feature", F.col("held").cast("double").alias("held"), F.col("some").cast("double").alias("some"), mid.alias("mid"), step("b5", "b1").alias("below"), step("b9", "b5").alias("above"), F.when(F.col("some") > 0, usual).alias("usual"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """For each (lang, source) and feature: the documents it holds, and the lowest and highest logarithm that passes; of events there is no lowest."""
    rows = measures_of(sketch)
    measures = ["mid", "below", "above", "usual"]
    level = lambda k, mark: rows.filter(F.col("level") == k).select(*[F.col(c).alias(f"{c}{mark}") for c in ("lang", "source", "feature", "held", "some", *measures)])
    drawn = lambda m, own, parent: (F.col(f"held{own}") * F.col(f"{m}{own}") + PRIOR * F.col(parent)) / (F.col(f"held{own}") + PRIOR)
    told = lambda own, parent: (F.col(f"some{own}") * F.coalesce(f"usual{own}", F.lit(0.0)) + PRIOR * parent) / (F.col(f"some{own}") + PRIOR)
    first = F.lit(0.0)
    for k, (least, _) in USUAL.items():
        first = F.when(F.col("feature0") == k, F.log(F.lit(least))).otherwise(first)
    every = level(0, "0").withColumn("usual0", told("0", first))
    langs = level(1, "1").join(F.broadcast(every), F.col("feature1") == F.col("feature0"))  # four rows
    langs = langs.select("lang1", "feature1", *[drawn(m, "1", f"{m}0").alias(f"{m}1") for m in measures[:3]], told("1", F.col("usual0")).alias("usual1"))
    own = level(2, "").join(langs, F.col("lang").eqNullSafe(F.col("lang1")) & (F.col("feature") == F.col("feature1")))
    ratio = F.col("feature") == "chars_per_word"
    center, below, above = (drawn(m, "", f"{m}1") for m in measures[:3])
    high = F.when(ratio, center + REACH * below).otherwise(F.log(F.lit(FACTOR)) + F.greatest(told("", F.col("usual1")), F.col("mid")))
    return own.select("lang", "source", "feature", "held", F.when(ratio, center - REACH * above).alias("low"), high.alias("high"))


def limits_of(counted: DataFrame) -> DataFrame:
    """Of each (lang, source), a struct `limits` with (low, high) by feature."""
    table, at = written(thresholds(sketches(counted)))
    each = [F.max(F.when(F.col("feature") == k, F.struct("low", "high"))).alias(k) for k in FEATURES]
    return table.groupBy("lang", "source").agg(*each).select("lang", "source", F.struct(*FEATURES).alias("limits"))


def _passes(counts: Column, limits: Column) -> Column:
    """Whether all features lie within their limits. Of n events, n less its root count, so that a short text is not rejected for one."""
    out = F.lit(True)
    for name, (part, whole, kind) in FEATURES.items():
        a, b = counts[part].cast("double"), counts[whole].cast("double")
        low, high = F.exp(limits[name]["low"]), F.exp(limits[name]["high"])
        if kind == "ratio":
            good = (a <= high * b) & (a >= low * b)
        else:
            sure = a - F.sqrt(a)
            good = sure <= high * (b if kind == "rate" else b - sure)
        out = out & F.coalesce(good, F.lit(True))
    return out


def _judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    c = F.col("counts")
    rows = lookup(counted, limits, ["lang", "source"])
    return rows.withColumn("failed", _base_failed(c)).withColumn("passes", _passes(c, F.col("limits")))


def judged(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows with `counts` (struct of COUNTS), `base_failed` and `kept`.

    A null text counts as empty; without words a text fails the base rules. Null languages and
    sources are groups like others, and groups of few documents lie close to their language.
    Repeated rows count each, ties at a limit pass, very long texts are read whole. An empty table
    gives an empty table. Input columns of the new names are replaced.
    """
    rows = packed(df).select("row", F.col("row").getField(lang).cast("string").alias("lang"), F.col("row").getField(source).cast("string").alias("source"), quality_counts(F.col("row").getField(text)).alias("counts"))
    few = df.select(named(lang).cast("string").alias("lang"), named(source).cast("string").alias("source"), quality_counts(named(text)).alias("counts"))
    out = _judged(rows, limits_of(few))
    return unpacked(out, df, F.col("counts"), F.col("failed").alias("base_failed"), (~F.col("failed") & F.col("passes")).alias("kept"), names=("counts", "base_failed", "kept"))


def op3_quality_rules(documents: DataFrame) -> DataFrame:
    """Counts and verdict of every document: texts are read once, counts are written and judged. See `judged`."""
    mark = marked()
    counted, _ = written(documents.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), quality_counts("text").alias("counts")))
    out = _judged(counted, limits_of(counted))
    return settled(out.select("doc_id", *[F.col("counts")[c].alias(c) for c in COUNTS[:5]], F.col("failed").alias("base_failed"), (~F.col("failed") & F.col("passes")).alias("kept")), mark)


_WORD = "[^\\x20\\x09-\\x0D]+"
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
tri AS (SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM win),
rep AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY id),
ln AS (SELECT id, line FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY id),
c AS (SELECT d.id, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN cov USING (id) LEFT JOIN dup USING (id)),
k AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS failed FROM c),
f AS (SELECT lang, source, unnest(['chars_per_word', 'symbols_per_word', 'dup_line_share', 'repeat_word_share']) AS feature,
    unnest([ln(word_chars::DOUBLE / n_words), CASE WHEN n_symbols > 0 THEN ln(n_symbols::DOUBLE / n_words) END, CASE WHEN n_dup_lines > 0 THEN ln(n_dup_lines / greatest(n_lines - n_dup_lines, 0.5::DOUBLE)) END,
      CASE WHEN n_repeat_words > 0 THEN ln(n_repeat_words / greatest(n_words - n_repeat_words, 0.5::DOUBLE)) END]) AS x FROM k WHERE NOT failed),
b AS (SELECT *, coalesce(floor(x * {RESOLUTION})::BIGINT, {NONE}) AS bucket FROM f),
g AS (SELECT 2 AS level, lang, source, feature, bucket, count(*) AS docs FROM b GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, feature, bucket, count(*) FROM b GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, feature, bucket, count(*) FROM b GROUP BY ALL),
u AS (SELECT *, sum(docs) OVER w AS upto, sum(docs) OVER p AS held, sum(CASE WHEN bucket > {NONE} THEN docs ELSE 0 END) OVER w AS upto_some, sum(CASE WHEN bucket > {NONE} THEN docs ELSE 0 END) OVER p AS eventful FROM g
  WINDOW p AS (PARTITION BY level, lang, source, feature), w AS (PARTITION BY level, lang, source, feature ORDER BY bucket)),
q AS (SELECT level, lang, source, feature, max(held)::DOUBLE AS held, max(eventful)::DOUBLE AS eventful, min(bucket) FILTER (upto >= held * 0.1::DOUBLE) AS b1, min(bucket) FILTER (upto >= held * 0.5::DOUBLE) AS b5, min(bucket) FILTER (upto >= held * 0.9::DOUBLE) AS b9,
    min(bucket) FILTER (bucket > {NONE} AND upto_some >= eventful * 0.25::DOUBLE) AS e FROM u GROUP BY ALL),
r(feature, least, most) AS (VALUES {", ".join(f"('{k}', ln({a}::DOUBLE), ln({b}::DOUBLE))" for k, (a, b) in USUAL.items())}),
v AS (SELECT level, lang, source, feature, held, eventful, CASE WHEN b5 > {NONE} THEN (b5 + 0.5::DOUBLE) / {RESOLUTION} END AS mid, greatest(b5 - b1, 1)::DOUBLE / {RESOLUTION} AS below, greatest(b9 - b5, 1)::DOUBLE / {RESOLUTION} AS above,
    coalesce(least(greatest((e + 0.5::DOUBLE) / {RESOLUTION}, least), most), 0) AS usual, least FROM q LEFT JOIN r USING (feature)),
l AS (SELECT o.lang, o.feature, (o.held * o.mid + {PRIOR} * p.mid) / (o.held + {PRIOR}) AS mid, (o.held * o.below + {PRIOR} * p.below) / (o.held + {PRIOR}) AS below,
    (o.held * o.above + {PRIOR} * p.above) / (o.held + {PRIOR}) AS above, (o.eventful * o.usual + {PRIOR} * ((p.eventful * p.usual + {PRIOR} * p.least) / (p.eventful + {PRIOR}))) / (o.eventful + {PRIOR}) AS usual FROM v o JOIN v p ON o.level = 1 AND p.level = 0 AND o.feature = p.feature),
m AS (SELECT o.lang, o.source, o.feature, (o.held * o.mid + {PRIOR} * p.mid) / (o.held + {PRIOR}) AS mid, (o.held * o.below + {PRIOR} * p.below) / (o.held + {PRIOR}) AS below,
    (o.held * o.above + {PRIOR} * p.above) / (o.held + {PRIOR}) AS above, ln({FACTOR}::DOUBLE) + greatest((o.eventful * o.usual + {PRIOR} * p.usual) / (o.eventful + {PRIOR}), coalesce(o.mid, -1e9::DOUBLE)) AS high
  FROM v o JOIN l p ON o.level = 2 AND o.feature = p.feature AND o.lang IS NOT DISTINCT FROM p.lang),
t AS (SELECT lang, source, max(exp(mid + {REACH}::DOUBLE * below)) FILTER (feature = 'chars_per_word') AS chars_high, max(exp(mid - {REACH}::DOUBLE * above)) FILTER (feature = 'chars_per_word') AS chars_low,
    max(exp(high)) FILTER (feature = 'symbols_per_word') AS symbols, max(exp(high)) FILTER (feature = 'dup_line_share') AS lines,
    max(exp(high)) FILTER (feature = 'repeat_word_share') AS words FROM m GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
  NOT failed AND word_chars <= chars_high * n_words AND word_chars >= chars_low * n_words AND n_symbols - sqrt(n_symbols) <= symbols * n_words
  AND n_dup_lines - sqrt(n_dup_lines) <= lines * (n_lines - (n_dup_lines - sqrt(n_dup_lines)))
  AND n_repeat_words - sqrt(n_repeat_words) <= words * (n_words - (n_repeat_words - sqrt(n_repeat_words))) AS kept
FROM k LEFT JOIN t ON k.lang IS NOT DISTINCT FROM t.lang AND k.source IS NOT DISTINCT FROM t.source
"""


def good(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that `judged` keeps, with exactly their own columns, whatever their names."""
    rows = packed(df, "own").select("own", *[F.col("own").getField(c).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    return judged(rows).filter("kept").select(*[F.col("own").getField(c).alias(c) for c in df.columns])
