"""Importance resampling towards a target: hashed features, gains by bucket, seeded draws.

A document's features are hashed into buckets by higher-order functions. Its weight is the mean of
its buckets' gains, the scaled log ratios of target to corpus, taken from a literal array, so that
scoring needs neither rows by feature nor a join; what is shuffled for it are counts by bucket. Of
the scored rows, counts by score tell the lowest score that is drawn, and only rows at or above it
are put in order, in as many ranges as there are shuffle partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.kit import marked, settled, written

#: Buckets of features.
BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 1
#: Words a document must have to be drawn, and percent of such documents that are drawn.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, with A-Z in lower case. A null text has none."""
    plain = F.coalesce(text, F.lit(""))
    # The general lower case is faster, and the same where all is ASCII.
    small = F.when(F.length(plain) == F.octet_length(plain), F.lower(plain)).otherwise(F.translate(plain, _UPPER, _LOWER))
    return F.array_remove(F.split(small, _SEPARATORS), "")


def buckets_of(words: Column, longest: int = LONGEST, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to `longest` words, repeats included."""
    bucket = lambda feature: (F.crc32(feature.cast("binary")) % buckets).cast("int")
    runs = lambda n: F.transform(F.slice(words, n, F.greatest(F.size(words), F.lit(0))), lambda _, i: bucket(F.array_join(F.slice(words, i + 1, n), " ")))
    return F.concat(F.transform(words, bucket), *[runs(n) for n in range(2, longest + 1)])


def bucket_counts(hashed: DataFrame) -> dict[int, int]:
    """Features by bucket: BUCKETS rows at most come to the driver. Tasks add up their own first, so only totals are shuffled."""
    rows = hashed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return {r.bucket: r.n for r in rows.collect()}


def gains_of(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Each bucket's thousandfold log ratio of its smoothed share in the target to that in the corpus, floored."""
    whole, wanted = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * whole / ((corpus.get(b, 0) + 1.0) * wanted))) for b in range(buckets)]


def weight_of(buckets: Column, gains: list[int]) -> Column:
    """The floored mean of the gains of a document's features; 0 without features."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded to one literal
    total = F.aggregate(buckets, F.lit(0).cast("bigint"), lambda s, b: s + F.element_at(table, b + 1))
    n = F.size(buckets).cast("bigint")
    return F.when(n > 0, F.call_function("div", total - F.pmod(total, n), n)).otherwise(F.lit(0).cast("bigint"))


def noise_of(key: Column, seed: int = SEED) -> Column:
    """A thousandfold Gumbel draw from the seed and a key, floored. A null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def drawn(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """Scored rows (doc_id, n_words, n_features, weight, score) with `rank`: 1, 2, 3 ... for the floor(percent * N / 100) highest scores of the N rows with `least` words, ties to the smaller doc_id (null last), else null. Rows that tie in all columns share their ranks in any order.

    Scores are thousandths of logarithms, so that counts by score are some ten thousand rows for
    any input; they tell the lowest score that is drawn. Equal rows at or above it are counted
    before they are ranked, so that a row which repeats a million times is one row in its range.
    """
    fit = F.col("n_words") >= least
    by_score, _ = written(scored.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    wanted = percent * (by_score.agg(F.sum("n")).first()[0] or 0) // 100
    upto = by_score.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("score"))))  # a row for each score
    lowest = upto.filter(F.col("upto") >= wanted).agg(F.max("score")).first()[0] if wanted else None
    none = F.lit(None).cast("bigint").alias("rank")
    if lowest is None:
        return scored.select("*", none)
    high = F.coalesce(fit & (F.col("score") >= lowest), F.lit(False))
    rows = scored.filter(high).groupBy(*scored.columns).agg(F.count(F.lit(1)).alias("times"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_words", "n_features", "weight"]
    # Written, so that a part's number stays what it is if a task runs again.
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, _ = written(rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.sum("times").alias("held"))
    before = sizes.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("times").over(inside), F.lit(0))
    ranked = parts.join(F.broadcast(before), "part").withColumn("first", first)
    ranked = ranked.select(*scored.columns, F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("times"))).alias("rank"))
    return ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).unionByName(scored.filter(~high).select("*", none))


def op13_importance_resampling(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document's features, weight, score and rank.

    A null or empty text has no features and weight 0, and is never drawn. Repeated rows are ranked
    one by one, ties go to the smaller doc_id. Very long texts are one array of buckets. An empty
    table gives no rows; an empty target makes all gains those of the smoothed corpus.
    """
    mark = marked()
    hashed, _ = written(documents.select("doc_id", buckets_of(words_of(F.col("text"))).cast("array<smallint>").alias("buckets")))
    wide = hashed.withColumn("buckets", F.col("buckets").cast("array<int>"))
    target = benchmark.select(buckets_of(words_of(F.col("text"))).alias("buckets"))
    gains = gains_of(bucket_counts(wide), bucket_counts(target))
    n = F.size("buckets").cast("bigint")
    scored = wide.select("doc_id", n.alias("n_words"), n.alias("n_features"), weight_of(F.col("buckets"), gains).alias("weight"))
    scored, _ = written(scored.withColumn("score", F.col("weight") + noise_of(F.col("doc_id"))))
    return settled(drawn(scored).select("doc_id", "n_features", "weight", "score", "rank"), mark)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
WITH crc AS (SELECT list(list_reduce([i::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda v, k: xor(v >> 1, 3988292384 * (v & 1))) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT id, unnest(w) AS w FROM d),
g AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM f UNION SELECT w FROM g)),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % {BUCKETS} AS b FROM v, crc),
s AS (SELECT b, count(*) AS n FROM f JOIN b USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM g JOIN b USING (w) GROUP BY b),
k AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
m AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN b USING (w) JOIN k USING (b) GROUP BY id),
p AS (SELECT id, doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS noise FROM d LEFT JOIN m USING (id)),
q AS (SELECT id, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features, weight) AS r, count(*) OVER () AS n FROM p WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank FROM p LEFT JOIN q USING (id)
"""
