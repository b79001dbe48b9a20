"""Sharding by a Feistel permutation of global row numbers, with DataFrame functions only.

Law `rows`: shard sizes in rows differ by one at most. Equal rows are counted before they are
dealt, so that a row which repeats a million times moves as one row and a count. Numbers follow
the digests of rows, so that they depend on the rows alone, not on files or partitions; equal rows
may swap numbers, which nothing shows. Everything is arithmetic that SQL has too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.kit import packed, unpacked

#: Hex digits of a row's digest that tell the bucket in which it is numbered before the buckets' offsets are added: 4,096 buckets.
BUCKET_DIGITS = 3
#: Rounds of the permutation; an even number, so that both halves end in their places.
ROUNDS = 6
#: A prime below 2**31: products of two numbers below it fit a long.
PRIME = 2**31 - 1
#: Steps of a walk back into the range; one step misses with a chance below 1 / sqrt(rows), and few steps exist for few rows.
WALKS = 64


def constants(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers below PRIME for each round, by a linear congruence from the seed."""
    out, x = [], (seed * 2654435761 + 12345) % PRIME
    for _ in range(3 * ROUNDS):
        x = (x * 48271 + 1) % PRIME
        out.append(x or 1)
    return [tuple(out[3 * k : 3 * k + 3]) for k in range(ROUNDS)]


def feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    """A permutation of 0 .. a*b-1: halves x div b and x mod b, each round adds a scrambled half to the other one."""
    start = F.struct(F.floor(x / b).cast("long").alias("u"), (x % b).alias("v"), a.alias("mu"), b.alias("mv"))
    keys = F.array(*[F.struct(*[F.lit(c).cast("long").alias(n) for c, n in zip(k, "abc", strict=True)]) for k in constants(seed)])
    line = lambda k, v: ((v % PRIME) * k["a"] + k["b"]) % PRIME
    scrambled = lambda k, y: (y * y % PRIME * k["c"] + y) % PRIME
    step = lambda s, k: F.struct(s.v.alias("u"), ((s.u + scrambled(k, line(k, s.v))) % s.mu).alias("v"), s.mv.alias("mu"), s.mu.alias("mv"))
    return F.aggregate(keys, start, step, lambda s: s.u * b + s.v)


def permuted(x: Column, n: Column, seed: int) -> Column:
    """A permutation of 0 .. n-1: values that leave the range walk on along their cycle."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")
    walks = F.sequence(F.lit(0).cast("long"), F.least(a * b - n, F.lit(WALKS).cast("long")))
    out = F.aggregate(walks, x, lambda v, i: F.when((i == 0) | (v >= n), feistel(v, a, b, seed)).otherwise(v))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("the Feistel walk did not return")).cast("long"))


def shard(df: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """The rows with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard), by a seeded shuffle.

    Any columns may be null. An empty table gives an empty table. Input columns named shard or slot
    are replaced. Repeated rows each get a slot of their own; digests that tie are of equal rows.
    Very long texts move once as a key and once to their bucket. Columns must be comparable (no maps).
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    same = packed(df).groupBy("row").agg(F.count(F.lit(1)).alias("times")).withColumn("hash", F.md5(F.to_json("row").cast("binary"))).withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    # A row for each bucket, whatever the input.
    sizes = same.groupBy("bucket").agg(F.sum("times").alias("held"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"), F.sum("held").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("bucket").orderBy("hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum("times").over(inside), F.lit(0))
    rows = same.join(F.broadcast(offsets), "bucket").withColumn("first", first)
    rows = rows.withColumn("number", F.explode(F.sequence("first", F.col("first") + F.col("times") - 1)))
    rows = rows.withColumn("place", permuted(F.col("number"), F.col("total"), seed))
    return unpacked(rows, df, (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), names=("shard", "slot"))


def op6_sharding(documents: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """Every document's shard and slot; see `shard`. A null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(narrow, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_LISTS = ["[" + ", ".join(f"{k[i]}::BIGINT" for k in constants(1)) + "]" for i in range(3)]
OP6_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda v, k: xor(v >> 1, 3988292384 * (v & 1))) ORDER BY i) AS t FROM range(256) r(i)),
h AS (SELECT row_number() OVER () AS id, doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT id, doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32 FROM h, crc),
x AS (SELECT *, row_number() OVER (ORDER BY md5('{{' || coalesce('"doc_id":' || doc_id || ',', '') || '"size":' || size || ',"text_crc32":' || text_crc32 || '}}')) - 1 AS number, count(*) OVER () AS n FROM c),
ab AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*)::BIGINT AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM documents) WHERE n > 0),
r AS (
  SELECT id, (number // b)::BIGINT AS u, (number % b)::BIGINT AS v, a AS mu, b AS mv, 0 AS k, ab.n, b FROM x, ab
  UNION ALL
  SELECT id, v, (u + (y * y % {PRIME} * {_LISTS[2]}[k % {ROUNDS} + 1] + y) % {PRIME}) % mu, mv, mu, k + 1, n, b
  FROM (SELECT *, ((v % {PRIME}) * {_LISTS[0]}[k % {ROUNDS} + 1] + {_LISTS[1]}[k % {ROUNDS} + 1]) % {PRIME} AS y FROM r) WHERE NOT (k > 0 AND k % {ROUNDS} = 0 AND u * b + v < n)),
p AS (SELECT id, u * b + v AS place FROM r WHERE k > 0 AND k % {ROUNDS} = 0 AND u * b + v < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % 8)::INT AS shard, place // 8 AS slot, NULL::INT AS grown_shard FROM x JOIN p USING (id)
"""
