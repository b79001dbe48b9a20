"""Exact n-gram Jaccard join with vertical partitioning, and its connected documents.

Documents with equal sets are one class. The global order of n-grams is by how common they are and
then by hash; by it, two linked sets share one of their first n-grams (the part that a partner may
lack, and one more). The global order is cut into FRAGMENTS pieces of equal weight, and every set
with it: a candidate pair's overlap is counted in each fragment by itself and summed by pair, first
from 16-bit codes, which never count too little, then from whole hashes.

Which pairs are candidates is kept small by stars: classes that share a first n-gram meet the most
central of them, and only classes that these stars leave in different components meet each other.
So a group of thousands of copies takes links in proportion to its size, and no link between
components is missed. N-grams and hubs with many members are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyloom.llm.components import components
from tallyloom.llm.kit import Texts, lookup, marked, mix, named, packed, record, settled, shingle_hashes, signed, slices, split_join, texts_of, unpacked, word_bounds, word_hashes, written

#: Counters of how common n-grams are. Unlike n-grams may share one: that only makes the order less good, not the join less exact.
COUNTERS = 1 << 18
#: Bits for each hash in the filters of classes whose sets are needed and of n-grams that several classes have, and all of a filter's at most. Filters have no false negatives; when full, they only save nothing.
BITS_EACH, MOST_BITS = 32, 1 << 27
#: Pieces of the global order, each of which holds as many n-grams.
FRAGMENTS = 8
#: Partners of a class that meet its set in one task, and classes of one n-gram that meet in one.
PARTNERS = 256


def sets_of(texts: Texts, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text: of `size` words each, or of all words of a shorter text."""
    starts, ends, first = word_bounds(texts)
    hashes, bounds = shingle_hashes(word_hashes(texts.data, starts, ends), first, size)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        some = np.sort(hashes[a:b])
        yield some[np.concatenate([[True], some[1:] != some[:-1]])] if len(some) else some


def class_of(some: np.ndarray) -> int:
    """A hash of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.sum(mix(some + np.uint64(0x1234_5678_9ABC_DEF1))) + np.uint64(len(some)) * np.uint64(0x9E3779B97F4A7C15)]))[0].view(np.int64))


def class_column(text: Column, size: int) -> Column:
    """A struct of a text's set size and class (null if it has no words)."""

    @F.arrow_udf(StructType([StructField("n", LongType()), StructField("class", LongType())]))
    def classes(texts: pa.Array) -> pa.Array:
        found = [(len(s), class_of(s) if len(s) else None) for _, _, part in slices(texts_of(texts)) for s in sets_of(part, size)]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], ["n", "class"])

    return classes(text)


def counted(df: DataFrame, id_: str, text: str, size: int) -> DataFrame:
    """In one table: (id, n, class) of every row, and (counter, docs): how many classes have n-grams of each counter, by task."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = np.zeros(COUNTERS, np.int64), set()
        for batch in batches:
            n, classes = [], []
            for _, _, part in slices(texts_of(batch.column(1))):
                for s in sets_of(part, size):
                    n.append(len(s))
                    classes.append(class_of(s) if len(s) else None)
                    if len(s) and classes[-1] not in seen:
                        seen.add(classes[-1])
                        np.add.at(common, (s >> np.uint64(46)).astype(np.int64), 1)
            empty = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), empty, empty], ["id", "n", "class", "counter", "docs"])
        some = np.flatnonzero(common)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), kind), none, none, pa.array(some), pa.array(common[some])], ["id", "n", "class", "counter", "docs"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[id_].dataType)
    return df.select(named(id_), F.col(text)).mapInArrow(emit, f"id {df.schema[id_].dataType.simpleString()}, n long, class long, counter long, docs long")


def global_order(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each counter, how common its n-grams are (a level) and the fragment of the global order that it lies in. COUNTERS rows at most come to the driver, whatever the corpus."""
    found = table.filter("counter is not null").groupBy("counter").agg(F.sum("docs").alias("docs")).toArrow()
    counts = np.zeros(COUNTERS)
    counts[np.asarray(found.column("counter"))] = np.asarray(found.column("docs"))
    levels = np.minimum(4 * np.log2(counts + 1), 255).astype(np.uint8)
    order = np.argsort(levels, kind="stable")
    before = np.cumsum(counts[order]) - counts[order]
    fragment = np.empty(COUNTERS, np.uint8)
    fragment[order] = np.minimum(before * FRAGMENTS // max(counts.sum(), 1), FRAGMENTS - 1)
    return levels, fragment


def postings(df: DataFrame, text: str, size: int, percent: int, levels: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """(gram, key, class, n, at): each class's first n-grams in the global order, of those that the filter lets through; the key's order is by how central the class is. A class may repeat, once in each task."""
    shared = df.sparkSession.sparkContext.broadcast((levels, wanted))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (levels, wanted), seen = shared.value, set()
        for batch in batches:
            for _, _, part in slices(texts_of(batch.column(0))):
                grams, classes, sizes, places, central = [], [], [], [], []
                for s in sets_of(part, size):
                    c = class_of(s) if len(s) else None
                    if c is None or c in seen:
                        continue
                    seen.add(c)
                    n = len(s)
                    common = levels[(s >> np.uint64(46)).astype(np.int64)]
                    k = n + percent * -n // 100 + 1  # n - ceil(percent n / 100) + 1
                    order = np.argsort(common.astype(np.uint64) << np.uint64(56) | s >> np.uint64(8), kind="stable")[:k]
                    grams.append(s[order])
                    classes.append(c)
                    sizes.append(n)
                    places.append(len(order))
                    central.append(min(int(common.mean() * 4), 1023))
                if grams:
                    upto = np.cumsum(places)
                    at = np.arange(upto[-1]) - np.repeat(upto - places, places)
                    gram, each = np.concatenate(grams), np.array(classes, np.int64)
                    key = np.array(central, np.int64) << 53 | (each.view(np.uint64) >> np.uint64(11)).view(np.int64)
                    some = slice(None) if wanted is None else np.flatnonzero(_has(wanted, gram))
                    of = np.repeat(np.arange(len(each)), places)[some]
                    yield record(gram=signed(gram[some]), key=key[of], **{"class": each[of]}, n=np.array(sizes, np.int64)[of], at=at[some].astype(np.int32))

    return df.select(text).mapInArrow(emit, "gram long, key long, class long, n long, at int")


def _has(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the filter lets each hash through."""
    at = x & np.uint64(64 * len(words) - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) > 0


def _need(percent: int, a: str, b: str) -> str:
    """The least overlap of linked sets of a and b n-grams."""
    return f"cast(ceil({percent}L * ({a} + {b}) / {100 + percent}.0D - 1e-9D) as long)"


def fragments(df: DataFrame, text: str, size: int, wanted: np.ndarray, fragment: np.ndarray, whole: bool) -> DataFrame:
    """(class, part, grams, lost) of the classes that the filter lets through: of each fragment of the global order, the n-grams, or 16-bit codes of them and how many n-grams share a code with another. A class may repeat, and an empty part is left out."""
    shared = df.sparkSession.sparkContext.broadcast((wanted, fragment))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (wanted, fragment), seen = shared.value, set()
        for batch in batches:
            for _, _, part in slices(texts_of(batch.column(0))):
                classes, parts, grams, lost = [], [], [], []
                for s in sets_of(part, size):
                    c = class_of(s) if len(s) else None
                    if c is None or c in seen or not _has(wanted, np.array([c]).view(np.uint64))[0]:
                        continue
                    seen.add(c)
                    at = fragment[(s >> np.uint64(46)).astype(np.int64)]
                    order = np.argsort(at, kind="stable")
                    cuts = np.searchsorted(at[order], np.arange(FRAGMENTS + 1))
                    s = s[order]
                    for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                        a, b = cuts[k], cuts[k + 1]
                        some = signed(s[a:b]) if whole else np.unique((s[a:b] & np.uint64(0xFFFF)).astype(np.uint16)).view(np.int16)
                        classes.append(c)
                        parts.append(k)
                        grams.append(some)
                        lost.append(b - a - len(some))
                if grams:
                    offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
                    yield record(**{"class": np.array(classes, np.int64)}, part=np.array(parts, np.int8), grams=pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(grams))), lost=np.array(lost, np.int32))

    return df.select(text).mapInArrow(emit, f"class long, part byte, grams array<{'long' if whole else 'short'}>, lost int")


def filter_of(hashes: DataFrame, column: str, count: int) -> np.ndarray:
    """A filter of some hashes: a bit for each, of BITS_EACH times their number in all, rounded up to a power of two. A 64th as many rows come to the driver, MOST_BITS / 64 at most: a corpus that outgrows that has a fuller filter, which lets more through and changes no result."""
    bits = 1 << min(max((BITS_EACH * count - 1).bit_length(), 6), MOST_BITS.bit_length() - 1)
    found = hashes.select(F.expr(f"{column} & {bits - 1}").alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("m")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[np.asarray(found.column("w"))] = np.asarray(found.column("m"))
    return words.view(np.uint64)


def overlaps(df: DataFrame, text: str, size: int, fragment: np.ndarray, pairs: DataFrame, whole: bool) -> DataFrame:
    """The pairs (a, b, na, nb) with `o`: their overlap, counted fragment by fragment and summed; by codes, at least their overlap. Pairs without a common fragment are left out."""
    both = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class")))
    # Dealt by class, once for both sides.
    cut = fragments(df, text, size, filter_of(both, "class", 2 * pairs.count()), fragment, whole).repartition("class").dropDuplicates(["class", "part"])
    side = lambda x: cut.select(F.col("class").alias(x), "part", F.col("grams").alias(f"g{x}"), F.col("lost").alias(f"l{x}"))
    # Either class of a pair may be in very many.
    hot = {k: written(pairs.groupBy(k).agg(F.floor(F.count(F.lit(1)) / PARTNERS).alias("salts")).filter("salts > 0"))[0] for k in "ab"}
    rows = pairs.select("a", "b", "na", "nb")
    # Without a hot class the sets stay where they were dealt.
    met = rows.join(side("a"), "a") if hot["a"].isEmpty() else split_join(rows, side("a"), ["a"], hot["a"], ["a"])
    met = split_join(met, side("b"), ["b", "part"], hot["b"], ["b"])
    # N-grams of the overlap have codes in common; those that share a code with another may hide behind it.
    one = F.size(F.array_intersect("ga", "gb")) + F.least("la", "lb")
    return met.select("a", "b", "na", "nb", one.alias("o")).groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))


def _reaches(percent: int) -> str:
    return f"100 * o >= {percent} * (na + nb - o)"


def verified(df: DataFrame, text: str, size: int, percent: int, fragment: np.ndarray, pairs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Of candidate pairs, (a, b, na, nb, o) with o at least the overlap, and the links (a, b), which are exact: codes refuse most pairs, whole n-grams decide on the rest. Also the tables to drop later."""
    rough, one = written(overlaps(df, text, size, fragment, pairs, False))
    links, two = written(overlaps(df, text, size, fragment, rough.filter(_reaches(percent)), True).filter(_reaches(percent)).select("a", "b"))
    return rough, links, [one, two]


def _crowded(grams: DataFrame) -> DataFrame:
    """Of n-grams with their number of members, those that are dealt over several tasks."""
    return grams.select("gram", F.floor(F.col("members") / PARTNERS).alias("salts")).filter("salts > 0")


def pairs_within(apart: DataFrame, grams: DataFrame) -> DataFrame:
    """Rows of `apart` of one n-gram that lie in different components, two by two (columns with x and y). The members of a crowded one are cut into blocks, and two blocks are a task's work."""
    hot, _ = written(_crowded(grams))
    rows = lookup(apart, hot, ["gram"]).withColumn("blocks", F.coalesce("salts", F.lit(0).cast("long")) + 1).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    named_ = lambda k: [F.col(c).alias(f"{c}{k}") for c in ("class", "n", "at", "kind", "root")]
    x = rows.select("gram", F.col("own").alias("i"), every.alias("j"), *named_("x"))
    y = rows.select("gram", every.alias("i"), F.col("own").alias("j"), *named_("y"))
    return x.join(y, ["gram", "i", "j"]).filter("classx < classy AND rootx <> rooty AND abs(kindx - kindy) < 2")


def classes_linked(df: DataFrame, text: str, size: int, percent: int, levels: np.ndarray, fragment: np.ndarray) -> DataFrame:
    """(node, root): classes by component, but for components of one class and the roots themselves."""
    # N-grams that several classes have, with the key of the most central one, which stands for the hub.
    many = postings(df, text, size, percent, levels).groupBy("gram").agg(F.max("key").alias("top"), F.min("key").alias("low"), F.count(F.lit(1)).alias("members")).filter("low <> top")
    many, _ = written(many.select("gram", "top", "members"))
    hot, _ = written(_crowded(many))
    rows = postings(df, text, size, percent, levels, filter_of(many, "gram", many.count()))
    met, _ = written(split_join(rows, many.select("gram", "top"), ["gram"], hot, ["gram"], once=True))
    # What concerns a class and its hub is told for both once, not for each n-gram that they share.
    both, _ = written(met.select("class", "n", "top", (F.col("key") == F.col("top")).alias("is_hub")).distinct())
    hubs = both.filter("is_hub").select("top", F.col("class").alias("hub"), F.col("n").alias("hub_n"))
    both, _ = written(both.join(hubs, "top"))
    stars = both.filter("class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b"), F.col("n").alias("na"), F.col("hub_n").alias("nb"))
    stars, _ = written(stars.filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"))
    rough, links, _ = verified(df, text, size, percent, fragment, stars)
    roots, _ = written(components(links))
    # Jaccard distances keep the triangle inequality: a class that lies more than twice the allowed
    # distance from the hub (kind 0) is linked with none that the hub is linked with (kind 2).
    far = 2 * percent - 100
    told = rough.select(F.col("a").alias("class"), F.col("b").alias("hub"), F.expr(f"CASE WHEN 100 * o < {far} * (na + nb - o) THEN 0 ELSE 1 END").alias("told"))
    sure = links.select(F.col("a").alias("class"), F.col("b").alias("hub"), F.lit(2).alias("sure"))
    kind = F.coalesce("sure", "told", F.expr(f"CASE WHEN class = hub THEN 3 WHEN 100 * least(n, hub_n) < {far} * greatest(n, hub_n) THEN 0 ELSE 1 END"))
    kinds = both.join(told, ["class", "hub"], "left").join(sure, ["class", "hub"], "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    kinds, _ = written(kinds.select("class", "top", "n", kind.alias("kind"), F.coalesce("root", "class").alias("root")))
    placed, _ = written(met.select("gram", "class", "at", "top").join(kinds, ["class", "top"]).drop("top"))
    # What the stars leave apart: n-grams whose classes lie in several components. Hubs have met all of theirs.
    torn, _ = written(placed.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members")).filter("low <> high").select("gram", "members"))
    apart, _ = written(split_join(placed.filter("kind <> 3"), torn, ["gram"], _crowded(torn), ["gram"]).drop("members"))
    # By the first n-gram that they share, both must have enough left to overlap.
    pairs = pairs_within(apart, torn).filter(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny) AND least(nx - atx, ny - aty) >= {_need(percent, 'nx', 'ny')}")
    pairs = pairs.selectExpr("classx AS a", "classy AS b", "nx AS na", "ny AS nb").distinct().join(stars.selectExpr("greatest(a, b) AS a_", "least(a, b) AS b_"), F.expr("greatest(a, b) = a_ AND least(a, b) = b_"), "left_anti")
    pairs, _ = written(pairs)
    if pairs.isEmpty():
        return roots
    _, more, _ = verified(df, text, size, percent, fragment, pairs)
    return components(links.union(more))


def linked(df: DataFrame, id_: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, class, component, component_class) of every row.

    Two texts link when 100 * overlap >= percent * union of their sets of `size`-word n-grams (a
    shorter text is one n-gram); a text without words, or null, is linked with nothing.
    `component` is the smallest id reachable, itself included (null ids count last), and
    `component_class` the class of that id's set. Repeated rows are copies. A very long text is
    cut by fragments like others. An empty table gives an empty table.
    """
    mark = marked()
    table, _ = written(counted(df, id_, text, size))
    rows = table.filter("counter is null").select("id", "n", "class")
    roots = classes_linked(df, text, size, percent, *global_order(table))
    classes = rows.filter("class is not null").groupBy("class").agg(F.min(F.struct(F.col("id").isNull(), "id")).alias("first"), F.count(F.lit(1)).alias("held"))
    placed = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    whole = placed.groupBy("root").agg(F.min(F.struct("first", "class")).alias("first"), F.sum("held").alias("held")).filter("held > 1")
    groups, _ = written(lookup(placed.select("class", "root"), whole, ["root"], "inner").select("class", F.col("first.first.id").alias("component"), F.col("first.class").alias("component_class")))
    joined = lookup(rows, groups, ["class"])
    alone = F.col("component_class").isNull()
    return settled(joined.select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), "class", F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"), F.coalesce("component_class", "class").alias("component_class")), mark)


def one_of_each(df: DataFrame, id_: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of which each group of linked documents keeps one, that with the smallest id, with their columns.

    Texts without words, or null, all stay. Of rows that repeat both id and set, one stays. Columns
    may have any names. An empty table gives an empty table.
    """
    groups = linked(df, id_, text, size, percent).filter("class is not null").groupBy("class").agg(F.first("component").alias("component"), F.first("component_class").alias("chosen"), F.count(F.lit(1)).alias("held")).filter("held > 1 OR class <> chosen")
    groups, _ = written(groups)
    rows = packed(df).select("row", F.col("row").getField(id_).alias("id"), class_column(F.col("row").getField(text), size)["class"].alias("class"))
    rows = lookup(rows, groups, ["class"])
    stays = rows.filter(F.col("chosen").isNull() | ((F.col("class") == F.col("chosen")) & F.col("id").eqNullSafe(F.col("component"))))
    # A class of several rows may hold its id more than once.
    once = stays.filter(F.col("held") > 1).dropDuplicates(["class"])
    return unpacked(stays.filter(F.col("held").isNull() | (F.col("held") == 1)).unionByName(once), df)


def op2_ngram_join(documents: DataFrame) -> DataFrame:
    """Every document's set size and component, by 4-word n-grams and a similarity of 85 %. See `linked`."""
    out = linked(documents, size=4, percent=85)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


OP2_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""
