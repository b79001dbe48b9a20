"""Augmentation of records: option order, none of the above, fitting options, packing, batches, ablations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.hashing import order_key, uniform
from tallyloom.functions.text import without_tags
from tallyloom.operators.records import OPTION
from tallyloom.operators.sampling import PART_DIGITS, hash_rank

# The option that says that no other fits.
NONE_KEY, NONE_TEXT = "none_of_the_above", "None of the other options fits."


def shuffled(opts: Column, seed: int, *key: Column) -> Column:
    """An option array in hash order."""
    keyed = F.transform(opts, lambda o: F.struct(order_key(seed, *key, o["key"]).alias("h"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda x: x["o"])


def with_none(df: DataFrame, p_none: float, p_distract: float, seed: int, *key: Column, opts: str = "options", label: str = "label") -> DataFrame:
    """None of the above in place of the gold option (with p_none, from three options on), or as a distractor (with p_distract).

    Rows without a label, or that have the option already, stay as they are.
    """
    u = uniform(seed, *key)
    none = F.array(F.struct(F.lit(NONE_KEY).alias("key"), F.lit(NONE_TEXT).alias("description"))).cast(f"array<{OPTION}>")
    open_ = F.col(label).isNotNull() & ~F.exists(opts, lambda o: o["key"] == NONE_KEY)
    drops = open_ & (u < p_none) & (F.size(opts) >= 3)
    adds = open_ & ~drops & (u < p_none + p_distract)
    others = F.filter(opts, lambda o: o["key"] != F.col(label))
    new = F.when(drops, F.concat(others, none)).when(adds, F.concat(F.col(opts), none)).otherwise(F.col(opts))
    return df.withColumn("new__", new).withColumn(label, F.when(drops, NONE_KEY).otherwise(F.col(label))).withColumn(opts, F.col("new__")).drop("new__")


def fitted(opts: Column, label: Column, most: int, seed: int, *key: Column) -> Column:
    """At most `most` options: the gold one and others in hash order, in their own order."""
    others = F.filter(opts, lambda o: ~o["key"].eqNullSafe(label))
    ranked = F.array_sort(F.transform(others, lambda o: F.struct(order_key(seed, *key, o["key"]).alias("h"), o["key"].alias("k"))))
    room = F.when(F.exists(opts, lambda o: o["key"] == label), most - 1).otherwise(most)
    keep = F.transform(F.slice(ranked, 1, room), lambda x: x["k"])
    return F.when(F.size(opts) > most, F.filter(opts, lambda o: F.array_contains(keep, o["key"]) | o["key"].eqNullSafe(label))).otherwise(opts)


def packed(records: DataFrame, size: int, seed: int) -> DataFrame:
    """Records without images and media packed `size` at a time into one: states as item_1 …, questions as item_1_name …

    Packs follow hash order; the last one may be smaller.
    """
    plain = records.filter((F.size("images") == 0) & (F.size("media") == 0))
    rows = hash_rank(plain, [], order_key(seed, F.col("id")), F.col("id"), "r").withColumn("pack", F.floor((F.col("r") - 1) / size))
    return _joined(rows.withColumn("item", (F.col("r") - 1) % size + 1))


def packed_by_coin(records: DataFrame, p_pack: float, most: int, seed: int) -> DataFrame:
    """Of the records without images and media, in hash order, a share packed two to `most` at a time; the others, and those with images or media, stay as they are.

    Runs of lcm(2 … most) records, by their number, take a coin and a size; so runs with a coin
    are cut into packs of one size without a rest, but for the last run.
    """
    run = math.lcm(*range(2, most + 1))
    plain = (F.size("images") == 0) & (F.size("media") == 0)
    rows = hash_rank(records.filter(plain), [], order_key(seed, F.col("id")), F.col("id"), "r").withColumn("run__", F.floor((F.col("r") - 1) / run))
    rows = rows.withColumn("coin__", uniform(f"{seed}:coin", F.col("run__")) < p_pack).withColumn("size__", 2 + F.floor(uniform(f"{seed}:size", F.col("run__")) * (most - 1)))
    inside = (F.col("r") - 1) % run
    packs = rows.filter("coin__").withColumn("pack", F.col("run__") * run + F.floor(inside / F.col("size__"))).withColumn("item", inside % F.col("size__") + 1)
    made = _joined(packs.drop("run__", "coin__", "size__"))
    alone = rows.filter("not coin__").select(*made.columns).unionByName(records.filter(~plain).select(*made.columns))
    return made.unionByName(alone)


def batch_seed(seed: int, ids: Column) -> Column:
    """A seed of a batch (an array of record ids in order), so that a batch made again is augmented alike."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), ids)), 1, 15), 16, 10).cast("long")


def _joined(rows: DataFrame) -> DataFrame:
    """One record of the rows of each pack, in order of item."""
    name = lambda n: F.concat(F.lit("item_"), F.col("item").cast("string"), F.lit("_"), n)
    about = lambda t: F.concat(F.lit("About item_"), F.col("item").cast("string"), F.lit(": "), t)
    rows = rows.withColumn("questions", F.transform("questions", lambda q: F.struct(name(q["name"]).alias("name"), q["type"].alias("type"), about(q["instructions"]).alias("instructions"), q["options"].alias("options"))))
    rows = rows.withColumn("targets", F.transform("targets", lambda t: F.struct(name(t["name"]).alias("name"), t["label"].alias("label"), t["probs"].alias("probs"))))
    items = F.array_sort(F.collect_list(F.struct("item", "id", "state", "questions", "targets", "meta")), lambda a, b: (a["item"] - b["item"]).cast("int"))
    grouped = rows.groupBy("pack").agg(items.alias("items"), F.first("source").alias("source"))
    state = F.to_json(F.map_from_entries(F.transform("items", lambda x: F.struct(F.concat(F.lit("item_"), x["item"].cast("string")).alias("key"), x["state"].alias("value")))))
    return grouped.select(
        F.array_join(F.transform("items", lambda x: x["id"]), "+").alias("id"),
        "source",
        state.alias("state"),
        F.flatten(F.transform("items", lambda x: x["questions"])).alias("questions"),
        F.flatten(F.transform("items", lambda x: x["targets"])).alias("targets"),
        F.map_concat(F.map_filter(F.element_at("items", 1)["meta"], lambda k, v: k != "packed"), F.create_map(F.lit("packed"), F.size("items").cast("string"))).alias("meta"),
    )


def length_batches(df: DataFrame, length: Column, batch: int, seed: int, key: Column, chunk: int = 64) -> DataFrame:
    """The rows with `chunk` and `batch`: chunks of chunk * batch rows in hash order, cut into batches by length; incomplete batches go."""
    ranked = hash_rank(df, [], order_key(seed, key), key, "r__").withColumn("chunk", F.floor((F.col("r__") - 1) / (chunk * batch)))
    place = F.row_number().over(Window.partitionBy("chunk").orderBy(length, order_key(seed, key), key)) - 1
    rows = ranked.withColumn("batch", F.floor(place / batch))
    full = F.count(F.lit(1)).over(Window.partitionBy("chunk", "batch"))
    return rows.withColumn("n__", full).filter(F.col("n__") == batch).drop("n__", "r__")


def muted(media: Column) -> Column:
    """Media without sound: audio items go, videos lose their track."""
    kept = F.filter(media, lambda m: m["type"] != "audio")
    return F.transform(kept, lambda m: m.withField("audio", F.lit(None).cast("string")).withField("mute", F.lit(True)))


def blacked(media: Column) -> Column:
    """Media with black pictures."""
    return F.transform(media, lambda m: F.when(m["type"] == "video", m.withField("black", F.lit(True))).otherwise(m))


def next_different(df: DataFrame, value: str, seed: int, key: Column, name: str = "other", digits: int = PART_DIGITS) -> DataFrame:
    """The rows with another row's value: the next different one in hash order, from the last row on to the first; null if all are equal.

    The hash space is cut into 16**digits parts. Inside a part the next run of equal values tells;
    its last run looks at a table with a row for each part.
    """
    ranked = df.withColumn("r__", F.struct(order_key(seed, key).alias("h"), key.alias("k"))).withColumn("part__", F.substring(F.col("r__.h"), 1, digits))
    inside = Window.partitionBy("part__").orderBy("r__")
    before = F.lag(value).over(inside)
    rows = ranked.withColumn("head__", F.when(before.isNull() | ~before.eqNullSafe(F.col(value)), 1).otherwise(0)).withColumn("run__", F.sum("head__").over(inside))
    heads = rows.filter("head__ = 1").select(F.col("part__").alias("p__"), F.col("run__").alias("u__"), F.col(value).alias("v__"))
    ends = rows.groupBy(F.col("part__").alias("p__")).agg(F.max_by(value, "r__").alias("last__"))
    edges = heads.groupBy("p__").agg(F.max(F.when(F.col("u__") == 1, F.col("v__"))).alias("one__"), F.max(F.when(F.col("u__") == 2, F.col("v__"))).alias("two__")).join(ends, "p__")
    # A row for each part: a part of one value that the part before ends with goes on with that.
    along = Window.orderBy("p__")
    edges = edges.withColumn("same__", F.col("two__").isNull() & F.coalesce(F.col("one__") == F.lag("last__").over(along), F.lit(False)))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stops = edges.filter(~F.col("same__"))
    for c in ("one__", "two__"):
        stops = stops.withColumn(f"n{c}", F.when(F.lead("p__").over(along).isNotNull(), F.lead(c).over(along)).otherwise(F.first(c).over(whole)))
    stops = stops.select(F.col("p__").alias("s__"), F.when(F.col("none__") != F.col("last__"), F.col("none__")).otherwise(F.col("ntwo__")).alias("a__"))
    told = edges.join(stops, F.col("p__") == F.col("s__"), "left").withColumn("after__", F.last("a__", True).over(along.rowsBetween(Window.unboundedPreceding, 0))).select("p__", "after__")
    following = heads.select(F.col("p__").alias("q__"), (F.col("u__") - 1).alias("w__"), F.col("v__").alias("next__"))
    out = rows.join(following, (F.col("part__") == F.col("q__")) & (F.col("run__") == F.col("w__")), "left").join(told, F.col("part__") == F.col("p__"))
    return out.withColumn(name, F.coalesce("next__", "after__")).drop("r__", "part__", "head__", "run__", "q__", "w__", "next__", "p__", "after__")


#: Ablations of records with media; others stay as they are.
ABLATIONS = ("none", "mute", "black", "shuffle_audio")


def ablated(records: DataFrame, kind: str, seed: int = 0) -> DataFrame:
    """Records without sound, with black pictures, or with each sound swapped for another record's; `meta.ablate` tells which."""
    if kind not in ABLATIONS:
        raise ValueError(f"unknown ablation {kind!r}; there are {', '.join(ABLATIONS)}")
    if kind == "none":
        return records
    records = records.withColumn("had__", F.size("media") > 0)
    marked = F.map_concat(F.map_filter("meta", lambda k, v: k != "ablate"), F.create_map(F.lit("ablate"), F.lit(kind)))
    if kind == "shuffle_audio":
        records = swapped_sounds(records, seed)
    else:
        records = records.withColumn("media", F.when(F.col("had__"), muted(F.col("media")) if kind == "mute" else blacked(F.col("media"))).otherwise(F.col("media")))
    if kind == "mute":
        records = records.withColumn("state", F.when(F.col("had__"), without_tags(F.col("state"), "audio")).otherwise(F.col("state")))
    return records.withColumn("meta", F.when(F.col("had__"), marked).otherwise(F.col("meta"))).drop("had__")


def swapped_sounds(records: DataFrame, seed: int) -> DataFrame:
    """Each sound (a video's track, or an audio item) becomes the next different one in hash order; with one sound alone nothing changes."""
    sound = lambda m: F.when(m["type"] == "audio", m["path"]).otherwise(m["audio"])
    slots = records.select("id", F.posexplode("media").alias("at", "m")).select("id", "at", sound(F.col("m")).alias("ref")).filter("ref is not null")
    other = next_different(slots, "ref", seed, F.concat_ws("|", "id", F.col("at").cast("string")))
    new = other.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", F.coalesce("other", "ref").alias("new")))).alias("new__"))
    joined = records.join(new, "id", "left")
    put = lambda m, i: F.when(F.try_element_at("new__", i).isNull(), m).when(m["type"] == "audio", m.withField("path", F.try_element_at("new__", i))).otherwise(m.withField("audio", F.try_element_at("new__", i)))
    return joined.withColumn("media", F.when(F.col("new__").isNotNull(), F.transform("media", put)).otherwise(F.col("media"))).drop("new__")
