"""Leakage control and mixtures of record sources."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.hashing import order_key
from tallyloom.functions.text import fingerprint
from tallyloom.operators.sampling import hash_rank

#: Fixed value: characters from which a text field is a key of its own.
LONG_FIELD = 40
#: Fixed value: what stands before a clip id in the id of a source.
CLIP = "yt:"
#: The form of a name that is a clip id of 11 characters, with or without a time range, and names of files that name no clip.
CLIP_NAME = r"^([A-Za-z0-9_-]{11})(?:_\d+(?:\.\d+)?){0,2}$"
PLAIN_NAMES, FRAME_NAME = ("a", "i"), r"^(frame_?)?\d+$"
#: Fixed value: how often a small group is repeated at most.
MOST_REPEATS = 3


def content_keys(state: Column, fields: Column | None = None) -> Column:
    """Fingerprints of a state and of each of its long text fields."""
    keys = F.array(fingerprint(state))
    if fields is not None:
        keys = F.array_union(keys, F.transform(F.filter(fields, lambda f: F.length(f) >= LONG_FIELD), fingerprint))
    return keys


def source_keys(ids: Column) -> Column:
    """Keys of the sources that a record was made of."""
    return F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda s: F.sha1(F.concat(F.lit("source|"), s)))


def media_source_id(item: Column) -> Column:
    """The source id of a media item whose file (of frames, and of files called a, i or by a number, whose folder) is named by a clip id of 11 characters, with or without a time range."""
    first = F.try_element_at(item["frames"], F.lit(1))
    path = F.coalesce(item["path"], first, item["audio"])
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    parent = F.try_element_at(F.split(path, "/"), F.lit(-2))
    name = F.when(first.isNotNull() | stem.isin(*PLAIN_NAMES) | stem.rlike(FRAME_NAME), parent).otherwise(stem)
    clip = F.nullif(F.regexp_extract(name, CLIP_NAME, 1), F.lit(""))
    return F.when(~name.startswith("video_"), F.concat(F.lit(CLIP), clip))


def file_digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, digest) of files: the SHA-1 of their content, so that a copy under another name is the same. Paths are as records tell them, without a scheme for local files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha1("content").alias("digest"))


def with_digests(records: DataFrame, digests: DataFrame) -> DataFrame:
    """The records with images by digest where there is one (path, digest), else by path."""
    each = records.select("id", F.posexplode("images").alias("at", "path")).join(digests, "path", "left").select("id", "at", F.coalesce("digest", "path").alias("ref"))
    told = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("told__"))
    return records.join(told, "id", "left").withColumn("images", F.coalesce("told__", "images")).drop("told__")


def record_keys(records: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """(id, key) of every key of every record. A record with images or media is another one over another file: images count by content where `digests` tells it, media by path."""
    if digests is not None:
        records = with_digests(records, digests)
    texts = F.when(F.col("state_kind") == "object", F.map_values(F.from_json("state", "map<string, string>")))
    media = F.array_join(F.transform("media", lambda m: F.coalesce(m["path"], F.try_element_at(m["frames"], F.lit(1)), F.lit(""))), "|")
    images = F.array_join("images", "|")
    content = F.when(F.size("images") > 0, content_keys(F.concat_ws("|", "state", images))).when(F.size("media") > 0, content_keys(F.concat_ws("|", "state", media))).otherwise(content_keys(F.col("state"), F.coalesce(texts, F.array().cast("array<string>"))))
    given = F.try_element_at("meta", F.lit("source_id"))
    told = F.when(F.ltrim(given).startswith("["), F.from_json(given, "array<string>")).when(F.trim(given) != "", F.array(given))
    found = F.filter(F.transform("media", media_source_id), lambda s: s.isNotNull())
    return records.select("id", F.explode(F.array_union(content, source_keys(F.coalesce(told, found)))).alias("key"))


def overlapping(keys: DataFrame, banned: DataFrame) -> DataFrame:
    """The distinct ids that share any key (id, key) with the banned ones (key)."""
    return keys.join(banned.select("key").distinct(), "key", "left_semi").select("id").distinct()


def without_leaks(records: DataFrame, evaluation: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """The records that share no key with the evaluation records."""
    return records.join(overlapping(record_keys(records, digests), record_keys(evaluation, digests)), "id", "left_anti")


def repeated_to(df: DataFrame, groups: list[str], n: int, key: Column, most: int | None = MOST_REPEATS) -> DataFrame:
    """Each group repeated cyclically in hash order up to n rows, not beyond `most` times; larger ones as they are. `copy` counts from 0."""
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("c__")).select(*[F.col(g).alias(f"{g}__r") for g in groups], "c__")
    same = [F.col(g).eqNullSafe(F.col(f"{g}__r")) for g in groups]
    ranked = hash_rank(df, groups, order_key(0, key), key)
    ranked = ranked.join(sizes, same) if groups else ranked.crossJoin(F.broadcast(sizes))  # without groups, one row
    goal = F.greatest(F.col("c__"), F.least(F.lit(n), F.col("c__") * most) if most else F.lit(n))
    copies = F.floor((goal - F.col("rank")) / F.col("c__"))
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies))).drop("c__", "rank", *[f"{g}__r" for g in groups])


def balanced(df: DataFrame, group: str, key: Column, per_group: int | None = None, repeat_to: int | None = None) -> DataFrame:
    """At most per_group rows of each group; groups below repeat_to are repeated, MOST_REPEATS times at most. A missing group is `None`."""
    rows = df.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("None")))
    if per_group:
        rows = hash_rank(rows, [group], order_key(0, key), key).filter(F.col("rank") <= per_group).drop("rank")
    if repeat_to:
        return repeated_to(rows, [group], min(repeat_to, per_group or repeat_to), key)
    return rows.withColumn("copy", F.lit(0).cast("long"))


def weighted(df: DataFrame, weight: float, key: Column) -> DataFrame:
    """round(n * weight) rows, half to even: a sample in hash order, or cyclic repeats without a limit."""
    total = df.agg(F.count(F.lit(1)).alias("n__"))
    ranked = hash_rank(df, [], order_key(0, key), key).crossJoin(F.broadcast(total)).withColumn("goal__", F.bround(F.col("n__") * F.lit(float(weight))).cast("long"))  # one row
    copies = F.floor((F.col("goal__") - F.col("rank")) / F.col("n__"))
    return ranked.filter(F.col("rank") <= F.col("goal__")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies))).drop("n__", "goal__", "rank")


@dataclass(frozen=True)
class Source:
    """A part of a mixture: at most max_samples of its records, balanced by a meta key, repeated, weighted."""

    name: str
    split: str = "train"
    max_samples: int | None = None
    weight: float = 1.0
    group_by: str | None = None
    per_group: int | None = None
    repeat_to: int | None = None


def parsed_sources(text: str) -> list[Source]:
    """`name, name:split, file.jsonl` as sources."""
    out = []
    for item in filter(None, (x.strip() for x in text.split(","))):
        name, colon, split = item.partition(":")
        out.append(Source(name, split) if colon and not item.endswith(".jsonl") else Source(item))
    return out


def sources_of(config: str | list) -> list[Source]:
    """Sources from `name, name:split` text, a list of names or dicts, or YAML text with a list `sources` (one field to a line, as `mixture_config` writes it). An unknown field is an error that tells the nearest."""
    if isinstance(config, str) and "sources:" not in config:
        return parsed_sources(config)
    items: list = [] if isinstance(config, str) else list(config)
    if isinstance(config, str):
        for line in config.splitlines():
            text = line.split(" #")[0].strip()
            if not text or text.startswith("#") or text == "sources:":
                continue
            if text.startswith("- "):
                items.append({})
                text = text[2:].strip()
            name, colon, value = text.partition(":")
            if not items or not colon:
                raise ValueError(f"not a field: {line!r}")
            items[-1][name.strip()] = value.strip().strip("\"'")
    out = []
    for item in items:
        if isinstance(item, str):
            out += parsed_sources(item)
            continue
        known = {f.name: f for f in fields(Source)}
        for name in item:
            if name not in known:
                near = difflib.get_close_matches(name, known, 1)
                raise ValueError(f"unknown field {name!r} of a source" + (f"; did you mean {near[0]!r}?" if near else ""))
        kinds = {"max_samples": int, "per_group": int, "repeat_to": int, "weight": float}
        out.append(Source(**{k: kinds.get(k, str)(v) if v not in (None, "null", "") else known[k].default for k, v in item.items()}))
    return out


def _by_source(sources: list[Source], value, otherwise=None) -> Column:
    """A number of each row's source (part__); null where it has none."""
    out = F.lit(otherwise)
    for i, s in enumerate(sources):
        if value(s) is not None:
            out = F.when(F.col("part__") == i, F.lit(value(s))).otherwise(out)
    return out


def mixed(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """Rows of all sources (part__, id and others) as often as the mixture takes them.

    Every step is made for all sources at once, by ranks within sources and groups, and left out
    where no source asks for it: groups are cut (of a source without groups, its rows), small ones
    repeated, grouped sources cut, and weights applied, in hash order of the ids.
    """
    key, long = F.col("id"), lambda c: c.cast("long")
    chosen = {s.group_by for s in sources if s.group_by}
    group = F.lit(None).cast("string")
    for g in chosen:
        of_this = F.col("part__").isin([i for i, s in enumerate(sources) if s.group_by == g])
        group = F.when(of_this, F.coalesce(F.try_element_at("meta", F.lit(g)), F.lit("None"))).otherwise(group)
    rows, by = rows.withColumn("group__", group), ["part__", "group__"]
    most = long(_by_source(sources, lambda s: s.per_group if s.group_by else s.max_samples))
    goal = long(_by_source(sources, lambda s: s.repeat_to and (min(s.repeat_to, s.per_group or s.repeat_to) if s.group_by else s.repeat_to)))
    if any((s.per_group if s.group_by else s.max_samples) or s.repeat_to for s in sources):
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n__")).select(*[F.col(c).alias(f"{c}r") for c in by], F.least("n__", most).alias("n__"))
        ranked = hash_rank(rows, by, order_key(0, key), key, "r__").filter(most.isNull() | (F.col("r__") <= most))
        same = [F.col(c).eqNullSafe(F.col(f"{c}r")) for c in by]
        whole = F.when(goal.isNull(), F.col("n__")).otherwise(F.greatest("n__", F.least(goal, F.col("n__") * MOST_REPEATS)))
        copies = F.floor((whole - F.col("r__")) / F.col("n__"))
        rows = ranked.join(sizes, same).withColumn("copy__", F.explode(F.sequence(F.lit(0).cast("long"), copies))).drop("r__", "n__", *[f"{c}r" for c in by])
    else:
        rows = rows.withColumn("copy__", F.lit(0).cast("long"))
    if any(s.group_by and s.max_samples for s in sources):
        limit = long(_by_source(sources, lambda s: s.max_samples if s.group_by else None))
        rows = hash_rank(rows, ["part__"], order_key(0, key, F.col("copy__")), F.struct(key, "copy__"), "r__").filter(limit.isNull() | (F.col("r__") <= limit)).drop("r__")
    if any(s.weight != 1.0 for s in sources):
        sizes = rows.groupBy(F.col("part__").alias("part__r")).agg(F.count(F.lit(1)).alias("n__"))
        ranked = hash_rank(rows, ["part__"], order_key(0, key), F.struct(key, "copy__"), "r__").join(F.broadcast(sizes), F.col("part__") == F.col("part__r"))  # a row for each source
        whole = long(F.bround(F.col("n__") * _by_source(sources, lambda s: float(s.weight))))
        ranked = ranked.withColumn("goal__", whole).filter(F.col("r__") <= F.col("goal__"))
        rows = ranked.withColumn("again__", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("goal__") - F.col("r__")) / F.col("n__"))))).drop("again__", "goal__", "r__", "n__", "part__r")
    return rows.drop("group__", "copy__")


def build_mixture(sources: list[tuple[Source, DataFrame]], evaluation: DataFrame | None = None, digests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture of record sources, and its report (source, loaded, overlap_removed, used).

    In order: leaks go, groups are balanced, samples are capped, small sources repeated, weights
    applied; see `mixed`. With groups, the cap comes after balancing. Rows are in no order: sort by
    `order_key` for a shuffle. Leaks are told once, for all sources together and by source and id,
    so that sources may use the same ids; what is flagged is kept for the mixture and its report.
    """
    every = None
    for i, (_, records) in enumerate(sources):
        part = records.withColumn("part__", F.lit(i))
        every = part if every is None else every.unionByName(part)
    if evaluation is None:
        every = every.withColumn("bad__", F.lit(False))
    else:
        own = F.concat(F.col("part__").cast("string"), F.lit("|"), F.col("id"))
        keys = record_keys(every.withColumn("id", own), digests)
        bad = overlapping(keys, record_keys(evaluation, digests)).select(F.col("id").alias("own__"), F.lit(True).alias("bad__")).persist()
        every = every.withColumn("own__", own).join(bad, "own__", "left").drop("own__").withColumn("bad__", F.coalesce("bad__", F.lit(False)))
    mixture = mixed(every.filter(~F.col("bad__")).drop("bad__"), [s for s, _ in sources])
    loaded = every.groupBy("part__").agg(F.count(F.lit(1)).alias("loaded"), F.count_if("bad__").alias("overlap_removed"))
    used = mixture.groupBy("part__").agg(F.count(F.lit(1)).alias("used"))
    names = mixture.sparkSession.createDataFrame([(i, s.name) for i, (s, _) in enumerate(sources)], "part__ int, source string")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    report = names.join(loaded, "part__", "left").join(used, "part__", "left").select("source", *map(count, ("loaded", "overlap_removed", "used")))
    return mixture.drop("part__"), report
