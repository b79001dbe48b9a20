"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so that a question with other values has the
same windows. Windows of documents and items meet by hash; a pair with slots counts only if they
agree: along an alignment, equal values of the item must stand for equal values in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.kit import identity, LOWER, Texts, lookup, marked, mix, named, packed, record, settled, shingle_hashes, signed, slices, texts_of, unpacked, word_bounds, word_hashes, written

#: Tokens in a window (an item of fewer is one window), and literal ones that a template needs; a window with fewer is taken as it stands.
WINDOW, LITERALS = 8, 4
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: Bits of the filter that documents are read through. It only saves work: it has no false negatives, whatever the number of items.
FILTER_BITS = 1 << 24
# Units that may follow a number.
UNITS = "mm cm m km in inch inches ft foot feet yd yards mi mile miles mg g kg lb lbs oz pound pounds gram grams ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent degrees dollars dollar cents usd eur euros gbp k kb mb gb tb hz khz mhz ghz w kw v mph kmh".split()

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_TOKEN[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_POINT = np.zeros(256, bool)
_POINT[[0x2E, 0x2C]] = True
_STOP = np.zeros(256, bool)
_STOP[np.frombuffer(b".!?\n:;|\"(", np.uint8)] = True
_SEPARATE = np.array([True, False])
_AS_IS = np.arange(256, dtype=np.uint8)
_HOLES = mix(np.arange(1, 4, dtype=np.uint64))


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of Latin-1 letters."""
    out = LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


def _unit_hashes() -> np.ndarray:
    text = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = word_bounds(Texts(text, np.zeros(1, np.int64), np.array([len(text)])))
    return np.sort(word_hashes(text, starts, ends, _AS_IS))


def tokens_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Literal hash and kind (0 literal, 1 number, 2 name, 3 unit) of each token, and each text's first token."""
    data = texts.data
    inside = _TOKEN[data]
    digit = _DIGIT[data]
    if len(data) > 2:
        inner = np.ones(len(data), bool)  # a sign at the edge of a text has no neighbour beyond it
        inner[texts.starts[texts.starts < texts.ends]] = False
        inner[texts.ends[texts.starts < texts.ends] - 1] = False
        inside[1:-1] |= _POINT[data[1:-1]] & digit[:-2] & digit[2:] & inner[1:-1]
        for at in np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)):  # general punctuation
            inside[at : at + 3] = False
    starts, ends, first = word_bounds(Texts(inside.view(np.uint8), texts.starts, texts.ends), _SEPARATE)
    folded = _folded(data)
    literal = word_hashes(folded, starts, ends, _AS_IS)
    sums = np.zeros((2, len(data) + 1), np.int64)
    np.cumsum(digit | _POINT[data], out=sums[0, 1:])
    np.cumsum(_STOP[data], out=sums[1, 1:])
    number = (sums[0, ends] - sums[0, starts] == ends - starts) & digit[starts] if len(starts) else np.zeros(0, bool)
    before = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    opens = sums[1, starts] > sums[1, before]
    opens[first[:-1][first[:-1] < len(starts)]] = True
    upper = folded != data
    next_ = np.minimum(starts + 1 + (data[starts] >= 0x80), np.maximum(ends - 1, 0)) if len(starts) else starts
    big = upper[starts] | (data[starts] == 0xC3) & upper[np.minimum(starts + 1, len(data) - 1)] if len(starts) else np.zeros(0, bool)
    name = big & ~opens & (next_ > starts) & ~upper[next_] & ~number if len(starts) else np.zeros(0, bool)
    after_number = np.zeros(len(starts), bool)
    after_number[1:] = number[:-1]
    after_number[first[:-1][first[:-1] < len(starts)]] = False
    unit = after_number & np.isin(literal, _UNIT_HASHES) & ~number
    return literal, np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0))).astype(np.int8), first


_UNIT_HASHES = _unit_hashes()


def windows_of(literal: np.ndarray, kind: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, first token of every window of `size` tokens, and whether it is a template with slots.

    A window with slots is also taken as it stands, for copies in which names cannot be told (all
    in capitals); with few literal tokens it is taken only so. Texts with fewer tokens have none.
    """
    template = np.where(kind > 0, _HOLES[np.maximum(kind, 1) - 1], literal)
    hashes, bounds = shingle_hashes(template, first, size)
    plain, _ = shingle_hashes(literal, first, size)
    counts, sizes = np.diff(first), np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), sizes)
    at = np.arange(len(hashes)) - np.repeat(bounds[:-1] - first[:-1], sizes)
    sums = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(kind > 0, out=sums[1:])
    full = counts[owner] >= size
    slots = np.where(full, sums[np.minimum(at + size, len(kind))] - sums[at], 0)
    holed = np.flatnonzero(full & (slots > 0) & (size - slots >= min(LITERALS, size)))
    plainly = np.flatnonzero(full)
    some = np.concatenate([holed, plainly])
    return np.concatenate([hashes[holed], plain[plainly]]) + np.uint64(size), owner[some], at[some], np.arange(len(some)) < len(holed)


def _slots(literal: np.ndarray, kind: np.ndarray, at: np.ndarray, size: int, holed: np.ndarray) -> pa.Array:
    return pa.array([signed(literal[a : a + size][kind[a : a + size] > 0]).tolist() if h else [] for a, h in zip(at, holed, strict=True)], pa.list_(pa.int64()))


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, item_key, hash, size, pos, slots, windows): every window of every item. The key tells texts that share an id apart; equal ones are one item."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part in slices(texts_of(batch.column(1))):
                literal, kind, first = tokens_of(part)
                counts = np.diff(first)
                for size in range(1, WINDOW + 1):
                    hashes, owner, at, holed = windows_of(literal, kind, first, size)
                    mine = np.minimum(counts[owner], WINDOW) == size
                    hashes, owner, at, holed = hashes[mine], owner[mine], at[mine], holed[mine]
                    if len(owner):
                        yield record(item_id=batch.column(0).slice(i, j - i).take(pa.array(owner)), item_key=batch.column(2).slice(i, j - i).take(pa.array(owner)), hash=signed(hashes), size=np.full(len(owner), size), pos=at - first[owner], slots=_slots(literal, kind, at, size, holed), windows=counts[owner] - size + 1)

    kind = benchmark.schema[item].dataType.simpleString()
    once = benchmark.select(named(item).alias("item"), named(text).alias("text"), identity(named(text)).alias("key")).distinct()
    return once.mapInArrow(emit, f"item_id {kind}, item_key binary, hash long, size long, pos long, slots array<long>, windows long")


def _filter_of(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bit for each hash (at most FILTER_BITS / 64 rows come to the driver) and the sizes of windows."""
    bits = windows.select(F.pmod("hash", F.lit(FILTER_BITS)).alias("b")).groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("m")).collect()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for r in bits:
        words[r.w] = r.m
    return words.view(np.uint64), [r.size for r in windows.select("size").distinct().collect()]


def matches(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, matched, coverage, reparameterised) of every text that holds an item; key tells the text (see `kit.identity`).

    A null or empty text or item matches nothing. Equal texts are one key. Items without tokens
    cannot be found. Items that share an id (or have none) with other texts are found each by
    itself; of one id the one with the largest coverage is told. Very long texts are read whole.
    An empty table on either side gives an empty table. Columns may have any other names.
    """
    items, _ = written(item_windows(benchmark, item, item_text))
    words, sizes = _filter_of(items)
    shared = df.sparkSession.sparkContext.broadcast(words)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            keys, seen = np.unique(np.asarray(batch.column(1)), return_index=True)
            batch = batch.take(pa.array(np.sort(seen)))
            for i, j, part in slices(texts_of(batch.column(0))):
                literal, kind, first = tokens_of(part)
                for size in sizes:
                    hashes, owner, at, holed = windows_of(literal, kind, first, size)
                    bit = hashes % np.uint64(FILTER_BITS)
                    some = np.flatnonzero(words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
                    if len(some):
                        hashes, owner, at, holed = hashes[some], owner[some], at[some], holed[some]
                        yield record(key=batch.column(1).slice(i, j - i).take(pa.array(owner)), hash=signed(hashes), at=at - first[owner], found=_slots(literal, kind, at, size, holed))

    rows = df.filter(named(text).isNotNull()).select(named(text), identity(named(text)).alias("key")).mapInArrow(hits, "key binary, hash long, at long, found array<long>").distinct()
    met = lookup(rows, items, ["hash"], "inner").filter(F.size("slots") == F.size("found"))
    met = met.withColumn("line", F.col("at") - F.col("pos"))
    # The slots of an alignment agree if each of the item's values stands for one value of the text. Windows without slots, taken word for word, count whether they agree or not.
    pairs = F.transform(F.arrays_zip("slots", "found"), lambda z: F.struct(z["slots"].alias("s"), z["found"].alias("f")))
    at = lambda some: F.collect_set(F.when(some, F.col("pos")))
    lines = met.groupBy("key", "item_id", "item_key", "line").agg(F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"), at(F.size("slots") == 0).alias("plain"), at(F.size("slots") > 0).alias("holed"), F.max("windows").alias("windows"))
    agree = F.size(F.array_distinct(F.transform("pairs", lambda p: p["s"]))) == F.size("pairs")
    lines = lines.withColumn("at", F.when(agree, F.array_union("plain", "holed")).otherwise(F.col("plain"))).withColumn("other", agree & F.exists("pairs", lambda p: p["s"] != p["f"]))
    good = lines.filter(F.size("at") > 0)
    found = good.groupBy("key", "item_id", "item_key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("matched"), F.max("windows").alias("windows"), F.min("other").alias("reparameterised"))
    found = found.withColumn("coverage", F.col("matched") / F.col("windows")).filter(F.col("coverage") >= COVERAGE)
    best = found.groupBy("key", "item_id").agg(F.max(F.struct("coverage", "matched", "reparameterised")).alias("best"))
    return best.select("key", "item_id", "best.matched", "best.coverage", "best.reparameterised")


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text holds no item, with their columns, whatever their names; a null text holds none."""
    mark = marked()
    bad = settled(matches(df, benchmark, text).select("key").distinct().withColumn("bad", F.lit(True)), mark)
    rows = packed(df).withColumn("key", identity(F.col("row").getField(text)))
    return unpacked(lookup(rows, bad, ["key"]).filter(F.col("bad").isNull()), df)


def op5_decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for every document and benchmark item that it holds. See `matches`; repeated documents have their rows each."""
    mark = marked()
    found = settled(matches(documents, benchmark), mark)
    keyed = documents.select("doc_id", identity(F.col("text")).alias("key"))
    return lookup(keyed, found, ["key"], "inner").select("doc_id", "item_id", "matched", "coverage", "reparameterised")
