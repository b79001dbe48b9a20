"""What the text operators share: Arrow text buffers as numpy bytes, word bounds and hashes, shared tables.

Words are maximal runs of bytes other than space and tab to carriage return, which are the same in
UTF-8 and in code points. All hashes are 64 bits; two different words or shingles that meet in one
document or pair collide with a chance below 1e-11.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Bytes of text that are worked on at once within a task; of long chains of steps, LONG_BYTES.
SLICE_BYTES, LONG_BYTES = 1 << 19, 1 << 21
#: Bytes of an Arrow batch between Spark and Python, unless the session has less.
BATCH_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 17))
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """Consecutive texts of an Arrow column as bytes: data, and bounds of each (a null is empty)."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends

    def __len__(self) -> int:
        return len(self.starts)


def texts_of(column: pa.Array) -> Texts:
    """The bytes of a string column without copying it."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    valid, offsets, data = column.buffers()
    n, at = len(column), column.offset
    if n == 0 or data is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64))
    bounds = np.frombuffer(offsets, np.int64, n + 1, at * 8)
    starts, ends = bounds[:-1].copy(), bounds[1:].copy()
    if column.null_count:
        empty = np.asarray(column.is_null())
        ends[empty] = starts[empty]
    return Texts(np.frombuffer(data, np.uint8), starts, ends)


def slices(texts: Texts, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Runs of texts of about `most` bytes; a longer text is a run of its own. Bounds start at 0."""
    n, i = len(texts), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(texts.ends, texts.starts[i] + most, "right")))
        j = min(j, n)
        a, b = int(texts.starts[i]), int(texts.ends[i:j].max())
        yield i, j, Texts(texts.data[a : max(a, b)], texts.starts[i:j] - a, texts.ends[i:j] - a)
        i = j


def word_bounds(texts: Texts, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each text (one more entry than texts)."""
    data = texts.data
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(separator[data], out=inside[:n])
    cuts = texts.starts[(texts.starts < texts.ends)]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    stops = np.zeros(n + 1, bool)
    stops[1:] = inside[:n]
    stops &= ~inside
    at = cuts[cuts > 0]
    stops[at] |= inside[at - 1]
    ends = np.flatnonzero(stops)
    first = np.searchsorted(starts, np.append(texts.starts, n if not len(texts) else texts.ends[-1]))
    return starts, ends, first


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A hash of every word's bytes, after folding each byte."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[fold[data]] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `size` words inside a text, or of all words of a shorter text; and bounds by text."""
    n = len(words)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        if n > k:
            total[: n - k] += words[k:] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 2**64))
    counts = np.diff(first)
    whole = np.maximum(counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(whole)])
    index = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], whole)
    out = total[index] if n else total
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        some = words[first[i] : first[i + 1]]
        out[bounds[i]] = np.sum(some * np.array([pow(0xD6E8FEB86659FD93, k + 1, 2**64) for k in range(len(some))], np.uint64))
    return mix(out), bounds


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


@F.arrow_udf(LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Words of each text; 0 for null."""
    found = [np.diff(word_bounds(part)[2]) for _, _, part in slices(texts_of(texts))]
    return pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())


def named(name: str) -> Column:
    """A column whose name may hold any character."""
    return F.col("`" + name.replace("`", "``") + "`")


def identity(text: Column) -> Column:
    """128 bits of a text's SHA-256, by which texts of a whole corpus are told apart; null stays null."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """One struct column with the whole input row, so that its names clash with nothing."""
    return df.select(F.struct(*[named(c) for c in df.columns]).alias(name))


def unpacked(df: DataFrame, like: DataFrame, *others: Column, names: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `like` from the struct `row`, but for those in names, and other columns."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in like.columns if c not in names], *others)


def bounded(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the number of rows in them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Where it is unset, a temporary one if everything runs on this machine (tests); else an error, as executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir("file://" + folder)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tallyloom-{uuid.uuid4().hex}"


_WRITTEN: list[str] = []


def reserved(spark: SparkSession) -> str:
    """A new folder that is dropped like a shared table."""
    _WRITTEN.append(shared_dir(spark))
    return _WRITTEN[-1]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    path = reserved(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def marked() -> int:
    """How many shared tables there are by now; see `settled`."""
    return len(_WRITTEN)


def settled(df: DataFrame, mark: int) -> DataFrame:
    """A result, written; the shared tables since the mark, which it was made from, are dropped."""
    out, path = written(df)
    drop(df.sparkSession, *[p for p in _WRITTEN[mark:] if p != path])
    return out


def sweep(spark: SparkSession) -> None:
    """Delete all shared tables of this process, once no result that reads them is needed."""
    drop(spark, *list(_WRITTEN))


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete shared tables that are no longer read."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


#: Rows, and bytes of their values, up to which a lookup table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row's values."""
    one = lambda f: F.coalesce(F.octet_length(named(f.name)), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.octet_length(F.to_json(F.struct(named(f.name)))) if hasattr(f.dataType, "elementType") or hasattr(f.dataType, "fields") or hasattr(f.dataType, "keyType") else F.lit(8)
    return sum((one(f) + 8 for f in df.schema.fields), F.lit(0))


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", most: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Join a table by its keys; one that repeats a key repeats rows. It is broadcast if counted at most `most` rows and BROADCAST_BYTES; else both sides are salted, as a key may be hot. A row's salt is that of the task it comes from, which a task that runs again has as well."""
    right = small.select(*[F.col(k).alias(f"{k}__r") for k in keys], *[c for c in small.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys]
    gone = [f"{k}__r" for k in keys]
    held = small.limit(most + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_bytes(small)), F.lit(0)).alias("bytes")).first()
    if held.rows <= most and held.bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(right), same, how).drop(*gone)
    left = big.withColumn("salt__", F.pmod(F.spark_partition_id(), F.lit(salts)).cast("long"))
    right = right.withColumn("salt__r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*same, F.col("salt__") == F.col("salt__r")], how).drop(*gone, "salt__", "salt__r")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, by: list[str], once: bool = False) -> DataFrame:
    """An inner join on keys. Rows of `left` whose key (by) is in `hot` (by, salts) are dealt over salts + 1 parts, and those of `right` are copied to each; null keys meet nothing. With `once`, rows that repeat stay once: they lie in one part, so that this moves nothing."""
    none = F.lit(0).cast("long")
    dealt = lookup(left, hot, by).withColumn("part__", F.pmod(F.xxhash64(*left.columns), F.coalesce("salts", none) + 1)).drop("salts")
    copied = lookup(right, hot, by).withColumn("part__", F.explode(F.sequence(none, F.coalesce("salts", none)))).drop("salts")
    met = dealt.join(copied, [*keys, "part__"])
    return (met.distinct() if once else met).drop("part__")
