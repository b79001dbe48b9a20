"""Members of zip and tar archives as rows.

The data source `archive` reads members by their places: a partition is a run of zip members, or a
tar that is streamed. `members` finds the archives under a path and uses it; in a store that tasks
cannot open by range, Spark gives them whole archives instead.
"""

from __future__ import annotations

import fnmatch
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyloom.sources.stores import Ranged, reachable

#: Gaps up to which members are read together, and the bytes of such a run.
GAP, RUN = 3 << 20, 40 << 20


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = RUN) -> list[list[int]]:
    """Indices of byte ranges (start, end), sorted by start, in runs with small gaps and bounded length."""
    runs: list[list[int]] = []
    for i, (start, end) in enumerate(ranges):
        if runs and start - ranges[runs[-1][-1]][1] <= gap and end - ranges[runs[-1][0]][0] <= most:
            runs[-1].append(i)
        else:
            runs.append([i])
    return runs


def members(spark: SparkSession, path: str, pattern: str = "*", quota: int | None = None) -> DataFrame:
    """(archive, member, content) of the files of archives under a path, of each at most `quota`; a tar that is cut off gives what it has, anything that is no archive nothing."""
    files = spark.read.format("binaryFile").load(path)
    if reachable(path):
        found = files.select("_metadata.file_path").toLocalIterator()  # a row for each archive
        parts = [(r.file_path,) for r in found]
        if not parts:
            return spark.createDataFrame([], "archive string, member string, content binary")
        spark.dataSource.register(ArchiveSource)
        options = {"members": pattern} | ({"quota": str(quota)} if quota is not None else {})
        return spark.read.format("archive").options(**options).load(",".join(p for (p,) in parts)).drop("fetched")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column(0), batch.column(1), strict=True):
                for name, data in islice(_inside(content.as_py(), pattern), quota):
                    yield pa.RecordBatch.from_pydict({"archive": [at.as_py()], "member": [name], "content": [data]})

    return files.select("path", "content").mapInArrow(opened, "archive string, member string, content binary")


def _inside(content: bytes, pattern: str) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for x in z.infolist():
                if not x.is_dir() and fnmatch.fnmatch(x.filename, pattern):
                    yield x.filename, z.read(x)
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as t:
            for x in t:
                if x.isfile() and fnmatch.fnmatch(x.name, pattern):
                    yield x.name, t.extractfile(x).read()
    except (tarfile.ReadError, EOFError, io.UnsupportedOperation):
        return


def tables_inside(spark: SparkSession, path: str, fields: str, pattern: str = "*.csv", sep: str = ",") -> DataFrame:
    """The rows of CSV files with a header line inside archives, by the DDL of their fields. A field holds no line break."""
    lines = members(spark, path, pattern).select(F.slice(F.split(F.col("content").cast("string"), "\r?\n"), 2, 1 << 30).alias("lines"))
    return lines.select(F.explode("lines").alias("line")).filter(F.trim("line") != "").select(F.from_csv("line", fields, {"sep": sep}).alias("row")).select("row.*")


def elements_inside(spark: SparkSession, path: str, fields: str, tag: str, pattern: str = "*.xml") -> DataFrame:
    """The elements of one name inside XML files inside archives, by the DDL of their children; attributes are fields with an underscore in front. An element holds none of its own name."""
    attributes = r"""(?:\s+[^\s=/>]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*"""
    whole = F.regexp_extract_all(F.col("content").cast("string"), F.lit(rf"(?s)<{tag}{attributes}(?:/>|>.*?</{tag}\s*>)"), 0)
    rows = members(spark, path, pattern).select(F.explode(whole).alias("element"))
    return rows.select(F.from_xml("element", fields).alias("row")).select("row.*")


class Part(InputPartition):
    """An archive that is streamed (members None), or a run of zip members (name, where its header begins, bytes stored, method, CRC)."""

    def __init__(self, path: str, members: list[tuple[str, int, int, int, int]] | None):
        self.path, self.members = path, members


#: Bytes that are decompressed at once.
STEP = 1 << 20


def _stored(z: zipfile.ZipFile, pattern: str) -> list[tuple[str, int, int, int, int]]:
    some = (x for x in z.infolist() if not x.is_dir() and fnmatch.fnmatch(x.filename, pattern))
    return sorted(((x.filename, x.header_offset, x.compress_size, x.compress_type, x.CRC) for x in some), key=lambda x: x[1])


def _member(f: Ranged, name: str, at: int, size: int, method: int, crc: int) -> bytes:
    """One member of a zip by its place: its header and its bytes are read, nothing else."""
    f.seek(at)
    header = f.read(30)
    if header[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"{name}: no member begins at byte {at}")
    f.seek(at + 30 + int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little"))
    inflate = {zipfile.ZIP_STORED: None, zipfile.ZIP_DEFLATED: zlib.decompressobj(-15)}.get(method, False)
    if inflate is False:
        raise NotImplementedError(f"{name}: compression method {method}")
    out, left = io.BytesIO(), size
    while left:
        piece = f.read(min(left, STEP))
        if not piece:
            raise EOFError(f"{name}: the archive ends inside the member")
        left -= len(piece)
        out.write(inflate.decompress(piece) if inflate else piece)
    if inflate:
        out.write(inflate.flush())
    content = out.getvalue()
    if zlib.crc32(content) != crc:
        raise zipfile.BadZipFile(f"{name}: its checksum differs")
    return content


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.pattern = options.get("members", "*")
        self.quota = int(options["quota"]) if "quota" in options else None

    def partitions(self):
        parts = []
        for path in self.paths:
            with Ranged(path) as f:
                if not zipfile.is_zipfile(f):
                    parts.append(Part(path, None))
                    continue
                f.seek(0)
                with zipfile.ZipFile(f) as z:  # the central directory only
                    found = _stored(z, self.pattern)[: self.quota]
            parts += [Part(path, [found[i] for i in run]) for run in coalesced([(at, at + size) for _, at, size, _, _ in found])]
        return parts

    def read(self, partition):
        if partition is None:
            return
        with Ranged(partition.path) as f:
            if partition.members is None:
                rows = _streamed(f, partition.path, self.pattern, self.quota)
            else:
                rows = ((m[0], _member(f, *m)) for m in partition.members)
            for name, content in rows:
                yield partition.path, name, content, f.fetched


def _streamed(f: Ranged, path: str, pattern: str, quota: int | None) -> Iterator[tuple[str, bytes]]:
    """Members of a tar as they come, a member at a time in memory; a cut off archive gives what it has, and after the quota no more is read."""
    left = quota
    try:
        with tarfile.open(fileobj=f, mode="r|*", bufsize=STEP) as t:
            for x in t:
                if left == 0:
                    return
                if x.isfile() and fnmatch.fnmatch(x.name, pattern):
                    yield x.name, t.extractfile(x).read()
                    left = left and left - 1
                    if left == 0:
                        return
    except (tarfile.ReadError, EOFError, zlib.error, io.UnsupportedOperation):
        return


class ArchiveSource(DataSource):
    """spark.dataSource.register(ArchiveSource); spark.read.format("archive").option("members", "*.json").option("quota", 100).load("s3://a/a.zip,/b.tar.gz")

    (archive, member, content, fetched) of the members whose name matches, of each archive `quota`
    at most. The driver reads the central directories of zip archives; a task reads a run of
    members by their places, or streams a tar until its quota is met. `fetched` is what the task
    has read of the archive so far. A member is one row, so that it, not the archive, has to fit
    a task. Archives may be in any store that Arrow opens.
    """

    @classmethod
    def name(cls):
        return "archive"

    def schema(self):
        return "archive string, member string, content binary, fetched bigint"

    def reader(self, schema):
        return ArchiveReader(self.options)
