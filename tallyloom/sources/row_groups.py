"""Chosen rows of Parquet files, late: only row groups that hold one are read, and of them only some columns.

`fetched` takes the choice as a table of any size: footers, read by tasks, tell in which group a
row lies; the choice is gathered by group, and each group is read by one task. The data source
`row_groups` takes the choice as a filter on file and row: its partitions are the row groups that
the filter leaves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import LongType, StringType, StructType

from tallyloom.sources.stores import Ranged, reachable


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, starts): the first row of each row group of each Parquet file under a path. Files are listed, not read; a task reads the footers of some of them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select(F.col("_metadata.file_path").alias("file"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = []
            for file in batch.column("file").to_pylist():
                with Ranged(file) as f:
                    starts.append(_starts(pq.read_metadata(f)))
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(starts, pa.list_(pa.int64()))], ["file", "starts"])

    return files.mapInArrow(told, "file string, starts array<bigint>")


def _starts(meta: pq.FileMetaData) -> list[int]:
    out = [0]
    for k in range(meta.num_row_groups - 1):
        out.append(out[-1] + meta.row_group(k).num_rows)
    return out


def fetched(spark: SparkSession, path: str, chosen: DataFrame, columns: list[str], told: str | None = None) -> DataFrame:
    """(columns, file, row) of the rows of Parquet files under `path` that are in `chosen` (file, row); each once, and null or unknown ones not at all.

    `file` is as `readers.with_address` gives it. A group's chosen row numbers are gathered for the task that reads it: as many as the group has
    rows at most. With `told`, a column of that name says how many bytes were read for the row's
    group, footer included. In a store that tasks cannot open by range, Spark reads the columns
    of whole files and joins.
    """
    kind = spark.read.parquet(path).select(*columns).schema
    if not reachable(path):
        wide = spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        out = wide.join(chosen.select("file", "row").distinct(), ["file", "row"], "left_semi")
        return out.withColumn(told, F.lit(None).cast("long")) if told else out
    known = chosen.filter("file is not null and row >= 0").select("file", "row")
    placed = known.join(footers(spark, path), "file").withColumn("group", F.size(F.filter("starts", lambda s: s <= F.col("row"))) - 1)
    wanted = placed.groupBy("file", "group").agg(F.array_sort(F.collect_set(F.col("row") - F.get("starts", F.col("group")))).alias("rows"), F.first(F.get("starts", F.col("group"))).alias("start"))
    out = StructType(kind.fields).add("file", StringType()).add("row", LongType())
    out = out.add(told, LongType()) if told else out
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with Ranged(r["file"]) as f:
                    file = pq.ParquetFile(f)
                    rows = [x for x in r["rows"] if x < file.metadata.row_group(r["group"]).num_rows]
                    table = file.read_row_group(r["group"], columns=columns).take(pa.array(rows, pa.int64()))
                    extra = [pa.array([r["file"]] * len(rows), pa.string()), pa.array([r["start"] + x for x in rows], pa.int64())]
                    extra += [pa.array([f.fetched] * len(rows), pa.int64())] if told else []
                    yield from pa.Table.from_arrays([*(table.column(c).cast(shape.field(c).type) for c in columns), *extra], schema=shape).to_batches()

    # Gathered by group, so that tasks take their groups one by one.
    return wanted.select("file", "group", "rows", "start").mapInArrow(read, out)


class Group(InputPartition):
    def __init__(self, file: str, group: int, start: int):
        self.file, self.group, self.start = file, group, start


class RowGroupReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.paths = [p for p in options["path"].split(",") if p]
        self.columns = [f.name for f in schema.fields if f.name not in ("file", "row")]
        self.schema = schema
        self.least, self.most = 0, None
        self.files: set[str] | None = None
        self.rows: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what filters say of file and row to choose groups. Spark still applies all of them to the rows."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("file",), ("row",)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                name = "files" if f.attribute == ("file",) else "rows"
                old = getattr(self, name)
                setattr(self, name, values if old is None else old & values)
            elif getattr(f, "attribute", None) == ("row",):
                if isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    last = f.value - isinstance(f, LessThan)
                    self.most = last if self.most is None else min(self.most, last)
            yield f

    def partitions(self) -> list[Group]:
        out = []
        for path in self.paths:
            if self.files is not None and path not in self.files:
                continue
            with Ranged(path) as f:
                meta = pq.read_metadata(f)
            for k, start in enumerate(_starts(meta)):
                last = start + meta.row_group(k).num_rows - 1
                if last < max(start, self.least) or (self.most is not None and start > self.most):
                    continue
                if self.rows is None or any(start <= r <= last for r in self.rows):
                    out.append(Group(path, k, start))
        return out

    def read(self, partition: Group | None) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # the filters leave no group
            return
        shape = to_arrow_schema(self.schema)
        with Ranged(partition.file) as f:
            at = partition.start
            for batch in pq.ParquetFile(f).iter_batches(row_groups=[partition.group], columns=self.columns):
                own = {c: batch.column(c).cast(shape.field(c).type) for c in self.columns}
                own |= {"file": pa.array([partition.file] * len(batch), pa.string()), "row": pa.array(range(at, at + len(batch)), pa.int64())}
                at += len(batch)
                yield pa.RecordBatch.from_arrays([own[n] for n in shape.names], schema=shape)


class RowGroupSource(DataSource):
    """Files with row numbers: spark.dataSource.register(RowGroupSource); spark.read.format("row_groups").option("columns", "id,audio").load("a.parquet,b.parquet").filter("row in (7, 8)")

    With spark.sql.python.filterPushdown.enabled, filters on file and row choose the row groups
    that are read. Footers of the files named are read on the driver; for many files see `fetched`.
    """

    @classmethod
    def name(cls):
        return "row_groups"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        with Ranged(self.options["path"].split(",")[0]) as f:
            kind = from_arrow_schema(pq.read_schema(f))
        some = [c for c in self.options.get("columns", "").split(",") if c] or kind.names
        return StructType([kind[c] for c in some]).add("file", StringType()).add("row", LongType())

    def reader(self, schema):
        return RowGroupReader(self.options, schema)
