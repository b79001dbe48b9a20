"""Readers and writers of record sources."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import json_type
from tallyloom.operators.records import RECORD, valid
from tallyloom.operators.sampling import take
from tallyloom.sources import record_json


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records from JSON lines, whose questions and targets are objects by name (see `record_json`) or arrays, as the first line has it; blank lines are skipped, a broken one is an error."""
    first = spark.read.text(path).filter(F.trim("value") != "").select(json_type(F.get_json_object("value", "$.questions")).alias("kind")).first()
    if first and first.kind == "object":
        return record_json.read_lines(spark, path)
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


def write_records(records: DataFrame, path: str) -> int:
    """Write records as JSON lines and tell how many; the folder appears whole or not at all."""
    from pyspark.sql import Observation

    seen = Observation()
    records.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def read_any(spark: SparkSession, path: str, ending: str | None = None) -> DataFrame:
    """A table by the ending of its path: parquet, csv, tsv, json (an array, or an object around the first of its lists of objects), xml, else JSON lines. CSV is read with `sep` given as part of the ending, as in `csv&`."""
    ending = ending or path.rstrip("/").removesuffix(".gz").rpartition(".")[2].lower()
    if ending == "parquet":
        return spark.read.option("mergeSchema", "true").parquet(path)
    if ending.startswith("csv") or ending == "tsv":
        return spark.read.options(header=True, sep="\t" if ending == "tsv" else ending[3:] or ",", multiLine=True, escape='"', maxCharsPerColumn=-1).csv(path)
    if ending == "json":
        found = spark.read.option("multiLine", True).json(path)
        lists = [f.name for f in found.schema if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"]
        # A file that is one object is around its rows; in a file that is an array, each element is a row, whatever it holds.
        whole = spark.read.text(path, wholetext=True).select(F.ltrim("value").startswith("{").alias("object")).first()
        return found.select(F.explode(lists[0]).alias("row")).select("row.*") if lists and whole and whole.object else found
    if ending == "xml":
        return spark.read.option("rowTag", "row").xml(path)
    return spark.read.json(path)


def read_ragged(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Lines of JSON with differing fields: those of the DDL, with file, line text and null where a line is not JSON."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    return lines.withColumn("row", F.from_json("value", fields)).select("file", "value", "row.*")


def with_address(df: DataFrame) -> DataFrame:
    """A Parquet table with the file and row number of each row, to fetch wide columns of chosen rows later."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def existing(df: DataFrame, path: Column, listing: DataFrame) -> DataFrame:
    """The rows whose file is in a listing (path)."""
    return df.join(listing.select(F.col("path").alias("path__")), path == F.col("path__"), "left_semi")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def materialised(spark: SparkSession, folder: str, name: str, split: str, version: int, cap: int | None, build) -> DataFrame:
    """The valid records of a dataset: from its table of this version and cap if there is one, else the first of one with a larger cap or none in hash order, else built and written. A table of another version is never used. No record is an error."""
    above = f"{folder}/{name}/split={split}/version={version}"
    path = f"{above}/cap={cap or 'all'}"
    caps = _complete_caps(spark, above)
    larger = [c for c in caps if cap and (c is None or c > cap)]
    if cap not in caps and larger:
        reused = min(larger, key=lambda c: c or float("inf"))
        return take(spark.read.schema(RECORD).parquet(f"{above}/cap={reused or 'all'}"), cap, f"{name}:{split}", F.col("id"))
    if cap not in caps:
        records = valid(build(spark, split, cap))
        records.withColumn("meta", F.map_concat(F.create_map(F.lit("source"), F.lit(name)), F.map_filter("meta", lambda k, v: k != "source"))).write.mode("overwrite").parquet(path)
    out = spark.read.schema(RECORD).parquet(path)
    if out.isEmpty():
        raise ValueError(f"dataset {name}, split {split}, has no valid record")
    return out


def _complete_caps(spark: SparkSession, above: str) -> list[int | None]:
    """Caps (None: all records) of the tables of a version that were written to their end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{above}/cap=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    names = [s.getPath().getParent().getName().removeprefix("cap=") for s in found]
    return [None if n == "all" else int(n) for n in names]


def flattened_metrics(metrics: dict, prefix: str = "") -> dict[str, float]:
    """Nested metrics as a/b/c -> number; truth values and texts go."""
    out: dict[str, float] = {}
    for k, v in metrics.items():
        if isinstance(v, dict):
            out |= flattened_metrics(v, f"{prefix}{k}/")
        elif isinstance(v, int | float) and not isinstance(v, bool):
            out[prefix + k] = float(v)
    return out


def results_text(rows: list[dict]) -> tuple[str, str]:
    """Results of benchmarks (a few rows) as JSON and as a Markdown table."""
    names = list(rows[0]) if rows else []
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)] + ["| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows]
    return json.dumps(rows, indent=2, ensure_ascii=False), "\n".join(lines)


def mixture_config(sizes: dict[str, int], keys: dict[str, dict | None], per_group: int = 1000) -> str:
    """A mixture as YAML: each dataset with its size, and, where a meta key balances it, that key and its groups' cap."""
    lines = ["sources:"]
    for name in sorted(sizes):
        lines.append(f"  - name: {name}")
        if keys.get(name):
            lines += [f"    group_by: {keys[name]['key']}", f"    per_group: {per_group}", f"    repeat_to: {min(per_group, max(1, sizes[name] // keys[name]['values']))}"]
        lines.append(f"    # {sizes[name]} records")
    return "\n".join(lines) + "\n"


def mapped_rows(df: DataFrame, f: Callable[[dict], dict | None], fields: str, log: str | None = None) -> DataFrame:
    """Rows of a Python function of each row as a dict (for files that only Python decodes). A row that raises, or gives None, is left out; with `log`, an error is a row with that column set instead. Rows go by Arrow batches."""

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    made = f(row)
                except Exception as e:  # any error of a row concerns that row only
                    made = {log: f"{type(e).__name__}: {e}"} if log else None
                if made is not None:
                    out.append(made)
            yield pa.RecordBatch.from_pylist(out, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(fields + (f", `{log}` string" if log else ""))
    schema = to_arrow_schema(kind)
    return df.mapInArrow(each, kind)


def first_rows(spark: SparkSession, path: str, n: int, columns: list[str] | None = None) -> DataFrame:
    """The first n rows of Parquet files: partitions are read one after the other until there are enough, and row groups beyond are not."""
    df = spark.read.parquet(path)
    return (df.select(*columns) if columns else df).limit(n)
