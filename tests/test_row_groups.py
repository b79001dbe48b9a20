"""Chosen rows are read by row group: the bytes read follow the chosen groups, not the file."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyloom.sources import readers, row_groups

ROWS, GROUP = 4000, 100


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two files of 40 row groups; the wide column is noise that does not compress."""
    at = tmp_path_factory.mktemp("some dir +%")
    rng = np.random.default_rng(0)
    for k in range(2):
        ids = np.arange(ROWS) + k * ROWS
        wide = [rng.bytes(2000) for _ in ids]
        pq.write_table(pa.table({"id": ids, "wide": pa.array(wide, pa.binary()), "other": [b"x" * 3000] * ROWS}), at / f"f{k}.parquet", row_group_size=GROUP, write_statistics=False)
    return str(at)


def chosen_of(spark, folder, condition):
    return readers.with_address(spark.read.parquet(folder)).filter(condition).select("id", "file", "row")


def test_bytes_follow_the_chosen_groups(spark, folder):
    whole = ROWS * 2000
    for condition, groups in (("id = 5", 1), ("id in (5, 6, 99)", 1), ("id in (5, 3999, 4000)", 3), ("id % 1000 = 7", 8)):
        out = row_groups.fetched(spark, folder, chosen_of(spark, folder, condition), ["wide", "id"], told="bytes").collect()
        assert sorted(r.id for r in out) == sorted(r.id for r in spark.read.parquet(folder).filter(condition).collect())
        read = sum({(r.file, (r.row // GROUP)): r.bytes for r in out}.values())
        assert len({(r.file, r.row // GROUP) for r in out}) == groups
        assert groups * GROUP * 2000 <= read < groups * (GROUP * 2000 + 70_000) < whole / 2


def test_rows_are_those_of_the_scan(spark, folder):
    chosen = chosen_of(spark, folder, "id % 37 = 3")
    out = {(r.file, r.row): (r.id, bytes(r.wide)) for r in row_groups.fetched(spark, folder, chosen.unionByName(chosen), ["id", "wide"]).collect()}
    want = {(r.file, r.row): (r.id, bytes(r.wide)) for r in readers.with_address(spark.read.parquet(folder)).filter("id % 37 = 3").collect()}
    assert out == want
    none = spark.createDataFrame([(None, 1), ("file:/nowhere.parquet", 1), (next(iter(want))[0], 10**9), (next(iter(want))[0], None)], "file string, row long")
    assert row_groups.fetched(spark, folder, none, ["id"]).count() == 0
    assert row_groups.fetched(spark, folder, chosen.limit(0), ["id"]).columns == ["id", "file", "row"]


def test_filters_choose_partitions(spark, folder):
    spark.dataSource.register(row_groups.RowGroupSource)
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        files = [f"{folder}/f{k}.parquet" for k in range(2)]
        table = lambda: spark.read.format("row_groups").option("columns", "id").load(",".join(files))
        assert table().count() == 2 * ROWS
        for condition, parts in (("row in (5, 250)", 4), ("row >= 3950", 2), ("row > 99 and row < 301", 6), ("row <= 99", 2), (f"file = '{files[1]}' and row = 8", 1), ("row < 0", 0)):
            some = table().filter(condition)
            assert some.rdd.getNumPartitions() == max(parts, 1), condition
            want = sorted(i for i in range(2 * ROWS) if eval(condition.replace(" = ", " == "), {"row": i % ROWS, "file": files[i // ROWS]}))
            assert sorted(r.id for r in some.collect()) == want
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", old)


def test_stores_that_tasks_cannot_open_are_scanned(spark, folder, monkeypatch):
    monkeypatch.setattr(row_groups, "reachable", lambda path: False)
    out = row_groups.fetched(spark, folder, chosen_of(spark, folder, "id in (5, 6)"), ["id"], told="bytes").collect()
    assert sorted((r.id, r.bytes) for r in out) == [(5, None), (6, None)]
