import io
import json
import tarfile
import zipfile

from pyspark.sql import functions as F

from tallyloom.operators import records
from tallyloom.sources import archives, readers, row_groups
from tallyloom.streaming import slices


def made(spark):
    df = spark.createDataFrame([("1", '{"z": 1, "a": "x"}', "a"), ("2", "text", "b")], "id string, state string, label string")
    return records.choice_records(df, source="t", state=F.col("state"), instructions="Which?", choices=[("b", "B"), ("a", "A")], label=F.col("label"), id_=F.col("id"))


def test_round_trip_keeps_order_of_options_and_keys(spark, tmp_path):
    path = str(tmp_path / "r")
    assert readers.write_records(made(spark), path) == 2
    back = {r.id: r for r in readers.read_records(spark, path).collect()}
    assert back["1"].state == '{"z": 1, "a": "x"}'
    assert [o.key for o in back["1"].questions[0].options] == ["b", "a"]


def test_readers_by_ending(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a\nb"\n')
    (tmp_path / "a.tsv").write_text("x\ty\n1\ta\n")
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"x": 1}, {"x": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "a.xml").write_text("<t><row><x>1</x></row><row><x>2</x></row></t>")
    counts = {p.name: readers.read_any(spark, str(p)).count() for p in tmp_path.iterdir() if p.suffix != ".crc"}
    assert counts == {"a.csv": 1, "a.tsv": 1, "a.json": 2, "b.json": 2, "a.jsonl": 2, "a.xml": 2}
    (tmp_path / "r.jsonl").write_text('{"x": 1}\n\n{"y": "b"}\nno\n')
    rows = readers.read_ragged(spark, str(tmp_path / "r.jsonl"), "x int, y string").collect()
    assert sorted((r.x is None, r.y or "") for r in rows) == [(False, ""), (True, ""), (True, "b")]


def test_late_columns_and_listing(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10).withColumn("wide", F.repeat(F.lit("x"), 10)).write.parquet(path)
    chosen = readers.with_address(spark.read.parquet(path)).filter("id in (3, 4)")
    assert row_groups.fetched(spark, path, chosen, ["wide"]).count() == 2
    assert readers.listing(spark, path, "*.parquet").count() > 0


def test_materialised_table_is_built_once(spark, tmp_path):
    calls = []
    build = lambda s, split, cap: calls.append(split) or made(s)
    for _ in range(2):
        out = readers.materialised(spark, str(tmp_path), "t", "train", 1, None, build)
    assert out.count() == 2 and calls == ["train"] and out.first().meta["source"] == "t"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(5):
            z.writestr(f"m{i}.txt", str(i))
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for i in range(3):
            info = tarfile.TarInfo(f"n{i}.txt")
            info.size = 1
            t.addfile(info, io.BytesIO(str(i).encode()))
    spark.dataSource.register(archives.ArchiveSource)
    rows = spark.read.format("archive").option("members", "*.txt").load(f"{tmp_path}/a.zip,{tmp_path}/b.tar.gz").collect()
    assert sorted((r.member, bytes(r.content)) for r in rows) == sorted([(f"m{i}.txt", str(i).encode()) for i in range(5)] + [(f"n{i}.txt", str(i).encode()) for i in range(3)])
    again = archives.members(spark, str(tmp_path), "*.txt").collect()
    assert sorted((r.member, bytes(r.content)) for r in again) == sorted((r.member, bytes(r.content)) for r in rows)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.csv", "a,b\r\n1,x\r\n2,y\n")
    assert sorted(tuple(r) for r in archives.tables_inside(spark, f"{tmp_path}/t.zip", "a int, b string").collect()) == [(1, "x"), (2, "y")]
    assert archives.coalesced([(0, 10), (12, 20), (5000, 5010)], gap=100, most=1000) == [[0, 1], [2]]


def test_results():
    assert readers.flattened_metrics({"a": {"b": 1, "c": True, "d": {"e": 0.5}}, "f": "x"}) == {"a/b": 1.0, "a/d/e": 0.5}
    text, table = readers.results_text([{"name": "x", "score": 0.5}])
    assert json.loads(text)[0]["score"] == 0.5 and "| x | 0.5000 |" in table


def test_watch_evaluates_each_file_once(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    spark.range(3).write.parquet(folder)
    run = lambda: slices.watch(spark, folder, "id long", str(tmp_path / "cp"), lambda df, _: seen.append(df.count()), files_at_once=100)
    run()
    run()
    assert sum(seen) == 3
    spark.range(2).write.mode("append").parquet(folder)
    run()
    assert sum(seen) == 5


def test_streams(spark, data, tmp_path):
    batch = {(r.start, r.event_type): r.n for r in slices.tumbling(spark.read.parquet(f"{data}/events.parquet")).collect()}
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    spark.read.parquet(f"{data}/events.parquet").write.parquet(str(tmp_path / "ev"))
    stream = slices.tumbling(spark.readStream.schema(schema).parquet(str(tmp_path / "ev")).withColumn("ts", F.col("ts").cast("timestamp")))
    query = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(r.n for r in spark.table("hours").collect()) == sum(batch.values())
    quota = slices.under_quota(spark.readStream.schema(schema).parquet(str(tmp_path / "ev")), "event_type", "event_id", 5)
    query = quota.writeStream.format("memory").queryName("few").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("few").groupBy("event_type").count().agg(F.max("count"), F.min("count")).first()[:] == (5, 5)


def test_mixture_config():
    text = readers.mixture_config({"b": 100, "a": 5}, {"b": {"key": "task", "values": 4}, "a": None}, per_group=50)
    assert text.splitlines()[:2] == ["sources:", "  - name: a"] and "    group_by: task" in text and "    repeat_to: 25" in text


def test_rows_that_raise_are_left_out_or_told(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("3",)], "v string")
    f = lambda row: {"n": int(row["v"])}
    assert sorted(r.n for r in readers.mapped_rows(df, f, "n long").collect()) == [1, 3]
    told = readers.mapped_rows(df, f, "n long", log="error").collect()
    assert len(told) == 4 and sum(r.error is not None and r.n is None for r in told) == 2


def test_objects_around_rows_whatever_their_columns(spark, tmp_path):
    wide = {f"c{i}": i for i in range(20)} | {"rows": [{"a": 1}, {"a": 2}]}
    (tmp_path / "wide.json").write_text(json.dumps(wide))
    assert readers.read_any(spark, str(tmp_path / "wide.json")).count() == 2
    (tmp_path / "list.json").write_text(json.dumps([{"a": 1, "list": [{"b": 1}, {"b": 2}]}]))
    assert readers.read_any(spark, str(tmp_path / "list.json")).columns == ["a", "list"]
    (tmp_path / "x.csv").write_text("a&b\n1&2\n")
    assert readers.read_any(spark, str(tmp_path / "x.csv"), "csv&").first().b == "2"
    spark.range(100).write.parquet(str(tmp_path / "p"))
    assert readers.first_rows(spark, str(tmp_path / "p"), 7, ["id"]).count() == 7


def test_a_larger_cap_is_reused_another_version_is_not(spark, tmp_path):
    built = []

    def build(spark, split, cap):
        built.append(cap)
        rows = spark.createDataFrame([(str(i), f"state {i}", "a") for i in range(50)], "id string, state string, label string")
        return records.choice_records(rows, source="t", state=F.col("state"), instructions="?", choices=[("a", "A"), ("b", "B")], label=F.col("label"), id_=F.col("id")).limit(cap or 50)

    get = lambda cap, version=1: readers.materialised(spark, str(tmp_path), "t", "train", version, cap, build).count()
    assert (get(20), get(20), get(5), get(30), get(None), get(40)) == (20, 20, 5, 30, 50, 40)
    assert built == [20, 30, None]
    assert get(5, 2) == 5 and built == [20, 30, None, 5]


def test_counts_of_a_stream_with_late_events(spark, tmp_path):
    import datetime as dt

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[(at(1, 5), "a", 1.0), (at(1, 50), "a", 2.0)], [(at(5), "a", 1.0)], [(at(1, 10), "a", 100.0), (at(5, 30), "b", 4.0)], [(at(9), "c", 0.0)]]
    schema = "ts timestamp, event_type string, value double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        run = slices.tumbling(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
        run.awaitTermination()
    got = sorted((r.start.hour, r.event_type, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # The event of 1:10 comes when the watermark has passed its window.
    assert got == [(1, "a", 2, 3.0), (5, "a", 1, 1.0), (5, "b", 1, 4.0)]
