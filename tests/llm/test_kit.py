import pytest
from pyspark.sql import functions as F

from tallyloom.llm import kit


def test_settled_drops_what_a_result_was_made_from(spark):
    mark = kit.marked()
    one, _ = kit.written(spark.range(5))
    two, _ = kit.written(one.withColumn("x", F.col("id") * 2))
    out = kit.settled(two.filter("x > 2"), mark)
    assert out.count() == 3 and kit.marked() == mark + 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(kit.reserved(spark))


class Session:
    """A session without spark.checkpoint.dir."""

    def __init__(self, master):
        self.conf, self.sparkContext, self.master, self.dir = {}, self, master, None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path + "/of-this-session"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="checkpoint"):
        kit.shared_dir(Session("spark://host:7077"))
    here = Session("local[4]")
    assert kit.shared_dir(here).startswith(here.dir) and kit.shared_dir(here).startswith(here.dir) and here.dir.startswith("file:///")


def test_split_join_is_an_inner_join(spark):
    left = spark.range(200).select((F.col("id") % 5).alias("k"), "id").unionByName(spark.sql("SELECT cast(null as long) AS k, 999L AS id"))
    right = spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = spark.sql("SELECT 1L AS k, 3L AS salts")
    out = kit.split_join(left, right, ["k"], hot, ["k"])
    assert sorted(map(tuple, out.select("k", "id", "v").collect())) == sorted((i % 5, i, i % 5 * 10) for i in range(200) if i % 5 < 4)


@pytest.mark.parametrize("most, size", [(1000, 1 << 30), (2, 1 << 30), (1000, 100)])
def test_lookup_broadcasts_by_rows_and_bytes(spark, monkeypatch, most, size):
    """The same rows whether the table is small, has too many rows, or rows that are too wide; keys may be null, repeat and be nested beside other columns."""
    monkeypatch.setattr(kit, "BROADCAST_BYTES", size)
    big = spark.range(300).select(F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("k"), "id").repartition(5)
    small = spark.createDataFrame([(1, "a", [1, 2], None), (None, "n", None, b"x"), (2, "b", [], b""), (2, "c", [3], b"y")], "k long, v string, w array<int>, x binary")
    out = kit.lookup(big, small, ["k"], most=most)
    want = {None: "n", 1: "a", 2: "bc", 3: None}
    assert sorted((repr(r.k), r.id, repr(r.v)) for r in out.collect()) == sorted((repr(k), i, repr(v)) for i in range(300) for k in [i % 4 or None] for v in (want[k] or [None]))
    assert ("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) == (most == 1000 and size > 100) or spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    assert out.unionByName(out).count() == 2 * out.count()
