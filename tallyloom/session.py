"""Session defaults for local work; a cluster's own session is used as it is."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with AQE, UTC timestamps and few shuffle partitions."""
    base = {
        "spark.sql.shuffle.partitions": str(cores if cores != "*" else 8),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tallyloom")
    spark = builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One of the fixture tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table as it is read, dealt over four tasks a core, unless they come in as many: a row group of a file is read by one task, however much work its rows make."""
    least = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def scratch_dir(spark: SparkSession) -> str:
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


def dropped(spark: SparkSession, *folders: str) -> None:
    """Delete folders that are no longer read."""
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
