"""Session settings and table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitted settings hold."""
    builder = SparkSession.builder.config(map=SETTINGS).config("spark.driver.memory", memory)
    builder = builder.master(master) if master else builder
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)) if shuffle_partitions else builder
    builder = builder.config("spark.checkpoint.dir", shared) if shared else builder
    os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks to a core where a table is dealt anew: no task is long, and the last ones leave no core idle.
TURNS = 4


def spread(df: DataFrame) -> DataFrame:
    """df over all cores by TURNS, where its files are fewer than that; a table of many files stays as it is read."""
    tasks = TURNS * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by columns into as many tasks as spread() makes, or as a shuffle has: for work that is long for few bytes, which adaptive execution would put into few tasks."""
    spark = df.sparkSession
    return df.repartition(max(TURNS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); in local mode without one, a folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="lexweave-")
    return f"{shared.rstrip('/')}/lexweave-{uuid.uuid4().hex}"
