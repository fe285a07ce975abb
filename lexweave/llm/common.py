"""Session helpers of the document operators: shared scratch tables, Arrow maps, connected components."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id where ids are compared; it sorts last.
NO_ID = (1 << 63) - 1


class Scope:
    """The tables that one query writes: scratch() paths are entered in the innermost open scope of their thread, and a scope removes nothing but its own."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def clear(self, spark: SparkSession) -> None:
        """Removes the tables of this scope; to be called when what rests on them has been read."""
        while self.paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: The scope of what is written outside all others.
_outside = Scope()
_open: contextvars.ContextVar[Scope] = contextvars.ContextVar("scope", default=_outside)


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    """Opens a scope in this thread; its tables stay until its clear() or until settled()."""
    own = Scope()
    token = _open.set(own)
    try:
        yield own
    finally:
        _open.reset(token)


def settled(own: Scope, *results: DataFrame) -> list[DataFrame]:
    """The results as tables in the scope that is open now; what has been written in own, to make them, is removed."""
    out = [saved(r) for r in results]
    own.clear(results[0].sparkSession)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own only where it is unset, in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lexweave-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/lexweave-{uuid.uuid4().hex}"
    _open.get().paths.append(path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark, schema, path = df.sparkSession, df.schema, scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes the tables of the scope that is open in this thread: without one, those behind all results so far that have none of their own."""
    _open.get().clear(spark)


def release(spark: SparkSession) -> None:
    """Has the shuffle files of what is through removed: Spark does so only after the driver's garbage is collected, which by itself may come when the disk is full."""
    spark._jvm.java.lang.System.gc()


def trim() -> None:
    """Gives freed memory back, for a Python worker that will stay idle beside other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_made: dict[str, Any] = {}


class Sent:
    """A broadcast value that each Python worker turns into what it needs once, and keeps until it needs another."""

    def __init__(self, spark: SparkSession, value: Any, make: Callable[[Any], Any]) -> None:
        self.name, self.value, self.make = uuid.uuid4().hex, spark.sparkContext.broadcast(value), make

    def made(self) -> Any:
        if self.name not in _made:
            _made.clear()
            _made[self.name] = self.make(self.value.value)
        return _made[self.name]


def arrow_stream(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with memory given back at the end of a task."""

    def each(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(source)
        finally:
            trim()

    return df.mapInArrow(each, schema)


def arrow_map(df: DataFrame, batches: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """arrow_stream with a function of one batch."""

    def each(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                yield from batches(batch)

    return arrow_stream(df, each, schema)


def place_among(first: np.ndarray, second: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the sorted boundaries (first, second) are not above each key (a, b)."""
    at, end = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
    for lo in np.unique(at[end > at]):  # the keys that are boundaries themselves
        rows = np.flatnonzero((at == lo) & (end > at))
        hi = end[rows[0]]
        at[rows] = lo + np.searchsorted(second[lo:hi], b[rows], "right")
    return at.astype(np.int32)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that further ones with any names can't clash."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges(a, b): label is the least node that is reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes; each round is
    a few shuffles of the links, with a minimum by node that is combined before it is shuffled.  Nothing but
    a count and a checksum reaches the driver.
    """
    links = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.filter("b < a")
        small_least = low.groupBy("a").agg(F.min("b").alias("m"))
        links = saved(
            low.join(small_least, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .filter("a <> b")
            .distinct()
        )
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        state = now
