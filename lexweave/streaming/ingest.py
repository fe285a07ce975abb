"""Incremental ingestion as a stream: files that arrive are hashed, repeats dropped, results appended once; changes of state are checked.

dropDuplicates keeps every hash as state, on purpose: the store is addressed by content.  For a landing zone
whose repeats are near in time, give a watermark column to bound it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from lexweave.operators.library import MOVES
from lexweave.session import scratch


def new_contents(stream: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, sha256 of the first document of each content."""
    hashed = stream.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    if watermark:
        return hashed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["sha256"])
    return hashed.dropDuplicates(["sha256"])


def opened(spark: SparkSession, source: str, schema: StructType | None = None) -> DataFrame:
    """The Parquet files at source as a stream; a lone file is read through its folder."""
    schema = schema or spark.read.parquet(source).schema
    folder, _, name = source.rpartition("/")
    single = name.endswith(".parquet") and not spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(source).filter(F.endswith("path", F.lit(f"/{name}"))).isEmpty()
    return spark.readStream.schema(schema).option("pathGlobFilter", name if single else "*.parquet").parquet(folder if single else source)


def drained(spark: SparkSession, out: DataFrame, path: str) -> DataFrame:
    """Everything that a stream has to give by now, appended once to a table at path; a later run on the same path takes only what is new."""
    run = out.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/data")


def ingest_stream(spark: SparkSession, source: str, schema: StructType | None = None, path: str | None = None) -> DataFrame:
    """Everything that has arrived at source, its contents each once."""
    return drained(spark, new_contents(opened(spark, source, schema)).select("doc_id", "sha256"), path or scratch(spark))


def moved(events: DataFrame, moves: dict[str, tuple[str, ...]] = MOVES, first: str = "uploaded") -> DataFrame:
    """doc_id, at, status: the changes of state among events(doc_id, at, status) that may follow.

    The state of each document, one word, is kept between batches; the events of a batch are taken by at.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else first
        out = []
        for at, status in sorted(row for frame in frames for row in zip(frame["at"], frame["status"])):
            if status in moves.get(now, ()):
                now = status
                out.append((key[0], at, status))
        state.update((now,))
        yield pd.DataFrame(out, columns=["doc_id", "at", "status"])

    rows = events.select("doc_id", "at", "status").filter("doc_id is not null and status is not null")
    return rows.groupBy("doc_id").applyInPandasWithState(run, f"doc_id {kinds['doc_id']}, at {kinds['at']}, status string", "status string", "append", "NoTimeout")
