"""Waiting for documents as a stream with timers: each is answered once it is done, or when its time is up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DONE = ("ready", "failed")
OUTCOME = "begun timestamp, outcome string, seconds double"


def timed(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep their state where timers can be set."""
    other = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(k, spark.conf.get(k))
    other.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return other


class Waiting(StatefulProcessor):
    """From a document's first event on: its first end state within limit, or the end of that time.

    State is one row a document, what it waits since and whether it has been answered.  With forget it is dropped so
    many seconds after the beginning; a document that has events later than that is then waited for anew.
    """

    def __init__(self, key: str, limit: float, done: tuple[str, ...] = DONE, forget: float | None = None) -> None:
        self.key, self.limit, self.done = key, pd.Timedelta(seconds=limit), done
        self.timers = [self.limit] if forget is None else [self.limit, pd.Timedelta(seconds=max(forget, limit + 0.001))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "begun timestamp, answered boolean")

    def answer(self, key: tuple, begun: pd.Timestamp, outcome: str, seconds: float) -> pd.DataFrame:
        self.since.update((begun.to_pydatetime(), True))
        return pd.DataFrame({self.key: [key[0]], "begun": [begun], "outcome": [outcome], "seconds": [seconds]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        found = sorted((at, status) for frame in rows for at, status in zip(frame["at"], frame["status"]))
        if self.since.exists():
            begun, answered = self.since.get()
            begun = pd.Timestamp(begun)
        else:
            begun, answered = found[0][0], False
            self.since.update((begun.to_pydatetime(), False))
            for after in self.timers:
                self.handle.registerTimer(int((begun + after).timestamp() * 1000))
        if answered:
            return
        last = begun + self.limit
        end = next(((at, status) for at, status in found if status in self.done and at <= last), None)
        if end:
            yield self.answer(key, begun, end[1], (end[0] - begun).total_seconds())
        elif found[-1][0] > last:
            yield self.answer(key, begun, "timeout", self.limit.total_seconds())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.since.exists():
            return
        begun, answered = self.since.get()
        begun = pd.Timestamp(begun)
        if not answered:
            yield self.answer(key, begun, "timeout", self.limit.total_seconds())
        if expiredTimerInfo.getExpiryTimeInMs() > int((begun + self.limit).timestamp() * 1000):
            self.since.clear()

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, limit: float, delay: str, done: tuple[str, ...] = DONE, key: str = "doc_id", forget: float | None = None) -> DataFrame:
    """key, begun, outcome (one of done, or timeout), seconds of events(key, at timestamp, status), a stream of a timed() session.

    Events may be `delay` late.  A document that is neither done nor out of time by the watermark is not answered yet.
    Events without a key, a time or a status don't count.
    """
    rows = events.select(key, "at", "status").filter(F.col(key).isNotNull() & F.col("at").isNotNull() & F.col("status").isNotNull())
    kind = rows.schema[key].dataType.simpleString()
    return rows.withWatermark("at", delay).groupBy(key).transformWithStateInPandas(Waiting(key, limit, done, forget), f"{key} {kind}, {OUTCOME}", "Append", "eventTime")
