"""Sharding by sampled splitters.

A size-weighted sample of keys gives quantile boundaries; records are range-partitioned by them; ranges
that turn out overfull are sampled again and subdivided.  Consecutive ranges are then dealt to shards by
their exact cumulative size.  The key is (hash of the group column, hash of the id): records of one group
(equal texts) stay adjacent and so in one range, unless the group is over `tolerance` of a shard; only such hot
groups are subdivided, by the second part, in which each row's place in a saved table sets apart rows of one id.

What reaches the driver is about `draws` sampled keys a range and a row for each range; there are
`ranges_per_shard` ranges to a shard, or as many as keep them at RANGE_BYTES.  Cases: null group values form a group; null ids hash like any value; repeated rows and ties get
slots of their own; an empty table gives an empty result; other columns are carried along unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import need, place_among, saved

LOW = -(1 << 63)
#: Bytes of a range: a larger table has more ranges, not larger ones.
RANGE_BYTES = 1 << 30


def byte_size(text: str | Column) -> Column:
    """UTF-8 bytes plus 1; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


@dataclass
class RangeSharder:
    """fit() chooses the ranges and deals them to shards; transform() adds shard and slot to records."""

    n_shards: int = 8
    ranges_per_shard: int = 128
    draws: int = 24
    overfull: float = 2.0
    rounds: int = 4
    tolerance: float = 0.05
    bounds: list[tuple[int, int]] = field(default_factory=list)
    deal: list[tuple[int, int, int]] = field(default_factory=list)
    #: Ranges to a shard, as fit() has chosen them: ranges_per_shard, or more of a large table.
    per_shard: int = 0
    #: Whether a range of several rows is left over the tolerance of a shard.
    stuck: bool = False

    def keyed(self, df: DataFrame, group: str, ident: str, place: bool = True) -> DataFrame:
        """Adds the two key parts; with place the second depends on the row's place, too, and the result is to be saved."""
        rest = [F.monotonically_increasing_id()] if place else []
        return df.withColumns({"__k1": F.xxhash64(F.col(f"`{group}`")), "__k2": F.xxhash64(F.col(f"`{ident}`"), *rest)})

    def ranged(self, df: DataFrame) -> DataFrame:
        first = np.array([b[0] for b in self.bounds], np.int64)
        second = np.array([b[1] for b in self.bounds], np.int64)

        @F.pandas_udf("int")
        def place(k1: pd.Series, k2: pd.Series) -> pd.Series:
            return pd.Series(place_among(first, second, k1.to_numpy(), k2.to_numpy()))

        return df.withColumn("__range", place("__k1", "__k2"))

    def drawn(self, light: DataFrame, rate: Column, seed: int) -> list[tuple[int, int, float, int]]:
        """A sample of keys: each row with the chance size * rate, or as its full weight where that is over 1."""
        weight = F.col("__size") * rate
        chance = (F.xxhash64(F.lit(seed), "__k1", "__k2").bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)
        rows = light.withColumn("__w", weight).filter(chance < F.col("__w")).select("__k1", "__k2", F.greatest("__w", F.lit(1.0)).alias("w"), "__range")
        return [tuple(r) for r in rows.collect()]

    def quantiles(self, sample: list[tuple[int, int, float, int]], pieces: int) -> list[tuple[int, int]]:
        """Boundaries that cut the sample into pieces of equal weight; inside a group only if it is over the tolerance."""
        if not sample or pieces < 2:
            return []
        sample = sorted((a, b, w) for a, b, w, _ in sample)
        total = np.cumsum([s[2] for s in sample])
        cuts = np.searchsorted(total, total[-1] * np.arange(1, pieces) / pieces)
        by_key = pd.Series([s[2] for s in sample]).groupby([s[0] for s in sample]).sum()
        heavy = set(by_key[by_key > self.tolerance * self.per_shard * self.draws].index)  # a shard's weight in draws
        return sorted({(sample[c][0], sample[c][1] if sample[c][0] in heavy else LOW) for c in cuts})

    def fit(self, light: DataFrame) -> RangeSharder:
        """light: __k1, __k2, __size."""
        total, rows = light.agg(F.sum("__size"), F.count("*")).first()
        self.bounds, self.deal, self.stuck = [], [], False
        if not rows:
            return self
        self.per_shard = max(self.ranges_per_shard, -(-total // (self.n_shards * RANGE_BYTES)))
        pieces = self.n_shards * self.per_shard
        sample = self.drawn(light.withColumn("__range", F.lit(0)), F.lit(pieces * self.draws / total), 1)
        self.bounds = self.quantiles(sample, pieces)
        spark = light.sparkSession
        for turn in range(self.rounds):
            stats = {r[0]: (r[1], r[2]) for r in self.ranged(light).groupBy("__range").agg(F.sum("__size"), F.count("*")).collect()}
            over = {k: v[0] for k, v in stats.items() if v[0] > self.overfull * total / pieces and v[1] > 1}
            if not over or turn == self.rounds - 1:
                break
            rates = spark.createDataFrame([(k, pieces * self.draws / total) for k in over], "__range int, rate double")
            again: dict[int, list] = {}
            for s in self.drawn(self.ranged(light).join(F.broadcast(rates), "__range"), F.col("rate"), turn + 2):
                again.setdefault(s[3], []).append(s)
            more = {b for k, s in again.items() for b in self.quantiles(s, int(np.ceil(over[k] * pieces / total)))}
            if more <= set(self.bounds):
                break
            self.bounds = sorted(more | set(self.bounds))
        self.stuck = any(v[0] > 2 * self.tolerance * total / self.n_shards and v[1] > 1 for v in stats.values())
        before, filled = 0, [0] * self.n_shards
        for k in sorted(stats):
            size, count = stats[k]
            shard = min(self.n_shards - 1, int((before + size / 2) * self.n_shards / total))
            self.deal.append((k, shard, filled[shard]))
            before, filled[shard] = before + size, filled[shard] + count
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds shard and slot (gapless from 0 in each shard) to records with __k1 and __k2.

        The window runs by range, so no task gets a whole shard; the broadcast deal has a row for each range.
        """
        deal = df.sparkSession.createDataFrame(self.deal, "__range int, shard int, __from long")
        order = Window.partitionBy("__range").orderBy("__k1", "__k2")
        placed = self.ranged(df).withColumn("__nth", F.row_number().over(order) - 1)
        return placed.join(F.broadcast(deal), "__range").withColumn("slot", F.col("__from") + F.col("__nth")).drop("__range", "__from", "__nth", "__k1", "__k2")


def shard_documents(documents: DataFrame, n_shards: int = 8) -> DataFrame:
    """The placement of documents(doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    sharder = RangeSharder(n_shards)
    light = sharder.keyed(need(documents, "doc_id", "text"), "text", "doc_id")
    light = saved(light.select("doc_id", byte_size("text").alias("__size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "__k1", "__k2"))
    placed = sharder.fit(light).transform(light)
    return placed.select("doc_id", F.col("__size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(documents: DataFrame, n_shards: int = 8) -> DataFrame:
    """The whole records, in the order of their shards' ranges, with shard and slot."""
    sharder = RangeSharder(n_shards)
    light = lambda keyed: keyed.select("__k1", "__k2", byte_size("text").alias("__size"))
    keyed = sharder.keyed(documents, "text", "doc_id", False)
    sharder.fit(saved(light(keyed)))
    if sharder.stuck:  # on rows of one id and text: these are told apart by their place, in a table of all columns
        keyed = saved(sharder.keyed(documents, "text", "doc_id"))
        sharder.fit(light(keyed))
    return sharder.transform(keyed)
