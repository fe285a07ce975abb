"""Embeddings that are learned from the texts: the main directions of a weighted term matrix, by randomised subspace iteration.

Terms are hashed to buckets and weighted by how rare they are.  The directions are fitted on all texts: their buckets
are counted once into a table on disk, which each round reads; in a round the tasks add up their part of A'(A X) and send
it in slabs, which are added by slab, so the driver gets one matrix of buckets x directions a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text
from lexweave.session import TURNS, scratch, spread

#: Slabs that a matrix is sent in, and words whose rows of it are multiplied at once: some 9 MB a block at 72 directions, however long the texts are.
SLABS, BLOCK = 16, 1 << 14
#: Cells to an entry up to which a block is multiplied as a full matrix of its texts and the buckets that they have.
FULL = 64


def cells(c: Column | str, buckets: int) -> Column:
    """The buckets of a text's words, one for each word."""
    return F.transform(text.words(text.casefold(F.coalesce(text.col(c), F.lit("")))), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def counted(column: pa.ListArray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the texts' words, by row and bucket."""
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    row = np.repeat(np.arange(len(column)), np.diff(ends))
    key, n = np.unique(row.astype(np.int64) * buckets + column.flatten().to_numpy(), return_counts=True)
    return *np.divmod(key, buckets), n


def values(row: np.ndarray, bucket: np.ndarray, n: np.ndarray, texts: int, weight: np.ndarray) -> np.ndarray:
    """(1 + log of the count) times the bucket's weight, each row of length 1."""
    value = (1 + np.log(n)) * weight[bucket]
    norm = np.sqrt(np.bincount(row, value * value, texts))
    return value / np.maximum(norm[row], 1e-300)


def weighted(column: pa.ListArray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the texts' matrix."""
    row, bucket, n = counted(column, len(weight))
    return row, bucket, values(row, bucket, n, len(column), weight)


def blocks(column: pa.ListArray) -> Iterator[tuple[int, pa.ListArray]]:
    """(place of the first, texts) of a column in blocks of at most BLOCK words; a text of more is a block of its own."""
    ends, begin = column.offsets.to_numpy(), 0
    while begin < len(column):
        end = max(int(np.searchsorted(ends, ends[begin] + BLOCK, "right")) - 1, begin + 1)
        yield begin, column.slice(begin, end - begin)
        begin = end


def times(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, matrix: np.ndarray, out: np.ndarray) -> np.ndarray:
    """out, with A X for the sparse rows A added; a row's entries stand together."""
    if len(row):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        part = matrix[bucket]
        part *= value[:, None]
        out[row[first]] += np.add.reduceat(part, first, axis=0)
    return out


def squared(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, texts: int, matrix: np.ndarray, out: np.ndarray) -> None:
    """Adds A'(A X) for the sparse rows A to out."""
    there = np.zeros(len(matrix), bool)
    there[bucket] = True
    seen = np.flatnonzero(there)
    if texts * len(seen) <= FULL * len(row):
        full = np.zeros((texts, len(seen)))
        full[row, np.cumsum(there)[bucket] - 1] = value
        out[seen] += full.T @ (full @ matrix[seen])
    else:
        have = times(row, bucket, value, matrix, np.zeros((texts, matrix.shape[1])))
        order = np.argsort(bucket, kind="stable")
        times(bucket[order], row[order], value[order], have, out)


@dataclass(frozen=True)
class Directions:
    """Buckets x directions, and the buckets' weights."""

    matrix: np.ndarray
    weight: np.ndarray
    strength: np.ndarray

    def embedded(self, c: Column | str) -> Column:
        """array<float> of length 1; null for a text without a word that has a weight.  A provider for files.with_missing_embeddings()."""
        matrix, weight = self.matrix, self.weight

        @F.arrow_udf("array<float>")
        def vectors(found: pa.Array) -> pa.Array:
            out, known = np.zeros((len(found), matrix.shape[1]), np.float32), np.zeros(len(found), bool)
            for k, part in blocks(found):
                have = times(*weighted(part, weight), matrix, np.zeros((len(part), matrix.shape[1])))
                norm = np.sqrt((have * have).sum(axis=1))
                known[k : k + len(part)] = norm > 1e-12
                out[k : k + len(part)] = have / np.where(norm > 1e-12, norm, 1)[:, None]
            ends = np.arange(len(found) + 1, dtype=np.int32) * matrix.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.reshape(-1)), mask=pa.array(~known))

        return vectors(cells(c, len(weight)))


def fit(texts: DataFrame, size: int = 64, buckets: int = 1 << 14, sample: int | None = None, rounds: int = 4, seed: int = 42) -> Directions:
    """Directions of texts(text), of all of them; or, where sample is given, of about so many, of which equal ones are in together or not at all."""
    spark, known = texts.sparkSession, texts.select("text").filter("text is not null")
    if sample is not None:
        chance = F.xxhash64(F.lit(seed), "text").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
        known = known.filter(chance < sample / max(known.count(), 1))
    path = scratch(spark)
    try:
        tallies(spread(known), buckets).write.parquet(path)
        # each task sends a matrix, and all of a slab come together: so their number goes by the cores, not by the table
        rows = spark.read.parquet(path).coalesce(TURNS * spark.sparkContext.defaultParallelism)
        total, counts = frequencies(rows, buckets)
        # words that all texts have tell nothing; a bucket that no text has has no weight
        weight = np.where(counts > 0, np.log((1 + total) / (1 + counts)), 0.0)
        width = min(size + 8, buckets)
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, width)))[0]
        for _ in range(rounds):
            grown = product(rows, weight, basis)
            found, turn = np.linalg.eigh(basis.T @ grown)  # of the matrix within the directions so far
            turned = basis @ turn[:, ::-1]
            basis = np.linalg.qr(grown)[0]
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    strength = np.maximum(found[::-1][:size], 0)
    turned = turned[:, :size] * np.where(turned[np.abs(turned).argmax(axis=0), np.arange(width)] < 0, -1, 1)[:size]
    return Directions(turned, weight, strength)


def tallies(texts: DataFrame, buckets: int) -> DataFrame:
    """b, n: for each of texts(text) its buckets and how many words are in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in blocks(batch.column(0)):
                row, bucket, n = counted(part, buckets)
                ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(part)))), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (bucket, n)], ["b", "n"])

    return texts.select(cells("text", buckets).alias("cells")).mapInArrow(run, "b array<int>, n array<int>")


def frequencies(rows: DataFrame, buckets: int) -> tuple[int, np.ndarray]:
    """The number of rows(b, n), and by bucket that of the rows which have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets + 1, np.int64)
        for batch in batches:
            counts[:-1] += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
            counts[-1] += batch.num_rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["b", "c"])

    found = rows.select("b").mapInArrow(run, "b long, c long").groupBy("b").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(buckets + 1)
    out[found["b"].to_numpy()] = found["c"].to_numpy()
    return int(out[-1]), out[:-1]


def product(rows: DataFrame, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A X) over rows(b, n)."""
    buckets, width = basis.shape
    sent = rows.sparkSession.sparkContext.broadcast((weight, basis))  # 8 bytes times buckets times directions
    cuts = np.linspace(0, buckets, SLABS + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, basis = sent.value
        total = np.zeros((buckets, width))
        for batch in batches:
            for at, part in blocks(batch.column(0)):
                row = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
                bucket, n = part.flatten().to_numpy(), batch.column(1).slice(at, len(part)).flatten().to_numpy()
                squared(row, bucket, values(row, bucket, n, len(part), weight), len(part), basis, total)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLABS), pa.int32()), pa.array([total[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["slab", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[slab] = sums.get(slab, 0) + np.frombuffer(body.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slab", "body"])

    schema = "slab int, body binary"
    parts = rows.mapInArrow(run, schema).repartition(SLABS, "slab").sortWithinPartitions("slab").mapInArrow(add, schema).toArrow()
    sent.unpersist()
    out = np.zeros((buckets, width))
    for slab, body in zip(parts["slab"].to_pylist(), parts["body"]):
        out[cuts[slab] : cuts[slab + 1]] = np.frombuffer(body.as_buffer()).reshape(-1, width)
    return out
