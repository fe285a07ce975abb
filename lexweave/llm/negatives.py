"""Hard-negative mining by bit-sliced integer products.

Vectors are scaled to whole numbers.  The products of a block of rows with all anchors of a chunk are built up from
the rows' bit planes, the most significant first: once the planes down to bit b are in, the rest of a component is
between 0 and 2^b - 1, so the product is in an interval that narrows with each plane.  A pair is dropped as soon as its
interval can't reach the anchor's best ones so far, or for negatives the window below each of its positives.  Planes
are matrix products while many pairs are left, and products of single pairs past that; what is left at bit 0 is exact.

Anchors are broadcast in chunks of a bounded number of components; each chunk is compared with all rows in two
passes without a shuffle of rows: positives, then negatives.  A task keeps its best few for each anchor, and only
these are shuffled and ranked, so the rows that are shuffled are the anchors times the tasks.

Cases: rows with a null label or vector, or a null or non-finite component, take no part; vectors of different length
are multiplied up to the shorter one's end; a row is never its own positive, but rows of the same id are; a null id is
no anchor and sorts last; of equal rows each counts, so results of repeated anchors are repeated; scores past a long
are cut to its range; without anchors the result is empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import NO_ID, Sent, arrow_stream, need, saved

#: Components of the anchors that are broadcast at once (8 bytes each), and pairs of a block.
CHUNK_COMPONENTS, PAIRS = 4_000_000, 1 << 21
#: Anchors of a range of row numbers: no range has more than this.
SPAN = 1 << 15
#: Products of components to a task, and below which share of pairs left these go one by one.
TASK_PRODUCTS, FEW = 20_000_000_000, 1 / 24
LONG = np.iinfo(np.int64)
#: Vectors with a component of this size are compared apart from the others, in Python's whole numbers.
WIDE = 2.0**27


def whole(body: np.ndarray) -> np.ndarray:
    """Floats that are whole, as 64-bit numbers, or as Python's where these are too small."""
    if not body.size or np.abs(body).max() < WIDE:
        return body.astype(np.int64)
    return np.array([int(x) if np.isfinite(x) else int(np.sign(x)) << 1100 for x in body.reshape(-1).tolist()], object).reshape(body.shape)


def by_length(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of floor(scale * component)) of the vectors of each length; those with very large components apart."""
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    body, size = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64), np.diff(ends)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        matrix = np.floor(body[(ends[rows][:, None] + np.arange(n)).reshape(-1)].reshape(len(rows), n) * scale)
        wide = np.abs(matrix).max(axis=1, initial=0) >= WIDE
        for part in (np.flatnonzero(~wide), np.flatnonzero(wide)):
            if len(part):
                yield rows[part], whole(matrix[part])


def kind_of(rows: np.ndarray, anchors: np.ndarray) -> type:
    """The cheapest numbers in which all products are exact."""
    top = (int(abs(rows).max()) + 1) * (int(abs(anchors).max()) + 1) * rows.shape[1] * 4 if rows.size and anchors.size else 0
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64 if top < 1 << 62 else object


def products(rows: np.ndarray, anchors: np.ndarray, may: np.ndarray, wanted: Callable[..., np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, product) of the pairs in may (rows x anchors) that are wanted to the last plane.

    wanted(lower, upper, at): whether products in this interval may count; at: the anchors' places, or all of them as
    the columns of matrices.
    """
    d = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :d], anchors[:, :d]
    kind = kind_of(rows, anchors)
    q = anchors.astype(kind)
    least, most = np.minimum(q, 0).sum(axis=1), np.maximum(q, 0).sum(axis=1)
    bits = max((int(max(rows.max(), ~rows.min())).bit_length() if rows.size else 0), 1)
    part = -(1 << bits) * ((rows < 0).astype(kind) @ q.T)
    i = None
    for b in range(bits - 1, -1, -1):
        plane = ((rows >> b) & 1).astype(kind)
        rest = (1 << b) - 1
        if i is None:
            part = part + (1 << b) * (plane @ q.T)
            may = may & wanted(part + rest * least, part + rest * most, slice(None), may)
            if b == 0 or np.count_nonzero(may) <= FEW * may.size:
                i, j = np.nonzero(may)
                part = part[i, j]
        elif len(i):
            part = part + (1 << b) * np.concatenate([(plane[i[k : k + PAIRS // 32]] * q[j[k : k + PAIRS // 32]]).sum(axis=1) for k in range(0, len(i), PAIRS // 32)])
            keep = np.asarray(wanted(part + rest * least[j], part + rest * most[j], j, None), bool)
            i, j, part = i[keep], j[keep], part[keep]
    if kind is object:
        part = np.array([min(max(int(x), LONG.min + 1), LONG.max) for x in part], np.int64)
    return i, j, part.astype(np.int64)


class Best:
    """The first few (score, id) of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, few: int) -> None:
        self.few = few
        self.score = np.full((slots, few), LONG.min)
        self.ident = np.full((slots, few), LONG.max)
        self.count = np.zeros(slots, np.int64)

    @property
    def least(self) -> np.ndarray:
        """By slot the score that a further one must reach."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        near = score >= self.least[slot]
        slot, score, ident = slot[near], score[near], ident[near]
        if not len(slot):
            return
        old = np.unique(slot)
        full = np.arange(self.few)[None] < self.count[old][:, None]
        slot = np.concatenate((slot, np.repeat(old, self.count[old])))
        score, ident = np.concatenate((score, self.score[old][full])), np.concatenate((ident, self.ident[old][full]))
        order = np.lexsort((ident, -1 - score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        begin = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        size = np.diff(np.append(begin, len(slot)))
        nth = np.arange(len(slot)) - np.repeat(begin, size)
        keep = nth < self.few
        self.score[slot[keep], nth[keep]], self.ident[slot[keep], nth[keep]] = score[keep], ident[keep]
        self.count[slot[begin]] = np.minimum(size, self.few)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, score, id)."""
        full = np.arange(self.few)[None] < self.count[:, None]
        return np.nonzero(full)[0], self.score[full], self.ident[full]


@dataclass
class Anchors:
    """A chunk of anchors, by the length of their vectors; positives' scores by anchor, best first, if they are known."""

    rid: np.ndarray
    label: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]
    low: np.ndarray | None = None  # anchors x positives: the window of the negatives' scores
    high: np.ndarray | None = None

    def blocks(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, PAIRS // max(1, n))
        for at, matrix in self.parts:
            for k in range(0, len(at), step):
                yield at[k : k + step], matrix[k : k + step]

    def positives(self, best: Best, rid: np.ndarray, ident: np.ndarray, label: np.ndarray, rows: np.ndarray) -> None:
        """Takes rows of the same label into best."""
        for name in np.unique(label):
            own = np.flatnonzero(label == name)
            for at, matrix in self.blocks(len(own)):
                same = self.label[at] == name
                at, matrix = at[same], matrix[same]
                if not len(at):
                    continue

                def wanted(lower: np.ndarray, upper: np.ndarray, j, may: np.ndarray | None) -> np.ndarray:
                    floor = best.least[at]
                    if may is not None and len(lower) >= best.few:  # the rows of this block show what the best must reach, too
                        sure = np.where(may, lower, LONG.min)
                        floor = np.maximum(floor, np.partition(sure, len(sure) - best.few, axis=0)[len(sure) - best.few])
                    return upper >= floor[j]

                i, j, score = products(rows[own], matrix, rid[own][:, None] != self.rid[at][None], wanted)
                best.add(at[j], score, ident[own][i])

    def negatives(self, best: Best, rid: np.ndarray, ident: np.ndarray, label: np.ndarray, rows: np.ndarray) -> None:
        """Takes rows of other labels whose score is in a window into best, a slot for each anchor and positive."""
        n = self.low.shape[1]
        for at, matrix in self.blocks(len(rows)):
            slots = at[:, None] * n + np.arange(n)
            low, high = self.low[at], self.high[at]

            def wanted(lower: np.ndarray, upper: np.ndarray, j, may: np.ndarray | None) -> np.ndarray:
                floor = np.maximum(low, best.least[slots])
                out = np.zeros(lower.shape, bool)
                for k in range(n):
                    out |= np.asarray((upper >= floor[:, k][j]) & (lower <= high[:, k][j]) & (low[:, k] <= high[:, k])[j], bool)
                return out

            i, j, score = products(rows, matrix, label[:, None] != self.label[at][None], wanted)
            for k in range(n):
                fits = (score >= low[j, k]) & (score <= high[j, k])
                best.add(slots[j[fits], k], score[fits], ident[i[fits]])


@dataclass(frozen=True)
class Miner:
    scale: float = 256.0
    n_positives: int = 5
    n_negatives: int = 5
    #: Negatives score at least this share of their positive, in hundredths.
    percent: int = 80

    def compared(self, rows: DataFrame, sent: Sent, few: int, negatives: bool) -> DataFrame:
        """slot (row number of the anchor), nth (of the positive), ident, score: the best of each task."""
        scale, width = self.scale, self.n_positives

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            anchors, best = None, None
            for batch in source:
                anchors = anchors or sent.made()
                best = best or Best(len(anchors.rid) * (width if negatives else 1), few)
                rid, ident, label = (batch.column(k).to_numpy() for k in (0, 1, 2))
                for at, matrix in by_length(batch.column(3), scale):
                    step = max(1, min(4096, PAIRS // max(1, matrix.shape[1])))
                    for k in range(0, len(at), step):
                        part = at[k : k + step]
                        take = anchors.negatives if negatives else anchors.positives
                        take(best, rid[part], ident[part], label[part], matrix[k : k + step])
            if best is not None:
                slot, score, ident = best.rows()
                nth = slot % width if negatives else np.zeros(len(slot), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.rid[slot // width if negatives else slot]), pa.array(nth), pa.array(ident), pa.array(score)], ["slot", "nth", "ident", "score"])

        found = arrow_stream(rows.select("rid", "ident", "label", "vector"), run, "slot long, nth long, ident long, score long")
        order = Window.partitionBy("slot", "nth").orderBy(F.desc("score"), "ident")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= few)

    def chunks(self, anchors: DataFrame) -> list[tuple[int, int]]:
        """Ranges of row numbers, from and to, with at most CHUNK_COMPONENTS of anchors each, or of one SPAN."""
        sizes = anchors.groupBy(F.floor(F.col("rid") / SPAN).cast("long").alias("k")).agg(F.sum(F.size("vector") + 8)).orderBy("k").collect()
        out, size = [], 0
        for k, n in sizes:
            if not out or size + n > CHUNK_COMPONENTS:
                out.append((k * SPAN, (k + 1) * SPAN))
                size = 0
            out[-1] = (out[-1][0], (k + 1) * SPAN)
            size += n
        return out

    def mined(self, vectors: DataFrame, anchor: Column) -> DataFrame:
        """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors(ident, label, vector); anchor: which rows are anchors."""
        spark, kind = vectors.sparkSession, vectors.schema["ident"].dataType
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        rows = vectors.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
        rows = saved(rows.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("ident", F.lit(NO_ID)).cast("long").alias("ident"), F.col("label").cast("long").alias("label"), "vector", F.coalesce(anchor, F.lit(False)).alias("anchor")))
        anchors = rows.filter("anchor").select("rid", "ident", "label", "vector")
        n, asked, size = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("vector"))).first()
        tasks = n * asked * (size or 0) // TASK_PRODUCTS
        rows = rows.repartition(int(tasks)) if tasks > spark.sparkContext.defaultParallelism else rows
        shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).cast(kind)
        out = None
        for first, last in self.chunks(anchors):
            own = anchors.filter((F.col("rid") >= first) & (F.col("rid") < last)).toArrow().combine_chunks().sort_by("rid")
            column = lambda k: own.column(k).combine_chunks()
            scale = self.scale
            value = (column(0).to_numpy(), column(2).to_numpy(), column(3) if not isinstance(column(3), pa.ChunkedArray) else pa.concat_arrays(column(3).chunks))
            sent = Sent(spark, value, lambda v: Anchors(v[0], v[1], list(by_length(v[2], scale))))
            positives = saved(self.compared(rows, sent, self.n_positives, False))
            known = positives.select("slot", "rank", "score").toPandas()  # n_positives for each anchor of the chunk
            place = np.searchsorted(value[0], known["slot"].to_numpy())
            low, high = np.full((len(value[0]), self.n_positives), 1), np.full((len(value[0]), self.n_positives), 0)
            scores = known["score"].tolist()
            high[place, known["rank"].to_numpy() - 1] = scores
            low[place, known["rank"].to_numpy() - 1] = [-(-self.percent * s // 100) for s in scores]
            sent = Sent(spark, (*value, low, high), lambda v: Anchors(v[0], v[1], list(by_length(v[2], scale)), v[3], v[4]))
            negatives = self.compared(rows, sent, self.n_negatives, True)
            named = positives.select("slot", (F.col("rank") - 1).cast("long").alias("nth"), F.col("ident").alias("positive"), F.col("score").alias("positive_score"))
            found = negatives.select("slot", "nth", "rank", F.col("ident").alias("negative"), F.col("score").alias("negative_score")).join(named, ["slot", "nth"])
            found = found.join(anchors.select(F.col("rid").alias("slot"), F.col("ident").alias("anchor")), "slot")
            found = saved(found.select(shown("anchor").alias("anchor_id"), shown("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), shown("negative").alias("negative_id"), "positive_score", "negative_score"))
            out = found if out is None else out.unionByName(found)
        if out is None:
            name = kind.simpleString()
            return spark.createDataFrame([], f"anchor_id {name}, positive_id {name}, rank int, negative_id {name}, positive_score long, negative_score long")
        return out


def mine_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of embeddings(vec_id, embedding, label).

    Labels of rows whose id is divisible by 7 are moved on by one first; anchors are the rows whose id is divisible by 100.
    """
    rows = need(embeddings, "vec_id", "embedding", "label")
    label = F.col("label").cast("long")
    moved = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label)
    return Miner().mined(rows.select(F.col("vec_id").alias("ident"), moved.alias("label"), F.col("embedding").alias("vector")), F.col("ident") % 100 == 0)
