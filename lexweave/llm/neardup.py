"""MinHash near-deduplication with HyperMinHash registers.

1. One pass over the texts gives each document the size and a 128-bit identity of its shingle set, its
   registers (by bucket of the hash space the least hash, as leading-zero count and mantissa bits in a byte)
   and a key for each band of registers.  Documents with equal sets are one class from here on.
2. Classes that share a band key are compared by their registers: the share of equal ones, corrected for
   chance collisions, estimates the Jaccard similarity.  Pairs that may reach the threshold (less 5
   standard errors) are candidates.
3. Candidates are verified on full shingle sets; links give components.

Not all pairs of a band group are written.  The first round takes from each piece of a group of the first bands (at
most `piece` classes) the spanning forest of the likeliest pairs.  Later rounds look only at groups whose classes
lie in different components, leave out pairs inside a component, and take for each class outside the group's
main component its likeliest pairs: at most 8, then 64 and so on in groups in which any are held back, each pair in
the first band that it shares.  So every pair that may link two components is verified before the end, while copies
of a hot text cost rows, not pairs.  Groups of over two pieces are cut into blocks of the main component's
classes, with the others in each.  Where the others are more than a piece (many texts that share much but are
no copies), the group's classes are grouped anew by their rarest shingles, an exact prefix filter, and where such a
group is as large, by the next ones that are shared.

Chance of losing a pair: under 1e-10 that no band agrees, (1 - s**rows)**bands for similarity s at the
threshold, less above it; and under 1e-6 that the estimate is 5 standard errors low.

Cases: null, empty and wordless texts have no set, link with nothing and are kept; equal texts link whatever
their ids; rows with equal ids are judged by the id; a null id sorts last, and its component is null only if
no other id is in it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import NO_ID, arrow_map, arrow_stream, components, need, release, saved, scope, settled
from lexweave.llm.kernels import mix, slices
from lexweave.llm.shingles import EMPTY, MANTISSA_BITS, band_keys, registers, shingle_sets

#: Up to so many ids (8 bytes, of sets 24) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Bits of the map that tells, past that, of most texts that they are not wanted; and the most ids (8 bytes each in the driver) that it is made of.
MAP_BITS, MAP_IDS = 1 << 27, 1 << 24
#: At most so many counts of common shingles (16 bytes each) are broadcast.
MAX_COMMON = 100_000
#: Rows of groups to a task, and the most tasks of a stage.
TASK_ROWS, MOST_TASKS = 10_000, 100_000
SALT = np.uint64(0xA0761D6478BD642F)


def set_ids(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """128 bits for each document's set: two sums of scrambled hashes; zero without shingles."""
    out = np.zeros((n, 2), np.uint64)
    if len(doc):
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        for k, salt in enumerate((np.uint64(0), SALT)):
            out[doc[begin], k] = np.add.reduceat(mix(value ^ salt), begin)
    return out


def places(uid: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each id in a map of so many."""
    return (mix(uid.view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def bit_map(ids: DataFrame) -> np.ndarray:
    """MAP_BITS bits, of which those of ids(uid) are set."""
    out = np.zeros(MAP_BITS // 8, np.uint8)
    at = places(ids.select("uid").toArrow()["uid"].to_numpy(), MAP_BITS)
    np.bitwise_or.at(out, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return out


def binaries(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as a binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary()) if len(rows) else pa.array([], pa.binary())


def lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values, kind))


def chance_equal(size: np.ndarray, buckets: int) -> np.ndarray:
    """The chance that registers of unrelated sets of this size are equal: both have a leading-zero count, and the mantissas agree."""
    each = size[..., None] / buckets
    zeros = np.arange(1, 40)
    at = np.exp(-each * 2.0**-zeros) - np.exp(-each * 2.0 ** (1 - zeros))
    return (at**2).sum(axis=-1) / (1 << MANTISSA_BITS)


@dataclass(frozen=True)
class NearDup:
    percent: int = 85
    width: int = 5
    buckets: int = 512
    rows: int = 6
    piece: int = 1024
    deviations: float = 5.0
    #: Forests are made in the groups of so many bands; the others are for pairs that are left then.
    early: int = 8
    #: How many atoms at most a group of classes is cut by.
    deep: int = 8

    @property
    def bands(self) -> int:
        """As many as leave a pair at the threshold a chance under 1e-10 to share none."""
        return math.ceil(math.log(1e-10) / math.log(1 - (self.percent / 100) ** self.rows))

    # ---- sketches -------------------------------------------------------------------------------------

    def sketches(self, documents: DataFrame) -> DataFrame:
        """uid, n, sid, regs for documents(doc_id, text)."""
        rows = documents.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("uid"), "text")

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lo, hi, data, offsets in slices(batch.column(1)):
                doc, value = shingle_sets(data, offsets, self.width)
                regs = registers(doc, value, hi - lo, self.buckets)
                n = np.bincount(doc, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), binaries(set_ids(doc, value, hi - lo)), binaries(regs)], ["uid", "n", "sid", "regs"])

        return arrow_map(rows, run, "uid long, n long, sid binary, regs binary")

    def banded(self, reps: DataFrame) -> DataFrame:
        """key, rid, nth: the band keys of each class, and which band each is of."""

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                keys = band_keys(self.matrix(part.column(1).to_pylist()), self.bands, self.rows)
                nth = np.tile(np.arange(self.bands, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(), self.bands)), pa.array(nth)], ["key", "rid", "nth"])

        return arrow_map(reps.select("rid", "regs"), run, "key long, rid long, nth int")

    def matrix(self, regs: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(regs), np.uint8).reshape(len(regs), self.buckets)

    def with_sids(self, documents: DataFrame) -> DataFrame:
        """The documents' rows with __sid."""
        at = documents.columns.index("text")

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sids = [binaries(set_ids(*shingle_sets(data, offsets, self.width), hi - lo)) for lo, hi, data, offsets in slices(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(sids)], [*batch.schema.names, "__sid"])

        return arrow_map(documents, run, documents.select("*", F.lit("").cast("binary").alias("__sid")).schema)

    def sets(self, documents: DataFrame, wanted: DataFrame) -> DataFrame:
        """rid, shingles (sorted hashes) of the classes in wanted(rid, sid, uid)."""
        ids = saved(wanted.select("rid", "sid", "uid"))
        many = ids.count()
        few, sent = many <= BROADCAST_IDS, None
        rows = documents.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("uid"), "text")
        if few:
            rows = rows.join(F.broadcast(ids.select(F.col("uid").alias("__want")).distinct()), F.col("uid") == F.col("__want"), "left_semi")
        elif many <= MAP_IDS:  # texts are not shuffled: a map of bits leaves out most, the join of the sets the others
            sent = documents.sparkSession.sparkContext.broadcast(bit_map(ids))

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if sent is not None:
                at = places(batch.column(0).to_numpy(), 8 * len(sent.value))
                batch = batch.filter(pa.array(sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0))
            for lo, hi, data, offsets in slices(batch.column(1)):
                doc, value = shingle_sets(data, offsets, self.width)
                yield pa.RecordBatch.from_arrays([binaries(set_ids(doc, value, hi - lo)), lists(np.bincount(doc, minlength=hi - lo), value.view(np.int64), pa.int64())], ["sid", "shingles"])

        named = ids.select("sid", "rid")
        found = arrow_map(rows, run, "sid binary, shingles array<long>").join(F.broadcast(named) if few else named, "sid")
        return found.select("rid", "shingles").dropDuplicates(["rid"])

    # ---- candidates -----------------------------------------------------------------------------------

    def estimates(self, regs: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Estimated similarity of rows `at` to all rows, or -1 where the threshold is out of reach.

        The standard error is that of drawing `either` of the union's shingles without replacement.
        """
        gap = regs == EMPTY
        limit = self.percent / 100
        out = np.empty((len(at), len(regs)), np.float32)
        for k in range(0, len(at), 64):
            i = at[k : k + 64]
            equal = np.empty((len(i), len(regs)), np.float32)
            for row, x in enumerate(i):
                equal[row] = np.count_nonzero(regs == regs[x], axis=1)
            none = gap[i].astype(np.float32) @ gap.T.astype(np.float32)
            equal, either = equal - none, np.maximum(self.buckets - none, 1)
            chance = chance_equal(size[i], self.buckets)[:, None]  # pairs that count are of like size
            guess = (equal / either - chance) / (1 - chance)
            union = np.maximum((size[i][:, None] + size[None]) / (1 + limit), either + 1)
            spread = limit * (1 - limit) / either * (1 - either / union) + chance / either
            ratio = np.minimum(size[i][:, None], size[None]) / np.maximum(size[i][:, None], size[None])
            out[k : k + 64] = np.where((guess >= limit - self.deviations * np.sqrt(spread)) & (ratio >= limit), np.maximum(guess, 0), -1)
        return out

    def forest(self, regs: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
        """A spanning forest of the likeliest pairs (Prim)."""
        n = len(size)
        near = self.estimates(regs, size, np.arange(n))
        np.fill_diagonal(near, -1)
        best, parent, left = np.full(n, -1, np.float32), np.full(n, -1), np.ones(n, bool)
        out = []
        for _ in range(n):
            at = int(np.argmax(np.where(left, best, -2)))
            left[at] = False
            if best[at] >= 0:
                out.append((int(parent[at]), at))
            closer = near[at] > best
            best[closer], parent[closer] = near[at][closer], at
        return out

    def crossing(self, regs: np.ndarray, size: np.ndarray, label: np.ndarray, main: np.ndarray, chunk: np.ndarray, group: tuple[int, int, int], banded: bool, limit: int) -> tuple[list[tuple[int, int]], bool]:
        """The likeliest pairs of rows with different labels, at most limit for each row outside the main label; and if any were held back.

        group: the key, then (-1, block) for a block of the main label's rows beside all others, of which the first
        compares the others among themselves; or the numbers of two chunks to be compared with each other.
        banded: whether keys are band keys; then a pair counts in the first band that it shares.
        """
        key, one, two = group
        rows = np.flatnonzero(~main & ((one < 0) | (chunk == one)))
        place = np.arange(len(regs))[None]
        out, held = [], False
        for k in range(0, len(rows), 256):
            at = rows[k : k + 256]
            near = self.estimates(regs, size, at)
            apart = label[at][:, None] != label[None]
            if one < 0:
                apart &= main[None] | ((two == 0) & (at[:, None] < place))
            else:
                apart &= (chunk == two)[None] & ((one != two) | (at[:, None] < place))
            near[~apart] = -1
            x, j = np.nonzero(near >= 0)
            if banded:
                here = self.met_first(regs, at[x], j, key)
                x, j = x[here], j[here]
            order = np.lexsort((-near[x, j], x))
            x, j = x[order], j[order]
            begin = np.flatnonzero(np.diff(x, prepend=-1))
            nth = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
            held |= bool((nth >= limit).any())
            out += zip(at[x[nth < limit]].tolist(), j[nth < limit].tolist())
        return out, held

    def met_first(self, regs: np.ndarray, one: np.ndarray, other: np.ndarray, key: int) -> np.ndarray:
        """Whether key is the first band key that each pair of rows shares."""
        used, which = np.unique(np.concatenate((one, other)), return_inverse=True)
        keys = band_keys(regs[used], self.bands, self.rows)
        a, b = keys[which[: len(one)]], keys[which[len(one) :]]
        return a[np.arange(len(a)), (a == b).argmax(axis=1)] == key

    def pairs(self, groups: DataFrame, reps: DataFrame, limit: int | None, many: int, banded: bool = True) -> DataFrame:
        """a, b from groups(key, rid[, label, main, chunk, one, two]): forests if limit is None, else crossing pairs; further rows have in held the keys of groups of which some are held back.

        many: the rows of groups.  The work on a row is far more than its bytes tell, so tasks are cut by rows.
        """
        crossing = limit is not None
        tasks = max(1, min(MOST_TASKS, many // TASK_ROWS))
        rows = groups.join(reps.select("rid", "n", "regs"), "rid")
        if crossing:
            rows = rows.select("key", "one", "two", "rid", "n", "regs", "label", "main", "chunk").repartition(tasks, "key", "one", "two").sortWithinPartitions("key", "one", "two", "rid")
        else:
            rows = rows.select("key", F.lit(-1).alias("one"), F.lit(0).alias("two"), "rid", "n", "regs").repartitionByRange(tasks, "key", "regs", "rid").sortWithinPartitions("key", "regs")
        piece = self.piece

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, part, out = None, [], []

            def solve() -> None:
                regs, size = self.matrix([p[1] for p in part]), np.array([p[0][1] for p in part], np.float64)
                rid = [p[0][0] for p in part]
                if crossing:
                    found, held = self.crossing(regs, size, *(np.array([p[k] for p in part]) for k in (2, 3, 4)), key, banded, limit)
                else:
                    found, held = self.forest(regs, size), False
                out.extend((min(rid[i], rid[j]), max(rid[i], rid[j]), None) for i, j in found if rid[i] != rid[j])
                if held:
                    out.append((None, None, key[0]))

            def flush() -> pa.RecordBatch:
                batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64()))], ["a", "b", "held"])
                out.clear()
                return batch

            for batch in source:
                for k, one, two, rid, n, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                    if (k, one, two) != key or not crossing and len(part) >= piece:
                        if len(part) > 1:
                            solve()
                        part = part[:: max(1, piece // 16)][:16] if (k, one, two) == key else []  # some go on, to tie the pieces
                        key = (k, one, two)
                        if len(out) > 20_000:
                            yield flush()
                    part.append(((rid, n), *rest))
            if len(part) > 1:
                solve()
            if out:
                yield flush()

        return arrow_stream(rows, run, "a long, b long, held long").distinct()

    def shared(self, banded: DataFrame) -> DataFrame:
        """banded's rows with the keys of groups of several classes.

        Keys come together once, in order, and a task looks at each run; cells (nth past the bands) of over two pieces are left to the bands.
        """
        rows, bands, most = banded.repartition("key").sortWithinPartitions("key", "nth"), self.bands, 2 * self.piece

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["key", "rid", "nth"]
            tail, through = None, None  # the run that is open; and (key, whether its rows stay) where that is known already
            for batch in source:
                rows = pa.Table.from_batches([batch])
                if through is not None:
                    same = int(np.searchsorted(rows["key"].to_numpy(), through[0], "right"))
                    if same and through[1]:
                        yield from rows.slice(0, same).to_batches()
                    rows = rows.slice(same)
                if not rows.num_rows:
                    continue
                through = None
                rows = (rows if tail is None else pa.concat_tables([tail, rows])).combine_chunks()
                key, nth = rows["key"].to_numpy(), rows["nth"].to_numpy()
                begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                n = np.diff(np.append(begin, len(key)))
                stays = (n > 1) & ((nth[begin] < bands) | (n <= most))
                closed, tail = int(begin[-1]), rows.slice(int(begin[-1]))
                yield from rows.slice(0, closed).filter(pa.array(np.repeat(stays[:-1], n[:-1]))).to_batches()
                if n[-1] > most:
                    through, out, tail = (key[-1], bool(stays[-1])), tail, None
                    if stays[-1]:
                        yield from out.to_batches()
            if tail is not None and tail.num_rows > 1:
                yield from tail.select(names).to_batches()

        return arrow_stream(rows.select("key", "rid", "nth"), run, "key long, rid long, nth int")

    def first_groups(self, members: DataFrame) -> DataFrame:
        """The groups that forests are made in."""
        return members.filter(F.col("nth") < self.early)

    def mixed_groups(self, members: DataFrame, labels: DataFrame, grid: bool = False) -> tuple[DataFrame, DataFrame | None, int]:
        """The groups with several labels, by blocks for pairs(); the classes of the groups left out of it, rid, if any; and the rows of the first.

        A large group with few classes outside its main label is cut into blocks of the main label's classes, with
        the others in each.  Where the others are more than a piece, the group is left out; or, with grid, cut into
        chunks, each pair of which is a block.
        """
        named = saved(members.join(labels.select(F.col("node").alias("rid"), "label"), "rid", "left").withColumn("label", F.coalesce("label", "rid")))
        by_label = named.groupBy("key", "label").agg(F.count("*").alias("c"))
        by_key = saved(by_label.groupBy("key").agg(F.sum("c").alias("all"), F.count("*").alias("kinds"), F.max("c").alias("top"), F.max_by("label", "c").alias("most")).filter("kinds > 1"))
        rows = named.join(by_key, "key")
        few = (F.col("all") <= 2 * self.piece) | (F.col("all") - F.col("top") <= self.piece)
        blocks = F.ceil(F.col("all") / F.lit((1.0 if grid else 2.0) * self.piece)).cast("int")
        own = F.pmod(F.xxhash64("rid"), blocks).cast("int")
        main = F.col("label") == F.col("most")
        upto = F.sequence(F.lit(0), blocks - 1)
        pair = lambda one, two: F.struct(one.cast("int").alias("one"), two.cast("int").alias("two"))
        beside = F.transform(F.when((blocks > 1) & ~main, upto).otherwise(F.array(own)), lambda b: pair(F.lit(-1), b))
        crossed = F.transform(upto, lambda b: pair(F.least(b, own), F.greatest(b, own)))
        compared = rows if grid else rows.filter(few)
        at = F.explode(F.when(few, beside).otherwise(crossed) if grid else beside)
        compared = compared.select("key", "rid", "label", (main & few).alias("main"), own.alias("chunk"), at.alias("at")).select("key", "rid", "label", "main", "chunk", "at.one", "at.two")
        made = F.when(few, F.when(blocks > 1, F.col("top") + (F.col("all") - F.col("top")) * blocks).otherwise(F.col("all"))).otherwise(F.col("all") * blocks if grid else F.lit(0))
        many, any_hot = by_key.agg(F.sum(made), F.max(~few)).first()
        hot = rows.filter(~few).select("rid").distinct() if any_hot and not grid else None
        return compared, hot, many or 0

    def rare_groups(self, documents: DataFrame, reps: DataFrame, hot: DataFrame, labels: DataFrame) -> DataFrame:
        """key, rid: the classes in hot(rid) grouped anew by what two similar sets must share (a prefix filter).

        Shingles that the same of these classes have are one atom, of as much weight as they are shingles.  With all
        atoms in one order, rarest first, a set of n shares with a similar one all but n - ceil(n * percent / 100) of
        its weight; so the first atom that they share is one before which it has no more than that.  Groups are made by that
        atom; those that are too large, not counting their main label, are cut by the second shared one, before which
        no more is passed over in all, and so on to `deep`.  Shingles in many sets are so few that their counts are
        broadcast; the others' counts are joined.
        """
        sets = saved(self.sets(documents, hot.join(reps.select("rid", "sid", "uid"), "rid")))
        each = sets.select("rid", F.explode("shingles").alias("s"))
        who = F.bit_xor(F.xxhash64(F.lit(1), "rid")), F.bit_xor(F.xxhash64(F.lit(2), "rid"))
        counts = each.groupBy("s").agg(F.count("*").alias("c"), who[0].alias("x"), who[1].alias("y"))
        counts = saved(counts.filter("c > 1").select("s", "c", F.xxhash64("c", "x", "y").alias("atom")))
        total = counts.agg(F.sum("c")).first()[0] or 0
        common = F.broadcast(counts.filter(F.col("c") > total / MAX_COMMON))  # under MAX_COMMON of them, by their sum
        rare = each.join(common.select(F.col("s").alias("o")), F.col("s") == F.col("o"), "left_anti").join(counts.filter(F.col("c") <= total / MAX_COMMON), "s")
        held = rare.select("rid", "c", "atom").unionByName(each.join(common, "s").select("rid", "c", "atom")).groupBy("rid", "c", "atom").agg(F.count("*").cast("int").alias("w"))
        ranked = held.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("c", "atom", "w"))).alias("t"))
        named = ranked.join(sets.select("rid", F.size("shingles").alias("n")), "rid").join(labels.select(F.col("node").alias("rid"), "label"), "rid", "left")
        least = F.ceil(F.col("n") * self.percent / F.lit(100)).cast("int")
        # shingles of one class only come first in the order, and are all passed over
        own = F.col("n") - F.aggregate("t", F.lit(0), lambda total, e: total + e["w"])
        ahead = F.transform("t", lambda e, k: F.aggregate(F.slice("t", F.lit(1), k), F.lit(0), lambda total, x: total + x["w"]))
        ranked = saved(named.select("rid", "t", ahead.alias("ahead"), least.alias("least"), (F.col("n") - least - own).alias("spare"), F.coalesce("label", "rid").alias("label")))

        def following(rows: DataFrame) -> DataFrame:
            """rows(rid, chosen, at, passed) with each atom that may be the next one which is shared."""
            after = F.get("ahead", F.col("at")) + F.get("t", F.col("at"))["w"]
            weight = lambda j: F.col("passed") + F.get("ahead", j) - F.coalesce(after, F.lit(0))
            places = F.when(F.col("at") + 1 < F.size("t"), F.sequence(F.col("at") + 1, F.size("t") - 1))
            each = rows.join(ranked, "rid").select("rid", "t", "ahead", "chosen", "got", "at", "passed", F.explode(F.filter(places, lambda j: weight(j) <= F.col("spare"))).alias("j"))
            atom = F.get("t", F.col("j"))
            return each.select("rid", F.array_append("chosen", atom["atom"]).alias("chosen"), (F.col("got") + atom["w"]).alias("got"), F.col("j").alias("at"), weight(F.col("j")).alias("passed"))

        start = ranked.select("rid", F.array().cast("array<bigint>").alias("chosen"), F.lit(0).alias("got"), F.lit(-1).alias("at"), F.lit(0).alias("passed"))
        rows = saved(following(start))
        for _ in range(1, self.deep):
            by_label = rows.join(ranked.select("rid", "label"), "rid").groupBy("chosen", "label").agg(F.count("*").alias("c"))
            by_key = by_label.groupBy(F.col("chosen").alias("k")).agg(F.sum("c").alias("all"), F.max("c").alias("top"))
            large = saved(by_key.filter((F.col("all") > 2 * self.piece) & (F.col("all") - F.col("top") > self.piece)).select("k"))
            if large.isEmpty():
                break
            cut = rows.join(large, F.col("chosen") == F.col("k"), "left_semi")
            enough = cut.join(ranked.select("rid", "least"), "rid").filter("got >= least").select("rid", "chosen", "got", F.lit(1 << 30).alias("at"), "passed")  # these may share no more, and stay
            whole = rows.join(large, F.col("chosen") == F.col("k"), "left_anti")
            rows = saved(whole.unionByName(enough).unionByName(following(cut)))
        return rows.select(F.xxhash64("chosen").alias("key"), "rid").distinct()

    # ---- links and components -------------------------------------------------------------------------

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs(a, b) that reach the threshold on their full sets."""
        left = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("y"))
        shared = F.size(F.array_intersect("x", "y")).cast("long")
        both = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).cast("long").alias("total"))
        return both.filter(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * self.percent).select("a", "b")

    def classes(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(uid, n, sid by document; sid, component, label by class): component is the least uid that is reachable, label tells apart groups that share it."""
        with scope() as own:
            results = self.judged(need(documents, "doc_id", "text"))
        found, joined = settled(own, *results)
        return found, joined

    def judged(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """classes(), resting on tables of the open scope."""
        spark = documents.sparkSession
        with scope() as own:
            sketched = saved(self.sketches(documents))
            reps = sketched.filter("n > 0").groupBy("sid").agg(F.min("uid").alias("uid"), F.first("n").alias("n"), F.first("regs").alias("regs"))
            reps = reps.select(F.monotonically_increasing_id().alias("rid"), "sid", "uid", "n", "regs")
        # registers are kept by class only
        rows, reps = settled(own, sketched.select("uid", "n", "sid"), reps)
        release(spark)
        members = saved(self.shared(self.banded(reps)))
        release(spark)
        labels = documents.sparkSession.createDataFrame([], "node long, label long")
        first = self.first_groups(members)
        tried = found = saved(self.pairs(first, reps, None, first.count())).select("a", "b")
        sets, rare, limit = None, None, 8
        while True:
            release(spark)
            if not found.isEmpty():
                used = found.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
                if sets is not None:
                    used = used.join(sets.select("rid"), "rid", "left_anti")
                used = saved(used.join(reps.select("rid", "sid", "uid"), "rid"))
                if not used.isEmpty():
                    more = saved(self.sets(documents, used))
                    sets = more if sets is None else sets.unionByName(more)
                    release(spark)
                new = saved(self.verified(found.select("a", "b"), sets))
                if not new.isEmpty():
                    # what is known already goes in as a star for each component, not as all its links
                    labels = saved(components(new.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))))
                release(spark)
            if members is None and rare is None:
                break
            # pairs between components; groups of which none are held back are through with, as components only grow together
            every = []
            for kind in ("members", "rare"):
                part = members if kind == "members" else rare
                if part is None:
                    continue
                groups, hot, many = self.mixed_groups(part, labels, kind == "rare")
                every.append(saved(self.pairs(groups, reps, limit, many, kind == "members")))
                keys = every[-1].filter("held is not null").select(F.col("held").alias("k"))
                rest = None if keys.isEmpty() else saved(part.join(keys, F.col("key") == F.col("k"), "left_semi"))
                if kind == "members":
                    members = rest
                    if hot is not None and limit == 8:  # later rounds' hot groups are among the first one's
                        rare = saved(self.rare_groups(documents, reps, saved(hot), labels))
                else:
                    rare = rest
            found = every[0] if len(every) == 1 else every[0].unionByName(every[1])
            found = saved(found.filter("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
            tried = tried.unionByName(found)
            limit *= 8
        named = reps.select("rid", "sid", "uid").join(labels.select(F.col("node").alias("rid"), "label"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
        least = named.groupBy("label").agg(F.min("uid").alias("component"))
        return rows, named.join(least, "label").select("sid", "component", "label")

    def deduplicated(self, documents: DataFrame) -> DataFrame:
        """doc_id, n_shingles, component_id, kept."""
        rows, classes = self.classes(documents)
        joined = rows.join(classes, "sid", "left").withColumn("component", F.coalesce("component", "uid"))
        kind = documents.schema["doc_id"].dataType
        shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).cast(kind)
        return joined.select(shown("uid").alias("doc_id"), F.col("n").alias("n_shingles"), shown("component").alias("component_id"), (F.col("uid") == F.col("component")).alias("kept"))
