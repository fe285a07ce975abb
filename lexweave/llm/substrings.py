"""Removal of repeated byte strings (suffix-array deduplication) by sparse prefix doubling.

Every byte covered by a string of `length` bytes that starts anywhere else, too, is removed.  Sorting all
suffixes would shuffle each byte position in each round; here only positions that can repeat take part:

1. Each `length`-byte string belongs to its minimizer: the `gram`-byte string in it with the least hash
   (leftmost on ties), which depends on its content alone.  Neighbouring strings with the same minimizer are
   a run, one row: about two rows for every `length - gram` bytes.
2. First rank: the minimizer's hash.  Runs with a unique one hold nothing repeated and drop out.
3. Second rank: the hash of all bytes of a run.  Runs where it occurs twice are repeated throughout; one of
   each stands in for the others in the last step.
4. What is left - runs with a shared minimizer in different surroundings - is brought together by minimizer,
   and there prefix doubling decides: pairs of ranks at growing offsets (gram, 2 gram, 4 gram ... length) are
   sorted and reranked, positions with unique ranks drop out, and what is still shared past the threshold is
   repeated.  A minimizer in over `group` surroundings (a passage that many documents share) is first split
   by growing strings around it, common to all strings that start at nearby offsets: 64 offsets, then 8, then
   1, where a count of equal keys decides.  So no task gets an unbounded group.

Beside this, n_passages reports the stretches of words that documents share: a passage of over 50 words has
often under `length` bytes, so that none of it is to be removed.

Strings are compared by 64-bit hashes within groups of equal 64-bit hashes.  Texts are known by a 64-bit hash
and their size.  Matches never cross documents, equal texts repeat each other, and strings are judged on the
input.

Cases: null texts are empty; texts under `length` bytes lose nothing; repeated rows count as repeats; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import arrow_map, arrow_stream, need, saved, scope, settled
from lexweave.llm.kernels import SLICE_BYTES, hashed_words, joined, mix, slices, widened, window_hashes
from lexweave.llm.shingles import SPACES

LOW32 = np.uint64(0xFFFFFFFF)
#: Whole runs are hashed by blocks of so many bytes.
BLOCK = 32
SOLVE_BYTES = 3_000_000
#: Up to so many texts' identities (12 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_TEXTS = 500_000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i < len(x) - width + 1 (van Herk, Gil and Werman)."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def passage_grams(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of the distinct minimizers, `gram` words each, of all windows of `window` words, sorted by both."""
    coded, counts = hashed_words(data, offsets, SPACES)
    if len(coded) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = widened(coded, 1, gram)
    least = sliding_least((grams & ~LOW32) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
    ends = np.cumsum(counts)
    doc = np.searchsorted(ends, np.arange(len(least)), "right")
    inside = np.arange(len(least)) + window <= ends[doc]
    doc, value = doc[inside], grams[(least[inside] & LOW32).astype(np.int64)]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


@dataclass(frozen=True)
class Repeats:
    length: int = 400
    gram: int = 50
    group: int = 500
    passage_words: int = 51
    passage_gram: int = 32

    def texts(self, documents: DataFrame) -> DataFrame:
        """doc_id, text, tid, size."""
        text = F.coalesce(F.col("text"), F.lit(""))
        return documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tid"), F.octet_length(text).alias("size"))

    def runs_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """(document, first start, count of starts, minimizer's place, its hash, hash of all bytes) of each run."""
        n, length, gram = len(data), self.length, self.gram
        if n < length:
            return None
        blocks = window_hashes(data, BLOCK)
        rolling = widened(blocks, BLOCK, gram)
        least = sliding_least((rolling & ~LOW32) | np.arange(len(rolling), dtype=np.uint64), length - gram + 1)
        place = (least & LOW32).astype(np.int64)
        long = offsets[1:] - offsets[:-1] >= length
        ok = np.zeros(len(place) + 1, np.int64)
        np.add.at(ok, offsets[:-1][long], 1)
        np.add.at(ok, offsets[1:][long] - length + 1, -1)
        at = np.flatnonzero(np.cumsum(ok)[:-1] > 0)
        if not len(at):
            return None
        doc = np.searchsorted(offsets, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (place[at][1:] != place[at][:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        start, doc = at[first], doc[first]
        spot = place[start]
        whole = joined(count.astype(np.uint64), (spot - start).astype(np.uint64))
        last = start + count - 1 + length - BLOCK
        for k in range(0, 2 * length - gram, BLOCK):
            whole = joined(whole, blocks[np.minimum(start + k, last)])
        return doc, start - offsets[doc], count, spot - start, mix(rolling[spot] ^ np.uint64(0x5851F42D4C957F2D)), whole

    def all_runs(self, texts: DataFrame) -> DataFrame:
        """gram, whole, tid, size, start, span (count of starts * 512 + the minimizer's offset)."""

        def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
            """Slices; of a long text the windows of its starts, with where they begin: a run that is cut is two runs."""
            for lo, _, data, offsets in slices(batch.column(0)):
                if len(data) <= 2 * SLICE_BYTES:
                    yield lo, 0, data, offsets
                    continue
                for a in range(0, len(data) - self.length + 1, SLICE_BYTES):
                    part = data[a : a + SLICE_BYTES + self.length - 1]
                    yield lo, a, part, np.array([0, len(part)])

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            tid, size = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo, a, data, offsets in pieces(batch):
                found = self.runs_of(data, offsets)
                if found is not None:
                    doc, start, count, offset, key, whole = found
                    start = start + a
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(tid[lo + doc]), pa.array(size[lo + doc], pa.int32()), pa.array(start, pa.int32()), pa.array(count * 512 + offset, pa.int32())],
                        ["gram", "whole", "tid", "size", "start", "span"],
                    )

        return arrow_map(texts.filter(F.col("size") >= self.length).select("text", "tid", "size"), run, "gram long, whole long, tid long, size int, start int, span int")

    def contexts(self, texts: DataFrame, wanted: DataFrame) -> DataFrame:
        """key, tid, size, start, span, ghost, n, bytes for wanted(gram, tid, size, start, span, ghost, n).

        Of equal texts one goes on: copies are dropped where they are read, before the shuffle.
        """
        lists_of = saved(wanted.groupBy("tid", "size").agg(F.collect_list(F.struct("gram", "start", "span", "ghost", "n")).alias("w")))
        few = lists_of.count() <= BROADCAST_TEXTS
        ids = lists_of.select("tid", "size")
        picked = texts.select("text", "tid", "size").join(F.broadcast(ids) if few else ids, ["tid", "size"], "left_semi")
        rows = picked.groupBy("tid", "size").agg(F.first("text").alias("text")).join(lists_of, ["tid", "size"]).select("text", "tid", "size", "w")

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in range(batch.num_rows):
                body = memoryview(batch.column(0)[row].as_buffer())
                w = batch.column(3)[row].values
                start, span = w.field("start").to_numpy(), w.field("span").to_numpy()
                cut = [bytes(body[a : a + s // 512 - 1 + self.length]) for a, s in zip(start.tolist(), span.tolist())]
                k = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [w.field("gram"), pa.array([batch.column(1)[row].as_py()] * k, pa.int64()), pa.array([batch.column(2)[row].as_py()] * k, pa.int32()), w.field("start"), w.field("span"), w.field("ghost"), w.field("n"), pa.array(cut, pa.binary())],
                    ["key", "tid", "size", "start", "span", "ghost", "n", "bytes"],
                )

        return arrow_map(rows, run, "key long, tid long, size int, start int, span int, ghost boolean, n long, bytes binary")

    def doubled(self, bodies: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(body, start) of the starts below counts whose string of `length` bytes is at two such places at least."""
        data = np.frombuffer(b"".join(bodies), np.uint8)
        size = np.array([len(b) for b in bodies])
        begin = np.cumsum(size) - size
        n = len(data)
        rank = np.full(n + 1, -1, np.int64)  # -1: unique, or too near its body's end
        ends = np.repeat(begin + size, size)
        at = np.flatnonzero(np.arange(n) + self.gram <= ends)
        code = window_hashes(data, self.gram)[at]
        reach = self.gram
        starts = np.zeros(n + 1, bool)
        starts[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)] = True
        while True:
            if reach == self.length:
                keep = starts[at]
                at, code = at[keep], code[keep]
            order = np.argsort(code, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = code[order][1:] != code[order][:-1]
            which = np.cumsum(new) - 1
            shared = np.bincount(which, minlength=1)[which] > 1 if len(order) else np.zeros(0, bool)
            alive, ranks = order[shared], which[shared]
            if reach == self.length:
                found = np.sort(at[alive])
                body = np.searchsorted(begin, found, "right") - 1
                return body, found - begin[body]
            rank[:] = -1
            rank[at[alive]] = ranks
            step = min(reach, self.length - reach)
            at = np.sort(at[alive])
            after = at + step
            at = at[(after < n) & (ends[np.minimum(at, n - 1)] - at >= reach + step)]
            second = rank[at + step]
            at, second = at[second >= 0], second[second >= 0]
            code = rank[at] * np.int64(len(which) + 1) + second
            reach += step

    def solved(self, groups: DataFrame) -> DataFrame:
        """tid, size, lo, hi: runs of repeated starts, from contexts of which each key's are few."""
        rows = groups.select("key", "tid", "size", "start", "span", "ghost", "bytes").repartition("key").sortWithinPartitions("key", "tid", "size", "start")

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            size = 0

            def solve(part: list[tuple]) -> pa.RecordBatch | None:
                counts = np.array([p[4] // 512 for p in part])
                body, start = self.doubled([p[6] for p in part], counts)
                ghost = np.array([p[5] for p in part])
                body, start = body[~ghost[body]], start[~ghost[body]]
                if not len(body):
                    return None
                new = np.ones(len(body), bool)
                new[1:] = (body[1:] != body[:-1]) | (start[1:] != start[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(body)) - 1
                base = np.array([p[3] for p in part])[body[first]]
                tid, many = np.array([p[1] for p in part], np.int64), np.array([p[2] for p in part], np.int32)
                return pa.RecordBatch.from_arrays(
                    [pa.array(tid[body[first]]), pa.array(many[body[first]]), pa.array((base + start[first]).astype(np.int32)), pa.array((base + start[last]).astype(np.int32))], ["tid", "size", "lo", "hi"]
                )

            for batch in source:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and row[0] != held[-1][0] and size > SOLVE_BYTES:
                        found = solve(held)
                        held, size = [], 0
                        if found is not None:
                            yield found
                    held.append(row)
                    size += len(row[6])
            if held and (found := solve(held)) is not None:
                yield found

        return arrow_stream(rows, run, "tid long, size int, lo int, hi int")

    def split(self, groups: DataFrame, width: int) -> DataFrame:
        """Contexts cut by aligned ranges of offsets; the key also holds the bytes common to all strings of a range."""

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for key, tid, size, start, span, ghost, _, body in zip(*(c.to_pylist() for c in batch.columns)):
                count, offset = span // 512, span % 512
                lowest = offset - count + 1
                for block in range(lowest // width, offset // width + 1):
                    a, b = max(lowest, block * width), min(offset, block * width + width - 1)
                    core = body[offset - block * width : offset - (block * width + width - 1) + self.length]
                    name = hashlib.blake2b(core, digest_size=8, key=f"{key}:{block}".encode()).digest()
                    out.append((int.from_bytes(name, "little", signed=True), tid, size, start + offset - b, (b - a + 1) * 512 + b, ghost, 0, body[offset - b : offset - a + self.length]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), batch.schema.types)], batch.schema.names)

        return arrow_map(groups, run, "key long, tid long, size int, start int, span int, ghost boolean, n long, bytes binary")

    def repeated(self, texts: DataFrame) -> DataFrame:
        """tid, size, lo, hi: runs of starts of repeated strings."""
        every = saved(self.all_runs(texts))
        shared = every.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("n")).filter("n > 1").select("g")
        every = saved(every.join(saved(shared), F.col("gram") == F.col("g"), "left_semi"))
        kinds = saved(every.groupBy("gram", "whole").agg(F.count("*").alias("c"), F.min(F.struct("tid", "size", "start", "span")).alias("r")))
        twice = kinds.filter("c > 1").select(F.col("gram").alias("g"), F.col("whole").alias("w"))
        ends = F.floor(F.col("span") / 512).cast("int") + F.col("start") - 1
        out = every.join(saved(twice), (F.col("gram") == F.col("g")) & (F.col("whole") == F.col("w")), "left_semi").select("tid", "size", F.col("start").alias("lo"), ends.alias("hi"))
        open_grams = kinds.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("n"), F.min("c").alias("least")).filter("n > 1 and least = 1").select("g", "n")
        wanted = saved(kinds.join(saved(open_grams), F.col("gram") == F.col("g")).select("gram", "r.*", (F.col("c") > 1).alias("ghost"), "n"))
        if wanted.isEmpty():
            return out.distinct()
        pending = saved(self.contexts(texts, wanted))
        out = out.unionByName(self.solved(pending.filter(F.col("n") <= self.group)))
        pending = pending.filter(F.col("n") > self.group)
        for width in (64, 8, 1):
            if pending.isEmpty():
                break
            parts = saved(self.split(pending.dropDuplicates(["key", "tid", "size", "start"]).select("key", "tid", "size", "start", "span", "ghost", "n", "bytes"), width))
            counts = saved(parts.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("m")).filter("m > 1"))  # a table, so that the join may be cut at hot keys
            parts = saved(parts.drop("n").join(counts, F.col("key") == F.col("k")).select("key", "tid", "size", "start", "span", "ghost", F.col("m").alias("n"), "bytes"))
            if width == 1:
                out = out.unionByName(parts.filter("not ghost").select("tid", "size", F.col("start").alias("lo"), F.col("start").alias("hi")))
            else:
                out = out.unionByName(self.solved(parts.filter(F.col("n") <= self.group)))
                pending = parts.filter(F.col("n") > self.group)
        return out.distinct()

    def passages(self, texts: DataFrame) -> DataFrame:
        """tid, size, n_passages of the texts that share stretches of words with other documents.

        Of each window of `passage_words` words one stretch of `passage_gram`, its minimizer, is looked up among those
        of all documents.  So a passage of that many words that another document has, too, is always found, whatever
        its bytes, and nothing shorter than a stretch ever is.
        """

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lo, _, data, offsets in slices(batch.column(0)):
                doc, value = passage_grams(data, offsets, self.passage_words, self.passage_gram)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column(1).take(pa.array(lo + doc)), batch.column(2).take(pa.array(lo + doc))], ["gram", "tid", "size"])

        long = texts.filter(F.col("size") >= 2 * self.passage_words - 1).select("text", "tid", "size")
        every = saved(arrow_map(long, run, "gram long, tid long, size int"))
        shared = every.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("n")).filter("n > 1").select("g")
        return every.join(saved(shared), F.col("gram") == F.col("g"), "left_semi").groupBy("tid", "size").agg(F.count_distinct("gram").alias("n_passages"))

    def removed(self, documents: DataFrame) -> DataFrame:
        """doc_id, text, spans array<struct<lo, hi>>: the byte ranges to remove by start (they may overlap); null without any; n_passages."""
        texts = self.texts(need(documents, "doc_id", "text"))
        with scope() as own:
            found = self.repeated(texts).groupBy("tid", "size").agg(F.array_sort(F.collect_list(F.struct("lo", (F.col("hi") + self.length).alias("hi")))).alias("spans"))
            found = found.join(self.passages(texts), ["tid", "size"], "full_outer")
        (both,) = settled(own, found)
        return texts.join(both, ["tid", "size"], "left").select("doc_id", "text", "spans", F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"))


def remove_repeats(documents: DataFrame, repeats: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size, gone, spans, digest = [], [], [], []
        found = batch.column(2)
        ends = found.offsets.to_numpy() - found.offsets[0].as_py()
        every = found.flatten()
        begin, end = every.field("lo").to_numpy().astype(np.int64), every.field("hi").to_numpy().astype(np.int64)
        for lo, hi, data, offsets in slices(batch.column(1)):
            for row in range(lo, hi):
                body = data[offsets[row - lo] : offsets[row - lo + 1]]
                a, b = begin[ends[row] : ends[row + 1]], np.maximum.accumulate(end[ends[row] : ends[row + 1]])
                first = np.flatnonzero(np.append(True, a[1:] > b[:-1])[: len(a)])
                start, stop = a[first], b[np.append(first[1:], len(b)) - 1] if len(b) else b
                kept, at = hashlib.sha256(), 0
                for x, y in zip(start.tolist(), stop.tolist()):
                    kept.update(body[at:x])
                    at = y
                kept.update(body[at:])
                size.append(len(body))
                gone.append(int((stop - start).sum()))
                spans.append(len(start))
                digest.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, spans)), pa.array(digest, pa.string()), batch.column(3)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(repeats.removed(documents), run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long")
