"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The windows of all benchmark items (10 consecutive words; an item of fewer words is one window) are the
patterns.  Patterns of one length share a matcher: a shift table over blocks of two words tells how far the
scan may jump, the suffix block chooses a bucket, and direct comparison confirms an occurrence.

Words are compared by 64-bit hashes until the last step, which compares bytes.  A matcher is a few sorted arrays,
some 60 bytes for each benchmark word, and covers items of at most `CHUNK_BYTES` of text, so what is broadcast is
bounded; a larger benchmark is matched chunk by chunk, each a narrow pass over the saved rows of the one before,
so that one matcher at a time is in memory.  Nothing is shuffled, so common passages and hot sources make no
difference.  The scan moves many cursors at once, one for each stretch of `STRETCH` windows; long texts are walked
in pieces that share the words at their borders.

Cases: null or wordless texts have no words and no hits; null item ids are left out of the item list but
their windows hit; equal items each count; repeated documents are judged alike; empty tables on either side
give no hits or no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import Sent, arrow_map, need, saved
from lexweave.llm.kernels import FOLD, SLICE_BYTES, joined, mix, slices, span_hashes, windows, words

WINDOW = 10
CHUNK_BYTES = 8_000_000
STRETCH = 256
#: Words are runs of ASCII letters and digits and of bytes from 0x80; A-Z count as a-z.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Text:
    """Words of documents laid end to end: folded bytes, where each word is, its hash, and the count by document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.starts, self.ends, self.counts = words(data, offsets, WORD)
        self.data = FOLD[data]
        self.coded = span_hashes(self.data, self.starts, self.ends)
        self.first = np.cumsum(self.counts) - self.counts

    def piece(self, at: int, n: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist())]

    def folded(self, at: np.ndarray, n: int) -> np.ndarray:
        """The hash of n words from each place on."""
        out = mix(np.full(len(at), n, np.uint64))
        for k in range(n):
            out = joined(out, self.coded[at + k])
        return out


class WuManber:
    """All windows of `length` words of some items."""

    def __init__(self, items: Text, which: np.ndarray, length: int) -> None:
        self.items, self.length, self.block = items, length, min(2, length)
        self.leap = length - self.block + 1
        count, first = items.counts[which], items.first[which]
        # a block may be passed by the distance from its first place in an item to the end of the item's first window
        of = np.repeat(np.arange(len(which)), count - self.block + 1)
        place = np.arange(len(of)) - np.repeat(np.cumsum(count - self.block + 1) - (count - self.block + 1), count - self.block + 1)
        blocks, shift = items.folded(first[of] + place, self.block), np.maximum(0, length - self.block - place)
        order = np.lexsort((shift, blocks))
        new = np.append(True, blocks[order][1:] != blocks[order][:-1])
        self.blocks, self.shift = blocks[order][new], shift[order][new].astype(np.int8 if length < 128 else np.int64)
        of = np.repeat(np.arange(len(which)), count - length + 1)
        place = np.arange(len(of)) - np.repeat(np.cumsum(count - length + 1) - (count - length + 1), count - length + 1)
        at = first[of] + place
        keys = items.folded(at, length)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.owner = keys[order], at[order].astype(np.int32), which[of][order].astype(np.int32)

    def candidates(self, text: Text) -> np.ndarray:
        """The windows of text that end with the last block of some pattern; the others are passed by the shift table."""
        m, b = self.length, self.block
        whole = np.flatnonzero(text.counts >= m)
        runs = text.counts[whole] - m + 1
        parts = -(-runs // STRETCH)
        of = np.repeat(np.arange(len(whole)), parts)
        start = text.first[whole][of] + (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
        last = np.minimum(start + STRETCH, (text.first[whole] + runs)[of]) - 1
        block = text.folded(np.arange(max(0, len(text.coded) - b + 1)), b)
        out = [np.empty(0, np.int64)]
        while len(start):
            seen = block[start + m - b]
            k = np.minimum(np.searchsorted(self.blocks, seen), len(self.blocks) - 1)
            jump = np.where(self.blocks[k] == seen, self.shift[k], self.leap)
            stop = jump == 0
            out.append(start[stop])
            start = start + np.maximum(jump, 1)
            on = start <= last
            start, last = start[on], last[on]
        return np.sort(np.concatenate(out))

    def find(self, text: Text) -> Iterator[tuple[int, np.ndarray]]:
        """(place, items) of every occurrence, in order."""
        at = self.candidates(text)
        seen = text.folded(at, self.length)
        lo, hi = np.searchsorted(self.keys, seen, "left"), np.searchsorted(self.keys, seen, "right")
        for k in np.flatnonzero(hi > lo):
            piece = text.piece(int(at[k]), self.length)
            # equal hashes are nearly always equal words; the bytes decide
            if piece == self.items.piece(int(self.at[lo[k]]), self.length):
                yield int(at[k]), np.unique(self.owner[lo[k] : hi[k]])


class Search:
    """The matchers of some items, one for each pattern length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        bodies = [(text or "").encode() for _, text in items]
        every = Text(np.frombuffer(b"".join(bodies), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in bodies]))).astype(np.int64))
        self.names, self.window = [ident for ident, _ in items], window
        sizes = np.minimum(every.counts, window)
        self.matchers = [WuManber(every, np.flatnonzero(sizes == n), int(n)) for n in np.unique(sizes[sizes > 0])]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, Text]]:
        """The words of a slice, with the number of words before them; those of a long document piece by piece."""
        if len(data) <= 2 * SLICE_BYTES or len(offsets) > 2:
            yield 0, Text(data, offsets)
            return
        done, back = 0, 0  # words before the piece, bytes of the piece before that are read again
        for a, b in windows(data, WORD):
            text = Text(data[a - back : b], np.array([0, b - a + back]))
            yield done, text
            carry = min(self.window - 1, len(text.coded))
            done += len(text.coded) - carry
            back = b - a + back - int(text.starts[-carry]) if carry else 0

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str]]]]:
        """The count of words by document; and by document with occurrences their spans in words and the items' names."""
        counts = np.zeros(len(offsets) - 1, np.int64)
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for done, text in self.texts(data, offsets):
            counts = np.maximum(counts, done + text.counts)
            for matcher in self.matchers:
                for at, owners in matcher.find(text):
                    doc = int(np.searchsorted(text.first, at, "right")) - 1
                    while not text.counts[doc]:
                        doc -= 1
                    spans, names = found.setdefault(doc, ([], set()))
                    begin = done + at - int(text.first[doc])
                    spans.append((begin, begin + matcher.length))
                    names.update(self.names[k] for k in owners.tolist() if self.names[k] is not None)
        return counts, found


def chunks(benchmark: DataFrame, limit: int = CHUNK_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items by chunks of bounded size; only one chunk at a time is on the driver."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limit) if total > limit else 1
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [tuple(r) for r in part.collect()]


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents' rows with n_words long, starts and ends (hit spans in words, ascending, apart), items array<string>."""
    spark = documents.sparkSession
    state = documents.withColumns({"n_words": F.lit(0).cast("long"), "starts": F.array().cast("array<int>"), "ends": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    schema = state.schema
    for nth, chunk in enumerate(chunks(benchmark)):
        state = saved(state) if nth else state

        def run(batch: pa.RecordBatch, sent: Sent = Sent(spark, chunk, lambda items: Search(items, window))) -> Iterator[pa.RecordBatch]:  # noqa: B008
            search = sent.made()
            at = batch.schema.get_field_index
            n_words, starts, ends, items = ([], *(batch.column(at(c)).to_pylist() for c in ("starts", "ends", "items")))
            for lo, _, data, offsets in slices(batch.column(at("text"))):
                counts, found = search.spans(data, offsets)
                n_words += counts.tolist()
                for row, (spans, names) in found.items():
                    spans += zip(starts[lo + row], ends[lo + row])
                    a, b = [], []
                    for start, end in sorted(spans):
                        if b and start <= b[-1]:
                            b[-1] = max(b[-1], end)
                        else:
                            a.append(start)
                            b.append(end)
                    starts[lo + row], ends[lo + row], items[lo + row] = a, b, sorted(names.union(items[lo + row]))
            new = {"n_words": pa.array(n_words, pa.int64()), "starts": pa.array(starts, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(name, batch.column(k)) for k, name in enumerate(batch.schema.names)], names=batch.schema.names)

        state = arrow_map(state, run, schema)
    return state


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(need(documents, "doc_id", "text"), need(benchmark, "item_id", "text"), window).drop("text")
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)
