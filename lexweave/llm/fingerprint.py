"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph (line with a byte other than white space) is hashed to a wide vector; a document's fingerprint
is the sum of its paragraphs' vectors, lane by lane modulo a power of two.  Order plays no part, equal
multisets have equal sums, and a paragraph is inserted or deleted by adding or subtracting its vector.

The vector has two parts.  8 lanes modulo 2**64 are the 512 bits of the paragraph's BLAKE2b: they carry equality.
256 lanes modulo 2**32 are the paragraph's word 3-grams, each counted with a random sign in a random lane
(a paragraph of fewer words is one unit): the difference of two sums estimates how much two documents
differ, for likeness = 1 - |a - b|^2 / (|a|^2 + |b|^2), clipped to 0..1, and 1 for equal fingerprints.

Cases: null texts are empty; an empty text has the zero vector; equal texts have equal fingerprints; a
lane holds up to 2**31 - 1 like units, more than the words of any text that Arrow's strings hold.  The rows of one
id, null for one, are ordered by their texts' hashes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import arrow_map, arrow_stream, need, place_among, saved
from lexweave.llm.kernels import SLICE_BYTES, hashed_words, joined, span_hashes, windows, word_table, words

WIDE, SKETCH, GRAM = 8, 256, 3
PART_BYTES = 4_000_000
#: Past this many, ranges grow; a task streams its ranges, whatever their size.
MOST_PARTS = 200_000
DRAWS = 16
LINE = word_table(b"\n\r")
SPACES = word_table(b"\x20\x09\x0a\x0b\x0c\x0d")


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row of WIDE independent lanes for each paragraph: 512 bits of a real hash."""
    body = memoryview(data)
    found = b"".join(hashlib.blake2b(body[a:b], digest_size=8 * WIDE).digest() for a, b in zip(start.tolist(), end.tolist()))
    return np.frombuffer(found, "<u8").reshape(-1, WIDE)


def sketched(coded: np.ndarray, first: np.ndarray, count: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n x SKETCH) uint32: the signed counts of the word 3-grams of paragraphs, each of count words from first on, in document doc."""
    taken = np.maximum(count - GRAM + 1, 1)
    owner = np.repeat(np.arange(len(doc)), taken)
    at = np.arange(taken.sum()) - (np.cumsum(taken) - taken)[owner] + first[owner]
    last = (first + count)[owner]
    unit = np.full(len(at), GRAM, np.uint64)
    for k in range(GRAM):
        unit = joined(unit, np.where(at + k < last, coded[np.minimum(at + k, len(coded) - 1)], np.uint64(0)))
    lane = doc[owner] * SKETCH + (unit & np.uint64(SKETCH - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((unit >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    return (np.bincount(lane, sign, n * SKETCH).astype(np.int64) & 0xFFFFFFFF).astype(np.uint32).reshape(n, SKETCH)


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the paragraphs' vectors of each document: (n x WIDE) uint64 and (n x SKETCH) uint32."""
    n = len(offsets) - 1
    if n == 1 and len(data) > 2 * SLICE_BYTES:
        return long_vectors(data)
    wide, sketch = np.zeros((n, WIDE), np.uint64), np.zeros((n, SKETCH), np.uint32)
    word_start, word_end, _ = words(data, offsets, SPACES)
    if not len(word_start):
        return wide, sketch
    start, end, lines = words(data, offsets, LINE)
    doc = np.repeat(np.arange(n), lines)
    first = np.searchsorted(word_start, start)
    count = np.searchsorted(word_start, end) - first
    start, end, doc, first, count = (x[count > 0] for x in (start, end, doc, first, count))
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    wide[doc[begin]] = np.add.reduceat(digests(data, start, end), begin, axis=0)
    return wide, sketched(span_hashes(data, word_start, word_end), first, count, doc, n)


def long_vectors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """vectors() of one long document: those of its pieces, added up; a paragraph longer than a piece goes by stretches of its words."""
    total = np.zeros((1, WIDE), np.uint64), np.zeros((1, SKETCH), np.uint32)
    for a, b in windows(data, LINE):
        if b - a > 2 * SLICE_BYTES:
            breaks = np.flatnonzero(~LINE[data[a : a + SLICE_BYTES]])
            cut = a + int(breaks[-1]) + 1 if len(breaks) else a
            total = combine(total, vectors(data[a:cut], np.array([0, cut - a])))
            line = data[cut:b]
            coded, _ = hashed_words(line, np.array([0, len(line)]), SPACES)
            if len(coded):
                total = combine(total, (digests(line, np.array([0]), np.array([len(line)])), np.zeros((1, SKETCH), np.uint32)))
            for k in range(0, max(len(coded) - GRAM + 1, min(len(coded), 1)), SLICE_BYTES):
                part = coded[k : k + SLICE_BYTES + GRAM - 1]
                total = combine(total, (np.zeros((1, WIDE), np.uint64), sketched(part, np.array([0]), np.array([len(part)]), np.array([0]), 1)))
        else:
            total = combine(total, vectors(data[a:b], np.array([0, b - a])))
    return total


def combine(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], delete: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint vectors of a with the paragraphs of b inserted or deleted."""
    return (a[0] - b[0], a[1] - b[1]) if delete else (a[0] + b[0], a[1] + b[1])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    square = lambda x: (x.astype(np.int32).astype(np.float64) ** 2).sum(axis=1)
    apart, size = square(a[1] - b[1]), square(a[1]) + square(b[1])
    out = np.clip(1.0 - apart / np.maximum(size, 1.0), 0.0, 1.0)
    out[size == 0] = 0.0
    out[(a[0] == b[0]).all(axis=1)] = 1.0
    return out


def encoded(v: tuple[np.ndarray, np.ndarray]) -> list[str]:
    joined = np.concatenate([v[0].astype("<u8").view(np.uint8), v[1].astype("<u4").view(np.uint8)], axis=1)
    return [base64.b64encode(row).decode() for row in joined]


def edited(text: str, after: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    bodies = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in bodies]))).astype(np.int64)
    return vectors(np.frombuffer(b"".join(bodies), np.uint8), offsets)


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def collapsed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (k, h, doc_id, text) with n: one for the batch's rows of one id and text."""
    keys = np.rec.fromarrays([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
    _, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    if not pc.all(pc.equal(batch.column(3), batch.column(3).take(pa.array(first[inverse])))).as_py():  # hashes collide
        first, count = np.arange(batch.num_rows), np.ones(batch.num_rows, np.int64)
    return pa.RecordBatch.from_arrays([*(c.take(pa.array(first)) for c in batch.columns), pa.array(count, pa.int64())], ["k", "h", "doc_id", "text", "n"])


def fingerprint_documents(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id and COLUMNS for documents(doc_id, text), each with the next by (doc_id, hash of the text); after the last comes the first.

    Documents are cut into ranges of (id, hash) by size-weighted sampled splitters (null ids first); each range also
    gets a copy of the first document of the following one.  So texts are shuffled once, no task orders the whole
    table, and an id of many texts, null for one, is cut like any others; rows of one id and text are counted up
    before the shuffle.  The driver gets some DRAWS keys a range.
    """
    spark = documents.sparkSession
    docs = need(documents, "doc_id", "text").select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("k"))
    docs = docs.withColumn("h", F.xxhash64("text")).select("k", "h", "doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {COLUMNS}"
    light = saved(docs.select("k", "h", (F.octet_length("text") + 64).cast("long").alias("w")))
    n, total = light.agg(F.count("*"), F.sum("w")).first()
    if not n:
        return spark.createDataFrame([], schema)
    parts = parts or max(1, min(-(-total // PART_BYTES), MOST_PARTS, n // 100))
    chance = F.xxhash64(F.lit(5), "k", "h").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    drawn = light.withColumn("w", F.col("w") * F.lit(parts * DRAWS / total)).filter(chance < F.col("w")).distinct().orderBy("k", "h").toPandas()
    upto = np.cumsum(np.maximum(drawn["w"].to_numpy(), 1.0))
    cuts = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)) if len(upto) else np.empty(0, np.int64)
    first, second = drawn["k"].to_numpy(np.int64)[cuts], drawn["h"].to_numpy(np.int64)[cuts]

    def least(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        part = place_among(first, second, k, h)
        order = np.lexsort((h, k))
        _, at = np.unique(part[order], return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(x[order][at]) for x in (part, k, h)], ["part", "k", "h"])

    starts = arrow_map(light.select("k", "h"), least, "part int, k long, h long").groupBy("part").agg(F.min(F.struct("k", "h")).alias("m")).orderBy("part").select("part", "m.k", "m.h").toPandas()
    before = {(k, h): part for k, h, part in zip(starts["k"], starts["h"], np.roll(starts["part"].to_numpy(), 1).tolist())}
    lead = np.sort(starts["k"].to_numpy(np.int64))

    def dealt(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = collapsed(batch)
        k, h = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        part = place_among(first, second, k, h)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(k), bool)), *rows.columns], ["part", "copy", *rows.schema.names])
        maybe = np.flatnonzero(lead[np.minimum(np.searchsorted(lead, k), len(lead) - 1)] == k)
        at = [(x, before[key]) for x in maybe.tolist() if (key := (int(k[x]), int(h[x]))) in before]
        if at:
            copies = rows.take(pa.array([x for x, _ in at]))
            yield pa.RecordBatch.from_arrays([pa.array([p for _, p in at], pa.int32()), pa.array([True] * len(at)), *copies.columns], ["part", "copy", *rows.schema.names])

    rows = arrow_map(docs, dealt, f"part int, copy boolean, k long, h long, doc_id {kind}, text string, n long")
    rows = rows.repartition(-(-len(starts) // 4), "part").sortWithinPartitions("part", "copy", "k", "h", "text").select("part", "copy", "doc_id", "text", "n")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: list[tuple] = []
        held, size, source_type = None, 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            texts, nexts = [u[1] for u in units], [u[2] for u in units]
            changed = [edited(t, x) for t, x in zip(texts, nexts)]
            own = of_texts(texts)
            after = of_texts(nexts)
            near_next = likeness(own, after)
            new = of_texts(changed)
            columns = [
                pa.array([u[0] for u in units], source_type),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array(encoded(own), pa.string()),
                pa.array(encoded(new), pa.string()),
                pa.array(likeness(own, new), pa.float64()),
                pa.array(near_next, pa.float64()),
            ]
            found = pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            times = np.array([u[3] for u in units])
            if (times == 1).all():
                yield found
                return
            upto = np.cumsum(times)
            for at in range(0, int(upto[-1]), 2000):
                yield found.take(pa.array(np.searchsorted(upto, np.arange(at, min(at + 2000, int(upto[-1]))), "right")))

        for batch in source:
            source_type = batch.schema.field("doc_id").type
            for part, copy, ident, text, n in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and held[0] == part:
                    units.append((held[1], held[2], text, 1))
                    size += len(held[2])
                if not copy and n > 1:  # all but the last of equal rows are followed by one like them
                    units.append((ident, text, text, n - 1))
                    size += len(text)
                held = None if copy else (part, ident, text)
                if size > SLICE_BYTES // 2:
                    yield from flush()
                    units, size = [], 0
        if units:
            yield from flush()

    return arrow_stream(rows, run, schema)
