"""Page-aware overlapping chunks with exact code-point offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import rules

SENTENCE_END = re.compile(r"[.!?;:]\s")
#: Bytes of text that a task cuts up at once; a longer page is cut on its own.
BLOCK = 1 << 20


def cut_point(text: str, low: int, high: int) -> int:
    """Where to end a chunk between low and high: after the last empty line, line, sentence or space, else at high."""
    for mark in ("\n\n", "\n"):
        at = text.rfind(mark, low, high)
        if at >= 0:
            return at + len(mark)
    last = None
    for last in SENTENCE_END.finditer(text, low, high):
        pass
    if last is not None:
        return last.end()
    at = text.rfind(" ", low, high)
    return at + 1 if at >= 0 else high


def spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Trimmed [start, end) of the chunks of one page."""
    total, at = len(text), 0
    while at < total:
        limit = min(at + size, total)
        end = limit if limit == total else cut_point(text, at + int(size * rules.LEAST_SHARE), limit)
        piece = text[at:end]
        lo = at + len(piece) - len(piece.lstrip())
        hi = at + len(piece.rstrip())
        if hi > lo:
            yield lo, hi
        if limit == total:
            return
        at = max(end - overlap, at + 1)
        at += len(text[at:end]) - len(text[at:end].lstrip()) if at < end else 0


def chunked(pages: DataFrame, size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP) -> DataFrame:
    """document_id, page_number, chunk_index, start_char, end_char, text; pages without text give none.

    The cursor depends on what it has read, so this is an Arrow function of pages: no shuffle, a block of pages at a time.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap in [0, size)")

    rows = pages.select("document_id", "page_number", F.coalesce("text", F.lit("")).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:2])
    return rows.mapInArrow(lambda batches: (cut(part, size, overlap) for batch in batches for part in blocks(batch)), f"{kinds}, chunk_index int, start_char int, end_char int, text string")


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, texts of at most BLOCK bytes at a time or one row: what is held does not go by the rows of a batch."""
    ends = np.append(0, np.cumsum(pc.binary_length(batch.column(2)).to_numpy(), dtype=np.int64))
    begin = 0
    while begin < batch.num_rows:
        end = max(int(np.searchsorted(ends, ends[begin] + BLOCK, "right")) - 1, begin + 1)
        yield batch.slice(begin, end - begin)
        begin = end


def cut(pages: pa.RecordBatch, size: int, overlap: int) -> pa.RecordBatch:
    """The chunks of pages(document_id, page_number, text)."""
    found = [(row, k, a, b, t[a:b]) for row, t in enumerate(pages.column(2).to_pylist()) for k, (a, b) in enumerate(spans(t, size, overlap))]
    row, *columns = zip(*found) if found else ((),) * 5
    ids = pages.take(pa.array(row, pa.int64())).columns[:2]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([*ids, *map(pa.array, columns, kinds)], [*pages.schema.names[:2], "chunk_index", "start_char", "end_char", "text"])


def with_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks with their page's text, joined by document and page."""
    return chunks.join(pages.select("document_id", "page_number", F.col("text").alias("page_text"), "char_count"), ["document_id", "page_number"])


def broken(chunks: DataFrame, pages: DataFrame, size: int) -> DataFrame:
    """Chunks that aren't the text they claim, or too long: there must be none."""
    cut = F.substring(F.col("page_text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    bad = (cut != F.col("text")) | (F.col("end_char") - F.col("start_char") > size) | (F.col("end_char") > F.col("char_count"))
    return with_pages(chunks, pages).filter(bad).select("document_id", "page_number", "chunk_index")
