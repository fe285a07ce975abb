"""Hybrid retrieval: lexical and dense top-k, reciprocal rank fusion, intent reranking.

Lexical and dense searches run for all queries at once; ranks are taken by query after filtering, so the plan
has a partial top-k before each shuffle.  Query tables are checked to be small before they are broadcast.
within names columns of the chunks that bound a search, such as document_id: each query is then answered for each
document on its own (Q6, Q7, F4-F6, T1).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import rules, text

MAX_BROADCAST_QUERIES = 10_000


def small(df: DataFrame, limit: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """df to be broadcast if it has no more rows than limit, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def beside(rows: DataFrame, asked: DataFrame, condition: Column | None = None) -> DataFrame:
    """rows joined with a stated set of queries on any condition (none: all), block by block: no block that is broadcast has many more than MAX_BROADCAST_QUERIES rows."""
    condition = F.lit(True) if condition is None else condition
    n = asked.count()
    if n <= MAX_BROADCAST_QUERIES:
        return rows.join(F.broadcast(asked), condition)
    blocks = 2 * -(-n // MAX_BROADCAST_QUERIES)
    part = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in asked.columns)), F.lit(blocks))
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(asked.filter(part == b)), condition) for b in range(blocks)])


def top(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def lexical(queries: DataFrame, chunks: DataFrame, k: int = rules.LEXICAL_K, within: tuple[str, ...] = ()) -> DataFrame:
    """query_id, chunk_id, lexical_score, lexical_rank: chunks with any of the query's tokens, by a tenth of their occurrences.

    A query without tokens finds nothing (F6); a null text has no tokens (C11).
    """
    asked = small(queries.select("query_id", F.explode(text.lexical_tokens("query")).alias("token")))
    tokens = chunks.select(*within, "chunk_id", F.explode(F.transform(text.words(F.coalesce("text", F.lit(""))), text.casefold)).alias("token"))
    scored = tokens.join(asked, "token").groupBy(*within, "query_id", "chunk_id").agg((F.count("*") * F.lit(0.1)).alias("lexical_score"))
    return top(scored, [*within, "query_id"], [F.desc("lexical_score"), F.col("chunk_id")], k, "lexical_rank")


#: Scores are rounded to so many digits, so that equal vectors tie whatever the order of summation.
SCORE_DIGITS = 12


def dense(queries: DataFrame, vectors: DataFrame, k: int = rules.DENSE_K, within: tuple[str, ...] = ()) -> DataFrame:
    """query_id, chunk_id, semantic_score, dense_rank: cosine similarity of queries(query_id, vector) to vectors(chunk_id, embedding).

    A stated set of queries against all rows: blocks of at most some MAX_BROADCAST_QUERIES go to the tasks as a matrix,
    each a pass over the vectors.  A task multiplies batches of vectors by the block and hands on the best k a query
    of all its batches; within many documents of what it has seen since it last did.  Vectors without a direction (null, zero, of another size than the query's) have no score.
    """
    n = queries.count()
    blocks = 1 if n <= MAX_BROADCAST_QUERIES else 2 * -(-n // MAX_BROADCAST_QUERIES)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema} | {"query_id": queries.schema["query_id"].dataType.simpleString()}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*within, "query_id", "chunk_id")) + ", semantic_score double"
    rows = vectors.filter("embedding is not null").select(*within, "chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    found = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        asked = queries.sparkSession.sparkContext.broadcast(part.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null").toArrow())
        near = rows.mapInArrow(partial(nearest, asked, k, len(within)), schema)
        found = near if found is None else found.unionByName(near)
    return top(found, [*within, "query_id"], [F.desc("semantic_score"), F.col("chunk_id")], k, "dense_rank")


def matrix(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of a column of lists, by size; those with nulls or of no length are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        every = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        norm = np.sqrt((every * every).sum(axis=1))
        with np.errstate(invalid="ignore"):
            good = norm > 0  # not for NaN
        yield at[good], every[good] / norm[good, None]


#: Rows that a task holds before it hands on what the best of them are.
HELD = 500_000


def nearest(asked: Broadcast, k: int, fixed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best k rows a query (and value of the first `fixed` columns) of a task, ties by chunk_id."""
    held: list[pa.RecordBatch] = []
    for part in nearest_by_batch(asked, k, fixed, batches):
        held.append(part)
        if sum(h.num_rows for h in held) > HELD:
            held = [best_rows(held, k, fixed)]
            if held[0].num_rows > HELD // 2:
                yield held.pop()
    if held:
        yield best_rows(held, k, fixed)


def best_rows(parts: list[pa.RecordBatch], k: int, fixed: int) -> pa.RecordBatch:
    """Of rows (fixed columns, query_id, chunk_id, semantic_score) the best k by query and fixed columns."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    keys = [rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in range(fixed + 1)]
    keys = [(key if isinstance(key, pa.DictionaryArray) else key.combine_chunks()).indices.to_numpy() for key in keys]
    place = np.empty(rows.num_rows, np.int64)
    place[pc.sort_indices(rows.column(fixed + 1)).to_numpy()] = np.arange(rows.num_rows)
    order = np.lexsort((place, -rows.column(fixed + 2).to_numpy(), *keys))
    first = np.any([np.diff(key[order], prepend=-1) != 0 for key in keys], axis=0)
    at = np.flatnonzero(first)
    nth = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
    return rows.take(pa.array(order[nth < k])).combine_chunks().to_batches()[0]


def nearest_by_batch(asked: Broadcast, k: int, fixed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """nearest() of each batch alone."""
    table = asked.value.combine_chunks()
    names = table.column("query_id").combine_chunks()
    queries = {m.shape[1]: (at, m) for at, m in matrix(table.column("vector").combine_chunks())} if len(names) else {}
    for batch in batches:
        groups = pa.Table.from_batches([batch.select(list(range(fixed)))]).group_by(batch.schema.names[:fixed]).aggregate([]).num_rows if fixed else 1
        of = np.zeros(batch.num_rows, np.int64)
        if groups > 1:
            keys = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in batch.columns[:fixed]]
            of = np.unique(np.stack(keys), axis=1, return_inverse=True)[1].reshape(-1)
        for at, unit in matrix(batch.column(fixed + 1)):
            if unit.shape[1] not in queries or not len(at):
                continue
            which, other = queries[unit.shape[1]]
            ident = batch.column(fixed).take(pa.array(at))
            place = np.empty(len(at), np.int64)
            place[pc.sort_indices(ident).to_numpy()] = np.arange(len(at))
            for begin in range(0, len(which), 256):
                score = np.round(unit @ other[begin : begin + 256].T, SCORE_DIGITS)
                rows, columns = [], []
                for q in range(score.shape[1]):
                    best = np.arange(len(at))
                    if groups == 1 and len(at) > 4 * k:
                        best = np.flatnonzero(score[:, q] >= np.partition(score[:, q], -k)[-k])
                    order = best[np.lexsort((place[best], -score[best, q], of[at][best]))]
                    group = of[at][order]
                    first = np.flatnonzero(np.diff(group, prepend=-1))
                    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                    rows.append(order[nth < k])
                    columns.append(np.full((nth < k).sum(), q))
                row, column = np.concatenate(rows), np.concatenate(columns)
                out = batch.take(pa.array(at[row]))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns[:fixed], names.take(pa.array(which[begin + column])), out.column(fixed), pa.array(score[row, column])], [*batch.schema.names[:fixed], "query_id", batch.schema.names[fixed], "semantic_score"]
                )


def fused(dense_hits: DataFrame, lexical_hits: DataFrame, rrf_k: int = rules.RRF_K, within: tuple[str, ...] = ()) -> DataFrame:
    """Both lists by chunk, with the sum of 1 / (k + rank)."""
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    return dense_hits.join(lexical_hits, [*within, "query_id", "chunk_id"], "full_outer").withColumn("rrf_score", part("dense_rank") + part("lexical_rank"))


def ranked(hits: DataFrame, limit: int = rules.FINAL_K, intent: Column | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Final order: intent, fused score, then first appearance (dense list, then lexical) (O4); a limit of 0 is the default."""
    order = [F.desc("intent"), F.desc("rrf_score"), F.coalesce("dense_rank", F.lit(1 << 30)), F.col("lexical_rank")]
    return top(hits.withColumn("intent", F.lit(0) if intent is None else intent), [*within, "query_id"], order, limit or rules.FINAL_K, "rank")


def hybrid(queries: DataFrame, chunks: DataFrame, limit: int = rules.FINAL_K, within: tuple[str, ...] = (), words: DataFrame | None = None) -> DataFrame:
    """queries(query_id, query, vector) over chunks(within, chunk_id, text, embedding): mode, rank and scores of the best chunks.

    words: the lexical list, where a stored index has given it (operators.postings.search).  Where no chunk has an embedding the lexical list stands alone (mode lexical).
    """
    near = dense(queries.select("query_id", "vector").filter("vector is not null"), chunks.select(*within, "chunk_id", "embedding"), within=within)
    hits = fused(near, lexical(queries, chunks, within=within) if words is None else words, within=within)
    by = [*within, "query_id"]
    modes = hits.groupBy(*by).agg(F.when(F.bool_or(F.col("dense_rank").isNotNull()), "hybrid").otherwise("lexical").alias("mode"))
    texts = hits.join(chunks.select(*within, "chunk_id", "text"), [*within, "chunk_id"]).join(small(queries.select("query_id", "query")), "query_id")
    best = ranked(texts, limit, text.intent_score("query", "text"), within)
    return best.join(modes, by).select(*by, "mode", "rank", "chunk_id", "rrf_score", "semantic_score", "lexical_score", "intent")


def missing(vectors: DataFrame) -> DataFrame:
    """Chunks that still need an embedding."""
    return vectors.filter("embedding is null")


def work_order(chunks: DataFrame, document_id: int) -> DataFrame:
    """The chunks of one document that still need an embedding, by page and place on it."""
    return missing(chunks.filter(F.col("document_id") == document_id)).orderBy("page_number", "chunk_index", "chunk_id")


def work_orders(chunks: DataFrame) -> DataFrame:
    """document_id, place, chunk_id, page_number, chunk_index: what each document still needs embeddings for, in order."""
    order = Window.partitionBy("document_id").orderBy("page_number", "chunk_index", "chunk_id")
    return missing(chunks).select("document_id", F.row_number().over(order).alias("place"), "chunk_id", "page_number", "chunk_index")


def wrong_dimension(vectors: DataFrame, size: int) -> DataFrame:
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") != size))
