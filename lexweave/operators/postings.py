"""A stored full-text index: posting lists in blocks, added to by commits, searched by block maxima.

Each commit adds a segment.  A segment cuts its chunks into ranges of some `PER_RANGE` by a hash; a row is the block
of one token in one range: how often it occurs at most in a chunk, and its chunks with the places of the token.  So
no row grows with a token's frequency, and a search needs just the blocks' heads to know what a range can give.

search() answers for all queries at once.  Of a query's ranges the best heads are scores that some chunks have, so the
k-th of them bounds the k-th result from below; ranges whose heads add up to less are not opened.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import rules, text
from lexweave.operators import registry
from lexweave.operators.retrieval import small, top
from lexweave.sources.store import Change, Store, Version, together

PER_RANGE = 256
#: So many tokens are looked for by conditions that reach the scan.
TOKENS = 200


#: Tokens that a task of Python groups at once, but for a longer chunk's.
AT_ONCE = 1 << 19


def grouped(c: Column) -> Column:
    """By row the distinct tokens of an array, each with its places in order."""

    @F.arrow_udf("array<struct<token:string,places:array<int>>>")
    def run(tokens: pa.Array) -> pa.Array:
        n = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        kind = pa.struct([("token", pa.string()), ("places", pa.list_(pa.int32()))])
        ends, parts, lo = np.cumsum(n), [pa.array([], pa.list_(kind))], 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - n[lo] + AT_ONCE, "right")))
            size = n[lo:hi]
            words = tokens.slice(lo, hi - lo).flatten().dictionary_encode()
            row, code = np.repeat(np.arange(len(size)), size), words.indices.to_numpy().astype(np.int64)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            key = row * max(1, len(words.dictionary)) + code
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1) != 0)
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(place[order], pa.int32()))
            of = order[first]
            ones = pa.StructArray.from_arrays([words.dictionary.take(pa.array(code[of])), places], fields=list(kind))
            parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[of], minlength=len(size))))), pa.int32()), ones).cast(pa.list_(kind)))
            lo = hi
        return pa.concat_arrays(parts)

    return run(c)


def blocks(entries: DataFrame, n: int, per_range: int = PER_RANGE) -> DataFrame:
    """token, rng, most, chunks array<struct<chunk_id, document_id, places>> of entries(chunk_id, document_id, token, places); n: about how many chunks they are of.

    One shuffle, with blocks combined before it.  A chunk that comes in several entries of a token is put together in its block.
    """
    rng = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-n // per_range)))).cast("int")
    out = entries.groupBy("token", rng.alias("rng")).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "document_id", "places"))).alias("chunks"))
    same = lambda a, b: a["chunk_id"].eqNullSafe(b["chunk_id"]) & a["document_id"].eqNullSafe(b["document_id"])
    places = lambda c: F.array_sort(F.flatten(F.transform(F.filter("chunks", lambda d: same(c, d)), lambda d: d["places"])))
    merged = F.array_distinct(F.transform("chunks", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["document_id"].alias("document_id"), places(c).alias("places"))))
    out = out.withColumn("chunks", F.when(F.size(F.array_distinct("chunks.chunk_id")) < F.size("chunks"), merged).otherwise(F.col("chunks")))
    most = F.array_max(F.transform("chunks", lambda c: F.size(c["places"])))
    return out.select("token", "rng", most.alias("most"), "chunks").sortWithinPartitions("token", "rng")  # so that scans pass over row groups and pages that have other tokens


def add(store: Store, chunks: DataFrame, writer: str, batch: int, per_range: int = PER_RANGE) -> Version:
    """Adds chunks(chunk_id, document_id, text) as a segment; a batch that was applied before changes nothing."""
    if store.latest().batches.get(writer, -1) >= batch:
        return store.latest()
    entries = chunks.select("chunk_id", "document_id", F.inline(grouped(text.simple_lexemes("text"))))
    staged = together(store.stage("postings", blocks(entries, chunks.count(), per_range)), batches={writer: batch})
    return store.transact(lambda version: None if version.batches.get(writer, -1) >= batch else staged)


def heads(found: DataFrame, queries: DataFrame, k: int, gone: int) -> DataFrame:
    """query_id, segment, rng, bound, opened: what each range can give a query, and whether it has to be opened for the best k.

    gone: how many chunks in the index are deleted; so many of the best heads may be theirs.
    """
    by_range = found.select("token", "segment", "rng", "most").join(small(queries), "token").groupBy("query_id", "segment", "rng").agg(F.sum("most").alias("bound"), F.max("most").alias("best"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best")))
    least = by_range.withColumn("nth", nth).filter(F.col("nth") <= k + gone).filter(F.col("nth") == k + gone).select(F.col("query_id").alias("q"), F.col("best").alias("least"))
    judged = by_range.join(small(least), F.col("query_id").eqNullSafe(F.col("q")), "left")
    return judged.select("query_id", "segment", "rng", "bound", (F.col("bound") >= F.coalesce("least", F.lit(0))).alias("opened"))


def asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(text.lexical_tokens("query")).alias("token"))


def holding(store: Store, version: Version, queries: DataFrame) -> DataFrame:
    """The blocks with a token of asked queries(query_id, token)."""
    found = store.read("postings", version, order="segment")
    names = [r[0] for r in queries.select("token").distinct().limit(TOKENS + 1).collect()]
    if len(names) > TOKENS:
        return found.join(small(queries.select("token").distinct()), "token", "left_semi")
    return found.filter(reduce(or_, [F.col("token") == n for n in names], F.lit(False)))


def deleted(store: Store, version: Version) -> tuple[DataFrame | None, int]:
    """Documents that are deleted but may be in the index, and how many of its chunks are theirs."""
    gone = store.read("removed", version)
    if gone is None:
        return None, 0
    chunks = store.read("chunks", version)
    if chunks is None:
        chunks = store.read("postings", version).select(F.explode("chunks").alias("c")).select("c.chunk_id", "c.document_id").distinct()
    return gone, chunks.join(gone.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi").count()


def search(store: Store, queries: DataFrame, k: int = rules.LEXICAL_K, within: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, lexical_score, lexical_rank of queries(query_id, query): a tenth of the occurrences of its tokens.

    within(query_id, document_id): each query is answered for each of its documents on its own, document_id is in
    the result, and all ranges are opened.  A query without tokens finds nothing.
    """
    version = store.latest()
    tokens = asked(queries)
    found = holding(store, version, tokens)
    gone, n = deleted(store, version)
    rows = found.join(small(tokens), "token")
    if within is None:
        opened = heads(found, tokens, k, n).filter("opened").select(F.col("query_id").alias("q"), F.col("segment").alias("s"), F.col("rng").alias("r"))
        rows = rows.join(opened, (F.col("query_id") == F.col("q")) & (F.col("segment") == F.col("s")) & (F.col("rng") == F.col("r")), "left_semi")
    rows = rows.select("query_id", F.explode("chunks").alias("c")).select("query_id", "c.chunk_id", "c.document_id", F.size("c.places").alias("n"))
    if gone is not None:
        rows = rows.join(gone.select(F.col("doc_id").alias("document_id")), "document_id", "left_anti")
    by = ["query_id"]
    if within is not None:
        rows, by = rows.join(small(within.select("query_id", "document_id").distinct()), ["query_id", "document_id"], "left_semi"), ["document_id", "query_id"]
    scored = rows.groupBy(*by, "chunk_id").agg((F.sum("n") * F.lit(0.1)).alias("lexical_score"))
    return top(scored, by, [F.desc("lexical_score"), F.col("chunk_id")], k, "lexical_rank")


def compact(store: Store, per_range: int = PER_RANGE) -> Version:
    """All segments as one, without deleted documents, in one commit with the other tables (see registry.compact)."""
    seen = store.latest()
    entries = store.read("postings", seen).select("token", F.explode("chunks").alias("c")).select("token", "c.*")
    gone = store.read("removed", seen)
    if gone is not None:
        entries = entries.join(gone.select(F.col("doc_id").alias("document_id")), "document_id", "left_anti")
    n = entries.agg(F.approx_count_distinct("chunk_id")).first()[0]
    return registry.compact(store, more=together(store.stage("postings", blocks(entries, n, per_range)), Change(drop={"postings": seen.folders["postings"]})))
