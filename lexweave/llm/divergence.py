"""Source divergence audit: how far apart the sources of a language are in their words.

1. One pass over the texts counts terms by language and source, each slice combined before it is shuffled.
2. A language keeps the terms of at least `least_docs` of its documents.  A kept term's counts by source are a sparse
   vector; terms with the same vector can't be told apart by any pair of sources, so vectors are deduplicated and
   carry how many terms they stand for.
3. Every pair of sources is evaluated once for each distinct vector, times its multiplicity.  What a pair would have if
   no term occurred in either is known in closed form, so a vector counts only for blocks of sources it occurs in, by
   what it differs from that.  Tasks add up matrices of at most `BLOCK` sources squared.
4. The excess of a source over its language is evaluated once for each distinct vector, too; the original terms are
   joined only to vectors that are among the first of a source, and ranked.

All arithmetic is in whole numbers; past 64 bits it goes on in Python's or in decimals.  A source's vectors and a
language's terms are never in one group: windows cut to the first ranks before they shuffle.  The result itself has a
row for each pair of sources of a language, so sources, not documents, must be few enough for that.

Cases: null text, lang and source count as ''; a language without kept terms has pairs of value 0 and no terms; a
source without terms takes part; repeated rows count each; ties are ranked by the item's UTF-8 bytes; an empty
table gives an empty result; long texts are read in pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import arrow_map, arrow_stream, need, saved
from lexweave.llm.kernels import FOLD, SLICE_BYTES, slices, span_hashes, windows, word_table, words

#: Terms are runs of ASCII letters and of bytes from 0x80; A-Z count as a-z (a fixed value of the contract).
LETTER = word_table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Sources to a block, and rows of (vector, source) that are evaluated at once.
BLOCK, CELLS = 512, 1 << 20
#: Slices of texts whose terms are counted together.
SLICE = 4 * SLICE_BYTES
#: So many groups are broadcast (some 60 bytes each and their names); more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
UNIT, SMOOTH = 1_000_000_000, 5


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings data[start:end]."""
    size = ends - starts
    upto = np.concatenate(([0], np.cumsum(size)))
    body = data[np.repeat(starts - upto[:-1], size) + np.arange(upto[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(upto), pa.py_buffer(np.ascontiguousarray(body))).cast(pa.string())


def tallied(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(group, term, occurrences, documents with it) of some documents; group: by document."""
    known: set[int] = set()
    long = len(group) == 1 and len(data) > 2 * SLICE
    for a, b in windows(data, LETTER) if long else [(0, len(data))]:
        piece = FOLD[data[a:b]]
        starts, ends, counts = words(piece, np.array([0, b - a]) if long else offsets, LETTER)
        if not len(starts):
            continue
        coded = span_hashes(piece, starts, ends)
        doc = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((doc, coded, group[doc]))
        g, w, d = group[doc][order], coded[order], doc[order]
        new = np.append(True, (g[1:] != g[:-1]) | (w[1:] != w[:-1]))
        in_doc = new | np.append(True, d[1:] != d[:-1])
        first = np.flatnonzero(new)
        docs = np.add.reduceat(in_doc, first, dtype=np.int64)
        if long:  # a document counts once, in the first piece that has the term
            fresh = w[first].tolist()
            docs = np.array([x not in known for x in fresh], np.int64)
            known.update(fresh)
        yield g[first], spelled(piece, starts[order[first]], ends[order[first]]), np.diff(np.append(first, len(g))), docs


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences), docs (documents with it)."""
    rows = documents.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = [batch.column(k).dictionary_encode() for k in (0, 1)]
        at = [n.indices.to_numpy() for n in names]
        group = at[0].astype(np.int64) * len(names[1].dictionary) + at[1]
        for lo, hi, data, offsets in slices(batch.column(2), SLICE):
            for g, term, c, docs in tallied(data, offsets, group[lo:hi]):
                lang, source = (n.dictionary.take(pa.array(i)) for n, i in zip(names, np.divmod(g, len(names[1].dictionary))))
                yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(c, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "c", "docs"])

    counted = arrow_map(rows, run, "lang string, source string, term string, c long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> Column:
    """p of a count: 1 and the smoothed share of total (N + 5 V) in billionths."""
    return F.expr(f"CAST(1 + (CAST({UNIT} AS DECIMAL(10, 0)) * (CAST({count} AS DECIMAL(20, 0)) + {SMOOTH})) div CAST({total} AS DECIMAL(20, 0)) AS LONG)")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """share() of a matrix of counts, with a total by column."""
    if counts.size and int(counts.max()) > (1 << 62) // UNIT:
        return (1 + UNIT * (counts.astype(object) + SMOOTH) // totals).astype(np.int64)
    return 1 + UNIT * (counts + SMOOTH) // totals


def excess(at: np.ndarray, source: np.ndarray, count: np.ndarray, times: np.ndarray, left: tuple[int, np.ndarray], right: tuple[int, np.ndarray]) -> np.ndarray:
    """Summed over vectors, for each source of the left and the right block: times * (|p - q| - |p - q without occurrences|).

    at, source, count: the vectors' entries; times: by vector; left and right: a block's first source and its totals.
    """
    out = np.zeros((len(left[1]), len(right[1])), np.int64)
    p, q = (dense(at, source, count, len(times), *side) for side in (left, right))
    for k, (one, none) in enumerate(zip(p.T, shares(np.zeros((1, len(left[1])), np.int64), left[1])[0])):
        idle = np.abs(none - shares(np.zeros((1, len(right[1])), np.int64), right[1]))
        out[k] = times @ (np.abs(one[:, None] - q) - idle)
    return out


def dense(at: np.ndarray, source: np.ndarray, count: np.ndarray, n: int, first: int, totals: np.ndarray) -> np.ndarray:
    """The p of n vectors for each source of a block."""
    inside = (source >= first) & (source < first + len(totals))
    counts = np.zeros((n, len(totals)), np.int64)
    counts[at[inside], source[inside] - first] = count[inside]
    return shares(counts, totals)


@dataclass(frozen=True)
class Audit:
    least_docs: int = 30
    top: int = 50
    block: int = BLOCK

    def pair_sums(self, vectors: DataFrame, blocks: DataFrame) -> DataFrame:
        """lang, a, b (a < b: sources by number), extra: what the vectors(lang, vec, m) add to a pair's value without any.

        blocks: lang, block, totals (N + 5 V of its sources, in order), n_blocks.
        """
        size = self.block
        one, two = blocks.select("lang", F.col("block").alias("x"), F.col("totals").alias("left")), blocks.select("lang", F.col("block").alias("y"), F.col("totals").alias("right"))
        kinds = blocks.select("lang", "n_blocks").distinct()
        own = F.array_distinct(F.transform("vec", lambda e: F.floor(e["i"] / F.lit(size)).cast("int")))
        every = F.sequence(F.lit(0), F.col("n_blocks").cast("int") - 1)
        meet = F.array_distinct(F.flatten(F.transform(own, lambda s: F.transform(every, lambda t: F.struct(F.least(s, t).alias("x"), F.greatest(s, t).alias("y"))))))
        placed = vectors.join(kinds, "lang").select("lang", "vec", "m", F.explode(meet).alias("at")).select("lang", "vec", "m", "at.x", "at.y")
        rows = placed.join(one, ["lang", "x"]).join(two, ["lang", "y"]).select("lang", "x", "y", "m", "left", "right", "vec")

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}

            def told() -> Iterator[pa.RecordBatch]:
                for (lang, x, y), found in sums.items():
                    a, b = np.nonzero(found)
                    keep = (a < b) | (x != y)
                    a, b = a[keep], b[keep]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + x * size, pa.int64()), pa.array(b + y * size, pa.int64()), pa.array(found[a, b])], ["lang", "a", "b", "extra"])
                sums.clear()

            for batch in source:
                if not batch.num_rows:
                    continue
                lang = batch.column(0).dictionary_encode()
                key = np.stack([lang.indices.to_numpy(), *(batch.column(k).to_numpy() for k in (1, 2))])
                keys, first, which = np.unique(key, axis=1, return_index=True, return_inverse=True)
                vec = batch.column(6)
                ends = vec.offsets.to_numpy() - vec.offsets[0].as_py()
                entry_i, entry_c = (vec.flatten().field(k).to_numpy() for k in ("i", "c"))
                times = batch.column(3).to_numpy()
                for k, at in enumerate(first.tolist()):
                    name = (lang.dictionary[int(keys[0, k])].as_py(), int(keys[1, k]), int(keys[2, k]))
                    left, right = (np.array(batch.column(c)[at].as_py(), np.int64) for c in (4, 5))
                    have = sums.setdefault(name, np.zeros((len(left), len(right)), np.int64))
                    rows, step = np.flatnonzero(which.reshape(-1) == k), max(1, CELLS // max(len(left), len(right)))
                    for lo in range(0, len(rows), step):
                        part = rows[lo : lo + step]
                        n = ends[part + 1] - ends[part]
                        entries = np.repeat(ends[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        have += excess(np.repeat(np.arange(len(part)), n), entry_i[entries], entry_c[entries], times[part], (name[1] * size, left), (name[2] * size, right))
                    if len(sums) > 32:
                        yield from told()
            yield from told()

        found = arrow_stream(rows, run, "lang string, a long, b long, extra long")
        return found.groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))

    def audited(self, documents: DataFrame) -> DataFrame:
        """lang, source, part, item, value, rank."""
        documents = need(documents, "text", "lang", "source")
        groups = documents.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        # numbers sources inside a language: as many rows as it has sources, whose pairs are the result
        groups = saved(groups.withColumn("i", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")))
        listed = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
        counts = term_counts(documents).join(listed, ["lang", "source"]).select("lang", "i", "term", "c", "docs")
        terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("i", "c"))).alias("vec"))
        terms = saved(terms.filter(F.col("docs") >= self.least_docs).select("lang", "term", "vec"))
        vectors = saved(terms.groupBy("lang", "vec").agg(F.count("*").alias("m")))
        entries = vectors.select("lang", "vec", "m", F.explode("vec").alias("e")).select("lang", "vec", "m", "e.i", "e.c")
        sizes = entries.groupBy("lang", "i").agg(F.sum(F.col("c") * F.col("m")).alias("n"))
        whole = vectors.groupBy("lang").agg(F.sum("m").alias("v"), F.sum(F.aggregate("vec", F.lit(0).cast("long"), lambda s, e: s + e["c"]) * F.col("m")).alias("all"))
        sides = groups.join(sizes, ["lang", "i"], "left").join(whole, "lang", "left")
        total = F.coalesce("n", F.lit(0)) + SMOOTH * F.coalesce("v", F.lit(0))
        sides = saved(sides.select("lang", "source", "i", F.coalesce("v", F.lit(0)).alias("v"), total.alias("d"), (F.coalesce("all", F.lit(0)) + SMOOTH * F.coalesce("v", F.lit(0))).alias("all_d")))
        return self.pairs(vectors, sides).unionByName(self.terms(terms, entries, sides))

    def pairs(self, vectors: DataFrame, sides: DataFrame) -> DataFrame:
        known = sides.filter("v > 0")
        blocks = known.groupBy("lang", F.floor(F.col("i") / self.block).cast("int").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda e: e["d"]).alias("totals"))
        blocks = blocks.join(blocks.groupBy("lang").agg(F.count("*").alias("n_blocks")), "lang")
        sums = self.pair_sums(vectors, saved(blocks))
        both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "extra"))
        idle = sides.select("lang", F.col("source"), F.col("i").alias("a"), "v", F.when(F.col("v") > 0, share("0", "d")).alias("p"))
        other = idle.select(F.col("lang").alias("l"), F.col("source").alias("item"), F.col("a").alias("b"), F.col("p").alias("q"))
        # each pair of sources of a language is a row of the result
        every = idle.join(other, (F.col("lang") == F.col("l")) & (F.col("a") != F.col("b"))).join(saved(both), ["lang", "a", "b"], "left")
        value = F.coalesce(F.col("v") * F.abs(F.col("p") - F.col("q")), F.lit(0)) + F.coalesce("extra", F.lit(0))
        return self.ranked(every.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")))

    def terms(self, terms: DataFrame, entries: DataFrame, sides: DataFrame) -> DataFrame:
        rows = entries.join(sides, ["lang", "i"])
        sums = F.aggregate("vec", F.lit(0).cast("long"), lambda s, e: s + e["c"])
        over = rows.withColumn("t", sums).select("lang", "source", "vec", (share("c", "d") - share("t", "all_d")).alias("value")).filter("value > 0")
        # every vector stands for a term at least, so no vector past these ranks has a term in the result
        first = over.withColumn("nth", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).filter(F.col("nth") <= self.top).drop("nth")
        named = saved(first).join(terms, ["lang", "vec"])
        return self.ranked(named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"), self.top)

    def ranked(self, rows: DataFrame, top: int | None = None) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        out = rows.withColumn("rank", F.row_number().over(order))
        return out.filter(F.col("rank") <= top) if top else out


def audit_sources(documents: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of documents(text, lang, source)."""
    return Audit().audited(documents)
