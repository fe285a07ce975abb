"""Language identification by a mixture of languages in each document.

Training counts letter trigrams (hashed to `BUCKETS`) by language, over a bounded, seeded sample of labelled
documents (`sample_docs` different texts a language, whole ones, whichever ids they have; each counts as often as it
occurs).  Prediction runs expectation-maximisation over the words of
a document: a word's likelihood in a language is the product of its trigrams', the mixing proportions are the
document's languages.  Nested language sets are compared by likelihood penalised by half the logarithm of the
word count for each language; the set's largest proportion names the language and is the score.

The model (languages x buckets floats) is what is broadcast: 256 KB a label, 1 MB for four, whatever the documents are;
the same buckets serve any number of labels.  The driver gets the counts by language and bucket.  A long text is read in pieces,
and its words are counted up by their hashes.

Cases: a null text, or one without a letter, is "und" with score 0; without any labelled document every text
is "und"; null labels are never learned; rows with a null id are not held out; repeated rows are judged alike;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import arrow_map, need, saved
from lexweave.llm.kernels import FOLD, SLICE_BYTES, slices, span_hashes, windows, words

BUCKETS = 1 << 16
SAMPLE_DOCS = 2000
#: So many sampled hashes are broadcast; more, of thousands of labels, are joined by a shuffle.
BROADCAST_TEXTS = 500_000
ROUNDS = 12
SMOOTHING = 0.5
UNKNOWN = "und"
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter byte, its word's first place among them, words by document)."""
    starts, ends, counts = words(data, offsets, LETTER)
    coded = np.zeros(len(data) + 2, np.uint32)
    inside = LETTER[data]
    coded[1:-1] = np.where(inside, FOLD[data], 0)
    at = np.flatnonzero(inside)
    before, after = coded[at], coded[at + 2]
    length = ends - starts
    first = np.cumsum(length) - length
    before[first] = 0  # a word begins or ends with its document, too
    if len(length):
        after[first + length - 1] = 0
    value = (before * np.uint32(0x9E3779B1)) ^ (coded[at + 1] * np.uint32(0x85EBCA6B)) ^ (after * np.uint32(0xC2B2AE35))
    value = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (value >> np.uint32(16)).astype(np.int64), first, counts


def fitted(likely: np.ndarray, times: np.ndarray, size: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by expectation-maximisation over words, and the log-likelihood (up to a constant), by document.

    likely: words x languages; times: how often each word counts; size: rows of likely by document; allowed: documents
    x languages, 0 or 1.
    """
    begin = np.cumsum(size) - size
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        part = likely * np.repeat(share, size, axis=0)
        part *= (times / np.maximum(part.sum(axis=1), 1e-30))[:, None]
        share = np.add.reduceat(part, begin, axis=0) * allowed
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
    share = np.where(share.sum(axis=1, keepdims=True) > 0, share, allowed / allowed.sum(axis=1, keepdims=True))
    gain = times * np.log(np.maximum((likely * np.repeat(share, size, axis=0)).sum(axis=1, dtype=np.float64), 1e-30))
    return share, np.add.reduceat(gain, begin)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, log-likelihoods

    def worded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-likelihoods of words by language, how often each counts, rows by document)."""
        if len(data) <= 2 * SLICE_BYTES or len(offsets) > 2:
            bucket, first, counts = trigrams(data, offsets)
            by_word = np.add.reduceat(self.table[bucket], first, axis=0) if len(first) else np.zeros((0, len(self.languages)), np.float32)
            return by_word, np.ones(len(by_word), np.float32), counts
        names, rows, times = np.empty(0, np.uint64), np.zeros((0, len(self.languages)), np.float32), np.zeros(0)
        for a, b in windows(data, LETTER):
            piece, ends = data[a:b], np.array([0, b - a])
            more, _, _ = Model.worded(self, piece, ends) if b - a <= 2 * SLICE_BYTES else (self.stretched(piece), None, None)
            start, stop, _ = words(piece, ends, LETTER)
            names = np.append(names, span_hashes(FOLD[piece], start, stop))
            rows, times = np.concatenate((rows, more)), np.append(times, np.ones(len(more)))
            names, first, which = np.unique(names, return_index=True, return_inverse=True)
            rows, times = rows[first], np.bincount(which, times)
        return rows, times.astype(np.float32), np.array([len(rows)])

    def stretched(self, data: np.ndarray) -> np.ndarray:
        """The log-likelihoods of the words of a piece that ends with a very long one: a word's trigrams are added up in stretches."""
        start, stop, _ = words(data, np.array([0, len(data)]), LETTER)
        out = np.zeros((len(start), len(self.languages)), np.float32)
        for k, (a, b) in enumerate(zip(start.tolist(), stop.tolist())):
            for x in range(a, b, SLICE_BYTES):
                lo, hi = max(a, x - 1), min(b, x + SLICE_BYTES + 1)
                bucket = trigrams(data[lo:hi], np.array([0, hi - lo]))[0][x - lo :][:SLICE_BYTES]
                out[k] += self.table[bucket].sum(axis=0)
        return out

    def mixtures(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents x languages: the proportions within the chosen language set; all 0 without letters."""
        by_word, times, counts = self.worded(data, offsets)
        n, k = len(counts), len(self.languages)
        out = np.zeros((n, k))
        has = np.flatnonzero(counts)
        if not len(has) or not k:
            return out
        likely = np.exp(by_word - by_word.max(axis=1, keepdims=True))
        size = counts[has]
        total = np.add.reduceat(times, np.cumsum(size) - size, dtype=np.float64)
        penalty = 0.5 * np.log(total + 1.0)
        every = np.ones((len(has), k), np.float32)
        full, gain = fitted(likely, times, size, every)
        order = np.argsort(-full, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(k)[None, :].repeat(len(has), 0), axis=1)
        chosen = (rank < 1).astype(np.float64)
        best = fitted(likely, times, size, chosen.astype(np.float32), 1)[1]
        # log-likelihood is concave in the proportions, so no set can lie above this, converged or not
        mixed = (likely * np.repeat(full, size, axis=0)).sum(axis=1, dtype=np.float64)
        slope = np.add.reduceat(likely * (times / np.maximum(mixed, 1e-30))[:, None], np.cumsum(size) - size, axis=0).max(axis=1) - total
        bound = gain + np.maximum(slope, 0) + 0.01  # and what rounding may hide
        left = np.arange(len(has))
        for m in range(2, k + 1):
            left = left[bound[left] - (m - 1) * penalty[left] > best[left]]  # for the others no set of m or more can win
            if not len(left):
                break
            rows = np.repeat(np.isin(np.arange(len(has)), left), size)
            share, gain = fitted(likely[rows], times[rows], size[left], (rank[left] < m).astype(np.float32))
            value = gain - (m - 1) * penalty[left]
            better = value > best[left]
            chosen[left[better]] = share[better]
            best[left] = np.maximum(best[left], value)
        out[has] = chosen
        return out


def train(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """From documents(doc_id, text, lang), those that are held out left aside."""
    labelled = need(documents, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    place = F.col("__t").bitwiseAND(F.lit((1 << 52) - 1))
    by_text = saved(labelled.groupBy("lang", F.xxhash64(F.lit(9), "text").alias("__t")).agg(F.count("*").alias("__n")).withColumn("__p", place))
    # the first by hash: a cut at twice as many as are expected leaves few to rank, whatever the language has
    sizes = by_text.groupBy(F.col("lang").alias("__l")).agg(F.count("*").alias("__all"))
    few = by_text.join(F.broadcast(sizes), F.col("lang") == F.col("__l")).filter(F.col("__p") * F.col("__all").cast("double") < float(1 << 52) * (2 * sample_docs + 100))
    drawn = few.withColumn("__nth", F.row_number().over(Window.partitionBy("lang").orderBy("__p", "__t"))).filter(F.col("__nth") <= sample_docs)
    # a table, as its rows are counted before they are broadcast: 16 bytes and a label for each of at most sample_docs a language
    drawn = saved(drawn.select("__l", F.col("__t").alias("__d"), "__n"))
    languages = sorted(r[0] for r in drawn.select("__l").distinct().collect())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    hashed = labelled.withColumn("__t", F.xxhash64(F.lit(9), "text"))
    few = drawn.count() <= BROADCAST_TEXTS
    sample = hashed.join(F.broadcast(drawn) if few else drawn, (F.col("lang") == F.col("__l")) & (F.col("__t") == F.col("__d"))).dropDuplicates(["lang", "__t"]).select("lang", "text", "__n")

    def told(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, have in sums.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(have[at], pa.int64())], ["lang", "bucket", "n"])
        sums.clear()

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        names, copies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for lo, hi, data, offsets in slices(batch.column(1)):
            for row in range(lo, hi):
                body = data[offsets[row - lo] : offsets[row - lo + 1]]
                for a, b in windows(body, LETTER):
                    have = sums.setdefault(names[row], np.zeros(BUCKETS, np.int64))
                    have += copies[row] * np.bincount(trigrams(body[a:b], np.array([0, b - a]))[0], minlength=BUCKETS)
                if len(sums) > 64:
                    yield from told(sums)
        yield from told(sums)

    counted = arrow_map(sample, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    place = {x: k for k, x in enumerate(languages)}
    counts[counted["bucket"].to_numpy(), [place[x] for x in counted["lang"].to_pylist()]] = counted["n"].to_numpy()
    shared = counts.sum(axis=1, keepdims=True)
    prior = (shared + 0.1) / (shared + 0.1).sum()
    counts += SMOOTHING * BUCKETS * prior / 64
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """The documents' rows with lang_pred, score and languages (the chosen set, largest share first)."""
    names = np.array([*model.languages, UNKNOWN], object)
    at = documents.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        labels, scores, sets = [], [], []
        for lo, hi, data, offsets in slices(batch.column(at)):
            share = model.mixtures(data, offsets)
            for row in np.flatnonzero(share.sum(axis=1) > 0):  # bytes beyond ASCII may be no letters
                body = data[offsets[row] : offsets[row + 1]]
                if not (LETTER[body] & (body < 128)).any() and not any(c.isalpha() for c in body.tobytes().decode("utf-8", "replace")):
                    share[row] = 0
            best = share.argmax(axis=1) if len(model.languages) else np.zeros(hi - lo, int)
            score = share.max(axis=1) if len(model.languages) else np.zeros(hi - lo)
            labels += names[np.where(score > 0, best, len(names) - 1)].tolist()
            scores += np.clip(score, 0, 1).tolist()
            sets += [[model.languages[k] for k in np.argsort(-s, kind="stable") if s[k] > 0.001] for s in share]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))], [*batch.schema.names, "lang_pred", "score", "languages"])

    schema = documents.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.array(F.lit("")).alias("languages")).schema
    return arrow_map(documents, run, schema)


def identify_documents(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages; learned and predicted on the same table, held-out rows not learned."""
    model = train(documents)
    found = identify(need(documents, "doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
