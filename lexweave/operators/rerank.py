"""Reranker data and ranking metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import rules, text
from lexweave.operators.retrieval import small

MASK_BITS = 62
#: More than the facts of a document.
PLACES = 1 << 12
SPLITS = ("train", "validation", "test")
#: Scorers by name: of (query, passage) columns; a pandas UDF fits, too.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {"overlap": lambda q, p: text.ochiai(text.rerank_tokens(q), text.rerank_tokens(p))}


def by_language(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """language and a map from category to an array of the columns, for a small table of templates or questions."""
    packed = rows.groupBy("language", "category").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("one"))
    return small(packed.groupBy("language").agg(F.map_from_entries(F.collect_list(F.struct("category", "one"))).alias(name)))


def fact_arrays(scenarios: DataFrame, categories: list[str], templates: DataFrame) -> DataFrame:
    """document_id, split, language and facts: an array with, for each category, the passage of the scenario's variant of the template.

    scenarios: document_id, split, language and a column for each category; templates: language, category, variant
    (from 0), passage, heading, page_number.  A category without a value, or without a template in the language, gives
    no fact; facts are in order of category.  A document's facts stay in one row, so whatever compares them needs no join and no shuffle.
    """
    # the sum over a text's code points is that of its parts: the id's is taken once, not for each use of each category
    summed = scenarios.withColumn("__sum", text.code_point_sum(F.col("document_id").cast("string")))
    rows = summed.join(by_language(templates, "templates", "variant", "heading", "page_number", "passage"), "language")

    def pick(category: str) -> Column:
        ones = F.try_element_at("templates", F.lit(category))
        variant = ((F.col("__sum") + sum(map(ord, f":{category}"))) % F.size(ones)).cast("int")
        there = F.col(category).isNotNull() & ones.isNotNull()
        return F.struct(F.lit(category).alias("category"), F.col(category).cast("string").alias("value"), there.alias("there"), F.get(ones, variant).alias("one"))

    def made(p: Column) -> Column:
        passage = F.replace(p["one"]["passage"], F.lit("{value}"), p["value"])
        return F.struct(p["category"].alias("category"), *(p["one"][c].alias(c) for c in ("variant", "heading", "page_number")), passage.alias("passage"))

    picked = F.filter(F.array(*map(pick, sorted(categories))), lambda p: p["there"])
    return rows.select("document_id", "split", "language", F.transform(picked, made).alias("facts"))


def facts(scenarios: DataFrame, categories: list[str], templates: DataFrame) -> DataFrame:
    """fact_arrays() with a row for each fact."""
    return fact_arrays(scenarios, categories, templates).select("document_id", "split", "language", F.explode("facts").alias("f")).select("document_id", "split", "language", "f.*")


def token_mask(tokens: Column, vocabulary: Column) -> Column:
    """A bit for each word of the vocabulary that is among the distinct tokens, in longs of MASK_BITS."""
    places = F.transform(F.array_intersect(tokens, vocabulary), lambda t: F.array_position(vocabulary, t).cast("int") - 1)

    def part(places: Column, w: Column) -> Column:
        def bit(place: Column) -> Column:
            at = place - w * MASK_BITS
            return F.when(at.between(0, MASK_BITS - 1), F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(places, F.lit(0).cast("long"), lambda sum_, place: sum_ + bit(place))

    longs = F.sequence(F.lit(0), F.greatest(F.floor((F.size(vocabulary) - 1) / MASK_BITS).cast("int"), F.lit(0)))
    # in an array of one, so that the places are found once and not for each long
    return F.get(F.transform(F.array(places), lambda found: F.transform(longs, lambda w: part(found, w))), F.lit(0))


def mask_overlap(a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """text.ochiai() of two token sets, one of them a part of the vocabulary of both masks."""
    zero = F.lit(0)
    every = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), zero, lambda n, x: n + x)
    shared = F.when(F.size(a) == 1, F.bit_count(F.get(a, zero).bitwiseAND(F.get(b, zero)))).otherwise(every)
    return F.when(size_a * size_b > 0, shared / F.sqrt((size_a * size_b).cast("double"))).otherwise(F.lit(0.0))


def asked(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """document_id, split, language, facts, tokens, vocabulary and asked: fact_arrays() with each question of each fact's category and language.

    questions: language, category, nth (from 1), question.  A question has in `of` the place of its fact, and in `mask`
    its words as bits of the vocabulary of its language, cut once a language; tokens are the words of each fact's passage.
    """
    cut = questions.withColumn("tokens", text.rerank_tokens("question"))
    words = cut.groupBy("language").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("vocabulary"))
    cut = cut.join(words, "language").select("language", "category", "nth", "question", F.size("tokens").alias("size"), token_mask(F.col("tokens"), F.col("vocabulary")).alias("mask"))
    both = rows.join(by_language(cut, "questions", "nth", "question", "size", "mask"), "language").join(small(words), "language")
    tokens = F.transform("facts", lambda f: text.rerank_tokens(f["passage"]))
    put = F.transform("facts", lambda f, at: F.transform(F.try_element_at("questions", f["category"]), lambda q: F.struct(at.alias("of"), q["nth"], q["question"], q["size"], q["mask"])))
    put = F.flatten(F.filter(put, lambda ones: ones.isNotNull()))
    return both.select("document_id", "split", "language", "facts", tokens.alias("tokens"), "vocabulary", put.alias("asked"))


#: Questions times facts that are compared at once.
COMPARED = 1 << 18


def ranked_facts(limit: int, confusions: dict[str, tuple[str, ...]]) -> Callable[..., Column]:
    """Of each question of a document its own fact and then the others, the first `limit` of them: array<array<struct<at, preferred, score>>>.

    One sort key is made of whether a category is preferred, the score in millionths, and the place (facts are in order
    of category); the key of an own category is none.  Scores are those of mask_overlap(); a batch's words are looked
    up in the vocabularies once each, however many passages they are in.
    """

    @F.arrow_udf("array<array<struct<at:int,preferred:boolean,score:double>>>")
    def run(language: pa.Array, category: pa.Array, tokens: pa.Array, vocabulary: pa.Array, of: pa.Array, asked_size: pa.Array, asked_mask: pa.Array) -> pa.Array:
        n_facts, n_asked = counts(category), counts(of)
        names = category.flatten().dictionary_encode()
        kind, names = names.indices.to_numpy(), names.dictionary.to_pylist()
        near = np.array([d in confusions.get(c, ()) for c in names for d in names], bool).reshape(len(names), len(names))
        of, asked_size = (c.flatten().to_numpy().astype(np.int64) for c in (of, asked_size))
        asked_bits, tokens = padded(asked_mask.flatten()), tokens.flatten()
        size, bits = counts(tokens), masks(language, vocabulary, n_facts, tokens, asked_bits.shape[1])
        first, doc = np.cumsum(n_facts) - n_facts, np.repeat(np.arange(len(n_asked)), n_asked)
        out, lo = [], 0
        while lo < len(doc):
            wide = max(1, int(n_facts[doc[lo : lo + COMPARED]].max()))
            hi = lo + max(1, COMPARED // wide)
            d, own, place = doc[lo:hi, None], of[lo:hi, None], np.arange(wide)[None]
            real = place < n_facts[d]
            fact, mine = np.where(real, first[d] + place, 0), kind[first[d] + own]
            shared = sum(np.bitwise_count(bits[fact, k] & asked_bits[lo:hi, k, None]).astype(np.int64) for k in range(bits.shape[1]))
            both = size[fact] * asked_size[lo:hi, None]
            score = np.where(both > 0, shared / np.sqrt(np.maximum(both, 1).astype(np.float64)), 0.0)
            preferred = near[mine, kind[fact]]
            key = np.rint(score * 1e6).astype(np.int64) * PLACES + place + np.where(preferred, PLACES << 30, 0)
            key[~real | (kind[fact] == mine)] = -1
            order = np.argsort(-key, axis=1, kind="stable")[:, :limit]
            keep = np.concatenate((np.ones_like(own, bool), np.take_along_axis(key, order, 1) >= 0), axis=1)
            order = np.concatenate((own, order), axis=1)
            out.append((keep.sum(axis=1), order[keep].astype(np.int32), np.take_along_axis(preferred, order, 1)[keep], np.take_along_axis(score, order, 1)[keep]))
            lo = hi
        n, *columns = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, t) for t in (np.int64, np.int32, bool, float))
        ones = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["at", "preferred", "score"])
        return pa.ListArray.from_arrays(offsets(n_asked), pa.ListArray.from_arrays(offsets(n), ones))

    return run


def counts(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def offsets(n: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())


def padded(masks: pa.ListArray) -> np.ndarray:
    """A row of unsigned longs for each mask; those of languages with fewer words end in zeros."""
    n = counts(masks)
    out = np.zeros((len(n), int(n.max(initial=1))), np.uint64)
    out[np.arange(out.shape[1])[None] < n[:, None]] = masks.flatten().to_numpy().view(np.uint64)
    return out


def masks(language: pa.Array, vocabulary: pa.ListArray, n_facts: np.ndarray, tokens: pa.ListArray, width: int) -> np.ndarray:
    """token_mask() of each fact's tokens, `width` unsigned longs wide; the vocabulary of a document is that of its language."""
    words, of_document = tokens.flatten().dictionary_encode(), language.dictionary_encode(null_encoding="encode").indices.to_numpy()
    _, first = np.unique(of_document, return_index=True)
    places = [pc.fill_null(pc.index_in(words.dictionary, value_set=vocabulary[k].values), -1).to_numpy() for k in first.tolist()]
    of_fact = np.repeat(of_document, n_facts)
    fact = np.repeat(np.arange(len(tokens)), counts(tokens))
    out = np.zeros((len(tokens), width), np.uint64)
    if len(fact):
        place = np.stack(places)[of_fact[fact], words.indices.to_numpy()]
        fact, place = fact[place >= 0], place[place >= 0]
    if len(fact):
        start = np.flatnonzero(np.append(True, fact[1:] != fact[:-1]))
        bit = np.uint64(1) << (place % MASK_BITS).astype(np.uint64)
        for k in range(width):
            out[fact[start], k] = np.bitwise_or.reduceat(np.where(place // MASK_BITS == k, bit, np.uint64(0)), start)
    return out


def each_asked(limit: int, *columns: str) -> Column:
    """A row for each question that has negatives, that is, whose document has facts of several categories.

    Not a filter, which would be evaluated below the facts, with the facts once more.
    """
    several = (F.size(F.array_distinct("facts.category")) > 1) & F.lit(limit > 0)
    return F.inline(F.when(several, F.arrays_zip("asked.of", "asked.nth", "asked.question", *columns)))


def negatives_of(rows: DataFrame, limit: int = 3, confusions: dict[str, tuple[str, ...]] = rules.CONFUSIONS, *also: str) -> DataFrame:
    """asked() with a row for each question: its fact, and `found`, the places and scores of that and of the document's other facts, easily confused categories first, then by overlap.

    All questions of a document are ranked together, a batch of documents at a time, before they become rows; each row
    takes just its own ranking with it, and the columns in also.
    """
    every = ranked_facts(limit, confusions)("language", "facts.category", "tokens", "vocabulary", "asked.of", "asked.size", "asked.mask")
    each = rows.select("document_id", "split", "language", "facts", *also, "asked", every.alias("found"))
    each = each.select("document_id", "split", "language", "facts", *also, each_asked(limit, "found"))
    return each.select("document_id", "split", "language", "facts", *also, F.get("facts", F.col("of")).alias("f"), "nth", "question", "found").select("document_id", "split", "language", "facts", *also, "f.*", "nth", "question", "found")


def hard_negatives(rows: DataFrame, limit: int = 3, confusions: dict[str, tuple[str, ...]] = rules.CONFUSIONS) -> DataFrame:
    """negatives_of() with a row for each, and its place."""
    each = negatives_of(rows, limit, confusions).select("document_id", "category", "nth", "facts", F.posexplode("found").alias("place", "n")).filter("place > 0")
    other = F.get("facts", F.col("n.at"))
    return each.select("document_id", "category", "nth", other["category"].alias("negative_category"), other["passage"].alias("negative"), "n.preferred", F.round("n.score", 6).alias("score"), "place")


def example_id() -> Column:
    return F.concat(F.col("document_id").cast("string"), F.lit("-"), "category", F.lit("-q"), F.col("nth").cast("string"))


def examples(rows: DataFrame, limit: int = 3, words: bool = False) -> DataFrame:
    """id, document_id, split, language, query, positive, negatives, category, source_page, negative_categories, overlaps, for asked(); negatives in order.

    overlaps are the scores by shared tokens of the positive and then the negatives, as finding these has given them;
    words, if wanted, their hashed tokens, cut once a document and not for each example that a passage is in.
    """
    others = F.slice("found.at", 2, limit)
    also = []
    if words:
        rows = rows.withColumn("__hashed", F.transform("tokens", lambda ts: F.transform(ts, lambda t: F.xxhash64(t))))
        also = [F.transform("found.at", lambda at: F.get("__hashed", at)).alias("words")]
    return negatives_of(rows, limit, rules.CONFUSIONS, *(["__hashed"] if words else [])).select(
        example_id().alias("id"),
        "document_id",
        "split",
        "language",
        F.col("question").alias("query"),
        F.col("passage").alias("positive"),
        F.transform(others, lambda at: F.get("facts", at)["passage"]).alias("negatives"),
        "category",
        F.col("page_number").alias("source_page"),
        F.transform(others, lambda at: F.get("facts", at)["category"]).alias("negative_categories"),
        F.col("found.score").alias("overlaps"),
        *also,
    )


def unranked(rows: DataFrame, limit: int = 3) -> DataFrame:
    """examples() without negatives, their categories and overlaps: the same rows, but no passage is cut into words and no question is ranked."""
    each = rows.select("document_id", "split", "language", "facts", each_asked(limit))
    each = each.select("document_id", "split", "language", F.get("facts", F.col("of")).alias("f"), "nth", "question").select("document_id", "split", "language", "f.*", "nth", "question")
    return each.select(example_id().alias("id"), "document_id", "split", "language", F.col("question").alias("query"), F.col("passage").alias("positive"), "category", F.col("page_number").alias("source_page"))


def pairs(rows: DataFrame, scores: str | None = None) -> DataFrame:
    """The positive (label 1) and then the negatives (0) of each example, with the scores that are known of them, in the order of an array (P5)."""
    known = [] if scores is None else [F.get(scores, F.col("position")).alias("score")]
    each = rows.select("id", "split", "query", *([scores] if known else []), F.posexplode(F.concat(F.array("positive"), "negatives")).alias("position", "passage"))
    return each.select("id", "split", "query", "position", "passage", F.when(F.col("position") == 0, 1.0).otherwise(0.0).alias("label"), *known)


def invalid(rows: DataFrame) -> DataFrame:
    """Examples that break a rule: under two negatives, equal ones, the positive among them, categories that don't fit them."""
    norm = F.transform("negatives", text.collapsed)
    bad = (F.size("negatives") < 2) | (F.size(F.array_distinct(norm)) < F.size(norm)) | F.array_contains(norm, text.collapsed("positive"))
    if "negative_categories" in rows.columns:
        n = F.coalesce(F.size("negative_categories"), F.lit(0))
        bad = bad | ((n > 0) & (n != F.size("negatives")))
    return rows.filter(bad).select("id")


def selected(rows: DataFrame, split: str) -> DataFrame:
    """The examples of a split."""
    return rows.filter(F.col("split") == split)


def sampled(rows: DataFrame) -> DataFrame:
    """The scenarios that documents are made of."""
    return rows.filter(F.coalesce("pdf_sample", F.lit(False)))


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """Ids of several examples (A4)."""
    return rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def missing_splits(rows: DataFrame) -> DataFrame:
    """Splits without an example."""
    every = rows.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return every.join(rows.select("split"), "split", "left_anti")


def dataset_summary(rows: DataFrame) -> DataFrame:
    """Examples by split (0 where there are none), documents and pairs (A3)."""
    by_split = [F.sum((F.col("split") == s).cast("long")).alias(s) for s in SPLITS]
    return rows.agg(F.count("*").alias("examples"), F.count_distinct("document_id").alias("documents"), F.sum(1 + F.size("negatives")).alias("pairs"), *by_split)


def language_summary(rows: DataFrame) -> DataFrame:
    """Examples by language (A3)."""
    return rows.groupBy("language").agg(F.count("*").alias("examples"))


def leaks(rows: DataFrame) -> DataFrame:
    """Documents in several splits (A4)."""
    return rows.groupBy("document_id").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def pair_scorer(score: Callable[[list[tuple[str, str]]], list[float]], batch: int = 64) -> Callable[[Column, Column], Column]:
    """A scorer of batches of (query, passage) pairs, such as a cross-encoder, for SCORERS; it must give as many scores as pairs."""

    @F.pandas_udf("double")
    def scores(query: pd.Series, passage: pd.Series) -> pd.Series:
        every, out = list(zip(query, passage)), []
        for k in range(0, len(every), batch):
            found = list(score(every[k : k + batch]))
            if len(found) != len(every[k : k + batch]):
                raise ValueError(f"{len(found)} scores for {len(every[k : k + batch])} pairs")
            out += map(float, found)
        return pd.Series(out, dtype="float64")

    return lambda q, p: scores(q, p)


def scored(rows: DataFrame, scorer: str = "overlap") -> DataFrame:
    """pairs() with a score."""
    return rows.withColumn("score", SCORERS[scorer](F.col("query"), F.col("passage")))


def predictions(rows: DataFrame) -> DataFrame:
    """By example: the positive's rank, ties against it, and the passage with the best score, ties to the last."""
    positive = F.max(F.when(F.col("label") == 1.0, F.col("score"))).alias("positive_score")
    with_best = rows.groupBy("id", "split").agg(
        positive,
        F.sort_array(F.collect_list(F.when(F.col("label") == 0.0, F.col("score")))).alias("others"),
        F.max_by("position", F.struct("score", "position")).alias("best_position"),
    )
    rank = 1 + F.size(F.filter("others", lambda s: s >= F.col("positive_score")))
    return with_best.select("id", "split", rank.alias("positive_rank"), "best_position")


def predictions_of(rows: DataFrame, scores: str = "overlaps") -> DataFrame:
    """predictions() of examples() that have their scores in an array, the positive's first: no pair leaves its row."""
    best = F.size(scores) - F.array_position(F.reverse(scores), F.array_max(scores))
    # sorted, the scores from the first that equals the positive's are its own and those that are not below it
    rank = F.size(scores) - F.array_position(F.sort_array(scores), F.get(scores, F.lit(0))) + 1
    return rows.select("id", "split", rank.alias("positive_rank"), best.alias("best_position"))


def mistakes(ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """Examples whose positive is not first, all or the first of them by id."""
    wrong = ranked.filter("positive_rank > 1")
    return wrong if limit is None else wrong.orderBy("id").limit(limit)


def metrics(rows: DataFrame) -> DataFrame:
    """hit@1, hit@3, MRR, nDCG@3 and the mean rank by split."""
    r = F.col("positive_rank")
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy("split").agg(
        F.count("*").alias("examples"),
        mean((r <= 1).cast("double")).alias("hit_at_1"),
        mean((r <= 3).cast("double")).alias("hit_at_3"),
        mean(1.0 / r).alias("mrr"),
        mean(F.when(r <= 3, 1.0 / F.log2(r + 1.0)).otherwise(0.0)).alias("ndcg_at_3"),
        mean(r.cast("double")).alias("mean_rank"),
    )
