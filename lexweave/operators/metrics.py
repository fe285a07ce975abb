"""Evaluation metrics."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text
from lexweave.operators.retrieval import beside, small


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def retrieval(hits: DataFrame, k: int = 5) -> DataFrame:
    """By query: whether a relevant hit is among the first k, and one over the first relevant rank (A6, W10). hits: query_id, rank, relevant."""
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return hits.groupBy("query_id").agg((F.coalesce(first, F.lit(1 << 30)) <= k).cast("int").alias("hit"), F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"))


#: A range around a percentile has two of so many parts of the rows, as far as a sketch tells.
RANGES = 1000


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], digits: int | None = 6) -> DataFrame:
    """Exact percentiles with linear interpolation; nulls don't count.

    No task gets all values of a group: a sketch gives each group's ranges, one close around each percentile and those
    between them, rows are counted by range, and only the values of the ranges that hold a rank which is asked for are
    counted up one by one.  A row is compared with two edges a percentile.
    """
    rows = rows.select(*by, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    around = sorted({min(max(q + side / RANGES, 0.0), 1.0) for q in shares.values() for side in (-1, 1)})
    marks = F.percentile_approx("__v", F.array(*map(F.lit, around)), 10 * RANGES)
    same = lambda c: F.col(c).eqNullSafe(F.col(f"__{c}"))
    edges = rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(marks.alias("__edges"))
    match = reduce(and_, map(same, by), F.lit(True))
    # a value's range is the number of edges below it, so equal values are in one
    below = reduce(add, ((F.get("__edges", F.lit(k)) < F.col("__v")).cast("int") for k in range(len(around))))
    placed = rows.join(small(edges), match).select(*by, "__v", below.alias("__r"))
    counted = placed.groupBy(*by, "__r").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range of a group
    ranges = counted.withColumns({"__all": F.sum("__n").over(Window.partitionBy(*by, F.lit(0))), "__from": F.coalesce(F.sum("__n").over(before), F.lit(0))})
    ranks = {name: (F.lit(q) * (F.col("__all") - 1)) for name, q in shares.items()}
    holds = lambda rank: (rank >= F.col("__from")) & (rank < F.col("__from") + F.col("__n"))
    wanted = ranges.filter(reduce(or_, (holds(f(p)) for p in ranks.values() for f in (F.floor, F.ceil))))
    wanted = wanted.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__r").alias("__own"), "__all", "__from")
    inside = placed.join(small(wanted), match & (F.col("__r") == F.col("__own"))).groupBy(*by, "__r", "__all", "__from", "__v").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by, "__r").orderBy("__v"))
    exact = inside.withColumn("__to", F.col("__from") + upto).withColumn("__from", F.col("__to") - F.col("__n"))
    at = lambda rank: F.max(F.when(holds(rank), F.col("__v")))
    low = [at(F.floor(p)).alias(f"__low_{name}") for name, p in ranks.items()]
    high = [at(F.ceil(p)).alias(f"__high_{name}") for name, p in ranks.items()]
    found = exact.groupBy(*by).agg(*low, *high, F.max("__all").alias("__all"))
    part = {name: p - F.floor(p) for name, p in ranks.items()}
    value_of = {n: F.col(f"__low_{n}") + (F.col(f"__high_{n}") - F.col(f"__low_{n}")) * part[n] for n in shares}
    return found.select(*by, *((v if digits is None else F.round(v, digits)).alias(n) for n, v in value_of.items()))


def refusals(rows: DataFrame) -> DataFrame:
    """Share of unanswerable questions that are refused, and of answerable ones that are grounded (F17, F23). rows: answerable, grounded."""
    yes, no = F.col("answerable").cast("int"), (~F.col("answerable")).cast("int")
    right = (~F.col("answerable") & ~F.col("grounded")).cast("int")
    return rows.agg(
        F.sum(yes).alias("answerable"),
        F.sum(no).alias("unanswerable"),
        F.round(ratio(F.sum((F.col("answerable") & F.col("grounded")).cast("int")), F.sum(yes)), 6).alias("grounded_rate"),
        F.round(ratio(F.sum(right), F.sum(no)), 6).alias("refusal_accuracy"),
    )


def precision_recall(expected: DataFrame, found: DataFrame, keys: list[str], page: str = "page_number") -> DataFrame:
    """Recall: expected keys that are found at all; precision: found rows on an expected page."""
    pages = found.groupBy(*keys).agg(F.collect_set(page).alias("pages"), F.count("*").alias("rows"))
    got = expected.join(pages, keys, "left")
    recall = got.agg(F.count("*").alias("expected"), F.sum(F.col("pages").isNotNull().cast("int")).alias("matched"))
    right = found.join(expected.select(*keys, F.col(page).alias("__page")), keys, "left")
    precise = right.agg(F.count("*").alias("extracted"), F.sum(F.coalesce((F.col("__page") == F.col(page)).cast("int"), F.lit(0))).alias("correct"))
    both = recall.join(precise, F.lit(True))
    return both.select("expected", "matched", "extracted", "correct", F.round(ratio(F.col("matched"), F.col("expected")), 6).alias("recall"), F.round(ratio(F.col("correct"), F.col("extracted")), 6).alias("precision"))


def quoting(documents: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, item_id for every text of documents(doc_id, text) that holds a quote(item_id, quote), case and white space aside.

    A quote's words, but for the first and last, are whole words of a text that holds it; the rarest of them leads to
    the texts that come into question.  Quotes of fewer than three words have none and are looked for everywhere.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    asked = quotes.select("item_id", text.collapsed("quote").alias("quote")).withColumn("inner", F.expr("slice(split(quote, ' '), 2, greatest(size(split(quote, ' ')) - 2, 0))"))
    folded = documents.select("doc_id", text.collapsed("text").alias("text"))
    wanted = asked.select("item_id", F.explode(F.array_distinct("inner")).alias("word"))
    listed = small(wanted.select("word").distinct())
    held = folded.select("doc_id", F.explode(F.array_distinct(words("text"))).alias("word")).join(listed, "word", "left_semi")
    counts = held.groupBy("word").agg(F.count("*").alias("n"))
    anchors = wanted.join(counts, "word", "left").groupBy("item_id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    maybe = held.join(small(anchors), "word").select("doc_id", "item_id")
    # doc_id need not be unique: a candidate is checked on all texts of the id
    checked = folded.join(maybe.distinct(), "doc_id").join(small(asked.select("item_id", "quote")), "item_id")
    short = beside(folded, asked.filter(F.size("inner") == 0).select("item_id", "quote"), F.contains("text", "quote"))
    return checked.filter(F.contains("text", "quote")).select("doc_id", "item_id").unionByName(short.select("doc_id", "item_id"))
