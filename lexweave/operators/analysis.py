"""Conditions, coverage and risk checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import rules, text

CATEGORIES = [c[0] for c in rules.CONDITIONS]


def segments(pages: DataFrame) -> DataFrame:
    """document_id, page_number, segment, quote, lo, hi for the non-empty pieces of each page."""
    spans = F.posexplode(text.analysis_spans("text")).alias("segment", "s")
    return pages.select("document_id", "page_number", spans).select("document_id", "page_number", "segment", "s.*")


def candidates(parts: DataFrame, only: str | None = None) -> DataFrame:
    """Segments by category, or those of one: with a keyword, and a value where one is required, and their score.

    The few rules are columns of one projection, not a join.
    """
    named = [(k, c) for k, c in enumerate(rules.CONDITIONS) if only in (None, c[0])]
    counts = {f"__hits_{k}": F.regexp_count("quote", F.lit(rules.spark(c[2]))) for k, c in named}
    matches = {f"__value_{k}": F.when(F.col(f"__hits_{k}") > 0, text.found("quote", c[3])) if c[3] else F.lit(False) for k, c in named}
    tested = parts.withColumns(counts).filter(" + ".join(counts) + " > 0").withColumns(matches)
    options = []
    for k, (name, _, _, _, required) in named:
        hits, valued = F.col(f"__hits_{k}"), F.col(f"__value_{k}")
        score = F.least(F.lit(0.99), F.lit(0.55) + F.lit(0.08) * hits + F.when(valued, F.lit(0.2)).otherwise(F.lit(0.0)))
        fits = (hits > 0) & (valued if required else F.lit(True))
        options.append(F.when(fits, F.struct(F.lit(k).alias("ord"), F.lit(name).alias("category"), score.alias("score"))))
    matched = F.explode(F.filter(F.array(*options), lambda o: o.isNotNull())).alias("m")
    return tested.select(*parts.columns, matched).select(*parts.columns, "m.*")


def best_conditions(rows: DataFrame, seen: list[str], limit: int) -> DataFrame:
    """Of equal quotes of a category the first by seen; the best by score, `limit` a category, numbered through."""
    # dealt by document once: the windows by parts of a document and by document need no more than that
    rows = rows.repartition("document_id").withColumn("norm", text.collapsed("quote"))
    first = Window.partitionBy("document_id", "ord", "norm").orderBy(*seen)
    best = Window.partitionBy("document_id", "ord").orderBy(F.desc("score"), "page_number", "lo", *seen)
    kept = rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit)
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("ord", "place"))
    return kept.withColumn("number", number)


def conditions(pages: DataFrame, limit: int = rules.MAX_ITEMS, only: str | None = None) -> DataFrame:
    """The conditions of each document over all its pages, with running citation numbers.

    only: one category, the patterns of which alone are looked for; numbers then run within it.
    """
    kept = best_conditions(candidates(segments(pages), only), ["page_number", "lo"], limit)
    return kept.select("document_id", "category", "ord", "place", "number", "page_number", F.col("lo").alias("start_char"), F.col("hi").alias("end_char"), "quote", F.round("score", 6).alias("score"))


def category_queries(spark: SparkSession) -> DataFrame:
    """query_id, ord, category, query_ord, query: what is searched for each category of conditions."""
    rows = [(10 * k + n, k, c[0], n, q) for k, c in enumerate(rules.CONDITIONS) for n, q in enumerate(c[1])]
    return spark.createDataFrame(rows, "query_id long, ord int, category string, query_ord int, query string")


def category_hits(found: DataFrame, asked: DataFrame) -> DataFrame:
    """The chunks that the queries of a category found in a document, each at its first place: by query, then by rank.

    found: document_id, query_id, mode, rank, chunk_id; a combined minimum by chunk takes the place of a window.
    """
    joined = found.join(F.broadcast(asked.select("query_id", "ord", "category", "query_ord")), "query_id")
    return joined.groupBy("document_id", "ord", "category", "chunk_id").agg(F.min(F.struct("query_ord", "rank")).alias("hit"))


def retrieval_modes(found: DataFrame) -> DataFrame:
    """The modes of the searches of each document, in order."""
    return found.groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_set("mode")), ",").alias("modes"))


def conditions_of_hits(hits: DataFrame, limit: int = rules.MAX_ITEMS) -> DataFrame:
    """Conditions from retrieved chunks: as conditions(), but a category is looked for in its own hits only, first hits first.

    hits: category_hits() with page_number, start_char (the chunk's on its page) and text.  Offsets are the page's.
    """
    spans = F.explode(text.analysis_spans("text")).alias("s")
    parts = hits.select("document_id", F.col("category").alias("wanted"), "hit", "chunk_id", "page_number", "start_char", spans).select("*", "s.quote", "s.lo", "s.hi").drop("s")
    kept = best_conditions(candidates(parts).filter("category = wanted"), ["hit", "lo"], limit)
    at = lambda c: (F.col("start_char") + F.col(c)).alias("start_char" if c == "lo" else "end_char")
    return kept.select("document_id", "category", "ord", "place", "number", "chunk_id", "page_number", at("lo"), at("hi"), "quote", F.round("score", 6).alias("score"))


def by_category(found: DataFrame) -> DataFrame:
    """Every category of each document's conditions with their citation numbers in order."""
    return found.groupBy("document_id", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list("number")), lambda n: n.cast("string")), ",").alias("numbers"))


def cited_chunks(found: DataFrame, checklist: DataFrame) -> DataFrame:
    """By document the different citations of conditions and grounded risks, the risks, and those grounded of high severity."""
    every = found.select("document_id", F.col("number").alias("n")).unionByName(checklist.filter("grounded").select("document_id", F.col("citation").alias("n")))
    cited = every.groupBy("document_id").agg(F.count_distinct("n").alias("citations"))
    grounded = F.col("grounded")
    counts = checklist.groupBy("document_id").agg(F.sum(grounded.cast("long")).alias("grounded"), F.sum((grounded & (F.col("severity") == "high")).cast("long")).alias("high"))
    return counts.join(cited, "document_id", "left").select("document_id", F.coalesce("citations", F.lit(0)).alias("citations"), "grounded", "high")


def citation_counts(documents: DataFrame, pages: DataFrame, limit: int = rules.MAX_ITEMS) -> DataFrame:
    """cited_chunks() of conditions(pages) and the risks() of documents, without a window.

    A document's conditions are numbered through, so there are as many citations as conditions: of each category the
    different quotes, at most `limit`; and what a rule cites is one of them.
    """
    rows = candidates(segments(pages)).select("document_id", "ord", text.collapsed("quote").alias("norm"))
    kinds = [F.least(F.size(F.collect_set(F.when(F.col("ord") == k, F.col("norm")))), F.lit(limit)).cast("long").alias(c) for k, c in enumerate(CATEGORIES)]
    counted = documents.groupBy("document_id").agg(F.count("*").alias("n")).join(rows.groupBy("document_id").agg(*kinds), "document_id", "left")
    total = lambda values: sum((F.coalesce(v, F.lit(0)) for v in values), F.lit(0))
    there = {r: (F.col(r[0]) > 0).cast("long") for r in rules.RISKS}
    return counted.select(
        "document_id",
        total(map(F.col, CATEGORIES)).alias("citations"),
        (F.col("n") * total(there.values())).alias("grounded"),
        (F.col("n") * total(v for r, v in there.items() if r[2] == "high")).alias("high"),
    )


def shown(checklist: DataFrame, limit: int = 3) -> DataFrame:
    """The first risks of each document."""
    return checklist.filter(F.col("position") <= limit)


def selected_citation(found: DataFrame, selected: DataFrame) -> DataFrame:
    """The condition that is selected in each document, or else its first (C4). selected: document_id, selected_number."""
    asked = found.join(selected, "document_id", "left").withColumn("hit", F.coalesce(F.col("number") == F.col("selected_number"), F.lit(False)))
    best = asked.groupBy("document_id").agg(F.max_by(F.struct("number", "page_number", "quote"), F.struct("hit", -F.col("number"))).alias("b"))
    return best.select("document_id", "b.*")


def category_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c) for k, c in enumerate(CATEGORIES)], "ord int, category string")


def coverage(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Found and missing categories of each document in category order, and the share found."""
    sets = documents.select("document_id").join(found.groupBy("document_id").agg(F.collect_set("category").alias("have")), "document_id", "left")
    every = F.array(*map(F.lit, CATEGORIES))
    have = F.coalesce("have", F.array().cast("array<string>"))
    pick = lambda inside: F.array_join(F.filter(every, lambda c: F.array_contains(have, c) if inside else ~F.array_contains(have, c)), ",")
    return sets.select("document_id", pick(True).alias("found"), pick(False).alias("missing"), (F.size(have) / F.lit(float(len(CATEGORIES)))).alias("coverage"))


def risks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The checklist: a rule for each category that is present (citing its first condition), then one for each that is missing."""
    spark = documents.sparkSession
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rules.RISKS)], "ord int, category string, rule_id string, severity string, title string, description string, recommendation string")
    first = found.filter("place = 1").select("document_id", "category", F.col("number").alias("citation"))
    grid = documents.select("document_id").join(F.broadcast(table), F.lit(True)).join(first, ["document_id", "category"], "left")
    there = F.col("citation").isNotNull()
    named = lambda pattern, c: F.concat(F.lit(pattern.split("{}")[0]), c, F.lit(pattern.split("{}")[1]))
    pick = lambda yes, no: F.when(there, F.col(yes)).otherwise(no)
    return grid.select(
        "document_id",
        F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc(there), "ord")).alias("position"),
        pick("rule_id", F.concat(F.lit("missing_"), "category")).alias("rule_id"),
        pick("severity", F.lit("high")).alias("severity"),
        pick("title", named(rules.MISSING_TITLE, F.initcap("category"))).alias("title"),
        pick("description", named(rules.MISSING_DESCRIPTION, F.col("category"))).alias("description"),
        pick("recommendation", F.lit(rules.MISSING_RECOMMENDATION)).alias("recommendation"),
        there.alias("grounded"),
        "citation",
    )


def localized(checklist: DataFrame, copy: DataFrame) -> DataFrame:
    """Titles from copy(rule_id, local_title), as they are for rules without."""
    return checklist.join(F.broadcast(copy), "rule_id", "left").withColumn("title", F.coalesce("local_title", "title")).drop("local_title")


def highlighted(body: Column, quote: Column, css: str = rules.HIGHLIGHT_CLASS) -> Column:
    """HTML-escaped text with the first place of the quote marked, matched whatever its white space and case.

    Without such a place, text that is itself a piece of the quote, of six characters and more, is marked as a whole.
    """
    tokens = F.filter(F.split(quote, text.SPACE + "+"), lambda t: t != "")
    pattern = F.concat(F.lit("(?iuU)"), F.array_join(F.transform(tokens, text.escaped), r"\s+"))
    hit = F.when(F.size(tokens) > 0, F.regexp_substr(body, pattern))
    at, piece = F.instr(body, hit), text.collapsed(body)
    mark = lambda c: F.concat(F.lit(f'<mark class="{css}">'), text.html_escaped(c), F.lit("</mark>"))
    around = F.concat(text.html_escaped(F.left(body, at - 1)), mark(hit), text.html_escaped(F.substring(body, at + F.length(hit), F.length(body))))
    inside = (F.size(tokens) > 0) & (F.length(piece) >= rules.LEAST_FRAGMENT) & F.contains(text.collapsed(quote), piece)
    return F.when(hit.isNotNull(), around).when(inside, mark(body)).otherwise(text.html_escaped(body))
