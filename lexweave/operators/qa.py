"""Grounded answers: evidence, extractive selection, refusals, claim verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import rules, text
from lexweave.operators.retrieval import beside, small
from lexweave.session import dealt


def evidence(hits: DataFrame, by: list[str], order: list[str], limit: int = rules.EVIDENCE_LIMIT) -> DataFrame:
    """The first hits of each question, numbered C1, C2, ...."""
    ranked = dealt(hits, *by).withColumn("evidence_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("evidence_rank") <= limit)
    return ranked.withColumn("evidence_id", F.concat(F.lit("C"), F.col("evidence_rank").cast("string")))


def extracted(proof: DataFrame, questions: DataFrame, by: list[str], asked: list[str], shared: list[str] | None = None) -> DataFrame:
    """The best sentence of the evidence for each question, or a refusal.

    proof: by columns, evidence_id, evidence_rank, text; questions: asked columns, question, and the columns in shared
    where a question is put to its own evidence only (without any, each is put to all).  Evidence is cut into sentences
    and terms once, whatever the number of questions.  The order of preference is category match, a value beside it,
    shared terms, earlier evidence, earlier sentence; a combined maximum finds it.
    """
    pieces = proof.select(*by, "evidence_id", "evidence_rank", F.posexplode(text.qa_segments("text")).alias("nth", "piece"))
    pieces = pieces.withColumn("quote", F.regexp_replace(F.left("piece", F.lit(rules.QUOTE_LIMIT)), text.SPACE + r"+\z", ""))
    cut = pieces.select(*by, "evidence_id", "evidence_rank", "nth", "quote", text.qa_terms("quote").alias("found"), text.found("quote", rules.QUOTE_VALUE).alias("value"))
    wanted = questions.withColumns({"category": text.question_category("question"), "terms": text.qa_terms("question")})
    parts = cut.join(small(wanted), shared) if shared else beside(cut, wanted)
    by = list(dict.fromkeys([*by, *asked]))
    match = text.category_match("category", "quote")
    parts = parts.withColumns({"match": match, "overlap": F.size(F.array_intersect("terms", "found"))})
    valued = ((F.col("match") == 1) & F.col("value")).cast("int")
    key = F.struct("match", valued.alias("valued"), "overlap", (-F.col("evidence_rank")).alias("e"), (-F.col("nth")).alias("s"))
    best = parts.groupBy(*by, "question", "category").agg(F.max_by(F.struct("evidence_id", "quote", "match", "overlap"), key).alias("b")).select(*by, "question", "category", "b.*")
    refused = (
        (F.col("category").isNotNull() & (F.col("match") == 0))
        | ((F.col("category") == "subcontracting") & text.found("question", rules.PERCENT_QUESTION) & ~text.found("quote", rules.PERCENT_VALUE, fold=False))
        | ((F.col("category") == "insurance") & text.found("question", rules.NUMBER_QUESTION) & ~text.found("quote", rules.POLICY_NUMBER, dotall=True))
        | (F.col("category").isNull() & (F.col("overlap") == 0))
        | (F.col("quote") == "")
    )
    return best.withColumn("cannot_answer", F.coalesce(refused, F.lit(False))).select(
        *by, "question", "category", "cannot_answer", F.when(~F.col("cannot_answer"), F.col("evidence_id")).alias("evidence_id"), F.when(~F.col("cannot_answer"), F.col("quote")).alias("quote")
    )


def refusal(question: Column | str) -> Column:
    """The message of an answer without evidence, in the question's script (P10)."""
    return F.when(F.rlike(text.col(question), F.lit("[\\u0400-\\u04ff]")), rules.REFUSALS["ru"]).otherwise(rules.REFUSALS["en"])


def verified(claims: DataFrame, hits: DataFrame, by: list[str], limit: int = rules.MAX_CLAIMS) -> DataFrame:
    """Claims whose quote stands in the evidence they name, numbered, with page offsets.

    claims: by, ord (from 1), claim, evidence_id, quote; hits: by, evidence_id, page_number, start_char, text.  Hits
    without some of the by columns are the evidence of all their values, and need not be repeated for each.
    """
    keys = [c for c in by if c in hits.columns]
    joined = claims.filter(F.col("ord") <= limit).join(hits.select(*keys, "evidence_id", "page_number", "start_char", "text"), [*keys, "evidence_id"])
    spans = joined.withColumn("span", text.quote_span("text", "quote")).filter("span is not null")
    number = F.row_number().over(Window.partitionBy(*by).orderBy("ord"))
    return spans.select(
        *by,
        "ord",
        number.alias("number"),
        "claim",
        "page_number",
        (F.col("start_char") + F.col("span.lo")).alias("start_char"),
        (F.col("start_char") + F.col("span.hi")).alias("end_char"),
        F.substring("text", F.col("span.lo") + 1, F.col("span.hi") - F.col("span.lo")).alias("quote"),
    )


def answers(questions: DataFrame, claims: DataFrame, by: list[str]) -> DataFrame:
    """The answer to each question: its verified claims with their numbers, or the refusal."""
    piece = F.concat(F.regexp_replace("claim", text.SPACE + r"+\z", ""), F.lit(" ["), F.col("number").cast("string"), F.lit("]"))
    joined = claims.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("number", piece.alias("piece")))).alias("p"))
    body = F.array_join(F.transform("p", lambda p: p["piece"]), " ")
    return questions.join(joined, by, "left").select(*by, F.coalesce(F.when(F.size("p") > 0, body), refusal("question")).alias("answer"), F.col("p").isNotNull().alias("grounded"))


def prompt(rows: DataFrame, by: list[str]) -> DataFrame:
    """The evidence blocks of a prompt, in rank order."""
    block = F.concat(F.lit("<"), "evidence_id", F.lit(' page="'), F.col("page_number").cast("string"), F.lit('">'), "text", F.lit("</"), "evidence_id", F.lit(">"))
    blocks = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("evidence_rank", block.alias("b")))).alias("p"))
    return blocks.select(*by, F.array_join(F.transform("p", lambda p: p["b"]), "\n\n").alias("prompt"))


MESSAGE = "struct<output:array<struct<type:string,content:array<struct<type:string,text:string>>>>>"


def output_text(payload: Column | str) -> Column:
    """The first output_text of the first message of a model's response, or null."""
    read = F.from_json(text.col(payload), MESSAGE)
    message = F.try_element_at(F.filter(read["output"], lambda o: o["type"] == "message"), F.lit(1))
    return F.try_element_at(F.filter(message["content"], lambda c: c["type"] == "output_text"), F.lit(1))["text"]


DRAFT = "struct<cannot_answer:boolean,claims:array<struct<text:string,evidence_id:string,quote:string>>>"


def draft_claims(rows: DataFrame, by: list[str], column: str = "draft") -> DataFrame:
    """Claims from a provider's JSON: at most ten, texts of 1 to 2000 characters, ids like C1; others are left out."""
    read = rows.withColumn("__draft", F.from_json(column, DRAFT))
    claims = read.filter(~F.coalesce("__draft.cannot_answer", F.lit(False))).select(*by, F.posexplode(F.slice("__draft.claims", 1, 10)).alias("k", "c"))
    good = F.length("c.text").between(1, 2000) & F.length("c.quote").between(1, 2000) & F.rlike("c.evidence_id", F.lit("^C[1-9][0-9]*$"))
    return claims.filter(good).select(*by, (F.col("k") + 1).alias("ord"), F.col("c.text").alias("claim"), F.col("c.evidence_id").alias("evidence_id"), F.col("c.quote").alias("quote"))


def with_fallback(drafts: DataFrame, answered: DataFrame, by: list[str], name: str = "provider", column: str = "draft") -> DataFrame:
    """by, ord, claim, evidence_id, quote, mode: a provider's claims, and where it failed those of extracted().

    A provider has failed on a row whose draft is null or no JSON object of a draft; mode is then extractive_fallback.
    """
    broken = F.get_json_object(column, "$.claims").isNull() & F.get_json_object(column, "$.cannot_answer").isNull()
    own = draft_claims(drafts.filter(~broken), by, column).withColumn("mode", F.lit(name))
    spare = answered.filter("not cannot_answer").join(drafts.filter(broken).select(*by), by, "left_semi")
    return own.unionByName(spare.select(*by, F.lit(1).alias("ord"), F.col("quote").alias("claim"), "evidence_id", "quote", F.lit("extractive_fallback").alias("mode")))
