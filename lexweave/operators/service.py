"""What the service shows and checks: responses, request bounds, messages, evaluation reports.

Table schemas S20; responses P1, P2, P14, C5-C7, C10, C15; bounds F22, F26; reports A12, A13, A15, C8, C12, F16, F18, P11, T6.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import rules, text
from lexweave.operators import library, metrics

#: The stored tables; keys and checks on them are sources.files.constraint_violations().
SCHEMAS = {
    "documents": "id string, original_filename string, content_type string, sha256 string, size_bytes bigint, status string, page_count int, error_code string, error_message string, created_at timestamp, updated_at timestamp",
    "document_pages": "id string, document_id string, page_number int, text string, char_count int",
    "document_chunks": "id string, document_id string, page_id string, page_number int, chunk_index int, start_char int, end_char int, text string, embedding array<float>",
}
#: Lowest and highest values of request parameters; of texts, their lengths.
BOUNDS = {"query": (2, 1000), "limit": (1, 20), "question": (2, 2000), "page_size": (1, 100), "offset": (0, None)}
#: Messages by error code in English and Russian; other codes have the last one.
MESSAGES = {
    "no_extractable_text": ("The PDF holds no text that can be read.", "В PDF нет текста, который можно прочитать."),
    "document_too_large": ("The file is larger than allowed.", "Файл больше допустимого размера."),
    "invalid_pdf": ("The file is not a valid PDF.", "Файл не является корректным PDF."),
    "document_not_found": ("There is no such document.", "Такого документа нет."),
    "document_not_ready": ("The document is not ready yet.", "Документ ещё не готов."),
    "": ("The request failed.", "Запрос не выполнен."),
}


@dataclass(frozen=True)
class Settings:
    """Parameters of a search service, checked."""

    chunk_size: int = rules.CHUNK_SIZE
    chunk_overlap: int = rules.CHUNK_OVERLAP
    max_upload_mb: int = 20

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("the overlap must be smaller than the chunk size")

    @property
    def max_upload_bytes(self) -> int:
        return self.max_upload_mb * 1024 * 1024


def settings_error(chunk_size: Column, chunk_overlap: Column, max_upload_mb: Column) -> Column:
    """What is wrong with settings, or null."""
    return F.when(~F.coalesce((chunk_overlap >= 0) & (chunk_overlap < chunk_size), F.lit(False)), "overlap").when(~F.coalesce(max_upload_mb > 0, F.lit(False)), "upload")


def search_responses(requests: DataFrame, documents: DataFrame, hits: DataFrame) -> DataFrame:
    """request_id, error, rank, chunk_id: each search request (request_id, document_id, query, limit) answered by its error or its hits.

    The first error counts: bounds, then a document that is unknown or not ready.  hits: request_id, chunk_id, rank.
    A request without error or hits has one row without a chunk.
    """
    status = documents.select(F.col("doc_id").alias("document_id"), "status")
    known = requests.join(status, "document_id", "left")
    judged = known.select("request_id", "limit", F.coalesce(request_error(query=F.col("query"), limit=F.col("limit")), library.guard(F.col("status"))).alias("error"))
    found = judged.join(hits.select("request_id", "rank", "chunk_id"), "request_id", "left")
    shown = F.col("error").isNull() & (F.col("rank") <= F.col("limit"))
    cut = found.filter(F.col("rank").isNull() | shown | (F.col("rank") == 1))
    return cut.select("request_id", "error", *(F.when(shown, F.col(c)).alias(c) for c in ("rank", "chunk_id")))


def checked(**request: str | int) -> None:
    """Raises ValueError for the first parameter of a request that is out of its bounds."""
    for name, value in request.items():
        low, high = BOUNDS[name]
        size = len(value) if isinstance(value, str) else value
        if size < low or (high is not None and size > high):
            raise ValueError(f"{name} must be from {low} to {high}")


def request_error(**request: Column) -> Column:
    """The first parameter of each request that is out of its bounds, or null."""
    bad = []
    for name, value in request.items():
        low, high = BOUNDS[name]
        size = F.length(value) if name in ("query", "question") else value
        test = (size < low) if high is None else ~size.between(low, high)
        bad.append(F.when(value.isNull() | test, name))
    return F.coalesce(*bad)


def document_responses(rows: DataFrame) -> DataFrame:
    """Library rows as they are shown: without the hash, with a short id and the day of creation."""
    created = F.timestamp_seconds("created_at")
    shown = rows.withColumns({"short_id": F.concat(F.lit("ID "), F.upper(F.left("sha256", F.lit(8)))), "created_on": F.date_format(created, "dd/MM/yyyy")})
    return shown.drop("sha256", "created_at")


def page_before(page: Column) -> Column:
    """The page to go back to."""
    return F.greatest(F.lit(1), page - 1)


def page_after(page: Column, count: Column) -> Column:
    """The page to go on to; without a known count there is always one."""
    return F.least(F.coalesce(count, page + 1), page + 1)


def may_ask(question: Column | str) -> Column:
    """Whether a question can be sent: two characters and more after trimming."""
    return F.length(text.stripped(question)) >= 2


def message(code: Column, locale: str = "en") -> Column:
    """What is shown for an error code; null without one."""
    k = ("en", "ru").index(locale)
    chain = F.when(code.isNull(), F.lit(None).cast("string"))
    for name, texts in MESSAGES.items():
        chain = chain.when(code == name, texts[k]) if name else chain
    return chain.otherwise(MESSAGES[""][k])


def flag_report(rows: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """Questions and the mean of each boolean flag, by group or over all; no row for no group."""
    means = (F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 6).alias(c) for c in flags)
    return rows.groupBy(*by).agg(F.count("*").alias("questions"), *means)


def evaluation_report(rows: DataFrame) -> DataFrame:
    """One row of metrics over observations; answerable ones count for retrieval and citations, the rest for refusals.

    rows: document_id, answerable, hit_at_5, reciprocal_rank, page_correct, quote_correct, refused, search_ms, answer_ms.
    """
    of = lambda c, answerable=True: F.when(F.col("answerable") == answerable, F.col(c).cast("double"))
    mean = lambda c, answerable=True: F.round(F.coalesce(F.avg(of(c, answerable)), F.lit(0.0)), 6)
    one = rows.agg(
        F.count_distinct("document_id").alias("documents"),
        F.count("*").alias("questions"),
        mean("hit_at_5").alias("hit_rate"),
        mean("reciprocal_rank").alias("mrr"),
        mean("page_correct").alias("page_accuracy"),
        mean("quote_correct").alias("quote_accuracy"),
        mean("refused", False).alias("refusal_accuracy"),
    )
    times = F.array(F.struct(F.lit("search").alias("time"), of("search_ms").alias("ms")), F.struct(F.lit("answer").alias("time"), F.col("answer_ms").cast("double").alias("ms")))
    shares = metrics.percentiles(rows.select(F.explode(times).alias("t")).select("t.time", "t.ms"), ["time"], "ms", {"p50": 0.5, "p95": 0.95}, None)
    of_time = lambda t, p: F.round(F.coalesce(F.max(F.when(F.col("time") == t, F.col(p))), F.lit(0.0)), 2).alias(f"{t}_{p}")
    return one.join(shares.agg(*(of_time(t, p) for t in ("search", "answer") for p in ("p50", "p95"))), F.lit(True))  # one row each


def failures(rows: DataFrame) -> DataFrame:
    """Observations in which something is wrong: an answerable one that is not hit or not cited, or an unanswerable one that is answered (F16)."""
    right = F.when(F.col("answerable"), F.col("hit_at_5") & F.col("page_correct") & F.col("quote_correct")).otherwise(F.col("refused"))
    return rows.filter(~F.coalesce(right, F.lit(False)))


def scored_citation(citations: Column) -> Column:
    """The first of an array of citations, null where it is empty: the one that counts."""
    return F.try_element_at(citations, F.lit(1))


def improvements(before: DataFrame, after: DataFrame, metric: str = "hit_at_1") -> DataFrame:
    """By split whether a metric rose between two ranking reports, and by how much."""
    old, new = before.select("split", F.col(metric).alias("before")), after.select("split", F.col(metric).alias("after"))
    return old.join(new, "split").select("split", "before", "after", (F.col("after") > F.col("before")).alias("improved"))


def file_totals(rows: DataFrame) -> DataFrame:
    """Files, bytes, and answerable and other questions of a checked manifest (A15). rows: size_bytes, answerable, questions."""
    rest = F.sum(F.col("questions") - F.col("answerable"))
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("answerable"), F.lit(0)).alias("answerable"), F.coalesce(rest, F.lit(0)).alias("unanswerable"), metrics.ratio(F.sum("answerable"), F.sum("questions")).alias("share"))
