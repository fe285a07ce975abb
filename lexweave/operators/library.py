"""Document library: lookups, pages, counts, search, dedupe, upload checks, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import rules, text

#: The ids of one document table row that identify it in order: newest first, then by id.
STAGES = {"ready": 2, "processing": 1}


def registered(documents: DataFrame) -> DataFrame:
    """Library rows from documents(doc_id, text, source, n_chars): file name, hash, size, status, creation time."""
    body = F.coalesce("text", F.lit(""))
    status = F.element_at(F.array(*map(F.lit, ("uploaded", "processing", "ready", "failed", "ready"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return documents.select(
        "doc_id",
        F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.sha2(body.cast("binary"), 256).alias("sha256"),
        F.octet_length(body).cast("long").alias("size_bytes"),
        status.alias("status"),
        (F.lit(1704067200) + F.col("doc_id") % 1000 * 60).cast("long").alias("created_at"),
    )


def listed(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page, newest first, ties by id (Q3, O1)."""
    return rows.orderBy(F.desc("created_at"), F.desc("doc_id")).offset(offset).limit(limit)


def first_by_hash(rows: DataFrame) -> DataFrame:
    """Each row with the first row of its hash and whether it repeats that.

    A combined minimum by hash instead of a window: a hot hash is one row of it.
    """
    first = rows.groupBy("sha256").agg(F.min(F.struct("created_at", "doc_id")).alias("f")).select(F.col("sha256").alias("h"), F.col("f.doc_id").alias("original_id"))
    return rows.join(first, F.col("sha256") == F.col("h")).withColumn("deduplicated", F.col("doc_id") != F.col("original_id")).drop("h")


def searched(rows: DataFrame, needle: str, status: str = "all") -> DataFrame:
    """Rows whose file name holds the trimmed, lower-cased needle, of one status or all."""
    kept = rows.filter(F.contains(F.lower("filename"), F.lower(F.trim(F.lit(needle)))))
    return kept if status == "all" else kept.filter(F.col("status") == status)


def upload_error(filename: Column, content_type: Column, size: Column, head: Column) -> Column:
    """The code of the first check that an upload fails, or null."""
    is_pdf = (content_type == "application/pdf") | F.endswith(F.lower(filename), F.lit(".pdf"))
    return F.when(size > rules.MAX_UPLOAD_BYTES, "document_too_large").when((size == 0) | ~is_pdf | ~F.contains(F.left(head, F.lit(1024)), F.lit("%PDF-")), "invalid_pdf")


def guard(status: Column) -> Column:
    """The error of a request on a document with this status (null: there is none) (F1, F2)."""
    return F.when(status.isNull(), "document_not_found").when(status != "ready", "document_not_ready")


def stage_index(status: Column) -> Column:
    """Progress shown for a status."""
    return F.when(status == "ready", 2).when(status == "processing", 1).otherwise(0)


def ingested(rows: DataFrame, error: Column) -> DataFrame:
    """The state each upload ends in: repeats are answered by the original, errors fail with their code, the rest is ready."""
    done = first_by_hash(rows).withColumn("error_code", F.when(~F.col("deduplicated"), error))
    return done.withColumn("state", F.when(F.col("deduplicated"), "deduplicated").when(F.col("error_code").isNotNull(), "failed").otherwise("ready"))


def summary(rows: DataFrame) -> DataFrame:
    """Totals over the library."""
    return rows.agg(
        F.count("*").alias("documents"),
        F.count_distinct("sha256").alias("contents"),
        F.sum("size_bytes").alias("bytes"),
        F.bool_or(F.col("status").isin("uploaded", "processing")).alias("pending"),
    )


def paginated(documents: DataFrame, lines: int = 10) -> DataFrame:
    """Pages of normalised text, `lines` lines each, numbered from 1: document_id, page_number, text, char_count."""
    parts = documents.select("doc_id", F.split(text.normalized(F.coalesce("text", F.lit(""))), "\n").alias("body"))
    count = F.floor((F.size("body") - 1) / lines).cast("int")
    pages = parts.select("doc_id", "body", F.explode(F.sequence(F.lit(0), count)).alias("k"))
    pages = pages.select(F.col("doc_id").alias("document_id"), (F.col("k") + 1).alias("page_number"), F.array_join(F.slice("body", F.col("k") * lines + 1, F.lit(lines)), "\n").alias("text"))
    return pages.withColumn("char_count", F.length("text"))


#: The states that a document may go on to.
MOVES = {"uploaded": ("processing", "failed"), "processing": ("ready", "failed"), "failed": ("processing",)}


def applied(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """The library after updates(doc_id, status, error_code), one a document: the table to be written next.

    An update to a state that does not follow is left out; a state other than failed has no error.
    """
    new = updates.select("doc_id", F.col("status").alias("__status"), F.col("error_code").alias("__error"))
    both = rows.join(new, "doc_id", "left")
    legal = F.lit(False)
    for state, after in MOVES.items():
        legal = legal | ((F.col("status") == state) & F.col("__status").isin(*after))
    legal = F.coalesce(legal, F.lit(False))
    old = F.col("error_code") if "error_code" in rows.columns else F.lit(None).cast("string")
    error = F.when(legal, F.when(F.col("__status") == "failed", F.col("__error"))).otherwise(old)
    return both.withColumns({"error_code": error, "status": F.when(legal, F.col("__status")).otherwise(F.col("status"))}).drop("__status", "__error")
