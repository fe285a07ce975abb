"""Sources and sinks: uploads, JSON lines, nested JSON, manifests, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import rules, text
from lexweave.operators import library

EXAMPLE = "id string, document_id string, split string, language string, query string, positive string, negatives array<string>, category string, source_page int, negative_categories array<string>"
EVALUATION = (
    "name string, description string, pages array<string>, questions array<struct<id:string,language:string,question:string,expected_pages:array<int>,expected_quote_fragments:array<string>>>, "
    "analysis_expectations array<struct<category:string,expected_pages:array<int>>>"
)
MANIFEST = (
    "version string, name string, split string, documents array<struct<id:string,filename:string,language:string,source_url:string,sha256:string,"
    "questions:array<struct<id:string,language:string,question:string,answerable:boolean,expected_pages:array<int>,expected_quote_fragments:array<string>>>>>"
)
HEAD = 1024
#: What a page reader may say of a file.
READER_CODES = ("unreadable_pdf", "encrypted_pdf", "page_extraction_failed")


def uploads(spark: SparkSession, path: str, stream: bool = False, max_bytes: int = rules.MAX_UPLOAD_BYTES) -> DataFrame:
    """Files under path: name, size, sha256, content, and the code of the check that they fail, if any.

    Only the head of a file is looked at beside its hash; files over max_bytes are refused by their length.
    Spark's reader leaves out files of no bytes; upload_error() refuses such rows from other sources.
    """
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    files = reader.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = text.safe_filename("path")
    head = F.decode(F.substring("content", 1, HEAD), "ISO-8859-1")
    error = F.when(F.col("length") > max_bytes, "document_too_large").otherwise(library.upload_error(name, F.lit(""), F.col("length"), head))
    return files.select("path", name.alias("filename"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), error.alias("error_code"), "content")


def extracted(files: DataFrame, pages_of: Callable[[bytes], list[str]], max_pages: int = 300) -> DataFrame:
    """Normalised pages of each file by a page reader, or the code of its failure.

    pages_of is any function of the bytes of a file (a PDF library's reader where one is installed); it may
    raise ValueError with one of READER_CODES.  Whatever else it raises is page_extraction_failed.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    pages = pages_of(bytes(content))
                    code = "empty_pdf" if not pages else "too_many_pages" if len(pages) > max_pages else "no_extractable_text" if not any(p.strip() for p in pages) else None
                except Exception as e:  # a bad file must not end the job, whatever the reader makes of it
                    pages, code = [], str(e) if isinstance(e, ValueError) and str(e) in READER_CODES else "page_extraction_failed"
                out += [(path, None, None, code)] if code else [(path, k, p, None) for k, p in enumerate(pages, 1)]
            yield pd.DataFrame(out, columns=["path", "page_number", "text", "error_code"])

    rows = files.filter("error_code is null").select("path", "content").mapInPandas(read, "path string, page_number int, text string, error_code string")
    return rows.withColumn("text", text.normalized("text"))


def json_lines(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """Rows of JSON lines with their 1-based line number by file; blank lines are skipped, bad ones have error set.

    Line numbers need each file in one piece: files are read whole, so they are to be of bounded size.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("k", "line"))
    lines = lines.filter(F.length(F.trim("line")) > 0)
    fields = f"{schema}, _bad string"
    read = F.from_json("line", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select("file", (F.col("k") + 1).alias("line_number"), read.alias("r")).select("file", "line_number", "r.*").withColumn("error", F.col("_bad").isNotNull()).drop("_bad")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested JSON, an object or an array a file; a file that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def evaluation_pages(evaluation: DataFrame) -> DataFrame:
    """document, page_number, text of an evaluation set."""
    return evaluation.select("name", F.posexplode("pages").alias("k", "text")).select("name", (F.col("k") + 1).alias("page_number"), "text")


def manifest_documents(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("documents").alias("d")).select("d.*")


def manifest_violations(documents: DataFrame) -> DataFrame:
    """id and rule of everything that a manifest gets wrong; there must be none."""
    asked = documents.select("id", F.explode("questions").alias("q"))
    asked = asked.select("id", F.col("q.id").alias("question_id"), "q.answerable", "q.expected_pages", "q.expected_quote_fragments")
    evident = (F.coalesce(F.size("expected_pages"), F.lit(0)) > 0) & (F.coalesce(F.size("expected_quote_fragments"), F.lit(0)) > 0)
    bare = ~F.rlike("filename", F.lit(r"[/\\]"))
    mark = lambda df, rule: df.select(F.col("id").cast("string").alias("id"), F.lit(rule).alias("rule"))
    counts = asked.groupBy("id").agg(F.max("answerable").alias("some"), F.min("answerable").alias("all"))
    twice = lambda c, rule: mark(documents.groupBy(c.alias("id")).count().filter("count > 1"), rule)
    parts = [
        mark(asked.filter(F.col("answerable") != evident), "answerable_without_evidence_or_reverse"),
        mark(asked.filter(F.exists("expected_pages", lambda p: p < 1)), "page_below_one"),
        mark(documents.filter(~bare), "filename_has_a_path"),
        mark(counts.filter(~F.col("some") | F.col("all")), "one_sided_questions"),
        mark(asked.groupBy("id", "question_id").agg(F.count("*").alias("n")).filter("n > 1"), "question_twice"),
        twice(F.col("id"), "document_twice"),
        twice(text.casefold("filename"), "filename_twice"),
        twice(F.col("sha256"), "hash_twice"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def file_verdicts(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Each document of a manifest beside the file it names: same, changed, missing or no_pdf."""
    have = files.select(F.col("filename"), F.col("sha256").alias("found"), F.decode(F.substring("content", 1, 5), "ISO-8859-1").alias("head"))
    verdict = F.when(F.col("found").isNull(), "missing").when(F.col("head") != "%PDF-", "no_pdf").when(F.col("found") != F.col("sha256"), "changed").otherwise("same")
    return documents.join(have, "filename", "left").select("id", "filename", verdict.alias("verdict"))


def missing_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Library rows whose file is gone."""
    return rows.join(files.select("sha256"), "sha256", "left_anti")


def sorted_json(df: DataFrame) -> DataFrame:
    """value: a row as JSON, its keys in order."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    sorted_json(df).write.mode("overwrite").text(path)


def differing_lines(df: DataFrame, path: str) -> DataFrame:
    """What a written file has too much or too little, for a check run."""
    ours, theirs = sorted_json(df), df.sparkSession.read.text(path)
    return ours.exceptAll(theirs).withColumn("side", F.lit("missing")).unionByName(theirs.exceptAll(ours).withColumn("side", F.lit("extra")))


def write_report(report: DataFrame, path: str) -> None:
    """Nested reports as JSON, a file each."""
    report.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def pack_violations(pages: DataFrame, expected: DataFrame, page_count: int = 20, page_chars: int = 350, document_chars: int = 12_000) -> DataFrame:
    """document_id and rule for packs that break a rule on pages, sizes, or expected quotes."""
    stats = pages.groupBy("document_id").agg(F.count("*").alias("n"), F.min(F.length("text")).alias("least"), F.sum(F.length("text")).alias("total"))
    bad = lambda test, rule: stats.filter(test).select("document_id", F.lit(rule).alias("rule"))
    quotes = expected.join(pages, ["document_id", "page_number"], "left").filter(~F.coalesce(text.contains_normalized("text", "quote"), F.lit(False)))
    parts = [bad(F.col("n") != page_count, "page_count"), bad(F.col("least") < page_chars, "short_page"), bad(F.col("total") < document_chars, "short_document"), quotes.select("document_id", F.lit("quote_not_on_page").alias("rule"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def feature_embedding(column: str, size: int = 384):
    """A deterministic hashed-token embedding for text where no model is installed: array<float>, null for text without tokens."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        import numpy as np

        def one(t: str | None):
            out = np.zeros(size, np.float32)
            for token in (t or "").lower().split():
                h = zlib.crc32(token.encode())
                out[h % size] += 1 if h >> 31 else -1
            norm = float(np.sqrt((out * out).sum()))
            return (out / norm).tolist() if norm else None

        for batch in texts:
            yield batch.map(one)

    return embed(column)


def embedding_provider(embed: Callable[[list[str]], list[list[float]]], size: int, batch: int = 64) -> Callable[[str], Column]:
    """A provider for with_missing_embeddings() from a function of a batch of texts, such as a model's; counts and sizes are checked."""

    def column(name: str) -> Column:
        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            asked, out = [t or "" for t in texts], []
            for k in range(0, len(asked), batch):
                part = asked[k : k + batch]
                found = [[float(x) for x in v] for v in embed(part)]
                if len(found) != len(part) or any(len(v) != size for v in found):
                    raise ValueError(f"{len(part)} texts want as many vectors of {size}")
                out += found
            return pd.Series(out, dtype=object)

        return vectors(name)

    return column


def with_missing_embeddings(chunks: DataFrame, embedded: DataFrame, provider: Callable[[str], Column] = feature_embedding) -> DataFrame:
    """Embeddings for the chunks that embedded(chunk_id) lacks: run again, it gives none."""
    return chunks.join(embedded.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", provider("text").alias("embedding")).filter("embedding is not null")


def with_embeddings(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The chunks, where embedding is null that of new(chunk_id, embedding): the table to be written next (Q8)."""
    return chunks.join(new.withColumnRenamed("embedding", "__new"), "chunk_id", "left").withColumn("embedding", F.coalesce("embedding", "__new")).drop("__new")


def manifest_of(rows: DataFrame) -> DataFrame:
    """document_id, filename, language and questions of a manifest, with page and evidence of each.

    rows: document_id, language, facts(category, page_number, passage) and asked(of: the place of a fact, nth, question),
    as rerank.asked() gives them.  A row has its document's questions already, so only rows whose document has others are shuffled whole.
    """
    def one(q: Column) -> Column:
        fact = F.get("facts", q["of"])
        ident = F.concat(fact["category"], F.lit("-q"), q["nth"].cast("string"))
        return F.struct(ident.alias("id"), F.col("language").alias("language"), q["question"], F.lit(True).alias("answerable"), F.array(fact["page_number"]).alias("expected_pages"), F.array(fact["passage"]).alias("expected_quote_fragments"))

    made = rows.filter(F.size("asked") > 0).select("document_id", "language", F.sort_array(F.transform("asked", one)).alias("questions"))
    twice = rows.groupBy("document_id", "language").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("document_id").alias("__id"), F.col("language").alias("__language"))
    if not twice.isEmpty():
        same = F.col("document_id").eqNullSafe(F.col("__id")) & F.col("language").eqNullSafe(F.col("__language"))
        parts = made.join(twice, same, "left_semi").groupBy("document_id", "language").agg(F.sort_array(F.flatten(F.collect_list("questions"))).alias("questions"))
        made = made.join(twice, same, "left_anti").unionByName(parts)
    name = F.concat(F.lit("document-"), F.col("document_id").cast("string"), F.lit(".pdf"))
    return made.select("document_id", name.alias("filename"), "language", "questions")


def constraint_violations(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """table, rule and count of broken keys and checks of the stored tables; there must be none (section 1.1)."""
    states = ["uploaded", "processing", "ready", "failed"]
    broken = [
        ("documents", "unique sha256", documents.groupBy("sha256").count().filter("count > 1")),
        ("documents", "size > 0", documents.filter("size_bytes <= 0")),
        ("documents", "status", documents.filter(~F.col("status").isin(*states))),
        ("pages", "unique page", pages.groupBy("document_id", "page_number").count().filter("count > 1")),
        ("pages", "page > 0", pages.filter("page_number <= 0")),
        ("chunks", "unique chunk", chunks.groupBy("document_id", "page_number", "chunk_index").count().filter("count > 1")),
        ("chunks", "end > start", chunks.filter("end_char <= start_char or start_char < 0")),
        ("chunks", "page exists", chunks.join(pages, ["document_id", "page_number"], "left_anti")),
    ]
    out = None
    for name, rule, rows in broken:
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(rule).alias("rule"), "n").filter("n > 0")
        out = part if out is None else out.unionByName(part)
    return out
