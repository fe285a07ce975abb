"""The library as stored tables: keyed inserts and updates of many writers, deletion with its cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators import library
from lexweave.operators.retrieval import small
from lexweave.sources.store import Change, Store, Version, together

#: Tables whose rows go with their document, and the column that names it.
CHILDREN = {"pages": "document_id", "chunks": "document_id"}
#: Tables whose rows go with their chunk.
OF_CHUNKS = ("embeddings",)


def register(store: Store, rows: DataFrame, writer: str, batch: int) -> DataFrame:
    """Adds documents whose sha256 is new, once whoever else adds it at the same time; doc_id, sha256, stored_id, deduplicated.

    rows: doc_id, filename, sha256, size_bytes, created_at.  The hash is the unique key: of a batch the first row of
    it (by time, then id) goes in, unless the table has it.  If another writer commits first, only what it added is
    looked at anew.  A batch that was applied before changes nothing and has the same answers.
    """
    rows = rows.select("doc_id", "filename", "sha256", "size_bytes", "created_at").filter(F.col("sha256").isNotNull())
    first = rows.groupBy("sha256").agg(F.min_by(F.struct("doc_id", "filename", "size_bytes", "created_at"), F.struct("created_at", "doc_id")).alias("r"))
    fresh = first.select("r.doc_id", "r.filename", "sha256", "r.size_bytes", "r.created_at", F.lit(writer).alias("writer"), F.lit(batch).cast("long").alias("batch"))
    hashes = small(fresh.select("sha256"))
    seen: set[str] = set()

    def build(version: Version) -> Change | None:
        nonlocal fresh
        if version.batches.get(writer, -1) >= batch:
            return None
        new = [f for f in version.folders.get("documents", []) if f not in seen]
        known = store.read("documents", version, new) if new else None
        if known is not None:  # only hashes of this batch leave the table
            fresh = fresh.join(known.select("sha256").join(hashes, "sha256", "left_semi").distinct(), "sha256", "left_anti")
            seen.update(new)
        return together(store.stage("documents", fresh.select("doc_id", "filename", "sha256", "size_bytes", "created_at", "writer", "batch")), batches={writer: batch})

    version = store.transact(build)
    stored = store.read("documents", version).join(hashes, "sha256", "left_semi")
    stored = stored.select("sha256", F.col("doc_id").alias("stored_id"), ((F.col("writer") == writer) & (F.col("batch") == batch)).alias("own"))
    own = F.col("own") & F.col("doc_id").eqNullSafe(F.col("stored_id"))
    return rows.join(stored, "sha256").select("doc_id", "sha256", "stored_id", (~own).alias("deduplicated"))


def register_stream(store: Store, stream: DataFrame, writer: str, checkpoint: str) -> None:
    """Registers all that a stream has by now; a batch that the stream repeats after a failure is recognised."""
    run = stream.writeStream.foreachBatch(lambda rows, batch: register(store, rows, writer, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def documents(store: Store, version: Version | None = None) -> DataFrame | None:
    """doc_id, filename, sha256, size_bytes, created_at, status, error_code of what is registered and not deleted."""
    version = version or store.latest()
    rows = store.read("documents", version)
    if rows is None:
        return None
    rows = rows.drop("writer", "batch")
    states = store.read("states", version, order="nth")
    if states is None:
        rows = rows.withColumns({"status": F.lit("uploaded"), "error_code": F.lit(None).cast("string")})
    else:
        last = states.groupBy("doc_id").agg(F.max_by(F.struct("status", "error_code"), "nth").alias("s"))
        rows = rows.join(last, "doc_id", "left").withColumns({"status": F.coalesce("s.status", F.lit("uploaded")), "error_code": F.col("s.error_code")}).drop("s")
    gone = store.read("removed", version)
    return rows if gone is None else rows.join(gone.select("doc_id"), "doc_id", "left_anti")


def update(store: Store, updates: DataFrame, writer: str, batch: int) -> Version:
    """Applies updates(doc_id, status, error_code), one a document, that may follow the state which it has at the commit."""

    def build(version: Version) -> Change | None:
        if version.batches.get(writer, -1) >= batch:
            return None
        now = documents(store, version)
        if now is None:
            return Change(batches={writer: batch})
        asked = now.join(small(updates.select("doc_id")), "doc_id", "left_semi").withColumn("__old", F.struct("status", "error_code"))
        moved = library.applied(asked, updates).filter(~F.struct("status", "error_code").eqNullSafe(F.col("__old")))
        return together(store.stage("states", moved.select("doc_id", "status", "error_code")), batches={writer: batch})

    return store.transact(build)


def remove(store: Store, ids: DataFrame) -> Version:
    """Deletes documents(doc_id): from now on no read shows them or what belongs to them."""
    staged = store.stage("removed", ids.select("doc_id").filter("doc_id is not null").distinct())
    return store.transact(lambda version: staged)


def kept(store: Store, table: str, version: Version | None = None) -> DataFrame | None:
    """Rows of a table whose document is not deleted."""
    version = version or store.latest()
    if table in OF_CHUNKS:
        rows, chunks = store.read(table, version), kept(store, "chunks", version)
        return rows if rows is None or chunks is None else rows.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    rows, gone = store.read(table, version), store.read("removed", version)
    key = CHILDREN.get(table, "doc_id")
    return rows if rows is None or gone is None else rows.join(gone.select(F.col("doc_id").alias(key)), key, "left_anti")


def compact(store: Store, tables: tuple[str, ...] = ("documents", *CHILDREN, *OF_CHUNKS), more: Change = Change()) -> Version:
    """Writes tables anew without what has been deleted, each as one folder; reads give the same before and after.

    Folders that other writers add meanwhile stay as they are.  The list of deleted ids goes only if every table
    that it bears on is written anew and nothing was deleted meanwhile.  more: tables that the caller has written anew.
    """
    seen = store.latest()
    parts = [more]
    for table in tables:
        rows = kept(store, table, seen)
        if rows is not None:
            parts.append(together(store.stage(table, rows), drop={table: seen.folders.get(table, [])}))
    states = store.read("states", seen, order="nth")
    if states is not None:
        last = states.groupBy("doc_id").agg(F.max_by(F.struct("status", "error_code"), "nth").alias("s")).select("doc_id", "s.*")
        parts.append(together(store.stage("states", last), drop={"states": seen.folders.get("states", [])}))
    whole = {"documents", *CHILDREN, "postings"} & set(seen.folders) <= {*tables, *more.drop}
    change = together(*parts)

    def build(version: Version) -> Change | None:
        same = all(version.folders.get(t, []) == seen.folders.get(t, []) for t in ("removed", *tables, *more.drop))
        return together(change, Change(drop={"removed": seen.folders.get("removed", [])})) if whole and same else change

    return store.transact(build)
