"""WARC archives as a PySpark Python data source, and deduplicated archiving of pages.

Format "lexwarc" writes rows (RECORD_SCHEMA) to WARC 1.1 files and reads them back.

Writing: each task writes files of its own, rolled at `roll_bytes`; names hold a random part, and only the
files of successful attempts are named in the manifest that the driver adds on commit, so retried and lost
tasks leave no duplicates.  With compress=gzip each record is a gzip member whose extra field "SL" holds its
compressed length, which other readers ignore.

Reading: the manifest names the files and offsets near every `split_bytes`, so partitions are planned
without opening files; without a manifest each *.warc or *.warc.gz is a partition.  Predicates on the record
type and other headers are pushed down.  Headers are parsed first; a record that they rule out is skipped by
its length, and payloads are decoded only if the schema asks for the payload column.

Paths are opened by pyarrow's file systems (local or mounted, s3, gs, hdfs).

Cases of archive_pages(): a null html is an empty payload; payloads under `least` bytes are all responses;
rows that repeat the least id of a payload are responses, too; rows of one id have one record id; null ids and urls go without the header; line
breaks in a url are percent-encoded; an empty table gives an empty archive, read as no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from lexweave.llm.common import need, saved, scratch

RECORD_SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_length long, payload binary"
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 4_000_000
#: 40 bytes each.
BROADCAST_DIGESTS = 500_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def uri_of(path: str) -> str:
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def record(row: dict, date: str) -> bytes:
    """A response with its payload, or a revisit that has the HTTP headers alone."""
    kind, length = row["record_type"] or "response", row["payload_length"]
    payload = (row["payload"] or b"") if kind != "revisit" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}"]
    lines += [f"{header}: {str(row[name]).replace('\r', '%0D').replace('\n', '%0A')}" for name, header in HEADERS.items() if name != "record_type" and row[name] is not None]
    lines += [f"WARC-Profile: {REVISIT}"] if kind == "revisit" else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + http + payload + b"\r\n\r\n"


def member(body: bytes, level: int) -> bytes:
    """A gzip member whose extra field SL holds its own length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = packer.compress(body) + packer.flush()
    extra = b"SL" + struct.pack("<HQ", 8, 12 + 12 + len(packed) + 8)
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(body), len(body) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path = uri_of(options["path"])
        self.gzip = options.get("compress", "gzip") == "gzip"
        self.level = int(options.get("level", 1))
        self.roll = int(options.get("roll_bytes", 512_000_000))
        self.split = int(options.get("split_bytes", 16_000_000))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, top = opened(self.path)
        files: list[dict] = []
        out, at = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    system.create_dir(top, recursive=True)
                    files.append({"name": f"part-{uuid.uuid4().hex}.warc{'.gz' * self.gzip}", "splits": [0]})
                    out, at = system.open_output_stream(f"{top}/{files[-1]['name']}", compression=None), 0
                if at - files[-1]["splits"][-1] >= self.split:
                    files[-1]["splits"].append(at)
                body = record(row, self.date)
                at += out.write(member(body, self.level) if self.gzip else body)
                if at >= self.roll:
                    out.close()
                    files[-1]["size"], out = at, None
        if out is not None:
            out.close()
            files[-1]["size"] = at
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, top = opened(self.path)
        system.create_dir(top, recursive=True)
        old = system.get_file_info(fs.FileSelector(top)) if self.overwrite else []
        ours = [f for m in messages if m is not None for f in m.files]
        with system.open_output_stream(f"{top}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(ours).encode())
        new = {f["name"] for f in ours}
        for f in sorted(old, key=lambda f: not f.base_name.startswith("_manifest-")):  # manifests first, then what they named
            if f.base_name.startswith("_manifest-") or f.base_name.endswith((".warc", ".warc.gz")) and f.base_name not in new:
                system.delete_file(f.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, top = opened(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                system.delete_file(f"{top}/{f['name']}")


@dataclass
class Span(InputPartition):
    path: str
    start: int
    end: int | None


def parsed(head: bytes) -> tuple[dict[str, str], int]:
    """The headers by lower-cased name, and where the block begins."""
    stop = head.index(b"\r\n\r\n") + 4
    pairs = (line.split(":", 1) for line in head[: stop - 4].decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}, stop


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names = schema.names
        self.arrow = pa.schema([(f.name, {"binary": pa.binary(), "bigint": pa.int64()}.get(f.dataType.simpleString(), pa.string())) for f in schema])
        self.path = uri_of(options["path"])
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith, StringEndsWith, StringContains)):
                self.tests.append((name, type(f).__name__, f.value))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            have = headers.get(HEADERS[name].lower())
            if kind == "EqualNullSafe":
                ok = have == value
            elif have is None:
                ok = False
            elif kind == "In":
                ok = have in value
            else:
                ok = {"EqualTo": have == value, "StringStartsWith": have.startswith(str(value)), "StringEndsWith": have.endswith(str(value)), "StringContains": str(value) in have}[kind]
            if not ok:
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        system, top = opened(self.path)
        names = [f for f in system.get_file_info(fs.FileSelector(top)) if f.type == fs.FileType.File]
        manifests = [f for f in names if f.base_name.startswith("_manifest-")]
        out = []
        for f in manifests:
            with system.open_input_stream(f.path) as source:
                for x in json.loads(source.read()):
                    ends = [*x["splits"][1:], x["size"]]
                    out += [Span(f"{top}/{x['name']}", a, b) for a, b in zip(x["splits"], ends)]
        if not manifests:
            out = [Span(f.path, 0, None) for f in sorted(names, key=lambda f: f.path) if f.base_name.endswith((".warc", ".warc.gz"))]
        return out or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        if partition.path:
            system, _ = opened(self.path)
            with system.open_input_file(partition.path) as source:
                for row in (self.packed if partition.path.endswith(".gz") else self.flat)(source, partition):
                    rows.append(row)
                    size += 500 + len(row.get("payload") or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, self.arrow)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.arrow)

    def row(self, headers: dict[str, str], http: bytes, payload: bytes | None) -> dict:
        out = {name: headers.get(HEADERS[name].lower()) for name in self.names if name in HEADERS}
        if "payload_length" in self.names:
            lengths = [line[15:] for line in http.decode("latin-1").split("\r\n") if line.lower().startswith("content-length:")]
            out["payload_length"] = int(lengths[0]) if lengths else None
        if "payload" in self.names:
            out["payload"] = None if headers.get("warc-type") == "revisit" else payload
        return out

    def flat(self, source: pa.NativeFile, span: Span) -> Iterator[dict]:
        at, end = span.start, span.end if span.end is not None else source.size()
        while at < end:
            source.seek(at)
            head = source.read(4096)
            while b"\r\n\r\n" not in head:
                more = source.read(65536)
                if not more:
                    return
                head += more
            headers, stop = parsed(head)
            length = int(headers["content-length"])
            if self.wanted(headers):
                need_all = "payload" in self.names and headers.get("warc-type") != "revisit"
                least = length if need_all else min(length, 2048)
                if len(head) - stop < least:
                    head += source.read(least - (len(head) - stop))
                http, _, payload = head[stop : stop + length].partition(b"\r\n\r\n")
                yield self.row(headers, http, payload if need_all else None)
            at += stop + length + 4

    def packed(self, source: pa.NativeFile, span: Span) -> Iterator[dict]:
        at, end = span.start, span.end if span.end is not None else source.size()
        while at < end:
            source.seek(at)
            first = source.read(24)
            length = struct.unpack("<Q", first[16:24])[0] if first[3:4] == b"\x04" and first[12:14] == b"SL" else None
            unpack = zlib.decompressobj(31)
            data, head = first, b""
            while b"\r\n\r\n" not in head and not unpack.eof:
                if not data:
                    data = source.read(4096)
                    if not data:
                        return
                head += unpack.decompress(data, 2048)
                data = unpack.unconsumed_tail
            headers, stop = parsed(head)
            take = self.wanted(headers)
            need_all = take and "payload" in self.names and headers.get("warc-type") != "revisit"
            while not unpack.eof and (need_all or length is None or take and b"\r\n\r\n" not in head[stop:]):
                if not data:
                    data = source.read(65536)
                    if not data:
                        break
                more = unpack.decompress(data, 0 if need_all else 65536)
                head = head + more if need_all or b"\r\n\r\n" not in head[stop:] else head
                data = unpack.unconsumed_tail
            if take:
                http, _, payload = head[stop : stop + int(headers["content-length"])].partition(b"\r\n\r\n")
                yield self.row(headers, http, payload if need_all else None)
            at = at + length if length is not None else source.tell() - len(unpack.unused_data)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexwarc"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, columns: str = RECORD_SCHEMA) -> DataFrame:
    """columns: the part of RECORD_SCHEMA that is wanted; without payload none is decoded."""
    register(spark)
    return spark.read.format("lexwarc").schema(columns).load(path)


def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """A record for each page: the least page_id of equal payloads is the response that the others revisit.

    The digests that occur twice or more are found by a combined minimum over ids and digests; a hot payload is one
    row of them.  Up to BROADCAST_DIGESTS of them are broadcast; past that, payloads of `least` bytes and more are
    joined by a shuffle, the others pass by.
    """
    pages = need(pages, "page_id", "url", "html").withColumn("payload", F.coalesce("html", F.lit("")).cast("binary")).drop("html")
    pages = pages.withColumns({"digest": F.sha2("payload", 256), "length": F.octet_length("payload").cast("long")})
    groups = pages.filter(F.col("length") >= least).groupBy(F.unhex("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("d", "first")
    groups = saved(groups)
    few = groups.count() <= BROADCAST_DIGESTS
    joined = pages.filter(F.col("length") >= least).join(F.broadcast(groups) if few else groups, F.unhex("digest") == F.col("d"), "left")
    joined = joined.unionByName(pages.filter(F.col("length") < least), allowMissingColumns=True)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.col("length").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives of pages(page_id, url, html) and reads them: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses' digests and sizes come from the payloads read, revisits' from their headers.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or scratch(spark)
    page_records(pages).write.format("lexwarc").mode("append").save(path)
    kind = pages.schema["page_id"].dataType.simpleString()
    back = lambda c: F.expr(f"cast(regexp_extract({c}, '<urn:page:(.*)>', 1) as {kind})")
    read = read_warc(spark, path)
    responses = read.filter("record_type = 'response'").select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    light = read_warc(spark, path, RECORD_SCHEMA.removesuffix(", payload binary"))
    revisits = light.filter("record_type = 'revisit'").select("record_id", F.col("payload_length").alias("payload_bytes"), F.expr("substring(payload_digest, 8)").alias("payload_digest"), "record_type", "refers_to")
    both = responses.unionByName(revisits)
    return both.select(back("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"))
