"""Pages of PDF files, read and written.

pages_of() is the reader for files.extracted(): it follows the cross-reference table (or, where that is broken or is a
stream, looks the objects up in the file), the page tree and the content streams, and maps glyph codes to text by each
font's ToUnicode table.  document_of() lays a document out, a page a text; the sink "lexfiles" writes such contents as a
file each, which count once its manifest lists them.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lexweave.session import dealt

# ---- reading --------------------------------------------------------------------------------------------

TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\x00\t\n\x0c\r ]*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\x00\t\n\x0c\r ]*>|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+|[{}])")
WHOLE, BROKEN = re.compile(rb"[+-]?\d+"), re.compile(rb"[+-]?(\d+\.\d*|\.\d+)")
ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Children of a page tree node, and nodes above a page.
DEPTH = 64


@dataclass(frozen=True)
class Ref:
    number: int


class Name(str):
    """A name, as against a string."""


class Stream(dict):
    """A dictionary with the bytes that follow it."""

    body = b""


class Word(bytes):
    """An operator or keyword."""


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string in brackets whose content begins at `at`, and where it ends."""
    out, depth = bytearray(), 1
    while depth:
        c = data[at : at + 1]
        if not c:
            raise ValueError("open string")
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            c = data[at + 1 : at + 2]
            out += b"" if c in b"\r\n" else ESCAPED.get(c, c)
            at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
            continue
        depth += (c == b"(") - (c == b")")
        if depth:
            out += c
        at += 1
    return bytes(out), at


def value(data: bytes, at: int, level: int = 0) -> tuple[object, int]:
    """The object at a place, and where it ends; a reference where one stands there."""
    found = TOKEN.match(data, at)
    if not found or level > DEPTH:
        raise ValueError("no object")
    token, at = found[1], found.end()
    if token in (b"<<", b"["):
        items = []
        while not (end := TOKEN.match(data, at)) or end[1] not in (b">>", b"]"):
            item, at = value(data, at, level + 1)
            if item == b"R" and isinstance(item, Word) and len(items) > 1:
                items[-2:] = [Ref(items[-2])]
            else:
                items.append(item)
        return (items if token == b"[" else dict(zip(items[::2], items[1::2]))), end.end()
    if token == b"(":
        return literal(data, at)
    if token[:1] == b"<":
        try:
            return bytes.fromhex(token[1:-1].decode()), at
        except ValueError:  # an odd digit, a gap within a byte
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
    if token[:1] == b"/":
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), token[1:]).decode("latin-1")), at
    if WHOLE.fullmatch(token):
        return int(token), at
    if BROKEN.fullmatch(token):
        return float(token), at
    return Word(token), at


@lru_cache(maxsize=16)
def codes_of(table: bytes) -> tuple[dict[bytes, bytes], int, bool]:
    """The texts (UTF-16) by glyph code of a ToUnicode table, the bytes of a code, and whether each code of two bytes is its own text; files of one writer often share it."""
    out: dict[bytes, bytes] = {}
    hexed = lambda x: bytes.fromhex(x.decode())
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[hexed(code)] = hexed(to)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            first, n, unit = int(low, 16), int(high, 16) - int(low, 16) + 1, hexed(to)
            last = int.from_bytes(unit[-2:], "big")
            for k in range(min(n, (1 << 16) - last)):
                out[(first + k).to_bytes(len(low) // 2, "big")] = unit[:-2] + (last + k).to_bytes(2, "big")
    return out, max((len(k) for k in out), default=1), len(out) == 1 << 16 and all(len(k) == 2 and k == to for k, to in out.items())


class File:
    """The objects of a file."""

    def __init__(self, data: bytes) -> None:
        self.data, self.places, self.known = data, {}, {}
        self.trailer: dict = {}
        try:
            self.table(int(re.findall(rb"startxref\s+(\d+)", data)[-1]), set())
            self.get(self.trailer["Root"])["Pages"]
        except Exception:
            self.scan()

    def table(self, at: int, seen: set[int]) -> None:
        """A cross-reference table and those before it; later ones count."""
        head = re.compile(rb"\s*xref\s+").match(self.data, at)
        if not head or at in seen:
            raise ValueError("no table")
        seen.add(at)
        at = head.end()
        while section := re.compile(rb"\s*(\d+) (\d+)\s+").match(self.data, at):
            first, n = int(section[1]), int(section[2])
            entries = self.data[section.end() : section.end() + 20 * n]
            for k in range(n):
                place, _, kind = entries[20 * k : 20 * k + 18].split()
                if kind == b"n":
                    self.places.setdefault(first + k, int(place))
            at = section.end() + 20 * n
        trailer, _ = value(self.data, re.compile(rb"\s*trailer").match(self.data, at).end())
        self.trailer = {**trailer, **self.trailer}
        if "Prev" in trailer:
            self.table(trailer["Prev"], seen)

    def scan(self) -> None:
        """The objects as they stand in the file, later ones count; then those in object streams."""
        self.places, self.known = {int(m[1]): m.start() for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", self.data)}, {}
        for m in re.finditer(rb"\btrailer\b", self.data):
            try:
                self.trailer.update(value(self.data, m.end())[0])
            except ValueError:
                continue
        for number in list(self.places):
            try:
                found = self.get(Ref(number))
            except Exception:
                continue
            if isinstance(found, Stream) and found.get("Type") == "XRef":
                self.trailer.update({k: v for k, v in found.items() if k in ("Root", "Encrypt")})
            if isinstance(found, Stream) and found.get("Type") == "ObjStm" and "Encrypt" not in self.trailer:
                body = self.inflated(found)
                heads = [int(x) for x in body[: self.get(found["First"])].split()]
                for n, at in zip(heads[::2], heads[1::2]):
                    if n not in self.places:
                        self.known[n] = value(body, self.get(found["First"]) + at)[0]

    def get(self, item: object) -> object:
        """The object that a reference names; anything else as it is."""
        if not isinstance(item, Ref):
            return item
        if item.number not in self.known:
            if item.number not in self.places:
                return None
            head = re.compile(rb"\s*(\d+)\s+\d+\s+obj\b").match(self.data, self.places[item.number])
            if not head or int(head[1]) != item.number:
                raise ValueError("object is elsewhere")
            found, at = value(self.data, head.end())
            begin = re.compile(rb"\s*stream\r?\n").match(self.data, at)
            if isinstance(found, dict) and begin:
                found = Stream(found)
                n = self.get(found.get("Length"))
                end = begin.end() + n if isinstance(n, int) else self.data.index(b"endstream", begin.end())
                found.body = self.data[begin.end() : end]
            self.known[item.number] = found
        return self.known[item.number]

    def inflated(self, stream: Stream) -> bytes:
        kinds = self.get(stream.get("Filter")) or []
        for kind in kinds if isinstance(kinds, list) else [kinds]:
            if kind != "FlateDecode":
                raise ValueError(f"filter {kind}")
            stream_body = zlib.decompressobj()
            return stream_body.decompress(stream.body) + stream_body.flush()
        return stream.body

    def pages(self) -> Iterator[dict]:
        """The pages in order, each with what it inherits."""

        def below(node: object, known: dict, seen: tuple) -> Iterator[dict]:
            node = self.get(node)
            if not isinstance(node, dict) or len(seen) > DEPTH or id(node) in seen:
                raise ValueError("page tree")
            known = known | {k: v for k, v in node.items() if k in ("Resources",)}
            if "Kids" in node:
                for kid in self.get(node["Kids"]):
                    yield from below(kid, known, (*seen, id(node)))
            else:
                yield {**known, **node}

        root = self.get(self.trailer["Root"])
        yield from below(root["Pages"], {}, ())

    def codes(self, font: object) -> tuple[dict[bytes, bytes], int, bool]:
        """codes_of() of a font; without a table codes are Latin letters."""
        font = self.get(font) or {}
        table = self.get(font.get("ToUnicode"))
        if not isinstance(table, Stream):
            return {}, 2 if font.get("Subtype") == "Type0" else 1, False
        return codes_of(self.inflated(table))

    def text(self, page: dict) -> str:
        """What a page shows, in the order of its content; a move to another line is a line feed."""
        parts = self.get(page.get("Contents")) or []
        body = b"\n".join(self.inflated(self.get(p)) for p in (parts if isinstance(parts, list) else [page["Contents"]]))
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        out, stack, at, codes = [], [], 0, ({}, 1, False)
        units = bytearray()  # of UTF-16, as one character may be two codes

        def shown(raw: bytes) -> None:
            table, n, same = codes
            if same:
                units.extend(raw[: len(raw) // 2 * 2])
                return
            if not table and n == 1:
                units.extend(raw.decode("latin-1").encode("utf-16-be"))
                return
            for k in range(0, len(raw), n):
                units.extend(table.get(raw[k : k + n], b""))

        def line() -> None:
            out.append(units.decode("utf-16-be", "replace"))
            units.clear()

        while TOKEN.match(body, at):
            item, at = value(body, at)
            if not isinstance(item, Word):
                stack.append(item)
                continue
            if item == b"Tf":
                codes = self.codes(fonts.get(stack[-2]))
            elif item in (b"T*", b"'", b'"') or item in (b"Td", b"TD") and stack[-1] or item in (b"Tm", b"ET"):
                if units or item not in (b"Td", b"TD", b"Tm", b"ET"):
                    line()
            if item in (b"Tj", b"'", b'"'):
                shown(stack[-1])
            elif item == b"TJ":
                for part in stack[-1]:
                    if isinstance(part, bytes):
                        shown(part)
                    elif part < -200:  # a gap as wide as a space
                        shown(b"\x00 " if codes[1] == 2 else b" ")
            stack = []
        if units:
            line()
        return "\n".join(out)


def pages_of(data: bytes, most: int = 300) -> list[str]:
    """The text of each page; ValueError with a code of files.READER_CODES where there is none to be had.

    Of a document of over `most` pages as many empty ones are given, for the caller to refuse it.
    """
    if b"%PDF-" not in data[:1024]:
        raise ValueError("unreadable_pdf")
    try:
        found = File(data)
        encrypted = "Encrypt" in found.trailer
        pages = [] if encrypted else list(found.pages())
    except Exception as e:
        raise ValueError("unreadable_pdf") from e
    if encrypted:
        raise ValueError("encrypted_pdf")
    if len(pages) > most:
        return [""] * len(pages)
    try:
        return [found.text(p) for p in pages]
    except Exception as e:
        raise ValueError("page_extraction_failed") from e


# ---- writing --------------------------------------------------------------------------------------------


def packed(body: bytes) -> bytes:
    return b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(z := zlib.compress(body, 1)), z)


@lru_cache(maxsize=1)
def own_codes() -> bytes:
    """A ToUnicode table by which each code is its own text; the same in all files."""
    return packed(b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + b"".join(
        b"%d beginbfrange\n%s endbfrange\n" % (64, b"".join(b"<%02X00> <%02XFF> <%02X00>\n" % (h, h, h) for h in range(b, b + 64))) for b in range(0, 256, 64)
    ) + b"endcmap")


def document_of(pages: list[str]) -> bytes:
    """A PDF file with a page for each text, a line a line; any character that UTF-16 has."""
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> /MediaBox [0 0 595 842] >>" % (len(pages), b" ".join(b"%d 0 R" % (6 + 2 * k) for k in range(len(pages)))),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /DescendantFonts [5 0 R] /ToUnicode 4 0 R >>",
        own_codes(),
        b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Helvetica /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> >>",
    ]
    for k, text in enumerate(pages):
        lines = b" T*\n".join(b"<%s> Tj" % line.encode("utf-16-be", "surrogatepass").hex().encode() for line in text.split("\n"))
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (7 + 2 * k), packed(b"BT /F1 10 Tf 12 TL 50 800 Td\n" + lines + b"\nET")]
    out, places = bytearray(b"%PDF-1.7\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
    return bytes(out)


def documents_of(pages: DataFrame) -> DataFrame:
    """document_id, content of pages(document_id, page_number, text): a PDF file for each document, pages in order."""
    packed = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    laid_out = F.udf(lambda texts: document_of(texts), "binary")
    return packed.select("document_id", laid_out(F.col("p.text")).alias("content"))


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class FilesWriter(DataSourceArrowWriter):
    """Writes rows (name, content) as files of a folder; a task that fails leaves files that no manifest lists."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def place(self) -> tuple[fs.FileSystem, str]:
        return place_of(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = self.place()
        store.create_dir(path, recursive=True)
        names = []
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content")):
                draft = f"{path}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(content.as_py())
                store.move(draft, f"{path}/{name.as_py()}")  # so that no file is ever there in part
                names.append(name.as_py())
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = self.place()
        names = sorted(n for m in messages if m for n in m.files)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/manifest.json") as out:
            out.write("\n".join(json.dumps({"name": n}) for n in names).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = self.place()
        for name in (n for m in messages if m for n in m.files):
            store.delete_file(f"{path}/{name}")


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexfiles"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options)


def write_pack(pages: DataFrame, path: str) -> None:
    """pages(document_id, page_number, text) as a PDF file each document, document-<id>.pdf, and a manifest of them."""
    spark = pages.sparkSession
    spark.dataSource.register(FilesSink)
    name = F.concat(F.lit("document-"), F.col("document_id").cast("string"), F.lit(".pdf"))
    documents_of(pages).select(name.alias("name"), "content").write.format("lexfiles").mode("append").save(path)


#: Bytes of files that a task hands on at once, at least one file.
READ = 4 << 20


def pack_files(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, content of the files that the pack's manifest lists, as far as they are there.

    The manifest is dealt over the tasks, and each opens its files by name: the folder, which may have millions, is not
    listed by the driver, nor are the files read some thirty to a task as Spark's reader, which counts 4 MB for opening each, would.
    """
    listed = spark.read.schema("name string").json(f"{path}/manifest.json").filter(F.endswith("name", F.lit(".pdf")))
    return dealt(listed, "name").dropDuplicates(["name"]).mapInArrow(partial(contents, path), "path string, filename string, content binary")


def contents(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, filename, content of the files of a folder by name, in batches of some READ bytes."""
    store, folder = place_of(path)
    held: list[tuple[str, str, bytes]] = []

    def out() -> pa.RecordBatch:
        columns = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(next(columns), kind) for kind in (pa.string(), pa.string(), pa.binary())], ["path", "filename", "content"])

    size = 0
    for batch in batches:
        for name in batch.column(0).to_pylist():
            try:
                with store.open_input_stream(f"{folder}/{name}") as file:
                    body = file.read()
            except FileNotFoundError:
                continue
            held.append((f"{path}/{name}", name, body))
            size += len(body)
            if size >= READ:
                yield out()
                held, size = [], 0
    if held:
        yield out()
