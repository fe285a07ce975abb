"""PDF files: what is written is read again, files of other writers, broken ones, and packs."""

from __future__ import annotations

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.sources import files, pdf

PAGES = ["Hello\nWorld (x) \\ <y>", "", "ЁЛКА 😀 é\n\nlast  line"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\r"), max_size=40), max_size=4))
def test_round_trip(pages):
    assert pdf.pages_of(pdf.document_of(pages)) == pages


def file_of(*objects: bytes, trailer: bytes = b"<< /Root 1 0 R >>") -> bytes:
    """A file without a cross-reference table."""
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj %s endobj" % (k, o) for k, o in enumerate(objects, 1)) + b"\ntrailer " + trailer


def one_page(content: bytes, fonts: bytes = b"<< /F1 << /Type /Font /Subtype /Type1 >> >>") -> bytes:
    return file_of(b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R] /Resources << /Font %s >> >>" % fonts, b"<< /Type /Page /Contents 4 0 R >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content))


@pytest.mark.parametrize("content, want", [
    (b"BT /F1 12 Tf 72 712 Td (A \\(simple\\) \\101 page) Tj 0 -14 Td (next) Tj ET", "A (simple) A page\nnext"),
    (b"BT /F1 9 Tf [(Kern) -10 (ed) -300 (line)] TJ ET % a comment ) here\nBT /F1 9 Tf (b) ' ET", "Kerned line\n\nb"),
    (b"BT /F1 9 Tf <48 69> Tj T* (nest (ed) \\\nline) Tj ET", "Hi\nnest (ed) line"),
    (b"q 1 0 0 1 0 0 cm Q", ""),
])
def test_contents_of_other_writers(content, want):
    assert pdf.pages_of(one_page(content))[0].strip("\n") == want.strip("\n")


def test_tables_of_characters_and_object_streams():
    table = zlib.compress(b"2 beginbfchar <01> <0416> <02> <D83DDE00> endbfchar 1 beginbfrange <10> <12> <0041> endbfrange")
    font = b"<< /F1 << /Type /Font /ToUnicode 5 0 R >> >>"
    content = b"BT /F1 1 Tf <0102101112> Tj ET"
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R] /Resources << /Font %s >> >>" % font, b"<< /Type /Page /Contents [4 0 R] >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content)]
    body = b"<< /Filter [/FlateDecode] /Length %d >>\nstream\n%s\nendstream" % (len(table), table)
    assert pdf.pages_of(file_of(*parts, body)) == ["Ж😀ABC"]
    inner = [p for p in parts[:3]]
    heads, at = b"", 0
    for k, p in enumerate(inner, 1):
        heads += b"%d %d " % (k, at)
        at += len(p) + 1
    packed = zlib.compress(heads + b"\n".join(inner))
    made = b"%PDF-1.5\n" + b"4 0 obj %s endobj\n5 0 obj %s endobj\n" % (parts[3], body) + b"6 0 obj << /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream endobj\n" % (len(heads), len(packed), packed)
    made += b"7 0 obj << /Type /XRef /Root 1 0 R /Length 0 >>\nstream\n\nendstream endobj\nstartxref\n9\n%%EOF"
    assert pdf.pages_of(made) == ["Ж😀ABC"]


def test_later_objects_count_and_a_broken_table_is_passed_over():
    made = pdf.document_of(PAGES)
    assert pdf.pages_of(made.replace(b"startxref\n", b"startxref\n9")) == PAGES
    later = made + b"\n1 0 obj << /Type /Catalog /Pages 99 0 R >> endobj 99 0 obj << /Kids [] >> endobj\nstartxref\n1\n"
    assert pdf.pages_of(later) == []


def damaged(made: bytes) -> bytes:
    at = made.index(b"stream\n", made.index(b"7 0 obj")) + 9
    return made[:at] + b"\xff\xff" + made[at + 2 :]


@pytest.mark.parametrize("body, code", [
    (b"", "unreadable_pdf"), (b"%PDF-1.4 nothing", "unreadable_pdf"), (b"<html>", "unreadable_pdf"), (file_of(b"<< /Pages 2 0 R >>", b"<< /Kids [2 0 R] >>"), "unreadable_pdf"),
    (pdf.document_of(PAGES).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"), "encrypted_pdf"), (damaged(pdf.document_of(PAGES)), "page_extraction_failed"),
    (one_page(b"BT (open Tj"), "page_extraction_failed"),
])
def test_codes(body, code):
    with pytest.raises(ValueError, match=f"^{code}$"):
        pdf.pages_of(body)


def test_a_pack_is_written_and_keeps_its_rules(spark, tmp_path):
    pages = spark.createDataFrame([(d, p, f"Page {p} of {d}: " + f"word{d} ü " * 40) for d in range(6) for p in range(1, 5)] + [(7, 1, None), (7, 2, " ")], "document_id long, page_number int, text string").repartition(3)
    path = str(tmp_path / "pack")
    pdf.write_pack(pages, path)
    (tmp_path / "pack" / "document-99.pdf").write_bytes(b"of a task that failed")
    listed = pdf.pack_files(spark, path)
    assert sorted(r.filename for r in listed.collect()) == [f"document-{d}.pdf" for d in (0, 1, 2, 3, 4, 5, 7)]
    extra = spark.createDataFrame([("x", bytearray(b"%PDF-junk")), ("y", bytearray(pdf.document_of([]))), ("z", bytearray(pdf.document_of(["p"] * 301)))], "path string, content binary")
    rows = listed.select(F.col("filename").alias("path"), "content").unionByName(extra).withColumn("error_code", F.lit(None).cast("string"))
    found = files.extracted(rows, pdf.pages_of)
    assert {r.path: r.error_code for r in found.filter("error_code is not null").collect()} == {"document-7.pdf": "no_extractable_text", "x": "unreadable_pdf", "y": "empty_pdf", "z": "too_many_pages"}
    read = found.filter("error_code is null").select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("document_id"), "page_number", "text")
    want = {(r.document_id, r.page_number): r.text.strip() for r in pages.filter("document_id < 6").collect()}
    assert {(r.document_id, r.page_number): r.text for r in read.collect()} == want
    quotes = read.select("document_id", "page_number", F.left("text", F.lit(20)).alias("quote"))
    assert files.pack_violations(read, quotes, 4, 300, 1200).count() == 0 and files.pack_violations(read, quotes, 5, 300, 1200).count() == 6


def test_a_pack_is_read_by_its_manifest_in_few_tasks(spark, tmp_path):
    path = str(tmp_path / "pack")
    pdf.write_pack(spark.createDataFrame([(d, 1, f"text {d}") for d in range(900)], "document_id long, page_number int, text string"), path)
    (tmp_path / "pack" / "document-5.pdf").unlink()
    listed = pdf.pack_files(spark, f"file://{path}")
    assert listed.rdd.getNumPartitions() <= max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))  # by Spark's reader 29, a task for 32 files
    rows = listed.collect()
    assert sorted(r.filename for r in rows) == sorted(f"document-{d}.pdf" for d in range(900) if d != 5)
    assert all(r.path == f"file://{path}/{r.filename}" and pdf.pages_of(bytes(r.content)) == [f"text {r.filename[9:-4]}"] for r in rows)


def test_codes_that_are_their_own_text():
    table = zlib.decompress(pdf.own_codes().split(b"stream\n")[1].rsplit(b"\nend", 1)[0])
    assert pdf.codes_of(table)[1:] == (2, True)
    assert not pdf.codes_of(table.replace(b"<4100> <41FF> <4100>", b"<4100> <41FF> <4200>"))[2] and not pdf.codes_of(table.replace(b"<4100> <41FF> <4100>", b"<4100> <41FE> <4100>"))[2]
    assert pdf.value(b"<4 14>", 0)[0] == b"\x41\x40" and pdf.value(b"<41\x0042>", 0)[0] == b"AB"
