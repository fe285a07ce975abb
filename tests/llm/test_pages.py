"""WARC archives, URL filters and chat formatting."""

from __future__ import annotations

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lexweave.llm import chatformat, queries, urlfilter, warc

PAGES = [
    (5, "http://a.example.com/en/71?q=1#f", "x" * 200), (3, "https://B.Example.com/en/8", "x" * 200), (9, "http://example.net/de/81", "x" * 200), (1, None, None), (2, "", ""), (4, "no scheme", "y" * 99),
    (6, "ftp://example.org", "y" * 99), (7, "http://notexample.com/en/7", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"), (7, "http://notexample.com/en/7", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"), (8, "http://x.net/de/a\r\nWARC-Type: fake", "z" * 300_000), (None, "http://com/en/", "x" * 200),
    (10, "http://EXAMPLE.net:80/de/8", "q" * 150), (11, "http://deep.a.example.net/de/8", "q" * 150), (12, "http://example.com/fr/en/7", "w"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "other", 1) for p in PAGES], "page_id long, url string, html string, digest string, n int")


@pytest.mark.parametrize("few", [500_000, 0])
def test_archive(pages, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", few)
    got = sorted((tuple(r) for r in warc.archive_pages(pages).collect()), key=repr)
    least: dict = {}
    for i, _, h in PAGES:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        again = len(body) >= 100 and i != least[h or ""]
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", least[h or ""] if again else None))
    assert got == sorted(want, key=repr)
    assert warc.archive_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("compress", ["gzip", "none"])
def test_reading(spark, pages, tmp_path, compress):
    path = str(tmp_path / "w")
    warc.register(spark)
    warc.page_records(pages).write.format("lexwarc").option("compress", compress).option("split_bytes", 500).option("roll_bytes", 2000).mode("append").save(path)
    every = warc.read_warc(spark, path)
    assert every.count() == len(PAGES)
    assert every.filter("record_type = 'revisit' and payload is null").count() == every.filter("record_type = 'revisit'").count() == 4
    light = warc.read_warc(spark, path, "record_id string, payload_length long").filter("record_id in ('<urn:page:8>', '<urn:page:12>')")
    assert sorted(r.payload_length for r in light.collect()) == [1, 300_000]
    assert [r.payload_digest for r in every.filter("target_uri like 'http://deep%'").collect()] == ["sha256:" + hashlib.sha256(b"q" * 150).hexdigest()]
    files = [f for f in os.listdir(path) if "part-" in f and not f.startswith(".")]
    assert len(files) > 1
    if compress == "gzip":  # any gzip reader can read it
        assert sum(gzip.open(f"{path}/{f}").read().count(b"WARC-Record-ID: <urn") for f in files) == len(PAGES) - 1
    for f in os.listdir(path):
        if f.startswith("_manifest"):
            os.remove(f"{path}/{f}")
    assert warc.read_warc(spark, path).count() == len(PAGES)  # without a manifest


def test_overwriting_leaves_nothing_behind(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.register(spark)
    for part in (pages, pages.filter("page_id = 8")):
        warc.page_records(part).write.format("lexwarc").mode("overwrite").save(path)
    left = [f for f in os.listdir(path) if not f.startswith(".")]
    assert warc.read_warc(spark, path).count() == 1 and len(left) == 2


def test_pushdown_skips_payloads(spark, tmp_path, pages):
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import StructType

    reader = warc.WarcReader(StructType.fromDDL(warc.RECORD_SCHEMA), {"path": str(tmp_path)})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_length",), 5)]))
    assert len(left) == 1 and reader.wanted({"warc-type": "response"}) and not reader.wanted({"warc-type": "revisit"})


def test_url_filter(pages):
    got = sorted((tuple(r) for r in urlfilter.filter_urls(pages, queries.RULES).collect()), key=repr)
    want = []
    for i, u, _ in PAGES:
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:]
            path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        best = max(((len(h) + len(p), a, f"{h}/{p}") for a, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith("/" + p)), default=(0, "allow", None))
        want.append((i, host, path, best[2], best[1]))
    assert got == sorted(want, key=repr)
    assert {w[4] for w in want} == {"allow", "block"}
    # a list longer than a chunk, as rows or as a table
    listed = pages.sparkSession.createDataFrame(list(queries.RULES), "action string, host string, path string")
    for rules in (queries.RULES, listed):
        assert sorted((tuple(r) for r in urlfilter.filter_urls(pages, rules, limit=12).collect()), key=repr) == sorted(want, key=repr)
    assert urlfilter.filter_urls(pages.limit(0), queries.RULES).count() == 0


def test_block_wins_a_tie():
    root = urlfilter.compile_rules([("allow", "a.org", "x"), ("block", "a.org", "x")])
    assert urlfilter.judge(root, "b.a.org", "/xyz")[2] == "block" and urlfilter.judge(root, "ba.org", "/xyz") is None


def test_many_entries_of_one_host():
    """A lookup does not walk the host's entries."""
    root = urlfilter.compile_rules([("block", "a.org", f"p/{k}") for k in range(50_000)] + [("allow", "a.org", "p/77/")])
    node = root.labels["org"].labels["a"].segments[""].segments["p"]
    assert len(node.open) == 50_000 and len(node.sizes) == 5
    assert urlfilter.judge(root, "a.org", "/p/49999x")[3] == "a.org/p/49999" and urlfilter.judge(root, "a.org", "/p/77/z")[2] == "allow"
    assert urlfilter.judge(root, "a.org", "/p/x") is None


TURNS = [
    (1, 2, "assistant", "a <|end|>\n& b &lt; c"), (1, 0, "system", "be <b>"), (1, 1, "user", "hi"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "assistant", "first"), (4, 0, None, "x"), (4, 1, "<|turn|>user", "y"),
    (5, 0, "user", "twin"), (5, 0, "user", "twin"), (6, None, "user", "q"), (6, 1, "assistant", "😀" * 5), (None, 0, "user", "nobody"), (7, 0, "user", "w " * 50_000), (7, 1, "assistant", "&amp;" * 1000), (8, 0, "system", "alone"),
    (9, 0, "us\ner", "hi"), (9, 1, "&#10;\n\n<", "there\n&#10;"),
]


def test_chat(spark):
    df = spark.createDataFrame([(*t, "f", 0) for t in TURNS], "conv_id long, turn long, role string, text string, formatted string, segments int")
    formatted = chatformat.format_conversations(df)
    got = {r.conv_id: r for r in queries.chat_digests(formatted).collect()}
    raw = {r.conv_id: r for r in formatted.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv in {t[0] for t in TURNS}:
        turns = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        loss = "".join(t[2] for t in turns if t[1] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss), len(raw[conv].formatted))
        assert "".join(s.text for s in raw[conv].segments) == raw[conv].formatted
    assert {k for k, r in got.items() if r.valid} == {1, 2, 6, 7, None}
    assert chatformat.format_conversations(df.limit(0)).count() == 0


def test_chat_runs_no_python(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    plan = queries.chat_digests(chatformat.format_conversations(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and F is not None
