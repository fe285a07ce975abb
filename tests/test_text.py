"""Text functions against Python's own, on awkward strings."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lexweave.functions import rules, text

STRINGS = [
    "", " ", "a", "Straße ÄÖ  \t x y", "one. two! three? four; five", "Срок подачи: 5 мая 2026.\nЦена 1 000 руб. Конец", "😀 bb (x|y) [z] 5% $9.50 a.b",
    "line one  \r\nline two\rthree\n\n\n\nfour \x00 five\t\n", "no end", "... !? ;;", "x y　z", "e.g. 3.5 apples; done.", "\n\n lead", "a\u001cb",
]


def column(spark, expr, strings=STRINGS):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(strings)], "k int, t string")
    return [r.v for r in df.select("k", expr.alias("v")).orderBy("k").collect()]


def test_collapsed(spark):
    assert column(spark, text.collapsed("t")) == [" ".join(s.casefold().split()) for s in STRINGS]


def test_normalized(spark):
    def plain(s):
        s = s.replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n")
        s = "\n".join(line.rstrip() for line in s.split("\n")).strip()
        return re.sub(r"\n{3,}", "\n\n", s)

    assert column(spark, text.normalized("t")) == [plain(s) for s in STRINGS]


def test_segments(spark):
    qa = [[m.group().strip() for m in re.finditer(r".+?(?:[.!?;](?=\s|$)|$)", s.strip(), re.S)] for s in STRINGS if "\r" not in s]
    assert column(spark, text.qa_segments("t"), [s for s in STRINGS if "\r" not in s]) == qa


def test_spans(spark):
    for s, got in zip(STRINGS, column(spark, text.analysis_spans("t"))):
        assert [s[g.lo : g.hi] for g in got] == [g.quote for g in got] and all(g.quote.strip() == g.quote != "" for g in got)
    pieces = column(spark, text.analysis_pieces("t"))
    assert ["".join(p) for p in pieces] == STRINGS


def test_tokens(spark):
    assert column(spark, text.lexical_query("t"), ["What is the Budget budget of LOT 42", "Какой срок СРОК для x1y", "a is"]) == ["budget | lot", "срок | x1y", ""]
    assert column(spark, text.qa_terms("t"), ["Which documents documented the deadline"]) == [["docume", "deadli"]]
    assert column(spark, text.rerank_tokens("t"), ["Ab abc ABC_1 é"]) == [["abc", "abc_1"]]


@pytest.mark.parametrize(("source", "quote", "want"), [
    ("abc def", "def", (4, 7)), ("😀 a\n b (c)", "a b (c)", (2, 10)), ("abc", "x", None), ("abc", " ", None), ("a.c abc", "abc", (4, 7)), ("x  y", "x y", (0, 4)), ("1+1 = 2", "1+1  =", (0, 5)),
])
def test_quote_span(spark, source, quote, want):
    df = spark.createDataFrame([(source, quote)], "s string, q string")
    got = df.select(text.quote_span("s", "q").alias("v")).first().v
    assert (tuple(got) if got else None) == want


def test_filenames(spark):
    names = ["../unsafe/x.pdf", "a\\b\\c.pdf", None, " ", "dir/", "n" * 300]
    assert column(spark, text.safe_filename("t"), names) == ["x.pdf", "c.pdf", "document.pdf", "document.pdf", "document.pdf", "n" * 255]


def test_rules(spark):
    df = spark.createDataFrame([("Какова начальная цена?", "Начальная цена: 5 000 руб"), ("When is the proposal deadline", "Proposal deadline is soon"), ("other", "x")], "q string, p string")
    assert [r.v for r in df.select(text.intent_score("q", "p").alias("v")).collect()] == [1, 0, 0]
    assert [r.v for r in df.select(text.question_category("q").alias("v")).collect()] == ["budget", "deadline", None]
    assert column(spark, text.expanded_query("t"), ["срок оплаты", "no trigger"]) == ["срок оплаты deadline due date payment", "no trigger"]
    assert len(rules.EXPANSIONS) == 10 and F is not None


def test_code_points(spark):
    assert column(spark, text.code_point_sum("t")) == [sum(map(ord, s)) for s in STRINGS]


def test_escape(spark):
    assert column(spark, text.html_escaped("t"), ["<a href=\"x\">&'"]) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#039;"]
