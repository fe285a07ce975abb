"""Chunks, retrieval, analysis, answers, ranking data and files on small cases."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.operators import analysis, chunking, library, metrics, qa, rerank, retrieval, service
from lexweave.sources import files
from lexweave.streaming import ingest


def test_chunks(spark):
    body = "First sentence here. Second one follows; third: and more words without end " * 9 + "\n\n" + "tail " * 30
    pages = spark.createDataFrame([(1, 1, body, len(body)), (1, 2, " \n ", 3), (1, 3, None, 0), (1, 4, "x", 1), (1, 5, "y" * 700, 700)], "document_id long, page_number int, text string, char_count int")
    got = chunking.chunked(pages, 200, 40)
    rows = got.orderBy("page_number", "chunk_index").collect()
    assert {r.page_number for r in rows} == {1, 4, 5}
    for r in rows:
        page = {1: body, 4: "x", 5: "y" * 700}[r.page_number]
        assert page[r.start_char : r.end_char] == r.text and len(r.text) <= 200 and r.text.strip() == r.text
    assert chunking.broken(got, pages, 200).count() == 0
    assert chunking.with_pages(got, pages).count() == len(rows)
    for bad in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            chunking.chunked(pages, *bad)


def test_chunks_are_cut_by_blocks_of_bytes(spark):
    texts = ["", None, "ü" * chunking.BLOCK, " \n ", *(f"Satz {k}. é 😀\n" * (k % 400) for k in range(1500))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([1] * len(texts), pa.int32()), pa.array([t or "" for t in texts])], ["document_id", "page_number", "text"])
    parts = list(chunking.blocks(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 4
    assert all(p.num_rows == 1 or sum(len(t.encode()) for t in p.column(2).to_pylist()) <= chunking.BLOCK for p in parts)
    got = chunking.chunked(spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "document_id long, page_number int, text string").repartition(2), 300, 30)
    assert got.schema.simpleString() == "struct<document_id:bigint,page_number:int,chunk_index:int,start_char:int,end_char:int,text:string>"
    assert sorted(map(tuple, got.collect())) == [(d, 1, k, lo, hi, t[lo:hi]) for d, t in enumerate(texts) if t for k, (lo, hi) in enumerate(chunking.spans(t, 300, 30))]


def test_hybrid(spark):
    chunks = spark.createDataFrame([(1, "maximum contract value: 500 USD", [1.0, 0.0]), (2, "value value value", [0.9, 0.1]), (3, "nothing", None), (4, None, [0.0, 0.0])], "chunk_id long, text string, embedding array<float>")
    asked = spark.createDataFrame([(1, "maximum contract value", [1.0, 0.0]), (2, "the value", None), (3, "is a", None)], "query_id long, query string, vector array<float>")
    got = {(r.query_id, r["rank"]): r for r in retrieval.hybrid(asked, chunks).collect()}
    assert (got[1, 1].chunk_id, got[1, 1].intent, got[1, 1]["mode"]) == (1, 1, "hybrid")
    assert (got[2, 1].chunk_id, got[2, 1]["mode"], got[2, 1].semantic_score) == (2, "lexical", None)
    assert not any(q == 3 for q, _ in got)
    assert abs(got[1, 1].rrf_score - (1 / 61 + 1 / 62)) < 1e-9 or got[1, 1].rrf_score > 1 / 61
    assert [r.chunk_id for r in retrieval.missing(chunks).collect()] == [3] and retrieval.wrong_dimension(chunks, 3).count() == 3


def test_conditions(spark):
    body = "Maximum budget: 1 000 USD net. The budget is open. Срок подачи 5 мая 2026; submission deadline\nПоставщик обязан. Penalty 5%! maximum  budget: 1 000 usd NET."
    pages = spark.createDataFrame([(1, 1, body), (2, 1, "nothing")], "document_id long, page_number int, text string")
    found = analysis.conditions(pages)
    rows = found.orderBy("document_id", "number").collect()
    assert [(r.category, r.number) for r in rows] == [("deadline", 1), ("deadline", 2), ("budget", 3), ("penalty", 4), ("requirement", 5)]
    assert all(body[r.start_char : r.end_char] == r.quote for r in rows) and rows[0].score == 0.83
    docs = pages.select("document_id")
    cover = {r.document_id: r for r in analysis.coverage(docs, found).collect()}
    assert cover[1].coverage == 1 and cover[2].missing == "deadline,budget,penalty,requirement"
    checks = analysis.risks(docs, found).filter("document_id = 1").orderBy("position").collect()
    assert [(c.rule_id, c.citation) for c in checks] == [("deadline_compliance", 1), ("budget_fit", 3), ("penalty_exposure", 4), ("eligibility_evidence", 5)]
    missing = analysis.risks(docs, found).filter("document_id = 2 and position = 2").first()
    assert (missing.rule_id, missing.title, missing.grounded) == ("missing_budget", "Budget not found", False)


def test_conditions_of_one_category(spark):
    """Only its patterns are evaluated, and a document's rows are dealt once."""
    body = "Maximum budget: 1 000 USD net. Submission deadline\n \n  Penalty 5%!  \x1c Penalty of 7%.\nBudget 5 EUR"
    pages = spark.createDataFrame([(1, 1, body), (1, 2, body + "; fine 3 %"), (2, 1, None), (3, 1, " \n ")], "document_id long, page_number int, text string")
    every, columns = analysis.conditions(pages), ["document_id", "category", "place", "page_number", "start_char", "end_char", "quote", "score"]
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    for name in analysis.CATEGORIES:
        one = analysis.conditions(pages, only=name)
        assert ("liquidated" in one._jdf.queryExecution().optimizedPlan().toString()) == (name == "penalty")
        assert one._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        want = every.filter(F.col("category") == name).select(columns).collect()
        assert sorted(one.select(columns).collect()) == sorted(want)
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert {r.quote for r in every.filter("category = 'penalty'").collect()} == {"Penalty 5%!", "Penalty of 7%.", "fine 3 %"}


def test_highlight(spark):
    cases = [
        ("A <b> must\n show & must show", "MUST show", 'A &lt;b&gt; <mark class="x">must\n show</mark> &amp; must show'),
        ("plain", " ", "plain"),
        ("a+b", "a+b", '<mark class="x">a+b</mark>'),
        ("Piece  of it", "a longer piece of it, and more", '<mark class="x">Piece  of it</mark>'),
        ("of it", "a longer piece of it", "of it"),
        (None, "q", None),
        ("t & u", None, "t &amp; u"),
    ]
    df = spark.createDataFrame([(k, *c[:2]) for k, c in enumerate(cases)], "k int, t string, q string")
    got = df.select("k", analysis.highlighted(F.col("t"), F.col("q"), "x").alias("v")).orderBy("k").collect()
    assert [r.v for r in got] == [c[2] for c in cases]


def test_answers(spark):
    hits = spark.createDataFrame([(1, 1, "Intro. The penalty applies. Penalty: 5% a day!", 100), (1, 2, "Insurance is needed. A subcontract is allowed.", 0)], "d long, page_number int, text string, start_char int")
    proof = qa.evidence(hits, ["d"], ["page_number"])
    asked = spark.createDataFrame([(1, "What is the penalty?"), (2, "Which policy number?"), (3, "What percentage may a subcontract take?"), (4, "intro please"), (5, "Где зебра?")], "q long, question string")
    got = {r.q: r for r in qa.extracted(proof, asked, ["d"], ["q"]).collect()}
    assert (got[1].evidence_id, got[1].quote) == ("C1", "Penalty: 5% a day!")
    assert [got[k].cannot_answer for k in (2, 3, 4, 5)] == [True, True, False, True]
    claims = spark.createDataFrame([(1, 1, 1, "a ", "C1", "Penalty:  5%"), (1, 1, 2, "b", "C9", "Intro."), (1, 1, 3, "c", "C2", "Insurance"), (1, 1, 6, "d", "C1", "Intro.")], "d long, q long, ord int, claim string, evidence_id string, quote string")
    checked = qa.verified(claims, proof.join(asked, F.lit(True)), ["d", "q"])
    assert [(r.number, r.start_char, r.quote) for r in checked.orderBy("number").collect()] == [(1, 128, "Penalty: 5%"), (2, 0, "Insurance")]
    final = {r.q: r for r in qa.answers(asked.withColumn("d", F.lit(1).cast("long")), checked, ["d", "q"]).collect()}
    assert final[1].answer == "a [1] c [2]" and final[5].answer.startswith("В найденных") and not final[2].grounded
    assert '<C1 page="1">' in qa.prompt(proof, ["d"]).first().prompt
    drafts = spark.createDataFrame([(1, json.dumps({"cannot_answer": False, "claims": [{"text": "t", "evidence_id": "C1", "quote": "q"}, {"text": "", "evidence_id": "C2", "quote": "q"}, {"text": "t", "evidence_id": "X", "quote": "q"}]})), (2, "bad")], "d long, draft string")
    assert [(r.d, r.ord) for r in qa.draft_claims(drafts, ["d"]).collect()] == [(1, 1)]


def test_ranking(spark):
    rows = spark.createDataFrame([("a", "test", "q", 0, "p", 1.0, 0.5), ("a", "test", "q", 1, "n", 0.0, 0.5), ("a", "test", "q", 2, "m", 0.0, 0.1), ("b", "test", "q", 0, "p", 1.0, 0.9), ("b", "test", "q", 1, "n", 0.0, 0.2)], "id string, split string, query string, position int, passage string, label double, score double")
    got = {r.id: r for r in rerank.predictions(rows).collect()}
    assert (got["a"].positive_rank, got["a"].best_position, got["b"].positive_rank) == (2, 1, 1)
    m = rerank.metrics(rerank.predictions(rows)).first()
    assert (m.hit_at_1, m.mrr, m.mean_rank) == (0.5, 0.75, 1.5) and abs(m.ndcg_at_3 - (1 + 0.63093) / 2) < 1e-4
    bad = spark.createDataFrame([("a", "P x", ["n", "p  X"]), ("b", "p", ["n"]), ("c", "p", ["n", "m"])], "id string, positive string, negatives array<string>")
    assert sorted(r.id for r in rerank.invalid(bad).collect()) == ["a", "b"]


def test_examples(spark):
    scenarios = spark.createDataFrame([(7, "train", "en", "1 May", "5 USD", "3 days")], "document_id long, split string, language string, deadline string, budget string, delivery string")
    templates = [("en", c, v, f"{c} {v} is {{value}}", c.title(), k) for k, c in enumerate(("deadline", "budget", "delivery"), 1) for v in range(3)]
    rows = rerank.fact_arrays(scenarios, ["deadline", "budget", "delivery"], spark.createDataFrame(templates, "language string, category string, variant int, passage string, heading string, page_number int"))
    want = {c: sum(map(ord, f"7:{c}")) % 3 for c in ("deadline", "budget", "delivery")}
    assert {f.category: f.variant for f in rows.first().facts} == want
    questions = spark.createDataFrame([("en", "deadline", 1, "budget when"), ("en", "deadline", 2, "x"), ("en", "budget", 1, "x"), ("en", "delivery", 1, "x"), ("de", "budget", 1, "y")], "language string, category string, nth int, question string")
    asked = rerank.asked(rows, questions)
    made = {r.id: r for r in rerank.examples(asked).collect()}
    assert sorted(made) == ["7-budget-q1", "7-deadline-q1", "7-deadline-q2", "7-delivery-q1"]
    first = made["7-deadline-q1"]
    assert first.negative_categories == ["delivery", "budget"]  # easily confused before more words in common
    assert (first.positive, first.source_page, first.language) == (f"deadline {want['deadline']} is 1 May", 1, "en")
    assert made["7-budget-q1"].negative_categories == ["delivery", "deadline"]  # a tie: the later name first
    every = rerank.examples(asked)
    assert rerank.invalid(every).count() == 0 and rerank.duplicate_ids(every).count() == 0
    assert sorted(r.split for r in rerank.missing_splits(every).collect()) == ["test", "validation"]
    assert rerank.selected(every, "train").count() == 4 and rerank.language_summary(every).first().examples == 4
    odd = every.withColumn("negative_categories", F.array(F.lit("one")))
    assert rerank.invalid(odd).count() == 4


def test_conditions_of_hits(spark):
    chunks = spark.createDataFrame(
        [(1, 1, 1, 0, "Penalty: 5% a day."), (1, 2, 2, 50, "A fine is due. penalty:  5% a DAY."), (1, 3, 3, 0, "Maximum budget: 10 USD.")], "document_id long, chunk_id long, page_number int, start_char int, text string"
    )
    asked = analysis.category_queries(spark)
    penalty = [r.query_id for r in asked.filter("category = 'penalty'").orderBy("query_ord").collect()]
    found = spark.createDataFrame([(1, penalty[0], "lexical", 1, 2), (1, penalty[1], "hybrid", 1, 1), (1, penalty[1], "hybrid", 2, 2)], "document_id long, query_id long, mode string, rank int, chunk_id long")
    hits = analysis.category_hits(found, asked)
    assert {r.chunk_id: tuple(r.hit) for r in hits.collect()} == {2: (0, 1), 1: (1, 1)}
    rows = analysis.conditions_of_hits(hits.join(chunks, ["document_id", "chunk_id"])).orderBy("number").collect()
    assert [(r.category, r.chunk_id, r.start_char, r.end_char) for r in rows] == [("penalty", 2, 65, 84), ("penalty", 2, 50, 64)]  # no budget: its queries found nothing
    assert analysis.retrieval_modes(found).first().modes == "hybrid,lexical"


def test_search_within_documents(spark):
    chunks = spark.createDataFrame([(1, 1, "price price", [1.0, 0.0]), (1, 2, "price", [0.0, 1.0]), (2, 3, "price", None), (2, 4, "price", None)], "document_id long, chunk_id long, text string, embedding array<float>")
    asked = spark.createDataFrame([(1, "the price", [0.0, 1.0])], "query_id long, query string, vector array<float>")
    got = {(r.document_id, r["rank"]): (r.chunk_id, r["mode"]) for r in retrieval.hybrid(asked, chunks, 1, ("document_id",)).collect()}
    assert got == {(1, 1): (2, "hybrid"), (2, 1): (3, "lexical")} or got == {(1, 1): (1, "hybrid"), (2, 1): (3, "lexical")}
    places = chunks.withColumns({"page_number": F.col("chunk_id"), "chunk_index": F.lit(0)})
    assert [r.chunk_id for r in retrieval.work_order(places, 2).collect()] == [3, 4]


def test_service(spark):
    with pytest.raises(ValueError):
        service.Settings(chunk_size=100, chunk_overlap=100)
    assert service.Settings().max_upload_bytes == 20 * 1024 * 1024
    service.checked(query="ab", limit=20, offset=0)
    for bad in ({"query": "a"}, {"limit": 0}, {"limit": 21}, {"question": "x" * 2001}, {"offset": -1}):
        with pytest.raises(ValueError):
            service.checked(**bad)
    codes = spark.createDataFrame([(1, "invalid_pdf"), (2, "odd"), (3, None)], "k int, c string").orderBy("k")
    assert [r.m for r in codes.select(service.message(F.col("c")).alias("m")).collect()] == [service.MESSAGES["invalid_pdf"][0], service.MESSAGES[""][0], None]
    nothing = spark.createDataFrame([], "document_id long, answerable boolean, hit_at_5 boolean, reciprocal_rank double, page_correct boolean, quote_correct boolean, refused boolean, search_ms double, answer_ms double")
    assert tuple(service.evaluation_report(nothing).first()) == (0,) * 11
    old = spark.createDataFrame([("test", 0.5), ("validation", 0.9)], "split string, hit_at_1 double")
    new = spark.createDataFrame([("test", 0.75), ("validation", 0.9)], "split string, hit_at_1 double")
    assert {r.split: r.improved for r in service.improvements(old, new).collect()} == {"test": True, "validation": False}
    totals = service.file_totals(spark.createDataFrame([(10, 2, 3), (5, 1, 1)], "size_bytes long, answerable long, questions long")).first()
    assert tuple(totals) == (2, 15, 3, 1, 0.75)
    rows = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "c array<string>")
    assert [r.s for r in rows.select(service.scored_citation(F.col("c")).alias("s")).collect()] == ["a", None, None]


def test_metrics(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (10, 20, 30, 40)], "k string, v double")
    assert metrics.percentiles(rows, ["k"], "v", {"p": 0.95}).first().p == 38.5
    none = metrics.refusals(spark.createDataFrame([], "answerable boolean, grounded boolean")).first()
    assert (none.grounded_rate, none.refusal_accuracy) == (0, 0)


def test_dedupe(spark):
    rows = spark.createDataFrame([(3, "x", 5), (1, "x", 5), (2, "y", 1)], "doc_id long, sha256 string, created_at long")
    got = {r.doc_id: (r.original_id, r.deduplicated) for r in library.first_by_hash(rows).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (1, True)}


def test_files(spark, tmp_path):
    top = tmp_path / "in"
    top.mkdir()
    (top / "a.pdf").write_bytes(b"%PDF-1.4 one\x0cpage two")
    (top / "b.pdf").write_bytes(b"not one")
    (top / "c.pdf").write_bytes(b"")
    (top / "d.pdf").write_bytes(b"%PDF-1.4 one\x0cpage two")
    found = files.uploads(spark, str(top))
    rows = {r.filename: r for r in found.collect()}
    assert rows["a.pdf"].error_code is None and rows["b.pdf"].error_code == "invalid_pdf" and "c.pdf" not in rows
    pages = files.extracted(found, lambda b: b.decode().split("\x0c"))
    assert pages.count() == 4 and files.extracted(found, lambda b: [" "]).filter("error_code = 'no_extractable_text'").count() == 2
    listed = spark.createDataFrame([("1", "a.pdf", rows["a.pdf"].sha256), ("2", "b.pdf", "x"), ("3", "z.pdf", "x")], "id string, filename string, sha256 string")
    assert {r.id: r.verdict for r in files.file_verdicts(listed, found).collect()} == {"1": "same", "2": "no_pdf", "3": "missing"}


def test_json(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id":"a","negatives":["x"]}\n\n{"id":\n{"id":"b"}\n')
    rows = files.json_lines(spark, str(path)).orderBy("line_number").collect()
    assert [(r.line_number, r.id, r.error) for r in rows] == [(1, "a", False), (3, None, True), (4, "b", False)]
    df = spark.createDataFrame([("ключ", 1)], "b string, a int")
    files.write_json_lines(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":1,"b":"ключ"}'
    assert files.differing_lines(df, str(tmp_path / "out")).count() == 0
    assert files.differing_lines(df.withColumn("a", F.lit(2)), str(tmp_path / "out")).count() == 2
    (tmp_path / "e.json").write_text(json.dumps({"name": "n", "pages": ["one", "two"], "questions": []}))
    assert [(r.page_number, r.text) for r in files.evaluation_pages(files.json_documents(spark, str(tmp_path / "e.json"), files.EVALUATION)).collect()] == [(1, "one"), (2, "two")]
    question = {"id": "q", "language": "en", "question": "?", "answerable": True, "expected_pages": [0], "expected_quote_fragments": ["x"]}
    (tmp_path / "m.json").write_text(json.dumps({"name": "n", "documents": [{"id": "d", "filename": "a/b.pdf", "sha256": "s", "questions": [question]}]}))
    broken = files.manifest_violations(files.manifest_documents(files.json_documents(spark, str(tmp_path / "m.json"), files.MANIFEST)))
    assert sorted(r.rule for r in broken.collect()) == ["filename_has_a_path", "one_sided_questions", "page_below_one"]


def test_embeddings_are_incremental(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "")], "chunk_id long, text string")
    first = files.with_missing_embeddings(chunks, spark.createDataFrame([(1,)], "chunk_id long"), lambda c: files.feature_embedding(c, 16))
    assert [(r.chunk_id, len(r.embedding)) for r in first.collect()] == [(2, 16)]


def test_providers_are_checked(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, None)], "chunk_id long, text string")
    none = spark.createDataFrame([], "chunk_id long")
    lengths = files.embedding_provider(lambda texts: [[len(t), 1.0] for t in texts], 2, 1)
    assert sorted((r.chunk_id, list(r.embedding)) for r in files.with_missing_embeddings(chunks, none, lengths).collect()) == [(1, [3, 1]), (2, [0, 1])]
    pairs = spark.createDataFrame([("q", "p"), ("q", "pp")], "query string, passage string")
    scorer = rerank.pair_scorer(lambda rows: [len(p) / 2 for _, p in rows], 1)
    assert sorted(r.s for r in pairs.select(scorer(F.col("query"), F.col("passage")).alias("s")).collect()) == [0.5, 1.0]
    for bad in (files.with_missing_embeddings(chunks, none, files.embedding_provider(lambda texts: [], 2)), files.with_missing_embeddings(chunks, none, files.embedding_provider(lambda texts: [[1.0]] * len(texts), 2)), pairs.select(rerank.pair_scorer(lambda rows: [1.0] * 3)("query", "passage"))):
        with pytest.raises(Exception, match="vectors|scores"):
            bad.collect()


def test_dense_search_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0] if k % 11 else None if k % 2 else [0.0, 0.0, 0.0]) for k in range(60)] + [(99, [1.0])], "chunk_id long, embedding array<double>")
    asked = rows.filter("chunk_id % 3 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(tuple(r) for r in retrieval.dense(asked, rows, 4).collect())
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_QUERIES", 5)
    assert sorted(tuple(r) for r in retrieval.dense(asked, rows, 4).collect()) == whole and len(whole) > 60
    assert retrieval.dense(asked.limit(0), rows, 4).count() == 0


def test_masks_of_many_words(spark):
    """More words than one long has bits."""
    vocabulary = [f"w{k}" for k in range(150)]
    df = spark.createDataFrame([(vocabulary, [f"w{k}" for k in range(0, 150, 7)], [f"w{k}" for k in range(0, 160, 5)])], "v array<string>, a array<string>, b array<string>")
    both = df.select(rerank.token_mask(F.col("a"), F.col("v")).alias("a"), rerank.token_mask(F.col("b"), F.col("v")).alias("b"), F.size("a").alias("n"), F.size("b").alias("m"))
    got = both.select(rerank.mask_overlap(F.col("a"), F.col("b"), F.col("n"), F.col("m")).alias("s")).first().s
    assert abs(got - 5 / (22 * 32) ** 0.5) < 1e-12


def test_facts_are_ranked_by_documents(spark, monkeypatch):
    """Whatever the slices: other facts by preference, score and name, as a plain version finds them; documents without facts or questions are left out."""
    kinds = ["a", "b", "c", "d"]
    scenarios = [(k, "train", "en" if k % 3 else "xx", *(f"w{k * 7 % 80} w{(k + j) % 80} tail{k}" if (k + j) % 4 else None for j in range(4))) for k in range(40)]
    templates = [("en", c, v, f"{c}{c}{c} w{v} w7 is {{value}}", c, v + 1) for c in kinds for v in range(2)] + [("xx", "a", 0, "{value}", "a", 1)]
    questions = [("en", c, n, " ".join(f"w{x}" for x in range(20 * n, 20 * n + 40))) for c in kinds[:3] for n in (1, 2)]
    rows = rerank.fact_arrays(spark.createDataFrame(scenarios, "document_id long, split string, language string, a string, b string, c string, d string"), kinds, spark.createDataFrame(templates, "language string, category string, variant int, passage string, heading string, page_number int"))
    known = {"a": ("c",)}
    tokens = lambda t: {w for w in t.split() if len(w) > 2}
    want = {}
    for r in rows.collect():
        for language, c, n, q in questions:
            own = [f for f in r.facts if f.category == c]
            if r.language == language and own and len(r.facts) > 1:
                score = lambda f: len(tokens(q) & tokens(f.passage)) / (len(tokens(q)) * len(tokens(f.passage))) ** 0.5  # noqa: E731,B023
                others = sorted((f for f in r.facts if f.category != c), key=lambda f: (f.category in known.get(c, ()), round(score(f), 6), f.category), reverse=True)[:2]  # noqa: B023
                want[r.document_id, c, n] = [(f.category, f.passage, f.category in known.get(c, ()), round(score(f), 6)) for f in others]
    assert len(want) > 60
    asked = rerank.asked(rows, spark.createDataFrame(questions, "language string, category string, nth int, question string"))
    for compared in (1 << 18, 7):
        monkeypatch.setattr(rerank, "COMPARED", compared)
        got = {}
        for r in rerank.hard_negatives(asked, 2, known).orderBy("place").collect():
            got.setdefault((r.document_id, r.category, r.nth), []).append((r.negative_category, r.negative, r.preferred, r.score))
        assert got == want
    made = rerank.pairs(rerank.examples(asked, 2), "overlaps").collect()
    assert len(made) == sum(1 + len(v) for v in want.values())
    assert all(abs(r.score - len(tokens(r.query) & tokens(r.passage)) / (len(tokens(r.query)) * len(tokens(r.passage))) ** 0.5) < 1e-12 for r in made)


def test_examples_are_counted_without_ranking(spark):
    """The same rows as examples(), but no task of Python and no words; each question takes just its own ranking into its row."""
    scenarios = [(k, "test" if k % 4 == 0 else "train", "en", f"x{k}", None if k % 3 == 0 else f"y{k}") for k in range(12)]
    templates = [("en", c, 0, f"{c} {{value}}", c, 1) for c in "ab"]
    rows = rerank.fact_arrays(spark.createDataFrame(scenarios, "document_id long, split string, language string, a string, b string"), ["a", "b"], spark.createDataFrame(templates, "language string, category string, variant int, passage string, heading string, page_number int"))
    asked = rerank.asked(rows, spark.createDataFrame([("en", c, n, f"which {c}{c}{c} {n}") for c in "ab" for n in (1, 2)], "language string, category string, nth int, question string"))
    plain = rerank.unranked(asked)
    assert sorted(plain.collect()) == sorted(rerank.examples(asked).select(plain.columns).collect()) and plain.count() == 8 * 2 * 2
    assert rerank.unranked(asked, 0).count() == rerank.examples(asked, 0).count() == 0
    plan = rerank.language_summary(plain)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "tokens" not in plan.split("Generate")[0]
    names = [f.name for f in rerank.negatives_of(asked).schema]
    assert "every" not in names and "found" in names


def test_ranks_of_scores_in_an_array(spark):
    """Ties count against the positive, and the last of the best is the best."""
    rows = spark.createDataFrame([(1, [1.0]), (2, [0.5, 0.5, 0.1]), (3, [0.2, 0.9, 0.9, 0.2]), (4, [0.0, -0.0]), (5, [2.0, 1.0, 1.0])], "id int, overlaps array<double>").withColumn("split", F.lit("x"))
    got = {r.id: (r.positive_rank, r.best_position) for r in rerank.predictions_of(rows).collect()}
    assert got == {1: (1, 0), 2: (2, 1), 3: (4, 2), 4: (2, 1), 5: (1, 0)}


def test_manifests_are_made_by_document(spark):
    """A document's questions stand in its row, without a shuffle of them; rows of one document are put together."""
    schema = "document_id long, language string, facts array<struct<category:string,page_number:int,passage:string>>, asked array<struct<of:int,nth:int,question:string>>"
    row = lambda ident, *of: (ident, "en", [("b", 2, "pb"), ("a", 1, "pa")], [(k, n, f"q{n}") for k, n in of])
    one = spark.createDataFrame([row(1, (0, 1), (1, 2), (1, 1)), row(2, (1, 1)), row(3)], schema)
    made = files.manifest_of(one)
    assert "collect_list" not in made._jdf.queryExecution().toString()
    assert {r.document_id: [q.id for q in r.questions] for r in made.collect()} == {1: ["a-q1", "a-q2", "b-q1"], 2: ["a-q1"]}
    two = files.manifest_of(one.unionByName(spark.createDataFrame([row(1, (0, 2)), row(None, (0, 1)), row(None, (1, 1))], schema)))
    assert {r.document_id: [(q.id, q.expected_pages, q.expected_quote_fragments) for q in r.questions] for r in two.collect() if r.document_id != 2} == {
        1: [("a-q1", [1], ["pa"]), ("a-q2", [1], ["pa"]), ("b-q1", [2], ["pb"]), ("b-q2", [2], ["pb"])], None: [("a-q1", [1], ["pa"]), ("b-q1", [2], ["pb"])]}


def test_quotes(spark):
    docs = spark.createDataFrame([(1, "The  GOODS are\nlisted here"), (2, "goods are listed"), (3, "nothing"), (4, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "oods are list"), (2, "listed here"), (3, "goods zebra listed"), (4, "not")], "item_id long, quote string")
    assert sorted(tuple(r) for r in metrics.quoting(docs, quotes).collect()) == [(1, 1), (1, 2), (2, 1), (3, 4)]


def test_constraints(spark):
    documents = spark.createDataFrame([("x", 1, "ready"), ("x", 0, "odd")], "sha256 string, size_bytes long, status string")
    pages = spark.createDataFrame([(1, 1)], "document_id long, page_number int")
    chunks = spark.createDataFrame([(1, 2, 0, 5, 5)], "document_id long, page_number int, chunk_index int, start_char int, end_char int")
    assert files.constraint_violations(documents, pages, chunks).count() == 5


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string").write.parquet(source)
    assert ingest.ingest_stream(spark, source, path=out).count() == 2
    spark.createDataFrame([(4, "a"), (5, "b")], "doc_id long, text string").write.mode("append").parquet(source)
    assert ingest.ingest_stream(spark, source, path=out).count() == 3


def test_states_are_kept_between_runs(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id long, at long, status string"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        return sorted(tuple(r) for r in ingest.drained(spark, ingest.moved(ingest.opened(spark, source)), out).collect())

    first = run([(1, 2, "ready"), (1, 1, "processing"), (2, 1, "ready"), (None, 1, "failed"), (3, 1, None)])
    assert first == [(1, 1, "processing"), (1, 2, "ready")]
    assert run([(1, 3, "failed"), (2, 2, "processing"), (2, 3, "failed"), (2, 4, "processing")]) == first + [(2, 2, "processing"), (2, 3, "failed"), (2, 4, "processing")]


def test_a_value_is_compared_with_two_edges_a_percentile(spark):
    rows = spark.range(5000).selectExpr("'g' AS g", "cast(id * 7 % 5000 AS double) AS v")
    found = metrics.percentiles(rows, ["g"], "v", {"p50": 0.5, "p95": 0.95})
    assert tuple(found.first()) == ("g", 2499.5, 4749.05)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "0.001" not in plan and "0.949" in plan


def test_percentiles_are_counted_in_ranges(spark, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(3)
    groups = {"a": rnd.normal(0, 9, 3000), "b": np.repeat([1.0, 2.0, 5.0], [1000, 1, 999]), "c": np.array([4.0]), "d": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None), (None, 1.5)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "high": 1.0}
    for ranges in (1000, 7):
        monkeypatch.setattr(metrics, "RANGES", ranges)
        got = {r.g: [r[n] for n in shares] for r in metrics.percentiles(df, ["g"], "v", shares).collect()}
        assert set(got) == {"a", "b", "c", "d", None} and got[None] == [1.5] * 5
        for g, vs in groups.items():
            assert np.allclose(got[g], np.quantile(vs, list(shares.values())), atol=1e-6)
    whole = metrics.percentiles(df.filter("g = 'a'"), [], "v", {"p50": 0.5}).first()
    assert abs(whole.p50 - np.median(groups["a"])) < 1e-6 and metrics.percentiles(df.limit(0), [], "v", {"p50": 0.5}).count() <= 1


def test_dense_hands_on_the_best_of_a_task(spark, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(4)
    rows = [(k, k % 5, rnd.normal(size=6).astype(np.float32).tolist()) for k in range(900)]
    vectors = spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<float>").repartition(2).cache()
    queries = spark.createDataFrame([(q, rnd.normal(size=6).astype(np.float32).tolist()) for q in range(4)], "query_id long, vector array<float>")
    show = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", F.round("semantic_score", 9), "dense_rank").collect()))
    want, within = show(retrieval.dense(queries, vectors, 7)), show(retrieval.dense(queries, vectors, 2, ("document_id",)))
    assert len(want) == 28 and len(within) == 40
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        handed = queries.sparkSession.sparkContext.broadcast(queries.toArrow())
        sent = vectors.select("chunk_id", F.col("embedding").cast("array<double>")).mapInArrow(lambda b: retrieval.nearest(handed, 7, 0, b), "query_id long, chunk_id long, semantic_score double").count()
        assert sent <= 2 * 4 * 7
        assert show(retrieval.dense(queries, vectors, 7)) == want and show(retrieval.dense(queries, vectors, 2, ("document_id",))) == within
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_every_failure_of_a_reader_has_a_listed_code(spark):
    def reader(body):
        if body == b"key":
            return [{}[0]]
        if body == b"bytes":
            return [b"\xff".decode()]
        if body == b"code":
            raise ValueError("unreadable_pdf")
        raise ValueError(body.decode())

    rows = [(k, bytearray(b), None) for k, b in (("a", b"key"), ("b", b"bytes"), ("c", b"code"), ("d", b"anything"), ("e", b"empty_pdf"))]
    got = files.extracted(spark.createDataFrame(rows, "path string, content binary, error_code string"), reader)
    failed = "page_extraction_failed"
    assert {r.path: r.error_code for r in got.collect()} == {"a": failed, "b": failed, "c": "unreadable_pdf", "d": failed, "e": failed}


def test_evidence_that_questions_share_is_not_repeated(spark):
    """The same answers from hits of a document as from hits of each of its questions; evidence is dealt into tasks that stay apart."""
    hits = qa.evidence(spark.createDataFrame([(d, p, f"The budget is {d}{p} EUR.") for d in range(6) for p in (1, 2)], "d long, page_number int, text string"), ["d"], ["page_number"])
    assert hits.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    hits = hits.withColumn("start_char", F.lit(0))
    claims = spark.createDataFrame([(d, q, 1, "c", f"C{q}", f"is  {d}{q}") for d in range(6) for q in (1, 2, 3)], "d long, q long, ord int, claim string, evidence_id string, quote string")
    each = hits.join(spark.range(1, 4).withColumnRenamed("id", "q"))
    got, want = (sorted(qa.verified(claims, h, ["d", "q"]).collect()) for h in (hits, each))
    assert got == want and len(got) == 12


def test_many_questions_go_block_by_block(spark, monkeypatch):
    proof = spark.createDataFrame([(d, "C1", 1, f"The budget is {d}00 EUR. Delivery takes {d} days.") for d in range(3)], "document_id long, evidence_id string, evidence_rank int, text string")
    questions = spark.createDataFrame([(q, f"What is the {w}?") for q, w in enumerate(("budget", "delivery", "colour", "budget limit", "delivery time", "tax"))], "question_id long, question string")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(("one two", "two  Three four five", None))], "doc_id long, text string")
    quotes = spark.createDataFrame([(k, q) for k, q in enumerate(("two", "one", "ONE two", "three", "two three four", "x"))], "item_id long, quote string")
    show = lambda: [sorted(map(str, map(tuple, df.collect()))) for df in (qa.extracted(proof, questions, ["document_id"], ["question_id"]), metrics.quoting(docs, quotes))]
    want = show()
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_QUERIES", 2)
    assert show() == want and len(want[0]) == 18 and len(want[1]) == 6


def test_citations_are_counted_without_windows(spark):
    many = " ".join(f"Penalty: {k}% per day of late delivery." for k in range(1, 9))
    body = [(1, 1, "Submission deadline: 3 May 2024. Maximum budget: 500 USD."), (1, 2, "Submission  DEADLINE: 3 May 2024. The bidder must show a certificate."), (2, 1, many), (2, 2, many), (3, 1, "Nothing of note."), (5, 1, "Penalty: 2%.")]
    pages = spark.createDataFrame(body, "document_id long, page_number int, text string")
    documents = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (None,)], "document_id long")
    found = analysis.conditions(pages)
    want = analysis.cited_chunks(found, analysis.risks(documents, found))
    got = analysis.citation_counts(documents, pages)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r.document_id: r.citations for r in got.collect()}[2] == 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Generate explode") <= 2  # conditions are found once
