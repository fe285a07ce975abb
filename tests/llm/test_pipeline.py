"""The pipeline's stages on the awkward table, and against plain versions."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from lexweave.llm import mixing
from tests.llm import brute
from tests.llm.test_documents import SCHEMA, made, plain_mixed


def test_stages(spark, tmp_path):
    rows = made()
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    item = " ".join(rows[10][1].split()[:14])
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, sf)
        if name != "sharding":
            assert done.columns == docs.columns
        done.write.parquet(f"{sf}/out{k}")
        before, docs = docs, spark.read.parquet(f"{sf}/out{k}")
        out[name] = [r.doc_id for r in docs.collect()]
        if name == "near_dedup":
            ids = [(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None]
            assert sorted(i for i in out[name] if i is not None) == sorted({w[0] for w in brute.near_groups(ids, 80) if w[3]})
    lettered = Counter(r[0] for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert Counter(out["language_id"]) == lettered
    assert rows[10][0] not in out["decontamination"] and set(out["decontamination"]) <= set(out["near_dedup"])
    assert len(out["near_dedup"]) - len(out["decontamination"]) == 1
    plain = plain_mixed(spark, mixing.MIXTURE, spark.read.parquet(f"{sf}/out2"), mixing.BUDGET_SHARE)
    assert Counter(out["mixing"]) == sum((Counter({ident: n}) for (ident, _, _), n in plain.items()), Counter())
    assert Counter(out["sharding"]) == Counter(out["mixing"])
    slots = defaultdict(list)
    sizes = Counter()
    for r in docs.collect():
        slots[r[-2]].append(r[-1])
        sizes[r[-2]] += len((r.text or "").encode()) + 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sizes.values()) <= sum(sizes.values()) / 8 + max(len((r.text or "").encode()) + 1 for r in docs.collect())


def test_awkward_rows_in_every_stage(spark, tmp_path):
    """Null columns, an id with several texts, repeated rows: no stage fails, and none takes more or less than its rule says."""
    sf = str(tmp_path)
    words = lambda x, n: " ".join(f"{x}{k}" for k in range(n))
    rows = [(1, words("a", 30), "en", "src1", 1), (1, words("b", 30), None, None, None), (None, words("c", 30), "en", None, 2), (None, words("c", 30), "en", None, 2), (2, None, "en", "src1", 0), (3, "", None, "src1", 0), (4, "12 34", "de", "src2", 5), (5, words("d", 30), "de", "src30", 9), (5, words("d", 30), "de", "src30", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, words("b", 12))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        seen.append(sorted((r.text[0] for r in docs.collect())))
    assert seen[:3] == [list("abccdd"), list("abcd"), list("acd")] and set(seen[3]) <= set("acd") and seen[4] == seen[3]


def test_empty(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
