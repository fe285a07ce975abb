"""Source divergence, hard negatives and the n-gram join against plain versions, with awkward rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import divergence, negatives, neardup, ngramjoin
from tests.llm import brute
from tests.llm.test_documents import made, SCHEMA
from tests.llm.test_whole import TEXTS, template


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- source divergence ----------------------------------------------------------------------------------


def audit(rows, least_docs=30, top=50):
    """(lang, source, part, item, value, rank) in whole numbers."""
    words = lambda t: [w.translate(brute.FOLD) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(words(text)))
        counts[lang, source].update(words(text))
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in docs[lang].items() if n >= least_docs]
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        own = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(own[s][w] - own[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, own[s][w] - q[w]) for w in kept if counts[lang, s][w] and own[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, top, block", [(3, 50, 512), (3, 4, 3), (1, 2, 1), (1000, 50, 512)])
def test_divergence(spark, least, top, block):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = divergence.Audit(least, top, block).audited(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(got) == audit([(r[1], r[2], r[3]) for r in rows], least, top)


def test_divergence_of_hot_vectors_long_texts_and_large_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 200)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rows = [("alpha " * 60 + "Beta " * 3, "x", "a"), ("beta " * 200, "x", "b"), ("y" * 900 + " beta", "x", "b"), ("é É", "x", "c"), ("", "x", "d"), (None, None, None)]
    rows += [(f"t{'abcdefghij'[k % 10]} same", "x", "a") for k in range(20)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert rows_of(divergence.Audit(1).audited(df)) == audit(rows, 1)
    big = divergence.shares(np.array([[1 << 60, 0]]), np.array([1 << 61, 7]))
    assert big.tolist() == [[1 + 10**9 * ((1 << 60) + 5) // (1 << 61), 1 + 5 * 10**9 // 7]]
    one = spark.createDataFrame([(1 << 60, 1 << 61)], "c long, d long").select(divergence.share("c", "d").alias("p")).first().p
    assert one == big[0, 0]
    assert rows_of(divergence.audit_sources(df.limit(0))) == []


# ---- hard negatives -------------------------------------------------------------------------------------


def mined(rows):
    kept = []
    for ident, vec, label in rows:
        if label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        kept.append((ident, (label + 1) % 10 if ident is not None and ident % 7 == 0 else label, [int(np.floor(256 * np.float64(x))) for x in vec]))
    ident_of = lambda k: (1 << 63) if kept[k][0] is None else kept[k][0]
    out = []
    for a, (ident, label, vec) in enumerate(kept):
        if ident is None or ident % 100:
            continue
        score = [sum(x * y for x, y in zip(vec, v)) for _, _, v in kept]
        order = sorted((k for k in range(len(kept)) if k != a), key=lambda k: (-score[k], ident_of(k)))
        for p in [k for k in order if kept[k][1] == label][:5]:
            fits = [k for k in order if kept[k][1] != label and 80 * score[p] <= 100 * score[k] <= 100 * score[p]]
            out += [(ident, kept[p][0], n, kept[k][0], score[p], score[k]) for n, k in enumerate(fits[:5], 1)]
    return sorted(out, key=repr)


def embeddings(n, seed, dims=12):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(0, 0.3, (6, dims))
    rows = [(int(k), (base[k % 6] + rnd.normal(0, 0.1, dims)).astype(np.float32).tolist(), int(rnd.integers(0, 4))) for k in range(n)]
    rows += [(n + k, rows[0][1], k % 3) for k in range(300)]  # a hot vector
    nan, inf = float("nan"), float("inf")
    rows += [(100, rows[5][1], 1), (100, rows[5][1], 1), (None, rows[0][1], 0), (None, rows[0][1], 1), (9001, None, 1), (9002, [nan] * dims, 1), (9003, [inf] * dims, 1), (9004, [None] * dims, 1), (9005, rows[0][1], None)]
    rows += [(9100, [], 0), (9101, [0.5], 0), (9102, [0.5, -1.0] * 20, 1), (9200, [-3.0] * dims, 2), (9300, [1e7] * dims, 3), (9301, [1e7] * dims, 0), (9302, [9e6] * dims, 3), (9400, [-0.9] * 3, 1)]
    return rows


EMBEDDINGS = "vec_id long, embedding array<float>, label int, rid string, score string"


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives(spark, seed, monkeypatch):
    rows = embeddings(400, seed)
    want = mined(rows)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], EMBEDDINGS).repartition(4)
    assert rows_of(negatives.mine_negatives(df)) == want and len(want) > 100
    monkeypatch.setattr(negatives, "CHUNK_COMPONENTS", 30)
    monkeypatch.setattr(negatives, "SPAN", 8)
    monkeypatch.setattr(negatives, "PAIRS", 64)
    assert rows_of(negatives.mine_negatives(df)) == want


def test_negatives_of_very_large_components_and_none(spark):
    rows = [(100, [1e30, -2e30], 1), (101, [1e30, 1e29], 1), (102, [2e29, 1e30], 2), (103, [1.0, 2.0], 1), (104, [1e-30, -1e-30], 3)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], EMBEDDINGS)
    got = negatives.mine_negatives(df).collect()
    assert all(-(1 << 63) < r.positive_score < 1 << 63 for r in got)
    assert negatives.mine_negatives(df.filter("vec_id <> 100")).collect() == [] and negatives.mine_negatives(df.limit(0)).collect() == []


@pytest.mark.parametrize("top", [100, 40_000, 1 << 26, 1 << 40])
def test_intervals_hold_their_products_and_narrow(top):
    rnd = np.random.default_rng(5)
    rows, anchors = rnd.integers(-top, top, (50, 9)), rnd.integers(-top, top, (7, 9))
    if top > 1 << 30:
        rows, anchors = rows.astype(object), anchors.astype(object)
    true, widths = rows.astype(object) @ anchors.astype(object).T, []

    def wanted(lower, upper, at, may):
        assert may is None or ((lower <= true) & (true <= upper)).all()
        widths.append(float(np.max(upper - lower)))
        return upper >= 0

    i, j, score = negatives.products(rows, anchors, np.ones((50, 7), bool), wanted)
    assert widths == sorted(widths, reverse=True) and widths[-1] == 0
    assert {(a, b, int(s)) for a, b, s in zip(i, j, score)} == {(a, b, min(int(true[a, b]), (1 << 63) - 1)) for a in range(50) for b in range(7) if true[a, b] >= 0}


# ---- n-gram join ----------------------------------------------------------------------------------------


def test_ngram_join(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = sorted({w[:3] for w in brute.near_groups([(r[0], r[1]) for r in rows if r[0] is not None], 80)})
    got = ngramjoin.join_ngrams(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted({tuple(r) for r in got.collect() if r.doc_id is not None}) == want
    assert got.filter("doc_id is null").count() == 1 and got.count() == len(rows)
    small = ngramjoin.NgramJoin(piece=4).deduplicated(df).drop("kept")
    assert rows_of(small) == rows_of(got)
    assert rows_of(ngramjoin.join_ngrams(df.limit(0))) == []


def test_tree_finds_every_pair_that_its_bound_allows():
    rnd = np.random.default_rng(2)
    points = rnd.poisson(2, (700, 32)).astype(np.uint16)
    points[350:] = np.maximum(points[:350].astype(int) + rnd.integers(-1, 2, (350, 32)) * (rnd.random((350, 32)) < 0.1), 0)
    size = points.sum(axis=1).astype(np.int64)
    tree = ngramjoin.CountTree(points, size, 80)
    at = np.arange(0, 700, 3)
    place, other, bound = tree.near(at)
    shared = np.minimum(points[at][:, None], points[None]).sum(axis=2, dtype=np.int64)
    both = size[at][:, None] + size[None]
    want = set(zip(*np.nonzero(shared * 180 >= both * 80)))
    assert set(zip(place.tolist(), other.tolist())) == {(int(a), int(b)) for a, b in want} and len(want) > len(at)
    assert np.allclose(bound, (shared / (both - shared))[place, other]) and len(tree.levels) > 2


@pytest.mark.parametrize("n, common", [(5, 4), (10, 9), (40, 36), (200, 178), (2000, 1778)])
def test_sets_at_the_threshold_share_a_cell(n, common):
    join, rnd = ngramjoin.NgramJoin(), np.random.default_rng(n)
    for _ in range(300):
        values = rnd.integers(0, 1 << 64, 2 * n - common, dtype=np.uint64)
        sets = [np.sort(values[:n]), np.sort(values[n - common :])]
        lows = [set(join.least(np.zeros(n, np.int64), s, np.array([n]))[0, : join.prefix(np.array([n]))[0]].tolist()) for s in sets]
        assert lows[0] & lows[1]


def test_a_hot_cell_and_many_alike_but_not_linked(spark):
    texts = [template(k, 60, 20) for k in range(60)] + [template(k, 60, 20) + " end" for k in range(0, 60, 7)] + [template(3, 60, 20) + " fin"]
    texts += [None, "", "  ", "one two", "One  two", "one two three four five"] + [" ".join(f"z{k}" for k in range(30))] * 20
    rows = list(enumerate(texts))
    want = [r[:3] for r in brute.near_groups(rows, 80)]
    for piece in (4, 1024):
        got = ngramjoin.NgramJoin(piece=piece).deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept")
        assert rows_of(got) == sorted(want, key=repr)


def test_a_frequent_shingle_makes_no_hot_group(spark, monkeypatch):
    """Many texts with one line in common: cells of its shingles have them all, bands don't."""
    texts = [template(k, 20, own) for k in range(60) for own in (60, 100)] + [template(k, 20, 100) + " end" for k in range(0, 60, 7)]
    seen = []
    monkeypatch.setattr(neardup.NearDup, "rare_groups", lambda self, *a, real=neardup.NearDup.rare_groups: seen.append(1) or real(self, *a))
    rows = list(enumerate(texts))
    got = ngramjoin.NgramJoin(piece=4).deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept")
    assert rows_of(got) == sorted((r[:3] for r in brute.near_groups(rows, 80)), key=repr) and not seen


def test_counts_past_a_byte_have_no_bound():
    join = ngramjoin.NgramJoin(groups=2)
    value = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 200_000, dtype=np.uint64))
    other = np.sort(np.concatenate((value[:190_000], np.random.default_rng(2).integers(0, 1 << 64, 9_000, dtype=np.uint64))))
    regs = []
    for v in (value, other):
        n = np.array([len(v)])
        regs.append(np.concatenate((join.least(np.zeros(len(v), np.int64), v, n).view(np.uint8), join.counts(np.zeros(len(v), np.int64), v, 1)), axis=1)[0])
    assert join.estimates(np.stack(regs), np.array([len(value), len(other)], np.float64), np.arange(2))[0, 1] >= 0.8


def test_large_groups_of_rare_shingles_are_cut_by_further_ones(spark):
    """Texts made of lines that many have: every shingle is frequent, so groups by one of them are large."""
    rnd = np.random.default_rng(8)
    lines = [" ".join(f"l{k}w{x}" for x in range(40)) for k in range(24)]
    texts = [" ".join(lines[k] for k in rnd.permutation(24)[:6]) for _ in range(300)]
    texts += [texts[k] + " end" for k in range(0, 300, 25)]
    rows = list(enumerate(texts))
    want = sorted(brute.near_groups(rows, 80), key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = neardup.NearDup(percent=80, piece=8)
    assert rows_of(near.deduplicated(df)) == want
    sketched = near.sketches(df).groupBy("sid").agg(F.min("uid").alias("uid"), F.first("n").alias("n")).select(F.monotonically_increasing_id().alias("rid"), "sid", "uid", "n").cache()
    labels = spark.createDataFrame([], "node long, label long")
    largest = {deep: near.__class__(percent=80, piece=8, deep=deep).rare_groups(df, sketched, sketched.select("rid"), labels).groupBy("key").count().agg(F.max("count")).first()[0] for deep in (1, 8)}
    assert largest[8] < largest[1] and largest[1] > 16
