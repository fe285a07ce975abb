"""Cases where an operator must do the whole job: small sets, held-back pairs, many languages, odd ids, long repetitive texts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import decontam, fingerprint, langid, neardup, ngramjoin, shingles, substrings
from tests.llm import brute


@pytest.mark.parametrize("percent, common, left, right", [(85, 6, 1, 0), (85, 12, 1, 1), (85, 17, 2, 1), (85, 17, 3, 0), (80, 4, 1, 0), (80, 8, 1, 1), (80, 12, 2, 1), (80, 16, 2, 2)])
def test_small_sets_at_the_threshold_share_a_band(percent, common, left, right):
    near, n = neardup.NearDup(percent=percent), 5000
    values = np.random.default_rng(common * 100 + left).integers(0, 1 << 64, (n, common + left + right), dtype=np.uint64)

    def keys(sets):
        sets = np.sort(sets, axis=1)
        regs = shingles.registers(np.repeat(np.arange(n), sets.shape[1]), sets.reshape(-1), n, near.buckets)
        return shingles.band_keys(regs, near.bands, near.rows)

    same = keys(values[:, : common + left]) == keys(np.delete(values, np.s_[common : common + left], axis=1))
    assert same.any(axis=1).all()


TEXTS = [" ".join(f"w{k}" for k in range(100)), " ".join(f"w{k}" for k in range(101)), " ".join(f"v{k}" for k in range(100))]


def test_pairs_are_looked_for_after_empty_forests(spark):
    class Cut(neardup.NearDup):
        def forest(self, regs, size):
            return []

    found = Cut().deduplicated(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(0, 0), (1, 0), (2, 2)]


def test_pairs_held_back_by_tried_ones_are_verified(spark):
    class Held(neardup.NearDup):
        def pairs(self, groups, reps, limit, *rest):
            if limit is not None and limit > 8:
                return super().pairs(groups, reps, limit, *rest)
            rid = {r.uid: r.rid for r in reps.collect()}
            keys = [] if limit is None else [r.key for r in groups.select("key").distinct().collect()]
            refused = [(min(rid[0], rid[2]), max(rid[0], rid[2]), None), *((None, None, k) for k in keys)]
            return reps.sparkSession.createDataFrame(refused, "a long, b long, held long")

    found = Held().deduplicated(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(0, 0), (1, 0), (2, 2)]


def template(k: int, shared: int, own: int) -> str:
    """A text whose first words many others share."""
    return " ".join([f"s{x}" for x in range(shared)] + [f"o{k}x{x}" for x in range(own)])


def test_many_classes_in_one_group_without_a_main_one(spark, monkeypatch):
    """Texts that share three quarters and so bands, but are not linked, beside real near copies among them."""
    texts = [template(k, 60, 20) for k in range(60)]
    texts += [texts[k] + " end" for k in range(0, 60, 7)] + [texts[3] + " fin", texts[3] + " end fin"]
    seen = []
    monkeypatch.setattr(neardup.NearDup, "rare_groups", lambda self, *a, real=neardup.NearDup.rare_groups: seen.append(1) or real(self, *a))
    found = neardup.NearDup(piece=4).deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute.near_groups(list(enumerate(texts)))) and seen


def test_blocks_of_a_hot_group_grow_with_its_classes(spark):
    near = neardup.NearDup(piece=64)
    rows = {}
    for n in (500, 1000):
        members = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("rid"))
        labels = spark.createDataFrame([], "node long, label long")
        groups, hot, _ = near.mixed_groups(members, labels)
        assert groups.count() == 0 and hot.count() == n
        # where even rare shingles don't tell them apart: each pair of chunks is a block of its own
        sizes = near.mixed_groups(members, labels, True)[0].groupBy("one", "two").count().collect()
        assert max(r["count"] for r in sizes) < 4 * near.piece
        main = near.mixed_groups(members, spark.range(n).filter("id > 20").select(F.col("id").alias("node"), F.lit(7).cast("long").alias("label")))
        rows[n] = main[0].count()
        assert main[1] is None and main[2] == rows[n]
    assert rows[1000] < 2.5 * rows[500] < 5000


@pytest.mark.parametrize("percent", [85, 80])
def test_bounds_of_losing_a_pair(percent):
    near = neardup.NearDup(percent=percent)
    assert (1 - (percent / 100) ** near.rows) ** near.bands <= 1e-10 and near.deviations >= 5 and near.bands * near.rows <= near.buckets


def test_every_language_set_that_can_win_is_fitted():
    rnd, k = np.random.default_rng(4), 20
    model = langid.Model([f"l{x}" for x in range(k)], rnd.normal(0, 0.35, (langid.BUCKETS, k)).astype(np.float32))
    vocabulary = ["".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(4000)]
    offsets = np.arange(len(vocabulary) + 1) * 6
    bucket, first, _ = langid.trigrams(np.frombuffer("".join(vocabulary).encode(), np.uint8), offsets)
    spoken = np.add.reduceat(model.table[bucket], first, axis=0).argmax(axis=1)
    texts = []
    for j in range(40):
        mix = rnd.dirichlet([1] * 6) if j % 4 == 0 else np.array([0.98 - j / 2000, 0.02 + j / 2000])
        languages = rnd.permutation(k)[: len(mix)]
        texts.append(" ".join(vocabulary[rnd.choice(np.flatnonzero(spoken == languages[rnd.choice(len(mix), p=mix)]))] for _ in range(600)).encode())
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = model.mixtures(data, offsets)
    bucket, first, size = langid.trigrams(data, offsets)
    likely = np.add.reduceat(model.table[bucket], first, axis=0)
    likely = np.exp(likely - likely.max(axis=1, keepdims=True))
    rank = np.argsort(np.argsort(-langid.fitted(likely, np.ones(len(likely)), size, np.ones((len(texts), k), np.float32))[0], axis=1, kind="stable"), axis=1)
    fits = [langid.fitted(likely, np.ones(len(likely)), size, (rank < m).astype(np.float32), 1 if m == 1 else langid.ROUNDS) for m in range(1, k + 1)]
    value = np.array([gain - m * 0.5 * np.log(size + 1.0) for m, (_, gain) in enumerate(fits)])
    want = np.array([fits[m][0][j] for j, m in enumerate(value.argmax(axis=0))])
    assert np.abs(got - want).max() < 1e-6 and (want > 0).sum(axis=1).max() > 4


def test_long_repetitive_texts_are_like():
    text = "x " * 65_538
    one, edited = fingerprint.of_texts([text]), fingerprint.of_texts([text + "and an end"])
    assert fingerprint.likeness(one, edited)[0] > 0.99


def test_rows_with_null_and_repeated_ids_are_judged_by_their_texts(spark):
    a, near, b = TEXTS
    c, d, e = (" ".join(f"{x}{k}" for k in range(100)) for x in "cde")
    rows = [(1, a), (None, near), (None, b), (None, b), (None, c), (5, d), (5, e), (5, d), (6, e), (7, ""), (7, ""), (7, None), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    want = [(1, a), (None, b), (None, c), (5, d), (5, e), (7, ""), (7, None), (None, ""), (None, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def opposites(n: int) -> tuple[str, str]:
    """A Thue-Morse text and its complement, which polynomials modulo a power of two can't tell apart."""
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_regular_texts_are_told_apart(spark, n):
    one, other = opposites(n)
    a, b = fingerprint.of_texts([one]), fingerprint.of_texts([other])
    assert not (a[0] == b[0]).any() and fingerprint.likeness(a, b)[0] < 0.5
    df = spark.createDataFrame([(0, f"{one} x y z w"), (1, f"{other} x y z w"), (2, f"{one} x y z w")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in neardup.NearDup().deduplicated(df).collect()) == [(0, 0), (1, 1), (2, 0)]
    texts = [one + "one", other + "other", "c" * 500 + one[:700]]
    got = substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).drop("n_passages")
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, *w) for k, w in enumerate(brute.repeats(texts)))


def test_long_texts_go_by_windows(spark, monkeypatch):
    """Every operator on slices gives the same for a text that is walked in windows."""
    from lexweave.llm import kernels

    rnd = np.random.default_rng(3)
    line = " ".join(f"w{x}" for x in rnd.integers(0, 4000, 3000))
    texts = [line + "\n" + " ".join(f"w{x}" for x in rnd.integers(0, 4000, 200)) + "\n" + line[:5000], line[300:9000] + "Zz" * 900, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bodies = [t.encode() for t in texts]

    def kinds():
        out = []
        for b in bodies:
            data, offsets = np.frombuffer(b, np.uint8), np.array([0, len(b)])
            out += [*fingerprint.vectors(data, offsets), *shingles.shingle_sets(data, offsets)]
        return out

    whole = kinds()
    for module in (kernels, fingerprint, shingles):
        monkeypatch.setattr(module, "SLICE_BYTES", 1000)
    assert all((a == b).all() for a, b in zip(whole, kinds(), strict=True))
    items = decontam.Search([("a", line[500:700]), ("b", "w1"), ("c", "Zz" * 300)])
    pieces = [items.spans(np.frombuffer(b, np.uint8), np.array([0, len(b)])) for b in bodies]
    monkeypatch.setattr(decontam, "SLICE_BYTES", 10**9)
    for (count, found), b in zip(pieces, bodies):
        again, want = items.spans(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        assert (count == again).all() and {d: (set(s), n) for d, (s, n) in found.items()} == {d: (set(s), n) for d, (s, n) in want.items()}
    assert pieces[0][1]
    model = langid.Model(["x", "y", "z"], rnd.normal(0, 0.5, (langid.BUCKETS, 3)).astype(np.float32))
    for b in bodies:
        shares = []
        for limit in (1000, 10**9):
            monkeypatch.setattr(langid, "SLICE_BYTES", limit)
            shares.append(model.mixtures(np.frombuffer(b, np.uint8), np.array([0, len(b)])))
        assert np.abs(shares[0] - shares[1]).max() < 1e-4
    repeats = substrings.Repeats()
    monkeypatch.setattr(substrings, "SLICE_BYTES", 1000)
    starts = repeats.all_runs(repeats.texts(df).repartition(1))
    assert sorted(tuple(r) for r in substrings.remove_repeats(df).drop("n_passages").collect()) == sorted((k, *w) for k, w in enumerate(brute.repeats(texts)))
    assert starts.filter("size > 2000").count() > 0


def spoken(lang: str, k: int) -> str:
    """A text with letters of its language only."""
    return " ".join("".join(lang[(k * 7 + x * 3 + y) % len(lang)] for y in range(4)) for x in range(12 + k % 5))


def test_no_language_is_lost_with_null_and_repeated_ids(spark):
    letters = {"de": "abcdefg", "fr": "hijklmn", "es": "opqrstu"}
    for odd in (2, 0, None):
        rows = [(4 * k + 1, spoken(letters["de"], k), "de") for k in range(300)] + [(None, spoken(letters["fr"], k), "fr") for k in range(600)] + [(odd, spoken(letters["es"], k), "es") for k in range(600)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
        model = langid.train(df, 50)
        right = langid.identify(df, model).filter("lang = lang_pred").groupBy("lang").count().collect()
        assert {r.lang: r["count"] for r in right} == {"de": 300, "fr": 600, "es": 600}


def test_the_sample_is_of_texts_whatever_their_copies(spark):
    texts = [spoken("abcdefg", k) + f" {'xyz'[k % 3]}" for k in range(40)]
    once = spark.createDataFrame([(4 * k + 1, t, "l") for k, t in enumerate(texts)], "doc_id long, text string, lang string").filter(~langid.held_out())
    one = once.orderBy("doc_id").first()
    rows = [(None, one.text, "l")] * 500
    own = [(4 * k + 1, one.text, "l") for k in range(2000, 2700)]  # and ids of their own
    copied = once.unionByName(spark.createDataFrame(rows, once.schema))
    other = once.unionByName(spark.createDataFrame(own, once.schema).filter(~langid.held_out()).limit(500))
    for sample in (7, 2000):
        assert (langid.train(copied, sample).table == langid.train(other, sample).table).all()
    assert (langid.train(once, 7).table != langid.train(once).table).any() and (langid.train(once).table != langid.train(copied).table).any()


def test_predictions_do_not_depend_on_the_number_of_labels(spark, monkeypatch):
    rows = [(k, spoken("abcdefg" if k % 2 else "hijklmn", k), "one" if k % 2 else "two") for k in range(80)]
    more = rows + [(None, f"{chr(97 + k % 26)}{chr(97 + k // 26)}q", f"l{k}") for k in range(300)]
    few, many = (langid.train(spark.createDataFrame(x, "doc_id long, text string, lang string")) for x in (rows, more))
    assert many.table.shape == (langid.BUCKETS, 302) and few.table.shape == (langid.BUCKETS, 2)
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, label string"), many)
    assert all(r.lang_pred == r.label for r in got.collect())
    monkeypatch.setattr(langid, "BROADCAST_TEXTS", 0)
    assert (langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).table == few.table).all()


def test_queries_at_once_keep_their_own_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    from lexweave.llm import mixing
    from lexweave.llm.common import scope

    texts = [template(k, 60, 4 + k % 9) for k in range(24)] + [template(k, 600, 5) for k in range(4)]
    df = spark.createDataFrame([(k, t, "en", f"src{k % 20}") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    runs = [lambda: neardup.NearDup().deduplicated(df), lambda: substrings.remove_repeats(df), lambda: mixing.mix_documents(df), lambda: corpus_pipeline.drop_near_duplicates(spark, df, "")]
    alone = [sorted((tuple(r) for r in run().collect()), key=repr) for run in runs]

    def scoped(run):
        with scope() as own:
            got = sorted((tuple(r) for r in run().collect()), key=repr)
            paths = list(own.paths)
            own.clear(spark)
        exists = [spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
        return got, paths, exists

    with ThreadPoolExecutor(4) as pool:
        together = list(pool.map(scoped, runs * 2))
    assert [g for g, _, _ in together] == alone * 2
    assert all(paths and not any(exists) for _, paths, exists in together)


def test_past_the_bounds_of_what_is_broadcast(spark, monkeypatch):
    """The ways beyond the thresholds give the same rows."""
    texts = [template(k, 60, 20) for k in range(12)] + [template(3, 60, 21), template(3, 60, 20), None, "", template(5, 60, 22)] + [template(k, 600, 5) for k in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def results():
        found = substrings.remove_repeats(df)
        pipe = corpus_pipeline.drop_near_duplicates(spark, df, "")
        return [sorted((tuple(r) for r in x.collect()), key=repr) for x in (neardup.NearDup(piece=3).deduplicated(df), found, pipe)]

    usual = results()
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(neardup, "MAX_COMMON", 3)
    monkeypatch.setattr(substrings, "BROADCAST_TEXTS", 0)
    assert results() == usual
    assert usual[0] == sorted(brute.near_groups(list(enumerate(texts))), key=repr)


def test_groups_come_from_one_shuffle(spark):
    join = ngramjoin.NgramJoin(piece=8)
    runs = [(5, 1, 0), (7, 40, 3), (9, 2, join.bands), (11, 16, join.bands + 1), (13, 17, join.bands), (15, 60, join.bands + 2), (17, 2, 1)]
    rows = spark.createDataFrame([(key, 100 * key + k, nth) for key, n, nth in runs for k in range(n)], "key long, rid long, nth int")
    want = {7: 40, 9: 2, 11: 16, 17: 2}
    for batch in (1, 3, 16, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        try:
            got = join.shared(rows).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert Counter(r.key for r in got) == want and len({r.rid for r in got}) == sum(want.values())
    plan = join.shared(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("bits", (8, 1 << 20))
def test_many_sets_are_looked_up_without_a_shuffle_of_texts(spark, monkeypatch, bits):
    near = neardup.NearDup()
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(9))) for k in range(40)] + [(3, "other words of one id that is twice there"), (None, "no id but words all the same here")], "doc_id long, text string")
    reps = near.sketches(docs).filter("uid % 3 = 0 and n > 0").selectExpr("cast(row_number() OVER (ORDER BY uid, sid) AS long) AS rid", "sid", "uid")
    reps = spark.createDataFrame(reps.collect(), reps.schema)
    want = {r.rid: sorted(r.shingles) for r in near.sets(docs, reps).collect()}
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(neardup, "MAP_BITS", bits)
    found = near.sets(docs, reps)
    assert {r.rid: sorted(r.shingles) for r in found.collect()} == want and len(want) == reps.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan  # ids are not joined to the texts
