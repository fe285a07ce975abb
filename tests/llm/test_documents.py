"""The operators on documents, on a table with every awkward case, against plain versions."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import decontam, fingerprint, kernels, langid, mixing, neardup, sharding, substrings
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, score double, tokens long, starts string, uid long, size int, part int, k int, __k1 string, domain string"
WORDS = {x: [f"{x}{a}{b}" for a in ("ra", "sol", "min", "té", "ß", "qu") for b in ("on", "er", "ita", "ung", "ö", "s")] for x in ("en", "de", "fr", "es")}


def made(seed: int = 3) -> list[tuple]:
    rnd = random.Random(seed)
    say = lambda lang, n: " ".join(rnd.choice(WORDS[lang]) for _ in range(n))
    texts: list[tuple[str | None, str | None, str | None]] = []
    for _ in range(60):
        lang = rnd.choice(list(WORDS))
        texts.append((".\n".join(say(lang, rnd.randint(3, 60)) for _ in range(rnd.randint(1, 6))), lang, f"src{rnd.randint(0, 19)}"))
    base = say("en", 150)
    for _ in range(25):  # near copies, with a word changed here and there
        words = base.split()
        for _ in range(rnd.randint(1, 6)):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS["en"])
        texts.append((" ".join(words), "en", "src0"))
    passage = say("fr", 70)
    texts += [(f"{say('fr', rnd.randint(5, 90))} {passage} {say('fr', rnd.randint(5, 90))}", "fr", "src0") for _ in range(15)]
    texts += [(base, "en", "src0")] * 12
    texts += [(None, None, None), ("", "de", "src1"), (" \n\t ", None, "odd"), ("12 34 !!", "en", "src2"), ("ab", "en", "src3"), ("Ñ", "es", "src4"), ("x " * 900, "en", "src5"), ("aa" * 1000, "en", "src6"), (say("de", 9000), "de", "src7"), ("😀 " + say("es", 30), "es", None)]
    rows = [(k * 3, t, lang, source, len(t or ""), "s", 1, 0.5, 7, "x", 9, 8, 6, 4, "z", "d") for k, (t, lang, source) in enumerate(texts)]
    return rows + rows[:3] + [(None, "nobody knows this one", "en", "src8", 21, "s", 1, 0.5, 7, "x", 9, 8, 6, 4, "z", "d")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs).collect()
    want = made()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((w[0], len((w[1] or "").encode()) + 1, zlib.crc32((w[1] or "").encode())) for w in want if w[0] is not None)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(8))
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    total, longest = sum(r.size for r in got), max(r.size for r in got)
    by_shard = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    groups = defaultdict(int)
    for r in got:
        groups[r.text_crc32] += r.size
    assert all(len(s) == 1 or groups[k] > 0.04 * total / 8 for k, s in where.items() if k)  # null and empty texts are two groups
    assert max(by_shard) - total / 8 <= max(longest, 0.05 * total / 8) + total / 100
    assert sharding.shard_documents(empty).count() == 0


def test_shards_near_equal_with_a_hot_group(spark):
    rows = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text " * 10)).otherwise(F.repeat(F.col("id").cast("string"), (F.col("id") % 40 + 1).cast("int"))).alias("text"))
    sizes = [r.s for r in sharding.shard_documents(rows).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.03 * sum(sizes) / 8 and min(sizes) > 0.97 * sum(sizes) / 8


def test_a_large_table_has_more_ranges(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.xxhash64("id").cast("string")).alias("text"))
    light = sharding.RangeSharder().keyed(df, "text", "doc_id", False).select("__k1", "__k2", sharding.byte_size("text").alias("__size")).cache()
    few = sharding.RangeSharder(2, 4).fit(light)
    monkeypatch.setattr(sharding, "RANGE_BYTES", 1000)
    many = sharding.RangeSharder(2, 4).fit(light)
    total = light.agg(F.sum("__size")).first()[0]
    assert few.per_shard == 4 and many.per_shard == -(-total // 2000)
    counts = many.ranged(light).groupBy("__range").agg(F.sum("__size").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert counts[0] < 3 * 1000 and counts[1] > 0.7 * total / 1000


def test_small_groups_stay_together_and_rows_of_one_key_are_cut(spark):
    groups = spark.range(150).select(F.explode(F.sequence(F.lit(1), F.col("id") % 8 + 2)).alias("k"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    shards = sharding.shard_documents(groups.select(F.monotonically_increasing_id().alias("doc_id"), "text")).groupBy("text_crc32").agg(F.count_distinct("shard").alias("n"), F.count("*").alias("c"))
    assert shards.filter("n > 1 and c < 5").isEmpty() and shards.filter("n > 1").count() <= 7
    same = spark.range(8000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    counts = [r["count"] for r in sharding.shard_documents(same).groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) < 1.1 * 1000
    slots = defaultdict(list)
    for r in sharding.sharded(same.withColumn("more", F.lit(1))).collect():
        slots[r.shard].append(r.slot)
    assert len(slots) == 8 and all(sorted(s) == list(range(len(s))) and len(s) < 1.1 * 1000 for s in slots.values())


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, empty, percent):
    got = rows_of(neardup.NearDup(percent=percent).deduplicated(docs).filter("doc_id is not null"))
    # rows with one id are judged by the id; here they have one text
    want = sorted(set(brute.near_groups([(r[0], r[1]) for r in made() if r[0] is not None], percent)), key=repr)
    assert sorted(set(got), key=repr) == want and len(got) == len(made()) - 1
    null = neardup.NearDup(percent=percent).deduplicated(docs).filter("doc_id is null").collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in null] == [(1, None, True)]
    assert neardup.NearDup().deduplicated(empty).count() == 0


def test_near_duplicates_in_small_pieces(docs):
    small = neardup.NearDup(piece=6).deduplicated(docs).filter("doc_id is not null")
    assert sorted(set(rows_of(small)), key=repr) == sorted(set(brute.near_groups([(r[0], r[1]) for r in made() if r[0] is not None])), key=repr)


@pytest.mark.parametrize("group", [2000, 2])
def test_repeated_substrings(docs, empty, group):
    texts = made()
    want = sorted(((r[0], *b) for r, b in zip(texts, brute.repeats([r[1] for r in texts]))), key=repr)
    got = substrings.remove_repeats(docs, substrings.Repeats(group=group)).cache()
    assert rows_of(got.drop("n_passages")) == want
    shared = {n: brute.sharing([r[1] for r in texts], n) for n in (51, 32)}
    found = {r.doc_id for r in got.filter("n_passages > 0").collect()}
    assert {texts[k][0] for k in shared[51]} <= found <= {texts[k][0] for k in shared[32]} and len(shared[51]) < len(texts)
    assert sum(w[2] for w in want) > 0
    assert substrings.remove_repeats(empty).count() == 0


def test_repeats_at_every_offset(spark):
    rnd = random.Random(5)
    alphabet = "ab "  # few letters: many repeats by chance, periods, overlaps
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 1500))) for _ in range(30)]
    texts += [texts[k][a : a + n] + texts[j][:200] for k, j, a, n in ((1, 2, 10, 700), (3, 4, 0, 399), (5, 6, 0, 400), (7, 8, 100, 401))] + ["ab" * 700, "ab" * 350]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(substrings.remove_repeats(df).drop("n_passages")) == sorted(((k, *b) for k, b in enumerate(brute.repeats(texts))), key=repr)


def test_decontamination(spark, docs, empty):
    texts = [r for r in made() if r[1]]
    items = [("a", " ".join(texts[70][1].split()[5:40]).upper()), ("b", "ab"), ("c", None), ("d", "..."), ("e", " ".join(texts[100][1].split()[2:10])), ("a2", " ".join(texts[70][1].split()[5:40])), (None, texts[3][1])]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id string, text string, n_words string")
    got = rows_of(decontam.decontaminate(docs, bench))

    def windows(t):
        w = brute.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.FOLD))
        return w, ([tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))] if w else [])

    owners = defaultdict(set)
    for ident, t in items:
        for x in windows(t)[1]:
            owners[x].add(ident)
    want = []
    for r in made():
        w, _ = windows(r[1])
        hit, who = set(), set()
        for x, ids in owners.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    who |= ids - {None}
        want.append((r[0], len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=repr) and any(w[2] for w in want)
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_by_chunks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(k, r[1]) for k, r in enumerate(made()[:20])], "item_id long, text string")
    whole = rows_of(decontam.decontaminate(docs, bench))
    monkeypatch.setattr(decontam.chunks, "__defaults__", (2000,))
    assert rows_of(decontam.decontaminate(docs, bench)) == whole


def test_language_id(docs, empty, spark):
    got = {r.doc_id: r for r in langid.identify_documents(docs).collect()}
    texts = {r[0]: r for r in made()}
    for ident, r in got.items():
        text, lang = texts[ident][1:3]
        assert 0 <= r.score <= 1 and r.held_out == (ident is not None and zlib.crc32(str(ident).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif len(text) > 60 and lang is not None and any(w in text for w in WORDS[lang]):
            assert r.lang_pred == lang
    assert langid.identify_documents(empty).count() == 0
    nothing = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify_documents(nothing).collect()] == [("und", 0.0)]


def plain_words(text):
    """The trigram buckets of each word."""
    found = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())
    return [langid.trigrams(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0].tolist() for w in found]


def plain_language(model, text):
    """(language, share) by expectation-maximisation over nested sets, a word at a time."""
    table = model.table.tolist()
    logs = [[sum(table[b][k] for b in word) for k in range(len(model.languages))] for word in plain_words(text)]
    if not logs or not any(c.isalpha() for c in text):
        return "und", 0.0
    likely = [[math.exp(x - max(row)) for x in row] for row in logs]

    def fit(allowed, rounds):
        share = {k: 1 / len(allowed) for k in allowed}
        for _ in range(rounds):
            new = dict.fromkeys(allowed, 0.0)
            for row in likely:
                total = max(sum(row[k] * share[k] for k in allowed), 1e-30)
                for k in allowed:
                    new[k] += row[k] * share[k] / total
            whole = sum(new.values())
            share = {k: v / whole for k, v in new.items()} if whole > 0 else share
        return share, sum(math.log(max(sum(row[k] * share[k] for k in allowed), 1e-30)) for row in likely)

    full = fit(list(range(len(model.languages))), langid.ROUNDS)[0]
    order = sorted(full, key=lambda k: -full[k])
    fits = [fit(order[:m], langid.ROUNDS) for m in range(1, len(order) + 1)]
    values = [gain - m * 0.5 * math.log(len(likely) + 1) for m, (_, gain) in enumerate(fits, 1)]
    best = fits[values.index(max(values))][0]
    name = max(best, key=lambda k: best[k])
    return model.languages[name], best[name]


def test_language_id_against_the_plain_version(docs):
    model = langid.train(docs)
    counts = {x: Counter() for x in model.languages}
    for r in made():
        if r[2] is not None and r[1] is not None and not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2):
            counts[r[2]].update(b for word in plain_words(r[1]) for b in word)
    both = sum(counts.values(), Counter())
    prior = {b: (both[b] + 0.1) for b in range(langid.BUCKETS)}
    mass = sum(prior.values())
    for k, x in enumerate(model.languages):
        raw = np.array([counts[x][b] + langid.SMOOTHING * langid.BUCKETS / 64 * prior[b] / mass for b in range(langid.BUCKETS)])
        assert np.allclose(model.table[:, k], np.log(raw / raw.sum()), atol=1e-4)
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text"), model).collect()}
    for ident, text in {r[0]: r[1] for r in made() if len(r[1] or "") < 5000}.items():
        name, share = plain_language(model, text)
        assert abs(got[ident].score - share) < 2e-3 and (got[ident].lang_pred == name or share < 0.51), ident


def test_mixed_languages_are_found(docs):
    model = langid.train(docs)
    rnd = random.Random(1)
    text = " ".join([rnd.choice(WORDS["en"]) for _ in range(60)] + [rnd.choice(WORDS["fr"]) for _ in range(40)]).encode()
    share = model.mixtures(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    assert abs(share[model.languages.index("en")] - 0.6) < 0.1 and abs(share[model.languages.index("fr")] - 0.4) < 0.1


def plain_fingerprint(text):
    """Paragraph by paragraph, word by word."""
    wide, sketch = [0] * fingerprint.WIDE, [0] * fingerprint.SKETCH
    one = lambda b: int(kernels.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])

    def mixed(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & (1 << 64) - 1
        return x ^ x >> 31

    for line in re.split(rb"[\n\r]", text.encode()):
        words = re.findall(rb"[^\x20\x09-\x0d]+", line)
        if not words:
            continue
        lanes = hashlib.blake2b(line, digest_size=64).digest()
        wide = [(w + int.from_bytes(lanes[8 * k : 8 * k + 8], "little")) % (1 << 64) for k, w in enumerate(wide)]
        for k in range(max(1, len(words) - 2)):
            unit = 3
            for j in range(3):
                unit = mixed((unit * 0x9E3779B97F4A7C15 + (one(words[k + j]) if k + j < len(words) else 0)) & (1 << 64) - 1)
            sketch[unit % 256] += 1 - 2 * (unit >> 40 & 1)
    near = lambda a, b: 1.0 if a[0] == b[0] else 0.0 if not any(a[1]) and not any(b[1]) else min(1.0, max(0.0, 1 - sum((x - y) ** 2 for x, y in zip(a[1], b[1])) / (sum(x * x for x in a[1]) + sum(x * x for x in b[1]))))
    return (tuple(wide), tuple(sketch)), near


@pytest.mark.parametrize("parts", [None, 7, 60])
def test_fingerprints(docs, empty, parts):
    got = sorted((tuple(r) for r in fingerprint.fingerprint_documents(docs, parts).collect()), key=repr)
    hashes = {r[0]: r[1] for r in docs.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    order = sorted(((r[0] if r[0] is not None else -(1 << 63), hashes[r[1] or ""], r[1] or "", r[0]) for r in made()), key=lambda x: x[:3])
    want = []
    for k, (_, _, text, ident) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        (own, near), (changed, _), (then, _) = plain_fingerprint(text), plain_fingerprint(new), plain_fingerprint(after)
        code = lambda v: base64.b64encode(b"".join(x.to_bytes(8, "little") for x in v[0]) + b"".join((x % (1 << 32)).to_bytes(4, "little") for x in v[1])).decode()
        want.append((ident, len(text), hashlib.sha256(new.encode()).hexdigest(), code(own), code(changed), near(own, changed), near(own, then)))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want, key=repr)]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in sorted(want, key=repr)])
    assert fingerprint.fingerprint_documents(empty).count() == 0


def test_fingerprints_of_rows_of_one_id(spark):
    """Many texts of one id are cut into ranges; rows of one id and text are counted up before they are shuffled."""
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 1000).cast("string")).alias("text"))
    rows = rows.unionAll(spark.range(20_000).select(F.lit(4).cast("long"), F.lit("same words"))).unionAll(spark.createDataFrame([(9, "the last")], "doc_id long, text string"))
    found = fingerprint.fingerprint_documents(rows, 20)
    parts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert found.count() == 23_001 and found.filter("doc_id = 4 and near_next = 1").count() == 19_999
    assert 2000 <= found.filter("doc_id is null and near_next = 1").count() < 2012 and sorted(parts)[-2] < 1000


def test_fingerprints_are_homomorphic():
    a, b = "first line here\nsecond one\nthird", "second one\nfourth line"
    both = fingerprint.of_texts([f"{b}\n{a}"])
    summed = fingerprint.combine(fingerprint.of_texts([a]), fingerprint.of_texts([b]))
    assert all((x == y).all() for x, y in zip(both, summed))
    back = fingerprint.combine(summed, fingerprint.of_texts([b]), delete=True)
    assert all((x == y).all() for x, y in zip(back, fingerprint.of_texts([a])))
    swapped = fingerprint.of_texts(["third\nfirst line here\nsecond one"])
    assert (swapped[0] == fingerprint.of_texts([a])[0]).all()


def test_likeness_follows_shared_text():
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(800)]
    one, half, other = " ".join(words[:400]), " ".join(words[:200] + words[400:600]), " ".join(words[400:])
    v = [fingerprint.of_texts([t]) for t in (one, half, other)]
    near = [float(fingerprint.likeness(v[0], x)[0]) for x in v]
    assert near[0] == 1 and 0.35 < near[1] < 0.65 and near[2] < 0.2


def plain_fill(budget, kids):
    """kids: (weight, room). One unit of level after the other: who is full drops out."""
    got = [0.0] * len(kids)
    while budget > 1e-7:
        free = [k for k, (w, r) in enumerate(kids) if w > 0 and r - got[k] > 1e-9]
        if not free:
            break
        weight = sum(kids[k][0] for k in free)
        step = min([budget / weight, *((kids[k][1] - got[k]) / kids[k][0] for k in free)])
        for k in free:
            got[k] += step * kids[k][0]
        budget -= step * weight
    return got


def plain_shares(mix, leaves, budget):
    """Tokens by leaf, level after level."""
    room = lambda node: sum(n * mix.max_epochs for leaf, n in leaves.items() if leaf[: len(node)] == node)
    have = {(): min(budget, room(()))}
    for depth in range(3):
        below = {}
        for node, b in have.items():
            kids = sorted({leaf[: depth + 1] for leaf in leaves if leaf[:depth] == node}, key=repr)
            below |= zip(kids, plain_fill(b, [(mix.weights.get(k, mix.default_weight), room(k)) for k in kids]))
        have = below
    return have


def leaf_tokens(docs):
    return {tuple(r[0]): r[1] for r in docs.groupBy(F.struct(mixing.domain_of().alias("d"), "lang", "source")).agg(F.sum(mixing.token_count("text"))).collect()}


def plain_mixed(spark, mix, docs, share):
    """How often the mixture takes each (doc_id, epoch, tokens taken): the order is the seeded hash of the epoch, id and text."""
    rows = defaultdict(list)
    keys = [F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), F.lit(e), "doc_id", F.xxhash64("text")), 1) for e in range(mix.max_epochs + 1)]
    for r in docs.select(mixing.domain_of(), "lang", "source", "doc_id", "text", *keys).collect():
        rows[tuple(r[:3])].append((r[3], len((r[4] or "").split()), r[5:]))
    leaves = {leaf: sum(n for _, n, _ in ones) for leaf, ones in rows.items()}
    out = Counter()
    for leaf, budget in plain_shares(mix, leaves, sum(leaves.values()) * share).items():
        left, total = round(budget), leaves[leaf]
        whole = min(mix.max_epochs, left // total) if total else 0
        out.update((ident, e, n) for ident, n, _ in rows[leaf] for e in range(whole))
        left -= whole * total
        for ident, n, key in sorted(rows[leaf], key=lambda r: r[2][min(whole, mix.max_epochs)]):
            if left <= 0:
                break
            out[ident, whole, min(n, left)] += 1
            left -= n
    return out


def test_mixing_takes_what_the_plain_version_takes(docs, spark):
    got = Counter((r.doc_id, r.epoch, r.taken_tokens) for r in mixing.mix_documents(docs).collect())
    assert got == plain_mixed(spark, mixing.MIXTURE, docs, mixing.BUDGET_SHARE)


def test_mixing(docs, empty, spark):
    got = mixing.mix_documents(docs).collect()
    leaves = leaf_tokens(docs)
    budgets = plain_shares(mixing.MIXTURE, leaves, sum(leaves.values()) * mixing.BUDGET_SHARE)
    taken, epochs = defaultdict(int), defaultdict(lambda: defaultdict(list))
    for r in got:
        leaf = (r.domain, r.lang, r.source)
        taken[leaf] += r.taken_tokens
        epochs[leaf][r.epoch].append(r)
        assert 0 <= r.taken_tokens <= r.tokens and 0 <= r.epoch < mixing.MIXTURE.max_epochs + 1
    assert all(abs(taken[k] - v) < 0.6 for k, v in budgets.items())
    assert abs(sum(taken.values()) - sum(leaves.values()) * mixing.BUDGET_SHARE) <= len(leaves)
    rows = defaultdict(list)
    for r in docs.withColumn("d", mixing.domain_of()).select("d", "lang", "source", "doc_id", mixing.token_count("text").alias("t"), F.xxhash64("text").alias("h")).collect():
        rows[tuple(r[:3])].append(r)
    for leaf, by_epoch in epochs.items():
        for epoch, picked in by_epoch.items():
            if sum(r.taken_tokens for r in picked) == leaves[leaf]:
                continue
            # a prefix of the epoch's order: all before the last one whole
            key = {(r.doc_id, r.t): F.shiftrightunsigned(F.xxhash64(F.lit(mixing.MIXTURE.seed), F.lit(epoch), F.lit(r.doc_id).cast("long"), F.lit(r.h)), 1) for r in rows[leaf]}
            value = spark.range(1).select(*key.values()).first()
            order = [k for _, k in sorted(zip(value, key), key=lambda x: x[0])]
            cut = [k for r in picked if r.taken_tokens < r.tokens for k in [(r.doc_id, r.tokens)]]
            assert len(cut) <= 1
            ends = max(order.index((r.doc_id, r.tokens)) for r in picked)
            assert {k for k in order[: ends + 1]} == {(r.doc_id, r.tokens) for r in picked} and (not cut or order[ends] == cut[0])
    assert mixing.mix_documents(empty).count() == 0


def test_shares_of_many_leaves(spark):
    rnd = random.Random(9)
    leaves = {(f"d{rnd.randrange(4)}", rnd.choice(["en", "de", None]), f"s{k}"): rnd.choice([0, 1, 50, 400, 30_000]) for k in range(400)}
    mix = mixing.Mixture(weights={("d0",): 3.0, ("d1",): 0.0, ("d2", "en"): 5.0} | {leaf: rnd.choice([0.0, 0.5, 7.0]) for leaf in list(leaves)[:150]})
    table = spark.createDataFrame([(k, n) for k, n in leaves.items()], "leaf struct<domain: string, lang: string, source: string>, n long")
    for share in (0.01, 0.4, 0.9, 5.0):
        want = plain_shares(mix, leaves, sum(leaves.values()) * share)
        got = {tuple(r[0]): r[1] for r in mix.shares(table, share).select("leaf", "share").collect()}
        assert set(got) <= set(want) and all(abs(got.get(k, 0) - v) <= 0.6 for k, v in want.items()), share
        assert all(abs(v - want[k]) < 1e-3 for k, v in mix.exact(leaves, sum(leaves.values()) * share).items())


def test_budgets_go_to_siblings_first():
    tree = {("a", "x", "1"): 100, ("a", "x", "2"): 10, ("a", "y", "1"): 500, ("b", "x", "1"): 1000}
    mix = mixing.Mixture(weights={("a",): 0.5, ("b",): 0.5}, max_epochs=1)
    got = mix.budgets(tree, 400)
    # a gets 200, x and y 100 each; leaf 2 can use only 10 of its 50, leaf 1 beside it the other 90
    assert got == {("a", "x", "1"): 90, ("a", "x", "2"): 10, ("a", "y", "1"): 100, ("b", "x", "1"): 200}
    assert mix.budgets(tree, 10_000) == {k: v for k, v in tree.items()}
    assert mix.budgets({}, 5) == {}


@pytest.mark.parametrize("name, value", [("EDGE_ROWS", 1), ("BROADCAST_LEAVES", 0)])
def test_mixing_takes_prefixes_whatever_the_buckets(docs, monkeypatch, name, value):
    few = rows_of(mixing.mix_documents(docs))
    monkeypatch.setattr(mixing, name, value)
    assert rows_of(mixing.mix_documents(docs)) == few


def test_mixing_cuts_equal_rows(spark, monkeypatch):
    """Rows with one key: as many of them as the budget has room for, in no single task."""
    monkeypatch.setattr(mixing, "EDGE_ROWS", 10)
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("en").alias("lang"), F.lit("s1").alias("source"))
    got = mixing.Mixture().select(mixing.Mixture().prepared(rows, mixing.domain_of()), 0.3101)
    assert got.agg(F.sum("taken_tokens")).first()[0] == round(20_000 * 0.3101) and got.count() == 1241
