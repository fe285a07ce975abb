"""Learned embeddings: the directions are those of a singular value decomposition, and neighbours share topics."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.operators import retrieval, spectral
from lexweave.sources import files


def topical(n: int = 240, topics: int = 6):
    """Texts of few words of a topic and many that all have: two texts of a topic may share no word of it."""
    rnd, rows = np.random.default_rng(1), []
    for k in range(n):
        own = [f"t{k % topics}w{x}" for x in rnd.integers(0, 40, 8)]
        rows.append((k, k % topics, " ".join(rnd.permutation(own + [f"c{x}" for x in rnd.integers(0, 60, 12)]))))
    return rows


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(topical(), "chunk_id long, topic int, text string").repartition(3).cache()


def test_directions_are_the_singular_ones(spark, texts):
    got = spectral.fit(texts, 6, 512, rounds=12)
    column = texts.select(spectral.cells("text", 512).alias("c")).toArrow()["c"].combine_chunks()
    row, bucket, value = spectral.weighted(column, got.weight)
    matrix = np.zeros((240, 512))
    matrix[row, bucket] = value
    _, s, v = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(got.strength, s[:6] ** 2, rtol=1e-3)
    assert np.linalg.norm(got.matrix.T @ v[:6].T, 2) > 0.99 and np.allclose(got.matrix.T @ got.matrix, np.eye(6), atol=1e-8)


def agreement(vectors) -> float:
    """How often the nearest other text is of the same topic."""
    unit = np.stack([r.embedding for r in vectors])
    near = unit @ unit.T
    np.fill_diagonal(near, -2)
    topic = np.array([r.topic for r in vectors])
    return float((topic[near.argmax(axis=1)] == topic).mean())


def test_neighbours_beat_hashed_tokens(spark, texts):
    model = spectral.fit(texts, 8, 4096)
    own = texts.select("topic", model.embedded("text").alias("embedding")).collect()
    hashed = texts.select("topic", files.feature_embedding("text").alias("embedding")).collect()
    assert agreement(own) > 0.9 > agreement(hashed) + 0.1
    again = texts.repartition(5).select("topic", spectral.fit(texts.repartition(5), 8, 4096).embedded("text").alias("embedding"))
    assert agreement(again.collect()) > 0.9


def test_cases(spark, texts):
    model = spectral.fit(texts, 4, 256, sample=100)
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "--- !"), (3, "t1w1 " * 5000), (4, "c1 t2w2")], "chunk_id long, text string")
    found = {r.chunk_id: r.embedding for r in odd.select("chunk_id", model.embedded("text").alias("embedding")).collect()}
    assert found[0] is found[1] is found[2] is None
    assert all(abs(np.linalg.norm(found[k]) - 1) < 1e-5 for k in (3, 4) if found[k] is not None)
    new = files.with_missing_embeddings(texts, texts.limit(5), model.embedded)
    assert new.count() == 235 and retrieval.wrong_dimension(new, 4).count() == 0
    empty = spectral.fit(texts.limit(0), 4, 64)
    assert odd.select(empty.embedded("text").alias("e")).filter("e is not null").count() == 0


def test_blocks_go_by_words_and_not_by_texts():
    rnd = np.random.default_rng(3)
    sizes = np.append(rnd.integers(0, 900, 2000), [0, 3 * spectral.BLOCK, 0])
    every = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(rnd.integers(0, 1 << 14, sizes.sum()).astype(np.int32)))
    matrix = rnd.normal(size=(1 << 14, 72))
    for column in (every, every.slice(1, 1500), every.slice(0, 0)):
        parts = list(spectral.blocks(column))
        assert pa.chunked_array([p for _, p in parts], column.type).equals(pa.chunked_array([column]))
        assert [k for k, _ in parts] == np.cumsum([0, *(len(p) for _, p in parts)])[:-1].tolist()
        assert all(len(p) == 1 or len(p.flatten()) <= spectral.BLOCK for _, p in parts)
    tracemalloc.start()
    for _, part in spectral.blocks(every):
        spectral.times(*spectral.weighted(part, np.ones(1 << 14)), matrix, np.zeros((len(part), 72)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000  # of all texts at once: 1 GB


def test_all_texts_are_fitted_on(spark):
    many = spark.range(60_000).selectExpr("concat('t', id % 5, ' own', id) AS text")  # more than the 50,000 that once were drawn
    got = spectral.fit(many, 2, 64, rounds=1)
    seen = many.select(F.explode(F.array_distinct(spectral.cells("text", 64))).alias("b")).groupBy("b").count().collect()
    counts = np.zeros(64)
    counts[[r.b for r in seen]] = [r["count"] for r in seen]
    assert np.allclose(got.weight, np.log(60_001 / (1 + counts)))


def test_full_blocks_are_multiplied_like_sparse_ones(monkeypatch):
    rnd = np.random.default_rng(5)
    sizes = np.append(rnd.integers(0, 40, 50), [0])
    column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(rnd.integers(0, 90, sizes.sum()).astype(np.int32)))
    row, bucket, value = spectral.weighted(column, rnd.random(100))
    matrix, dense = rnd.normal(size=(100, 7)), np.zeros((51, 100))
    dense[row, bucket] = value
    for full in (0, 1000):
        monkeypatch.setattr(spectral, "FULL", full)
        out = np.zeros((100, 7))
        spectral.squared(row, bucket, value, 51, matrix, out)
        assert np.allclose(out, dense.T @ dense @ matrix)
