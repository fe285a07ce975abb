"""Embeddings by committed batches (D3, F3, O7): a killed run goes on with the batches that are not committed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators.registry import kept
from lexweave.sources.store import Change, Store, Version, together

#: Texts to a call of the provider.
CALL = 32


def missing(store: Store, version: Version | None = None) -> DataFrame | None:
    """Chunks of stored documents without an embedding."""
    version = version or store.latest()
    chunks, have = kept(store, "chunks", version), store.read("embeddings", version)
    return chunks if chunks is None or have is None else chunks.join(have.select("chunk_id"), "chunk_id", "left_anti")


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int, call: int = CALL) -> DataFrame:
    """chunk_id, embedding of rows(chunk_id, text): the provider gets `call` texts at once, and its counts and sizes are checked."""
    kind = rows.schema["chunk_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), call):
                part = frame.iloc[k : k + call]
                found = [[float(x) for x in v] for v in embed([t or "" for t in part["text"]])]
                if len(found) != len(part) or any(len(v) != size for v in found):
                    raise ValueError(f"{len(part)} texts want as many vectors of {size}")
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "embedding": found})

    return rows.select("chunk_id", "text").mapInPandas(run, f"chunk_id {kind}, embedding array<float>")


def embed_missing(store: Store, embed: Callable[[list[str]], list[list[float]]], size: int, per_commit: int = 1_000_000, most: int | None = None) -> tuple[int, int]:
    """Embeds the chunks that have none, a commit for each of n parts; (parts done now, parts left).

    The number of parts is noted with the first commit, the parts that are done with theirs, so a later run embeds
    just the others.  Parts are cut by a hash of the id, inside each part texts go in order of page and place.
    most: stop after so many parts.
    """
    version = store.latest()
    plan = version.notes.get("embedding")  # number of parts, then those that are done
    if not plan:
        todo = missing(store, version)
        n = 0 if todo is None else todo.count()
        if not n:
            return 0, 0
        plan = [-(-n // per_commit)]
        store.transact(lambda v: Change(notes={"embedding": plan}) if not v.notes.get("embedding") else None)
        plan = store.latest().notes["embedding"]
    left = [k for k in range(plan[0]) if k not in plan[1:]]
    for k in left if most is None else left[:most]:
        seen = store.latest()
        rows = missing(store, seen).filter(F.pmod(F.xxhash64("chunk_id"), F.lit(plan[0])) == k)
        rows = rows.sortWithinPartitions(*(c for c in ("document_id", "page_number", "chunk_index", "chunk_id") if c in rows.columns))
        staged = store.stage("embeddings", embedded(rows, embed, size))

        def build(version: Version, k: int = k, staged: Change = staged) -> Change | None:
            noted = version.notes.get("embedding")
            if not noted or k in noted[1:]:
                return None  # another run was first with this part
            done = [*noted, k]
            return together(staged, notes={"embedding": done if len(done) <= noted[0] else None})

        store.transact(build)
    return (len(left) if most is None else min(most, len(left))), 0 if most is None else max(0, len(left) - most)
