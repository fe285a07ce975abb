"""URL filters: a trie over reversed host labels and path segments, with longest-match precedence.

Entries are (action, host, path).  An entry fits its host and all subdomains, where the url's path starts
with the entry's.  The longest fitting entry wins (by host labels and path characters together); of an
allow and a block entry for the same host and path, block wins.  Without a fitting entry the default holds.

Entries are broadcast in chunks of at most `CHUNK_BYTES` of text, and each Python worker builds a chunk's trie
once.  A longer list, which may be a DataFrame, is judged chunk by chunk, each a narrow pass over the saved rows of
the one before, which keeps the longest match; so one trie at a time is in memory.

Cases: a null url, or one without ://, has an empty host and path and fits nothing; repeated urls are judged
alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import Sent, arrow_map, need, saved

CHUNK_BYTES = 16_000_000
DEFAULT = "allow"
URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Length in host and path characters, whether it blocks, action, host and path.
Rule = tuple[int, bool, str, str]


class Node:
    """One host label or path segment: children by label or segment, and the entries that end here.

    An entry's last segment may go on, as "/en/7" does in "/en/7198": `open` has them by this segment, and `sizes`
    the lengths that occur, longest first, so a lookup costs as many steps as there are lengths.
    """

    __slots__ = ("labels", "open", "segments", "sizes")

    def __init__(self) -> None:
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.open: dict[str, Rule] = {}
        self.sizes: list[int] = []

    def longest(self, segment: str) -> Rule | None:
        """The entry of the longest open segment that this one begins with."""
        for size in self.sizes:
            if size <= len(segment) and (found := self.open.get(segment[:size])) is not None:
                return found
        return None


def compile_rules(rules: Iterable[tuple[str, str, str]]) -> Node:
    root = Node()
    for action, host, path in rules:
        path = path if path.startswith("/") or not path else f"/{path}"
        node = root
        for label in reversed(host.translate(FOLD).split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, last = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        rule = (len(host) + len(path), action == "block", action, f"{host}{path or '/'}")
        if last not in node.open or rule[:2] > node.open[last][:2]:
            node.open[last] = rule
        if len(last) not in node.sizes:
            node.sizes = sorted([*node.sizes, len(last)], reverse=True)
    return root


def judge(root: Node, host: str, path: str) -> Rule | None:
    """The longest fitting entry."""
    best = None
    node = root
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        at = node
        for k, segment in enumerate(segments):
            rule = at.longest(segment)
            if rule is not None and (best is None or rule[:2] > best[:2]):
                best = rule
            at = at.segments.get(segment)
            if at is None:
                break
        else:
            continue
    return best


def split_url(url: str | None) -> tuple[str, str]:
    found = URL.search(url) if url else None
    return (found[1].translate(FOLD), found[2]) if found else ("", "")


def chunks(rules: Iterable[tuple[str, str, str]] | DataFrame, limit: int) -> Iterator[list[tuple[str, str, str]]]:
    """The entries in chunks of bounded size; of a DataFrame only one chunk at a time is on the driver."""
    if isinstance(rules, DataFrame):
        rows = need(rules, "action", "host", "path")
        total = rows.agg(F.sum(F.octet_length("host") + F.octet_length("path"))).first()[0] or 0
        n = total // limit + 1
        for k in range(n):
            yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("host", "path"), F.lit(n)) == k).collect()]
        return
    part, size = [], 0
    for rule in rules:
        part.append(tuple(rule))
        size += len(rule[1]) + len(rule[2])
        if size >= limit:
            yield part
            part, size = [], 0
    yield part


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, default: str = DEFAULT, limit: int = CHUNK_BYTES) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict; rules: (action, host, path)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    state = need(pages, "page_id", "url").withColumns({"host": F.lit(""), "path": F.lit(""), "size": F.lit(-1), "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    for nth, chunk in enumerate(chunks(rules, limit)):
        state = saved(state) if nth else state

        def run(batch: pa.RecordBatch, sent: Sent = Sent(pages.sparkSession, chunk, compile_rules)) -> Iterator[pa.RecordBatch]:  # noqa: B008
            root = sent.made()
            ids, urls, _, _, sizes, rules, verdicts = batch.columns
            parts = [split_url(u) for u in urls.to_pylist()]
            size, rule, verdict = sizes.to_pylist(), rules.to_pylist(), verdicts.to_pylist()
            for k, (host, path) in enumerate(parts):
                best = judge(root, host, path) if host else None
                if best is not None and (best[0], best[1]) > (size[k], verdict[k] == "block"):
                    size[k], rule[k], verdict[k] = best[0], best[3], best[2]
            columns = [ids, urls, pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(size, pa.int32()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        state = arrow_map(state, run, f"page_id {kind}, url string, host string, path string, size int, rule string, verdict string")
    return state.select("page_id", "host", "path", "rule", "verdict")
