"""Mixing sources to target weights by hierarchical budgeting.

A token budget is split along a tree of domains, languages and sources in proportion to weights.  No node
gets more than its documents can give in `max_epochs` passes; what a node can't use goes to its siblings
first, and only what the whole parent can't use goes further up.  Each leaf then takes as many whole epochs
as fit and a token prefix of the next one, in that epoch's seeded order; of the last document of the prefix
only the tokens that are left to the budget count.

The nodes above the leaves are shared out on the driver, which gets a row for each domain and language; the leaves
of one parent by a window over them, so any number of sources will do.  A leaf's order is a seeded hash, cut into
2 ** BITS buckets: whole buckets are taken by their sums, and the bucket where the budget ends is cut again until it
holds at most EDGE_ROWS rows; only these are ordered row by row, so a source with a third of all rows is nowhere in
one task.  Rows that share their id and text are told apart by their place in a saved table.

Cases: null domains, languages and sources are leaves of their own, with the default weight; null and empty
texts have no tokens and go with the place they have in the order; ties in the order (repeated rows, null ids with
one text) are broken by place; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import saved

#: Up to so many leaves (some 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_LEAVES = 100_000
BITS, KEY_BITS = 9, 63
EDGE_ROWS = 1000
LAST = (1 << KEY_BITS) - 1


def token_count(text: str | Column) -> Column:
    """Runs of other characters than white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def fill(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """budget split by weight, none above its room; what is left over goes to the others by weight."""
    given = [0.0] * len(weights)
    free = {k for k in range(len(weights)) if weights[k] > 0 and room[k] > 0}
    while free and budget > 1e-9:
        total = sum(weights[k] for k in free)
        full = {k for k in free if given[k] + budget * weights[k] / total >= room[k] - 1e-9}
        if not full:
            for k in free:
                given[k] += budget * weights[k] / total
            break
        spent = sum(room[k] - given[k] for k in full)
        for k in full:
            given[k] = room[k]
        budget -= spent
        free -= full
    return given


@dataclass
class Mixture:
    """weights: by node path, such as ("web",) or ("web", "en"); a node that isn't named has default_weight."""

    weights: dict[tuple, float] = field(default_factory=dict)
    default_weight: float = 1.0
    max_epochs: int = 2
    seed: int = 7

    def exact(self, leaves: dict[tuple, int], budget: float) -> dict[tuple, float]:
        """The share of each of these nodes, all of one depth; leaves: the tokens that each has."""
        room: dict[tuple, float] = {}
        children: dict[tuple, list[tuple]] = {}
        for leaf in sorted(leaves, key=repr):
            for depth in range(len(leaf) + 1):
                node = leaf[:depth]
                if depth < len(leaf) and node not in children:
                    children[node] = []
                if depth and node not in room:
                    children[leaf[: depth - 1]].append(node)
                room[node] = room.get(node, 0) + leaves[leaf] * self.max_epochs
        out: dict[tuple, float] = {}
        todo = [((), min(budget, room.get((), 0)))] if leaves else []
        while todo:
            node, have = todo.pop()
            if node not in children:
                out[node] = have
                continue
            below = children[node]
            todo += zip(below, fill(have, [self.weights.get(c, self.default_weight) for c in below], [room[c] for c in below]))
        return out

    def budgets(self, leaves: dict[tuple, int], budget: float) -> dict[tuple, int]:
        """Whole tokens for each leaf (domain, lang, source)."""
        return {leaf: round(have) for leaf, have in self.exact(leaves, budget).items()}

    def shares(self, leaves: DataFrame, budget_share: float) -> DataFrame:
        """leaf, n, share for leaves(leaf, n): the tokens that each leaf gives.

        Siblings are filled in the order of room by weight: those up to some level give all that they have, the
        others that level by weight.
        """
        spark = leaves.sparkSession
        above = {(r[0], r[1]): r[2] for r in leaves.groupBy("leaf.domain", "leaf.lang").agg(F.sum("n")).collect()}
        parents = [(*k, float(v)) for k, v in self.exact(above, sum(above.values()) * budget_share).items()]
        given = F.broadcast(spark.createDataFrame(parents, "d string, l string, have double"))
        named = F.broadcast(spark.createDataFrame([(*k, float(w)) for k, w in self.weights.items() if len(k) == 3], "wd string, wl string, ws string, w double"))
        rows = leaves.join(given, F.col("leaf.domain").eqNullSafe(F.col("d")) & F.col("leaf.lang").eqNullSafe(F.col("l")))
        rows = rows.join(named, F.col("leaf.domain").eqNullSafe(F.col("wd")) & F.col("leaf.lang").eqNullSafe(F.col("wl")) & F.col("leaf.source").eqNullSafe(F.col("ws")), "left")
        rows = rows.select("leaf", "n", "have", F.coalesce("w", F.lit(float(self.default_weight))).alias("w"), (F.col("n") * self.max_epochs).cast("double").alias("room"))
        rows = rows.withColumn("level", F.when(F.col("w") > 0, F.col("room") / F.col("w")).otherwise(F.lit(0.0))).withColumn("room", F.when(F.col("w") > 0, F.col("room")).otherwise(F.lit(0.0)))
        of = Window.partitionBy("leaf.domain", "leaf.lang")
        upto = of.orderBy("level", "leaf.source").rowsBetween(Window.unboundedPreceding, -1)
        left = F.greatest(F.col("have") - F.coalesce(F.sum("room").over(upto), F.lit(0.0)), F.lit(0.0))
        weight = F.sum("w").over(of) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
        rows = rows.withColumn("mark", F.when(F.col("w") > 0, left / weight))
        # the first that is not full sets the level; for those after it the mark is lower
        level = F.max(F.when(F.col("mark") < F.col("level"), F.col("mark"))).over(of)
        return rows.withColumn("cap", level).select("leaf", "n", F.rint(F.least("room", F.coalesce(F.col("cap") * F.col("w"), F.col("room")))).cast("long").alias("share"))

    def prepared(self, documents: DataFrame, domain: Column) -> DataFrame:
        """The documents' rows with __leaf, __tokens and __tie, the hash that sets the rows of one id apart."""
        leaf = F.struct(domain.alias("domain"), F.col("lang").alias("lang"), F.col("source").alias("source"))
        return documents.withColumns({"__leaf": leaf, "__tokens": token_count("text"), "__tie": F.xxhash64("text")})

    def select(self, prepared: DataFrame, budget_share: float) -> DataFrame:
        """The rows of prepared(), one for each epoch that takes them, with domain, tokens, epoch and taken_tokens.

        budget_share: the token budget as a share of the tokens of documents.
        """
        names = [F.col(f"`{c}`") for c in prepared.columns if c not in ("__leaf", "__tokens", "__tie")]
        rows = saved(prepared.withColumn("__place", F.monotonically_increasing_id()))
        leaves = saved(self.shares(rows.groupBy(F.col("__leaf").alias("leaf")).agg(F.sum("__tokens").alias("n")), budget_share))
        few = leaves.count() <= BROADCAST_LEAVES
        whole = F.when(F.col("n") > 0, F.least(F.lit(self.max_epochs), F.floor(F.col("share") / F.col("n")))).otherwise(F.lit(0)).cast("int")
        leaves = leaves.select("leaf", "n", whole.alias("whole"), "share").withColumn("rest", F.col("share") - F.col("whole") * F.col("n"))
        listed = lambda df: F.broadcast(df) if few else df
        hashed = lambda *c: F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), *c), 1)
        keyed = rows.join(listed(leaves), F.col("__leaf").eqNullSafe(F.col("leaf"))).withColumns({"__key": hashed("whole", "doc_id", "__tie"), "__second": hashed("__place")})
        # the bucket where a leaf's budget ends: keys from lo to hi, and second keys from lo2 to hi2 if lo = hi
        edges = leaves.filter("rest > 0").select("leaf", "rest", *(F.lit(x).cast("long").alias(c) for c, x in (("lo", 0), ("hi", LAST), ("lo2", 0), ("hi2", LAST), ("before", 0), ("held", EDGE_ROWS + 1))))
        edges = saved(edges)
        for level in range(2 * KEY_BITS // BITS):
            todo = edges.filter(F.col("held") > EDGE_ROWS)
            if todo.isEmpty():
                break
            second, shift = level >= KEY_BITS // BITS, KEY_BITS - BITS * (level % (KEY_BITS // BITS) + 1)
            key, lo, hi = ("__second", "lo2", "hi2") if second else ("__key", "lo", "hi")
            inside = keyed.select(F.col("leaf").alias("of"), "__key", "__second", "__tokens").join(listed(todo), F.col("of").eqNullSafe(F.col("leaf")) & F.col("__key").between(F.col("lo"), F.col("hi")) & F.col("__second").between(F.col("lo2"), F.col("hi2")))
            sums = inside.groupBy("leaf", F.shiftrightunsigned(F.col(key) - F.col(lo), shift).alias("bucket")).agg(
                F.sum("__tokens").alias("t"), F.count("*").alias("c"), *(F.first(x).alias(x) for x in ("rest", "lo", "hi", "lo2", "hi2", "before"))
            )
            upto = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
            cut = sums.withColumn("start", F.col("before") + F.coalesce(F.sum("t").over(upto), F.lit(0))).filter((F.col("start") < F.col("rest")) & (F.col("start") + F.col("t") >= F.col("rest")))
            begin = F.col(lo) + F.shiftleft("bucket", shift)
            cut = cut.select("leaf", "rest", "lo", "hi", "lo2", "hi2", F.col("start").alias("before"), F.col("c").alias("held"), begin.alias("a"), (begin + F.lit((1 << shift) - 1)).alias("b"))
            cut = cut.withColumns({lo: F.col("a"), hi: F.col("b")}).drop("a", "b")
            edges = saved(edges.filter(F.col("held") <= EDGE_ROWS).unionByName(cut))
        edges = edges.select(F.col("leaf").alias("of"), "lo", "hi", "lo2", "hi2", "before")
        keyed = keyed.join(listed(edges), F.col("leaf").eqNullSafe(F.col("of")), "left")

        def made(df: DataFrame, epoch: Column, taken: Column) -> DataFrame:
            return df.select(*names, F.col("leaf.domain").alias("domain"), F.col("__tokens").alias("tokens"), epoch.cast("int").alias("epoch"), taken.cast("long").alias("taken_tokens"))

        inside = F.col("__key").between(F.col("lo"), F.col("hi"))
        sure = F.col("whole") + F.when((F.col("__key") < F.col("lo")) | (inside & (F.col("__second") < F.col("lo2"))), 1).otherwise(0)
        every = keyed.filter(sure > 0).withColumn("__epoch", F.explode(F.sequence(F.lit(0), sure - 1)))
        order = Window.partitionBy("leaf").orderBy("__key", "__second").rowsBetween(Window.unboundedPreceding, -1)
        last = keyed.filter(inside & F.col("__second").between(F.col("lo2"), F.col("hi2"))).withColumn("__at", F.coalesce(F.sum("__tokens").over(order), F.lit(0)) + F.col("before")).filter("__at < rest")
        return made(every, F.col("__epoch"), F.col("__tokens")).unionByName(made(last, F.col("whole"), F.least(F.col("__tokens"), F.col("rest") - F.col("__at"))))


#: The tree that the query and the pipeline use: sources are grouped into domains by their number.
MIXTURE = Mixture(weights={("web",): 0.5, ("books",): 0.3, ("forum",): 0.2} | {(d, x): w for d in ("web", "books", "forum") for x, w in (("en", 0.55), ("de", 0.15), ("fr", 0.15), ("es", 0.15))})
BUDGET_SHARE = 0.8


def domain_of() -> Column:
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int)")
    return F.when(number < 10, "web").when(number < 15, "books").when(number >= 15, "forum").otherwise("other")


def mix_documents(documents: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch, taken_tokens."""
    picked = MIXTURE.prepared(documents.select("doc_id", "text", "lang", "source"), domain_of())
    return MIXTURE.select(picked.drop("text"), BUDGET_SHARE)
