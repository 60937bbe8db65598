"""Mixing overlapping sources to target weights, by a min-cost flow over membership patterns.

Documents of the same sources share a pattern, and a pattern is one node: it can give each of its words up to ``MOST`` times, the first time for nothing and every
further time at a higher price, so costs are convex. Sources are nodes that take words from the patterns they are in, up to their target. The cheapest flow that
fills the targets says how many words of each pattern the mix takes; documents are then selected by a seeded hash.

Sources and patterns are counted before anything is shuffled, and only their sums are: targets are settled by sums over sources, the flow is solved apart for each
connected set of sources and patterns, and the hash at which a pattern's last round ends is found in two rounds of counting by hash ranges. As the price lies on the
pattern's own edges alone, an augmenting path costs what its first edge costs, so the cheapest flow is found by opening the rounds of repetition one after another.

Results: a null text has size 0; a null source is a source of its own, the last, a document without any source (an empty list) is taken 0 times; rows of equal id
and source share a hash and differ in size at most, ties after that are interchangeable; very long texts count as one document; an empty table has no rows; extra
columns of any name are not read. Reruns agree: nothing depends on how rows are dealt.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut_lineage, numbered
from pulsegrid.llm.neardup import components

#: Weights of sources in their order, over and over.
WEIGHTS = (1, 2, 3)
#: A document, and a source, is taken so many times at most.
MOST = 3
#: Hashes are counted by their first so many bits, and inside the range where a pattern ends by as many further ones.
BITS = 12
#: Rounds in which what is still missing of a pattern is filled with one document; fewer if nothing fits any more.
FILLS = 8
#: Rows, one for each pattern or source, up to which they are sent to all tasks; beyond it they are joined by shuffles.
BROADCAST = 100_000
#: Where a pattern misses its words by more than this part of them, its largest documents are tried first.
CLOSE = 0.01
SEED = 13


def size_of(text: Column) -> Column:
    """Number of words, counted without making them: places where one begins."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def named(source: Column) -> Column:
    """A name that is never null and sorts as sources do: by code point, null last. :func:`plain` gives the source back."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def plain(name: Column) -> Column:
    return F.when(name != "1", F.substr(name, F.lit(2)))


def beside(rows: DataFrame, few: DataFrame, on: str, n: int) -> DataFrame:
    """Each row with its one row of ``few``, if any; ``n``, the number of those, says whether they are sent to all tasks."""
    return rows.join(F.broadcast(few) if n <= BROADCAST else few, on, "left")


def targets(sources: DataFrame, total: int, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, size, weight, target`` from ``source`` (a name), ``size``: the total shared by weight, none above ``most`` times its size, the excess shared anew.

    Only sums leave the tasks; a round caps one source at least, and few rounds do as a rule.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    rows = numbered(sources.select(F.lit("").alias("all"), "source", "size"), "all", "source").select("source", "size", weight.alias("weight"), F.lit(False).alias("full"))
    while True:
        rows = cut_lineage(rows)
        sums = rows.agg(F.sum(F.when(F.col("full"), most * F.col("size"))).alias("fixed"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("open")).first()  # one row
        share = (total - (sums["fixed"] or 0)) / sums["open"] if sums["open"] else 0.0
        above = ~F.col("full") & (share * F.col("weight") > most * F.col("size"))
        if rows.where(above).isEmpty():
            break
        rows = rows.withColumn("full", F.col("full") | above)
    target = F.when(F.col("full"), (most * F.col("size")).cast("double")).otherwise(share * F.col("weight"))
    return rows.select("source", "size", "weight", target.alias("target"))


class Flow:
    """Maximum flow by augmenting along shortest paths; capacities of edges may grow between calls."""

    def __init__(self, n: int):
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _depths(self, start: int, end: int) -> list[int]:
        depth = [-1] * len(self.edges)
        depth[start], queue = 0, deque([start])
        while queue and depth[end] < 0:
            x = queue.popleft()
            for e in self.edges[x]:
                if self.room[e] > 0 and depth[self.to[e]] < 0:
                    depth[self.to[e]] = depth[x] + 1
                    queue.append(self.to[e])
        return depth

    def augment(self, start: int, end: int) -> None:
        while (depth := self._depths(start, end))[end] >= 0:
            tried = [0] * len(self.edges)  # edges of each node that lead nowhere in this round
            path: list[int] = []
            while True:
                at = self.to[path[-1]] if path else start
                if at == end:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path = path[: next(i for i, e in enumerate(path) if not self.room[e])]
                elif tried[at] < len(self.edges[at]):
                    e = self.edges[at][tried[at]]
                    if self.room[e] > 0 and depth[self.to[e]] == depth[at] + 1:
                        path.append(e)
                    else:
                        tried[at] += 1
                elif path:
                    tried[self.to[path.pop() ^ 1]] += 1
                else:
                    break


def cheapest(sizes: dict[str, int], members: dict[str, Sequence[str]], quotas: dict[str, int], most: int = MOST) -> dict[tuple[str, str], int]:
    """Words that go from each pattern to each of its sources in the cheapest flow that fills the quotas as far as can be."""
    patterns, sources = sorted(sizes), sorted(quotas)
    place = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    flow = Flow(len(place) + 2)
    first = {p: flow.edge(0, place["p", p], 0) for p in patterns}
    ways = {(p, s): flow.edge(place["p", p], place["s", s], most * sizes[p]) for p in patterns for s in sorted(set(members[p]))}
    for s in sources:
        flow.edge(place["s", s], 1, quotas[s])
    for _ in range(most):  # a round of repetition costs more than all before it
        for p in patterns:
            flow.room[first[p]] += sizes[p]
        flow.augment(0, 1)
    return {k: flow.room[e ^ 1] for k, e in ways.items()}


def routed(patterns: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """``pattern, source, words`` of the flow, solved apart for each connected set of patterns and sources.

    ``patterns`` has ``pattern, members, size``, ``wanted`` has ``source, target``. A set is as large as its number of distinct patterns, however many documents these have.
    """
    edges = cut_lineage(patterns.select("pattern", "size", F.explode("members").alias("source")).join(wanted, "source"))
    ids = components(edges.select(F.concat(F.lit("p"), "pattern").alias("a"), F.concat(F.lit("s"), "source").alias("b")))
    of = edges.withColumn("key", F.concat(F.lit("s"), "source")).join(ids, "key").select("label", "pattern", "size", "source", "target")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        members: dict[str, list] = {}
        for p, s in zip(rows["pattern"], rows["source"], strict=True):
            members.setdefault(p, []).append(s)
        sizes = {p: int(n) for p, n in zip(rows["pattern"], rows["size"], strict=True)}
        found = cheapest(sizes, members, {s: round(t) for s, t in zip(rows["source"], rows["target"], strict=True)}, most)
        return pd.DataFrame([(p, s, n) for (p, s), n in found.items()], columns=["pattern", "source", "words"])

    return cut_lineage(of.groupBy("label").applyInPandas(solve, "pattern string, source string, words long"))


def _ends(rows: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """For each pattern the first range of the hash, ``at``, in which the sum of sizes passes what is wanted, and what is wanted of that range."""
    sums = rows.groupBy("pattern", by).agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("pattern").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    passed = sums.withColumn("upto", upto).join(wanted, "pattern").where(F.col("upto") > F.col("rest"))
    end = F.min_by(F.struct(F.col(by).alias("at"), (F.col("rest") - F.col("upto") + F.col("size")).alias("rest")), by)
    return cut_lineage(passed.groupBy("pattern").agg(end.alias("end")).select("pattern", F.col("end.at").alias("at"), F.col("end.rest").alias("rest")))


def selected(rows: DataFrame, wanted: DataFrame, n: int) -> Callable[[DataFrame], DataFrame]:
    """Adds ``chosen`` to rows: documents in the order of their hash as far as the words ``rest`` of their pattern go, then those that fill what is left.

    ``rows`` has ``row, pattern, size, h``, and ``wanted`` at most ``n`` rows. Two rounds of sums by ranges of the hash leave a few documents of each pattern in
    which the end is looked for; every round after that picks one document of each pattern, the largest that fits, the last one that which comes nearest.
    """
    high, low = F.shiftrightunsigned("h", 64 - BITS), F.shiftrightunsigned("h", 64 - 2 * BITS).bitwiseAND((1 << BITS) - 1)
    rows = rows.select("pattern", "size", "h", "row", high.alias("high"), low.alias("low")).where(F.col("size") > 0)
    first = _ends(rows, wanted, "high")
    inside = beside(rows, first, "pattern", n).where(F.col("high") == F.col("at")).drop("at", "rest")
    second = _ends(inside, first.select("pattern", "rest"), "low")
    by = Window.partitionBy("pattern").orderBy("h", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    few = beside(inside, second, "pattern", n).where(F.col("low") == F.col("at")).withColumn("upto", F.sum("size").over(by))
    fits = F.when(F.col("upto") <= F.col("rest"), F.struct("upto", F.struct("h", "size", "row").alias("last")))
    last = few.groupBy("pattern", "rest").agg(F.max(fits).alias("fits"))
    ends = first.select("pattern", F.col("at").alias("end_high")).join(second.select("pattern", F.col("at").alias("end_low")), "pattern").join(last, "pattern")
    ends = cut_lineage(ends.join(wanted.select("pattern", F.col("rest").alias("all")), "pattern").select("pattern", F.col("all").alias("rest"), "end_high", "end_low", F.col("fits.last").alias("last"), (F.col("rest") - F.coalesce("fits.upto", F.lit(0))).alias("gap"), F.array().cast("array<long>").alias("fills")))

    def chosen(ends: DataFrame, rows: DataFrame) -> DataFrame:
        before = (high < F.col("end_high")) | (high == F.col("end_high")) & ((low < F.col("end_low")) | (low == F.col("end_low")) & F.coalesce(F.struct("h", "size", "row") <= F.col("last"), F.lit(False)))
        return beside(rows, ends, "pattern", n).withColumn("chosen", F.coalesce(before | F.array_contains("fills", F.col("row")), F.lit(False)))

    def filled(ends: DataFrame) -> DataFrame:
        for turn in range(FILLS):
            final = turn == FILLS - 1
            if not final and ends.where("gap > 0").isEmpty():
                continue
            near = F.col("size") < 2 * F.col("gap") if final else F.col("size") <= F.col("gap")
            order = F.struct(-F.abs(F.col("size") - F.col("gap")), "size", "h", "row")
            fill = chosen(ends, rows).where(~F.col("chosen") & near).groupBy("pattern").agg(F.max_by(F.struct("row", "size"), order).alias("fill"))
            left = (F.col("gap") - F.coalesce("fill.size", F.lit(0))).alias("gap")
            fills = F.when(F.col("fill").isNull(), F.col("fills")).otherwise(F.array_append("fills", F.col("fill.row"))).alias("fills")
            ends = cut_lineage(ends.join(fill, "pattern", "left").select("pattern", "rest", "end_high", "end_low", "last", left, fills))
        return ends

    ends = filled(ends)
    poor = ends.where(F.abs("gap") > CLOSE * F.col("rest"))
    if not poor.isEmpty():  # a few documents, too large for what their neighbours left: the largest first
        anew = filled(cut_lineage(poor.withColumns({"end_high": F.lit(-1).cast("long"), "gap": F.col("rest")}).withColumn("fills", F.array().cast("array<long>"))))
        better = anew.select("pattern", F.struct("end_high", "fills", "gap").alias("anew"))
        use = F.col("anew").isNotNull() & (F.abs("anew.gap") < F.abs("gap"))
        ends = cut_lineage(ends.join(better, "pattern", "left").select("pattern", "end_low", "last", *(F.when(use, F.col(f"anew.{c}")).otherwise(F.col(c)).alias(c) for c in ("end_high", "fills", "gap"))))
    kept = ends.select("pattern", "end_high", "end_low", "last", "fills")
    return lambda rows: chosen(kept, rows).drop("end_high", "end_low", "last", "fills")


class Mix:
    """``documents``: doc_id, members, size and copies; ``sources``: source, size, weight and target; ``routes``: words from patterns to sources.

    Names of sources in these frames are those of :func:`named`.
    """

    def __init__(self, docs: DataFrame, members: Column, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = SEED):
        names = F.array_sort(F.array_distinct(F.transform(F.coalesce(members, F.array().cast("array<string>")), named)))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), names.alias("members"), size_of(F.col("text")).alias("size"))
        rows = cut_lineage(rows.select("*", F.md5(F.to_json("members")).alias("pattern"), F.xxhash64(F.lit(seed), "doc_id", "members").alias("h"), F.monotonically_increasing_id().alias("row")))
        patterns = cut_lineage(rows.groupBy("pattern", "members").agg(F.sum("size").alias("size")))
        counts = patterns.agg(F.count("*").alias("n"), F.sum(F.when(F.size("members") > 0, F.col("size"))).alias("total")).first()  # one row
        self.n_patterns = counts["n"]
        sources = patterns.select("size", F.explode("members").alias("source")).groupBy("source").agg(F.sum("size").alias("size"))
        self.sources = targets(sources, counts["total"] or 0, weights, most)
        self.routes = routed(patterns, self.sources.select("source", "target"), most)
        words = self.routes.groupBy("pattern").agg(F.sum("words").alias("words")).join(patterns.select("pattern", "size"), "pattern").where("size > 0")
        words = cut_lineage(words.select("pattern", F.floor(F.col("words") / F.col("size")).cast("int").alias("whole"), (F.col("words") % F.col("size")).alias("rest")))
        choose = selected(rows, words.select("pattern", "rest"), self.n_patterns)
        found = beside(choose(rows), words.select("pattern", "whole"), "pattern", self.n_patterns)
        copies = F.coalesce(F.col("whole"), F.lit(0)) + F.col("chosen").cast("int")
        self.documents = found.select("doc_id", "members", "size", F.least(copies, F.lit(most)).alias("copies"))
