"""Mixing sources to target weights (problem 7).

Documents are aggregated by membership pattern (the plan's sources a document belongs to).  On the small
graph pattern -> source a maximum flow finds the largest total that meets all shares, and a min-cost flow with convex repetition
costs (the k-th pass over a pattern's tokens costs k) routes token capacity to the source quotas.  Each pattern's documents, in
a seeded order, are then laid out along its passes and the quotas cut that line into segments; an occurrence belongs to
the segment its middle falls into, so a document occurs in a source at most ``max_repeats`` times and a
source differs from its quota by about half a document at either end of its segment.

The seeded order needs running sums.  They are taken in two levels, over hash buckets and within one bucket, so no task ever
holds a whole source.

A plan of n sources may have up to 2^n patterns.  All of them are routed as they are: path by path, and where a plan has over
``MOST_PATTERNS``, by blocking flows, which send along all paths of one cost together and end at the same least cost.

Defined results: sources are compared trimmed and lower-cased; documents with a null source, or none of the plan's, stay
out, as do documents without tokens; a source with a share but without tokens reaches 0 and its share goes to
the others in proportion; a share of 0, negative or null takes nothing; rows of one plan that name a source twice add their
shares and keep the smaller ``max_repeats``.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from .bpe import VOCABULARY, token_count

#: Documents that one hash bucket of a pattern is meant to hold.
BUCKET_ROWS = 20_000
#: Membership patterns of a plan whose flow is sent path by path; the flow of more is sent along all paths of one cost together.
MOST_PATTERNS = 10_000


class Flow:
    """Maximum flow and min-cost flow on a small graph, by shortest augmenting paths over integer capacities.

    An edge may have convex costs: with ``step`` tokens a pass, the tokens of its k-th pass cost k each.  A path goes on to the end of the
    pass at most, so no pass needs an edge of its own and there is no last one.
    """

    def __init__(self):
        self.graph: dict = defaultdict(list)
        self.ends: list = []
        self.room: list[int] = []
        self.step: list[int] = []  # 0: no cost
        self.reached: set = set()  # once ``run`` has fallen short: what the source still reaches

    def edge(self, a, b, capacity: int, step: int = 0) -> int:
        for x, y, room in ((a, b, capacity), (b, a, 0)):
            self.graph[x].append(len(self.ends))
            self.ends.append(y)
            self.room.append(room)
            self.step.append(step)
        return len(self.ends) - 2

    def _next(self, e: int) -> tuple[int, int]:
        """Cost of one more token on an edge, and how many have that cost."""
        step = self.step[e]
        if not step:
            return 0, self.room[e]
        if e % 2:  # back: the last pass is undone first
            done = self.room[e]
            k = (done - 1) // step
            return -k, done - k * step
        k, into = divmod(self.room[e ^ 1], step)
        return k, min(self.room[e], step - into)

    def run(self, source, sink, need: int, together: bool = False) -> int:
        """Send up to ``need`` along cheapest paths, one at a time or all of one cost ``together``; returns what was sent."""
        sent = 0
        while sent < need:
            best, via = {source: 0}, {}
            queue, queued = [source], {source}
            for v in queue:
                queued.discard(v)
                for e in self.graph[v]:
                    if not self.room[e]:
                        continue
                    to, cost = self.ends[e], best[v] + self._next(e)[0]
                    if cost < best.get(to, 1 << 60):
                        best[to], via[to] = cost, (v, e)
                        if to not in queued:
                            queued.add(to)
                            queue.append(to)
            if sink not in best:
                self.reached = set(best)
                break
            if together:
                sent += self._cheapest(source, sink, need - sent, best)
                continue
            path, v = [], sink
            while v != source:
                v, e = via[v]
                path.append(e)
            push = min([need - sent, *(self._next(e)[1] for e in path)])
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            sent += push
        return sent

    def _cheapest(self, source, sink, need: int, best: dict) -> int:
        """Send up to ``need`` along paths that cost as much as the cheapest, by the distances ``best`` from the source."""
        sent = 0
        while sent < need:
            level, queue = {source: 0}, [source]
            open_at: dict = {}
            for v in queue:
                open_at[v] = [e for e in self.graph[v] if self.room[e] and best.get(self.ends[e]) == best[v] + self._next(e)[0]]
                for e in open_at[v]:
                    if self.ends[e] not in level:
                        level[self.ends[e]] = level[v] + 1
                        queue.append(self.ends[e])
            if sink not in level:
                break
            path, v = [], source
            while sent < need:
                if v == sink:
                    push = min([need - sent, *(self._next(e)[1] for e in path)])
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    sent += push
                    path, v = [], source
                    continue
                while open_at[v]:  # from the last; what no longer leads on at this cost goes for good
                    e = open_at[v][-1]
                    to = self.ends[e]
                    if level.get(to) == level[v] + 1 and self.room[e] and best[to] == best[v] + self._next(e)[0]:
                        break
                    open_at[v].pop()
                if open_at[v]:
                    path.append(e)
                    v = to
                elif path:
                    v = self.ends[path.pop() ^ 1]
                    open_at[v].pop()
                else:
                    break
        return sent

    def flow(self, e: int) -> int:
        return self.room[e ^ 1]


def _quotas(shares: dict[str, float], total: int) -> dict[str, int]:
    return {s: int(w * total) for s, w in shares.items()}


def route(shares: dict[str, float], repeats: dict[str, int], tokens: dict[tuple[str, ...], int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens each membership pattern gives each source, for the largest total that the shares and repeats allow."""
    live = {s for p, n in tokens.items() if n > 0 for s in p if repeats.get(s, 0) > 0}
    shares = {s: w for s, w in shares.items() if w > 0 and s in live}
    if not shares:
        return {}
    whole = sum(shares.values())
    shares = {s: w / whole for s, w in shares.items()}
    patterns = {p: n for p, n in tokens.items() if n > 0 and any(s in shares for s in p)}

    together = len(patterns) > MOST_PATTERNS
    node = {x: i for i, x in enumerate([*patterns, *shares])}  # sources by name, patterns as tuples

    def solve(total: int, convex: bool) -> tuple[int, dict, Flow, dict]:
        net, arcs = Flow(), {}
        quotas = _quotas(shares, total)
        for p, n in patterns.items():
            most = max(repeats[s] for s in p if s in shares)
            net.edge("from", node[p], n * most, n if convex else 0)
            for s in p:
                if s in shares:
                    arcs[p, s] = net.edge(node[p], node[s], n * repeats[s])
        ends = {s: net.edge(node[s], "to", q) for s, q in quotas.items()}
        sent = net.run("from", "to", sum(quotas.values()), together)
        return sum(quotas.values()) - sent, arcs, net, ends

    total = sum(n * max(repeats[s] for s in p if s in shares) for p, n in patterns.items()) + len(shares)
    while True:
        short, _, net, ends = solve(total, False)
        if not short:
            break
        # the sources that the flow no longer reaches got all there is for them: the total falls until their quotas fit into that
        full = [s for s in shares if node[s] not in net.reached]
        there = sum(net.flow(ends[s]) for s in full)
        lo, hi = 0, total - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            quotas = _quotas(shares, mid)
            if sum(quotas[s] for s in full) <= there:
                lo = mid
            else:
                hi = mid - 1
        total = lo
    _, arcs, net, _ = solve(total, True)
    return {k: f for k, e in arcs.items() if (f := net.flow(e))}


def _seeded(key, seed: int):
    return F.xxhash64(key, F.lit(seed))


def source_key(col):
    return F.lower(F.trim(col))


def mixture(sizes: DataFrame, plan: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(mixture, shares)`` of ``sizes(doc_id, sources array<string>, n_tokens)`` under ``plan(plan_name, source, target_share,
    max_repeats)``.  The mixture has a row per plan, source and document that occurs, with its number of occurrences."""
    spark = sizes.sparkSession
    plan = (
        plan.where(F.col("source").isNotNull() & F.col("plan_name").isNotNull())
        .groupBy("plan_name", source_key(F.col("source")).alias("source"))
        .agg(F.sum(F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)).alias("share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("repeats"))
    )
    plans: dict[str, list] = defaultdict(list)
    for r in plan.collect():  # a configuration table: one row per plan and source
        plans[r.plan_name].append(r)
    if not plans:
        plans[""] = []
    # one struct per plan, as a constant: each document meets the plans without a join
    listed = F.array(*(F.struct(F.lit(n).alias("plan_name"), F.array(*(F.lit(r.source) for r in rows)).cast("array<string>").alias("listed")) for n, rows in plans.items()))

    member = (
        sizes.where((F.col("n_tokens") > 0) & (F.size("sources") > 0))
        .select("doc_id", "n_tokens", "sources", F.explode(listed).alias("p"))
        .withColumn("pattern", F.array_sort(F.array_distinct(F.array_intersect("sources", "p.listed"))))
        .where(F.size("pattern") > 0)
        .select("p.plan_name", "pattern", "doc_id", "n_tokens", _seeded(F.col("doc_id"), seed).alias("turn"))
    )
    buckets = 1 + sizes.count() // BUCKET_ROWS
    member = member.withColumn("bucket", F.pmod("turn", F.lit(buckets)))
    by_bucket = cut_lineage(member.groupBy("plan_name", "pattern", "bucket").agg(F.sum("n_tokens").alias("held")))
    tokens: dict[str, dict] = defaultdict(dict)
    whole = by_bucket.groupBy("plan_name", "pattern").agg(F.sum("held").alias("n"))
    for r in whole.toLocalIterator():  # a number per plan and pattern; the flow of a plan takes all of them at once
        tokens[r.plan_name][tuple(r.pattern)] = r.n

    segments = []
    for name, rows in plans.items():
        routed = route({r.source: r.share for r in rows}, {r.source: r.repeats for r in rows}, tokens[name])
        at: dict = defaultdict(int)
        for (pattern, source), n in sorted(routed.items()):
            segments.append((name, list(pattern), tokens[name][pattern], source, at[pattern], at[pattern] + n))
            at[pattern] += n
    cuts = spark.createDataFrame(segments, "plan_name string, pattern array<string>, pattern_tokens long, source string, seg_from long, seg_to long")

    before = F.coalesce(F.sum("held").over(_order("bucket")), F.lit(0)).alias("before")
    starts = by_bucket.select("plan_name", "pattern", "bucket", before)
    inside = F.coalesce(F.sum("n_tokens").over(_order("turn", "doc_id", "n_tokens", within=["bucket"])), F.lit(0))
    ceil = lambda a: F.expr(f"-floor(-({a}) / cast(pattern_tokens as decimal(20, 0)))").cast("long")
    mixed = (
        member.withColumn("inside", inside)
        .join(starts, ["plan_name", "pattern", "bucket"])
        .join(F.broadcast(cuts) if len(segments) <= MOST_PATTERNS else cuts, ["plan_name", "pattern"])
        .withColumn("first", F.col("before") + F.col("inside") + F.expr("n_tokens div 2"))
        .withColumn("occurrences", F.greatest(ceil("seg_to - first"), F.lit(0)) - F.greatest(ceil("seg_from - first"), F.lit(0)))
        .where("occurrences > 0")
        .select("plan_name", "source", "doc_id", F.col("occurrences").cast("int").alias("occurrences"), "n_tokens")
    )
    whole = mixed.groupBy("plan_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("occurrences")).alias("tokens"), F.count("*").alias("documents"), F.max("occurrences").alias("most_repeats")
    )
    target = plan.withColumn("target_share", F.col("share") / F.sum("share").over(_all("plan_name")))
    shares = (
        target.join(whole, ["plan_name", "source"], "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(_all("plan_name"))), F.lit(0.0)))
        .select("plan_name", "source", "target_share", "reached_share", "tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.col("repeats").alias("max_repeats"))
    )
    return mixed, shares


def _order(*by: str, within: list[str] | None = None):
    return Window.partitionBy("plan_name", "pattern", *(within or [])).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)


def _all(*by: str):
    return Window.partitionBy(*by)


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, sources, n_tokens`` of documents that name one source each."""
    key = source_key(F.col("source"))
    return cut_lineage(
        documents.where(F.col("source").isNotNull() & (F.col("text") != ""))
        .select("doc_id", F.array(key).alias("sources"), token_count(F.col("text"), vocabulary).alias("n_tokens"))
    )


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Per plan the documents of the mixture, with how often each occurs."""
    return mixture(sized(table(spark, folder, "documents")), table(spark, folder, "mixplan"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per plan and source the share aimed at and the share reached."""
    return mixture(sized(table(spark, folder, "documents")), table(spark, folder, "mixplan"))[1]
