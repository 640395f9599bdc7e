"""Graph operators over note links.

Vertices and edges stay DataFrames.  Iterative operators write each round to the shared folder; hub vertices are handled by
aggregating messages before they are shuffled.
"""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, discard, java_class
from .notes import live_edges

#: Undirected edges up to which a worker holds the whole graph for betweenness (8 bytes each way); above, it runs on joins.
HELD_EDGES = 4_000_000
#: Rows of (source, vertex) that one block of sources is meant to make there.
BLOCK_ROWS = 2_000_000_000
#: Rows whose sums a worker takes at a time, so that they stay in its cache, and links from which a vertex has its sum taken alone.
PART_ROWS, HUB_LINKS = 2048, 64


def build(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: distinct directed edges between the notes."""
    return live_edges(edges, notes).select("source_id", "target_id").distinct()


def undirected(directed: DataFrame) -> DataFrame:
    """``a <= b``, each pair once, self-loops once."""
    return directed.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()


def neighbours(pairs: DataFrame) -> DataFrame:
    """Both directions of undirected pairs; a self-loop once."""
    return pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.where("a != b").select("b", "a"))


def pagerank(notes: DataFrame, pairs: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, most: int = 1000, cut_every: int = 5, rounds: int | None = None) -> DataFrame:
    """Rank over the vertices with any edge, as an undirected graph; others score 0.  ``rounds``: so many, converged or not.

    Messages are summed map-side before the shuffle, so a hub's column is never collected; partitioning by vertex is kept from round
    to round, and every ``cut_every`` rounds the ranks are written out.
    """
    both = cut_lineage(neighbours(pairs))
    out = both.groupBy("x").agg(F.count("*").alias("degree"))
    n = out.count()
    if not n:
        return notes.select("id", F.lit(0.0).alias("score"))
    links = cut_lineage(both.join(out, "x").select("x", "y", (1.0 / F.col("degree")).alias("w")))
    ranks, last = out.select("x", F.lit(1.0 / n).alias("r")), None
    for turn in range(most if rounds is None else rounds):
        sent = links.join(ranks, "x").groupBy("y").agg(F.sum(F.col("w") * F.col("r")).alias("got"))
        step = ranks.join(sent.withColumnRenamed("y", "x"), "x", "left").select("x", F.col("r").alias("old"), ((1 - alpha) / n + alpha * F.coalesce("got", F.lit(0.0))).alias("r"))
        if turn % cut_every == cut_every - 1:
            step = cut_lineage(step)
            if last is not None:
                discard(last)
            last = step
            if rounds is None and step.agg(F.sum(F.abs(F.col("r") - F.col("old"))).alias("d")).first().d < n * tolerance:
                ranks = step.select("x", "r")
                break
        ranks = step.select("x", "r")
    else:
        if rounds is None:
            raise ArithmeticError("PageRank did not converge")
    return notes.select("id").join(ranks.withColumnRenamed("x", "id"), "id", "left").select("id", F.coalesce("r", F.lit(0.0)).alias("score"))


def _held(x: np.ndarray, y: np.ndarray, sources: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """``start, ends, sources, names``: adjacency arrays of the vertices numbered anew by falling degree, each one's neighbours ascending, and the
    sources so that those with the same best-linked neighbours come together: their distances differ little, so their levels are the same rows."""
    names = np.argsort(-np.bincount(x, minlength=n), kind="stable")
    place = np.empty(n, np.int32)
    place[names] = np.arange(n, dtype=np.int32)
    x, y = place[x], place[y]
    order = np.lexsort((y, x))
    start, ends = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))]), y[order]
    first = start[:-1][place[sources]]
    return start, ends, place[sources][np.lexsort((ends[np.minimum(first + 1, len(ends) - 1)], ends[first]))], names


def _neighbours_of(start, ends, rows, todo):
    """The vertices of ``todo`` next to ``rows``, ascending."""
    sizes = start[rows + 1] - start[rows]
    near = ends[np.repeat(start[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    near = near[todo[near]]
    if len(near) < len(todo) // 8:
        return np.unique(near)
    met = np.zeros(len(todo), bool)
    met[near] = True
    return np.flatnonzero(met)


def _sums(start, ends, values, rows, out):
    """Put the sum of its neighbours' ``values`` into ``out`` for each of the ascending ``rows``; yields the parts that are done.

    Degrees fall along the rows, so the k-th neighbours of a part are those of its first rows: they are added as one block."""
    first, sizes = start[rows], start[rows + 1] - start[rows]
    spare = np.empty((min(PART_ROWS, len(rows)), values.shape[1]), values.dtype)
    for lo in range(0, len(rows), PART_ROWS):
        part = slice(lo, min(lo + PART_ROWS, len(rows)))
        hubs = lo + int(np.searchsorted(-sizes[part], -HUB_LINKS))
        for i in range(lo, hubs):
            np.add.reduce(np.take(values, ends[first[i] : first[i] + sizes[i]], axis=0), axis=0, out=out[i])
        if hubs < part.stop:
            at, size, to = first[hubs : part.stop], sizes[hubs : part.stop], out[hubs : part.stop]
            np.take(values, ends[at], axis=0, out=to, mode="clip")
            for k, c in enumerate(np.searchsorted(-size, -np.arange(1, size[0])).tolist(), 1):
                to[:c] += np.take(values, ends[at[:c] + k], axis=0, out=spare[:c], mode="clip")
        yield part


def _levels(start, ends, sources, values):
    """Breadth-first levels of a block of sources, a column each: the rows that are on the level of some source, and the number of shortest paths
    where they are, 0 elsewhere.  None if a number is too large for ``values`` to count exactly."""
    n, b, at = len(start) - 1, len(sources), np.arange(len(sources))
    unseen, todo = np.ones((n, b), bool), np.ones(n, bool)
    unseen[sources, at] = False
    rows = np.sort(sources)
    paths = np.zeros((b, b), values.dtype)
    paths[np.searchsorted(rows, sources), at] = 1
    levels = []
    while len(rows):
        levels.append((rows, paths))
        values[rows] = paths
        to = _neighbours_of(start, ends, rows, todo)
        out, some, most = np.empty((len(to), b), values.dtype), np.empty(len(to), bool), 0.0
        for part in _sums(start, ends, values, to, out):
            r, got = to[part], out[part]
            left = unseen[r]
            got *= left
            fresh, most = got != 0, max(most, got.max())
            left &= ~fresh
            unseen[r], todo[r], some[part] = left, left.any(axis=1), fresh.any(axis=1)
        values[rows] = 0
        if values.dtype == np.float32 and most >= 1 << 24:
            return None
        rows, paths = (to, out) if some.all() else (to[some], np.compress(some, out, axis=0))
    return levels


def _brandes(held, n: int):
    """Dependencies of blocks of sources given by number, on adjacency arrays that every worker holds.

    The sources of a block are columns of one matrix, so each link is followed once for all of them on a level.  Paths are counted in 32-bit floats,
    which are exact below 2^24, and again in 64-bit ones where there are more."""
    width = block_width(n)

    def run(batches):
        start, ends, sources, names = held.value
        total = np.zeros(n)
        room = {}
        for batch in batches:
            for k in batch.column(0).to_pylist():
                block = sources[k * width : (k + 1) * width]
                b = len(block)
                for kind in (np.float32, np.float64):
                    if (kind, b) not in room:
                        room[kind, b] = np.zeros((n, b), kind)
                levels = _levels(start, ends, block, room[np.float32, b]) or _levels(start, ends, block, room[np.float64, b])
                values, due = room[np.float64, b], None
                for (rows, paths), (above, fewer) in zip(levels[:1:-1], levels[-2:0:-1]):
                    values[rows] = np.minimum(paths, 1.0) / np.maximum(paths, 1.0).astype(float) if due is None else due
                    due = np.empty((len(above), b))
                    for part in _sums(start, ends, values, above, due):
                        got, p = due[part], fewer[part]
                        got *= p
                        total[above[part]] += got.sum(axis=1)
                        got += np.minimum(p, 1)  # now (1 + delta) / sigma, 0 where the row is on another level
                        got /= np.maximum(p, 1)
                    values[rows] = 0
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names[got]), pa.array(total[got])], ["v", "delta"])

    return run


def block_width(n: int) -> int:
    """Sources a worker walks from at once: fewer on a large graph, as its matrices have a row per vertex."""
    return max(1, min(32, (1 << 22) // n))


def _alike(start: np.ndarray, ends: np.ndarray, sources: np.ndarray, block: int = 64, marks: int = 32, far: int = 8) -> np.ndarray:
    """The sources so that those of a block have much the same distances: halved again and again along the direction in which their distances to the
    best-linked vertices differ most.  Only the time hangs on it, so distances from ``far`` on count as one."""
    n, x = len(start) - 1, np.repeat(np.arange(len(start) - 1, dtype=np.int32), np.diff(start))
    away = np.full((len(sources), marks), far, np.float32)
    for mark in range(min(marks, n)):
        unseen, near = np.ones(n, bool), np.zeros(n, bool)
        near[mark] = True
        for d in range(far):
            away[near[sources], mark] = d
            unseen &= ~near
            met = np.zeros(n, bool)
            met[ends[near[x]]] = True
            near = met & unseen
    done, parts = [], [np.arange(len(sources))]
    while parts:
        part = parts.pop()
        if len(part) <= block:
            done.append(part)
            continue
        rows = away[part] - away[part].mean(axis=0)
        order = np.argsort(rows @ np.linalg.eigh(rows.T @ rows)[1][:, -1], kind="stable")
        half = -(-(len(part) // 2) // block) * block
        parts += [part[order[half:]], part[order[:half]]]
    return sources[np.concatenate(done)]


def _walker(spark, held) -> str | None:
    """The name of an SQL function of two numbers, the sum of the dependencies of the sources from one to the other (``Betweenness.java``)."""
    walk = java_class(spark, "notefathom.Betweenness", Path(__file__).with_name("Betweenness.java").read_text())
    if walk is None:
        return None
    start, ends, sources, _ = held
    n, sources = len(start) - 1, _alike(start, ends, sources)
    file, path = tempfile.mkstemp()
    try:
        with os.fdopen(file, "wb") as out:
            for part in ([n, len(ends), len(sources)], start, ends, sources):
                np.asarray(part, "<i4").tofile(out)
        gateway = spark.sparkContext._gateway
        kinds = gateway.new_array(gateway.jvm.java.lang.Class, 2)
        kinds[0], kinds[1] = spark.sparkContext._jsc.getClass(), gateway.jvm.java.lang.Class.forName("java.lang.String")
        args = gateway.new_array(gateway.jvm.java.lang.Object, 2)
        args[0], args[1] = spark.sparkContext._jsc, path
        made = walk.getMethod("over", kinds).invoke(None, args)
    finally:
        os.unlink(path)
    spark._jsparkSession.udf().register("notefathom_betweenness", made, gateway.jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return "notefathom_betweenness"


def _by_vertex(names, n: int):
    """Rows of the sums that ``_walker`` gives; ``names`` are the vertices by the numbers that those have there."""

    def run(batches):
        total = np.zeros(n)
        for batch in batches:
            for sums in batch.column(0):
                total += np.frombuffer(sums.as_buffer(), "<f8")
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names.value[got]), pa.array(total[got])], ["v", "delta"])

    return run


def _brandes_joined(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Dependencies of a block of sources by joins: one breadth-first round per level, then back."""
    seen = cut_lineage(sources.select(F.col("v").alias("s"), "v", F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))
    frontier, depth = seen, 0
    while True:
        step = frontier.join(links, frontier.v == links.x).groupBy("s", F.col("y").alias("v")).agg(F.sum("sigma").alias("sigma"))
        fresh = cut_lineage(step.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(depth + 1).alias("d"), "sigma"))
        if not fresh.limit(1).count():
            break
        seen, frontier, depth = cut_lineage(seen.unionByName(fresh)), fresh, depth + 1
    delta = None
    for d in range(depth, 0, -1):
        low = seen.where(F.col("d") == d)
        low = low.withColumn("delta", F.lit(0.0)) if delta is None else low.join(delta, ["s", "v"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        up = low.join(links.select(F.col("x").alias("v"), F.col("y").alias("u")), "v").join(seen.where(F.col("d") == d - 1).select("s", F.col("v").alias("u"), F.col("sigma").alias("sigma_u")), ["s", "u"])
        got = up.groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("sigma_u") / F.col("sigma") * (1 + F.col("delta"))).alias("delta"))
        got = cut_lineage(got)
        delta = got
        part = got.where("v != s").groupBy("v").agg(F.sum("delta").alias("delta"))
        total = part if d == depth else total.unionByName(part)
    return total if depth else sources.select("v", F.lit(0.0).alias("delta")).limit(0)


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``key`` with dense numbers from 0: sorted ranges are counted, and only the counts per range meet in one place."""
    parts = cut_lineage(rows.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return parts.join(F.broadcast(before), "part").select(key, (F.col("before") + F.col("at")).alias(name))


def betweenness(notes: DataFrame, pairs: DataFrame, pivots: int | None = None, seed: int = 42, rows: int = BLOCK_ROWS) -> DataFrame:
    """Brandes' sums, scaled by 1 / ((n - 1)(n - 2)).

    Exact sums cost vertices times edges, whatever the plan.  A graph of checked size goes to every executor as integers, and blocks of sources
    are spread over them (in Java; in numpy where Spark's Java compiler is missing).  A larger one is walked by joins keyed by (source, vertex), as many sources at once as make about ``rows`` such rows.
    ``pivots`` takes that many sources, drawn by hash, and scales their sums up: an estimate, for graphs on which exact sums are out of reach.
    """
    n = notes.count()
    simple = cut_lineage(pairs.where("a != b"))
    m = simple.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if not m:
        return notes.select("id", F.lit(0.0).alias("score"))
    index = cut_lineage(numbered(simple.select(F.col("a").alias("id")).union(simple.select("b")).distinct(), "id", "v"))
    size = index.count()
    sources = index.select("v")
    if pivots is not None and pivots < size:
        sources, scale = sources.orderBy(F.xxhash64("v", F.lit(seed))).limit(pivots), scale * size / pivots
    end = lambda c: index.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"))
    links = cut_lineage(neighbours(simple).join(end("x"), "x").join(end("y"), "y").select(F.col("vx").alias("x"), F.col("vy").alias("y")))
    spark = notes.sparkSession
    if m <= HELD_EDGES:
        got = links.select(F.col("x").cast("int"), F.col("y").cast("int")).toArrow()  # 2 * HELD_EDGES rows of 8 bytes at most
        x, y = got.column("x").to_numpy(), got.column("y").to_numpy()
        held = _held(x, y, sources.toArrow().column("v").to_numpy(), size)
        count, tasks = len(held[2]), 8 * spark.sparkContext.defaultParallelism
        walk = _walker(spark, held)
        if walk:
            blocks = -(-count // 64)
            tasks, at = min(blocks, tasks), lambda k: F.least(F.floor(k * blocks / tasks) * 64, F.lit(count)).cast("int")
            spread = spark.range(0, tasks, 1, tasks).select(F.call_function(walk, at(F.col("id")), at(F.col("id") + 1)))
            run = _by_vertex(spark.sparkContext.broadcast(held[3]), size)
        else:
            blocks = -(-count // block_width(size))
            spread, run = spark.range(0, blocks, 1, min(blocks, tasks)), _brandes(spark.sparkContext.broadcast(held), size)
        sums = spread.mapInArrow(run, "v long, delta double").groupBy("v").agg(F.sum("delta").alias("delta"))
    else:
        blocks = max(1, -(-sources.count() * size // rows))
        every = cut_lineage(sources.withColumn("block", F.pmod("v", F.lit(blocks))))
        sums = None
        for k in range(blocks):
            part = _brandes_joined(links, every.where(F.col("block") == k))
            last, sums = sums, cut_lineage((part if sums is None else sums.unionByName(part)).groupBy("v").agg(F.sum("delta").alias("delta")))
            if last is not None:
                discard(last)
    scores = sums.join(index, "v").select("id", F.col("delta").alias("sum"))
    return notes.select("id").join(scores, "id", "left").select("id", (F.coalesce("sum", F.lit(0.0)) * scale).alias("score"))


def bridging(scores: DataFrame, n: int) -> DataFrame:
    """The score divided once more by the number of pairs, and kept within [0, 1]; fewer than two notes give nothing."""
    if n < 2:
        return scores.limit(0)
    return scores.select("id", F.least(F.greatest(F.col("score") / (n * (n - 1) / 2), F.lit(0.0)), F.lit(1.0)).alias("score"))


def rank_notes(notes: DataFrame, edges: DataFrame, metric: str = "both", limit: int = 20, least_links: int = 2, rounds: int | None = None) -> DataFrame:
    """``metric, id, title, score``: the best notes by influence (PageRank, with a least number of linking notes), by bridging, or a list of
    each.  Scores that agree to 12 digits are ties, which the id breaks."""
    if metric not in ("influence", "bridging", "both"):
        raise ValueError(f"unknown metric {metric!r}")
    notes = cut_lineage(notes.select("id", "title"))  # read time and again below
    directed = cut_lineage(build(notes, edges))
    pairs, lists = undirected(directed), {}
    if metric != "bridging":
        linked = directed.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= least_links)
        lists["influence"] = pagerank(notes, pairs, rounds=rounds).join(linked.select("id"), "id", "left_semi")
    if metric != "influence":
        lists["bridging"] = bridging(betweenness(notes, pairs), notes.count())
    best = [rows.join(notes.select("id", "title"), "id").orderBy(F.desc(F.round("score", 12)), "id").limit(limit).select(F.lit(name).alias("metric"), "id", "title", "score") for name, rows in lists.items()]
    return best[0] if len(best) == 1 else best[0].unionByName(best[1])


def connections(pairs: DataFrame, seed: str, depth: int) -> DataFrame:
    """``id, distance`` of what is within ``depth`` hops of the seed, the seed left out; a frontier per hop."""
    both = neighbours(pairs)
    seen = both.sparkSession.createDataFrame([(seed, 0)], "id string, distance int")
    frontier = seen
    for d in range(1, depth + 1):
        step = both.join(frontier.select(F.col("id").alias("x")), "x").select(F.col("y").alias("id")).distinct()
        frontier = cut_lineage(step.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


def subgraph(directed: DataFrame, members: DataFrame) -> DataFrame:
    """Edges among a set of ids."""
    ids = members.select("id")
    return directed.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def latest_context(edges: DataFrame) -> DataFrame:
    """Per pair the context of its latest link."""
    return edges.groupBy("source_id", "target_id").agg(F.max_by("context", "id").alias("context"))


def simple_paths(pairs: DataFrame, start: str, end: str, most: int = 3) -> DataFrame:
    """All simple paths of at most ``most`` edges, as arrays of ids.

    Frontiers grow from both ends and meet in a join, so only half the depth is expanded from either side; a path may
    not come back to a vertex.
    """
    spark = pairs.sparkSession
    if start == end:
        return spark.createDataFrame([([start], 0)], "path array<string>, length int")
    both = neighbours(pairs.where("a != b"))

    def grown(seed: str, other: str, steps: int) -> list[DataFrame]:
        out = [spark.createDataFrame([([seed],)], "path array<string>")]
        for _ in range(steps):
            last = out[-1].where(F.element_at("path", -1) != other)
            out.append(cut_lineage(last.join(both, F.element_at("path", -1) == F.col("x")).where(~F.array_contains("path", F.col("y"))).select(F.concat("path", F.array("y")).alias("path"))))
        return out

    left, right = grown(start, end, (most + 1) // 2), grown(end, start, most // 2)
    found = None
    for length in range(1, most + 1):
        i = (length + 1) // 2
        j = length - i
        a = left[i].select(F.col("path").alias("p"), F.element_at("path", -1).alias("mid"))
        b = right[j].select(F.col("path").alias("q"), F.element_at("path", -1).alias("mid"))
        met = a.join(b, "mid").select("p", F.slice(F.reverse("q"), 2, 1 << 20).alias("q")).where(~F.arrays_overlap("p", "q") | (F.size("q") == 0))
        met = met.select(F.concat("p", "q").alias("path"), F.lit(length).alias("length"))
        found = met if found is None else found.unionByName(met)
    return found.distinct()


def path_hops(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, hop, source_id, target_id, context`` of each step of each path: the context of the latest link forward, else of the latest back."""
    hops = paths.where(F.size("path") > 1).select(F.array_join("path", " > ").alias("trail"), F.posexplode(F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda a, i: F.struct(a.alias("a"), F.get("path", i + 1).alias("b")))).alias("hop", "h"))
    hops = hops.select(F.col("trail").alias("path"), "hop", F.col("h.a").alias("source_id"), F.col("h.b").alias("target_id"))
    known = latest_context(edges).select("source_id", "target_id", F.struct("context").alias("c"))
    back = known.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"), F.col("c").alias("r"))
    got = hops.join(known, ["source_id", "target_id"], "left").join(back, ["source_id", "target_id"], "left")
    return got.select("path", "hop", "source_id", "target_id", F.coalesce("c", "r")["context"].alias("context"))


def common_neighbours(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """G10/U3/J14."""
    both = neighbours(pairs)
    return both.where(F.col("x") == a).select(F.col("y").alias("id")).intersect(both.where(F.col("x") == b).select("y")).where(~F.col("id").isin(a, b))
