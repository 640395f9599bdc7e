"""Near-duplicate records with small edits (problem 3): an exact similarity join by token-group matrix.

A record is the set of its distinct three-word sequences.  Records with one set form a class and are compared once.

1. A counting sketch of bounded size tells about how often each sequence occurs in the whole collection; it only sets the
   order of sequences, rare ones first, so its error costs time and never a pair.
2. Two sets that agree to the threshold share at least k sequences among the first ``n - ceil(t n) + k`` of each.  Those
   prefixes are the tokens of the matrix.  Classes are partitioned into groups by the smallest hash in their prefix, which
   similar sets mostly share; sequences that are common everywhere never name a group.
3. The token-group matrix holds for each token the groups whose members' prefixes have it, with the members' size range, so
   a family of near-copies takes one row per token however large it is.  Per class and group the matrix bounds the
   overlap; groups below the bound are not opened.
4. Members of opened groups are compared with the class: prefix overlap and size first, then the whole sets.

Groups and classes may hold a third of all rows: joins on them run in a grid of blocks of askers and blocks of members.  Texts are
cut into words once; the later steps read the hashes of the words from the shared folder.

Defined results: null contents, and texts under the least number of words, take part in no pair; repeated rows and copies
pair like any other rows of different ids; a null id differs from every id but not from another null.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, discard, table
from .sketch import coded, sketch

THRESHOLD, LEAST_WORDS, SHARED = 0.7, 30, 3
#: log2 of the sketch's cells: one byte each when broadcast, so never over 16 MB.
MOST_BITS = 24
#: Bits per class of the filter that tells whose whole sets are needed, and log2 of the most bits it may have (16 MB).
FILTER_DENSITY, MOST_FILTER_BITS = 16, 27
#: Members, and askers, of one block of a salted join.
BLOCK, ASKERS = 500, 20_000
#: Entries of a token above which its groups are met in blocks.
HOT = 2_000

_U = np.uint64
_WORD_HASHES: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hash(word: str) -> int:
    found = _WORD_HASHES.get(word)
    if found is None:
        if len(_WORD_HASHES) >= 500_000:
            _WORD_HASHES.clear()
        found = _WORD_HASHES[word] = xxhash.xxh3_64_intdigest(word)
    return found


_WORDS = re.compile(r"[^\W_]+").findall


def words(titles: pa.Array, contents: pa.Array, least: int) -> tuple[np.ndarray, pa.Array]:
    """Rows with at least ``least`` words in title and content, and the hashes of those words in one sequence each, as bytes."""
    rows, flat, ends = [], [], [0]
    for k, (t, c) in enumerate(zip(titles.to_pylist(), contents.to_pylist())):
        found = _WORDS(f"{t} {c}".lower() if t else c.lower()) if c is not None else ()
        if len(found) >= least:
            rows.append(k)
            flat += found
            ends.append(len(flat))
    coded = pa.array(flat, pa.string()).dictionary_encode()
    names = np.fromiter(map(_word_hash, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = names[coded.indices.to_numpy()] if len(flat) else names
    return np.array(rows, np.int64), pa.array([hashes[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())


def _unpacked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each record, and all hashes one after the other."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] // 8 if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2] if len(words) else None
    return np.diff(ends).astype(np.int64), np.frombuffer(data, np.uint64, ends[-1])[ends[0] :] if data is not None and ends[-1] else np.empty(0, np.uint64)


def _grouped(rec: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``order``, sorted by record and otherwise left as it is; few records sort by radix."""
    key = rec[order]
    return order[np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")]


def sequences(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(record, hash)`` of the distinct three-word sequences of a batch of hashed words, sorted by both."""
    sizes, w = _unpacked(words)
    if len(w) < 3:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    rec = np.repeat(np.arange(len(sizes)), sizes)
    h = _mix(_mix(_mix(w[:-2] + _U(0x9E3779B97F4A7C15)) + w[1:-1]) + w[2:])
    whole = rec[:-2] == rec[2:]
    rec, h = rec[:-2][whole], h[whole]
    order = _grouped(rec, np.argsort(h))
    rec, h = rec[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (rec[1:] != rec[:-1])
    return rec[first], h[first]


def _cells(bits: int):
    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        _, h = sequences(batch.column(0))
        return (h >> _U(64 - bits)).astype(np.int64), np.ones(len(h), np.int64)

    return of


# ---- records ------------------------------------------------------------------------------------------------------

_WORDED = pa.schema([("row_id", pa.int64()), ("id", pa.string()), ("words", pa.binary())])
_WORDED_DDL = "row_id long, id string, words binary"


def _worded(least_words: int):
    def run(batches):
        for batch in batches:
            rows, hashes = words(batch.column(2), batch.column(3), least_words)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), hashes], schema=_WORDED)

    return run


def worded(nodes: DataFrame, least_words: int) -> DataFrame:
    """``row_id, id, words`` of the records with enough words, cut and hashed once for all later steps."""
    long = F.coalesce(F.length("title"), F.lit(0)) + F.length("content") + 1 >= 2 * least_words - 1
    some = nodes.where(F.col("content").isNotNull() & long)
    return cut_lineage(some.select(F.col("row_id").cast("long"), F.col("id").cast("string"), F.col("title").cast("string"), F.col("content").cast("string")).mapInArrow(_worded(least_words), _WORDED_DDL))


_RECORD = pa.schema([("row_id", pa.int64()), ("id", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("grp", pa.int64()), ("prefix", pa.list_(pa.int64())), ("often", pa.list_(pa.int64()))])
_RECORD_DDL = "row_id long, id string, k1 long, k2 long, n int, grp long, prefix array<long>, often array<long>"


def need(n, threshold: float):
    """Least overlap of a set of ``n`` with any set similar to it."""
    return np.ceil(n * threshold - 1e-9)


def _records(cells, bits: int, threshold: float):
    hot = int(coded(np.array([HOT]))[0]) - 1

    def run(batches):
        counts = np.frombuffer(cells.value, np.uint8)
        for batch in batches:
            rec, h = sequences(batch.column(2))
            rows, start = np.unique(rec, return_index=True)
            if not len(rows):
                continue
            n = np.diff(np.append(start, len(rec)))
            k1 = np.add.reduceat(_mix(h + _U(0x632BE59BD9B4E019)), start)
            k2 = np.add.reduceat(_mix(h ^ _U(0xD6E8FEB86659FD93)), start)
            often = counts[(h >> _U(64 - bits)).astype(np.int64)]
            order = _grouped(rec, np.argsort(often, kind="stable"))
            rank = np.arange(len(rec)) - np.repeat(start, n)
            most = n - need(n, threshold) + np.minimum(SHARED, need(n, threshold))
            keep = (rank < np.repeat(most, n)) & (often[order] != 1)  # a count of 1 is sure to be the only one
            kept = np.add.reduceat(keep.astype(np.int64), start)
            tokens = h[order]
            lowest = np.minimum.reduceat(np.where(keep, tokens, _U(2**64 - 1)), start)
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept)), pa.int32()), pa.array(tokens[keep].view(np.int64)))
            many = keep & (often[order] > hot)  # the sketch never counts too low, so hot tokens are among these
            held = np.add.reduceat(many.astype(np.int64), start)
            maybe = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), pa.array(tokens[many].view(np.int64)))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), batch.column(1).take(take), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                pa.array(n.astype(np.int32)), pa.array(lowest.view(np.int64)), prefix, maybe,
            ], schema=_RECORD)

    return run


def _bits_for(total: int) -> int:
    return max(12, min(MOST_BITS, math.ceil(math.log2(2 * max(1, total)))))


def blocked(many: DataFrame, members: DataFrame, on: list[str], asker: str, member: str) -> DataFrame:
    """``many`` join ``members`` on keys that may be hot on either side: askers and members fall into blocks, and each block of askers
    meets each block of members of its key in a group of its own."""
    held = members.groupBy(*on).agg((1 + F.floor(F.count("*") / BLOCK)).cast("int").alias("blocks")).where("blocks > 1")
    asked = many.groupBy(*on).agg((1 + F.floor(F.count("*") / ASKERS)).cast("int").alias("parts")).where("parts > 1")
    # only hot keys are in the grid; as a written table its size is known, and Spark broadcasts it where that is small
    grid = cut_lineage(held.join(asked, on, "full"))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(n, F.lit(1))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    salted = members.join(grid, on, "left").withColumn("salt", own(member, F.col("blocks"))).withColumn("part", each(F.col("parts"))).drop("blocks", "parts")
    spread = many.join(grid, on, "left").withColumn("part", own(asker, F.col("parts"))).withColumn("salt", each(F.col("blocks"))).drop("blocks", "parts")
    return spread.join(salted, [*on, "salt", "part"]).drop("salt", "part")


_SET = pa.schema([("row_id", pa.int64()), ("seqs", pa.list_(pa.int64()))])


def whole_sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``row_id, seqs`` of the rows of ``worded`` whose ``row_id`` is among the ``rep`` of ``ids``, and maybe of some others.

    A bitmap of ``FILTER_DENSITY`` bits an id tells, whose false hits only cost time; where it would be over its bound, a
    semi-join on the ids does.
    """
    wanted = ids.distinct().count()
    bits = max(16, math.ceil(math.log2(FILTER_DENSITY * max(1, wanted))))
    if bits > MOST_FILTER_BITS:
        some, held = rows.where("row_id is not null").join(ids.select(F.col("rep").alias("row_id")).distinct(), "row_id", "left_semi").select(F.lit(0).cast("long").alias("bit"), "row_id", "words"), None
    else:
        size = 1 << bits
        bit = F.pmod(F.xxhash64("rep"), F.lit(size)) + 1  # the bitmap functions count from 1
        parts = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()
        flags = np.zeros(size, bool)
        for r in parts:  # 2 ** MOST_FILTER_BITS bits at most
            got = np.unpackbits(np.frombuffer(r.map, np.uint8), bitorder="little")
            flags[(r.bucket - 1) * len(got) : r.bucket * len(got)] = got[: size - (r.bucket - 1) * len(got)]
        held = rows.sparkSession.sparkContext.broadcast(np.packbits(flags).tobytes())
        some = rows.where("row_id is not null").select(F.pmod(F.xxhash64("row_id"), F.lit(size)).alias("bit"), "row_id", "words")

    def run(batches):
        wanted = None if held is None else np.unpackbits(np.frombuffer(held.value, np.uint8)).astype(bool)
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(wanted[batch.column(0).to_numpy()]))
            rec, h = sequences(batch.column(2))
            counts = np.bincount(rec, minlength=batch.num_rows)
            seqs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(1), seqs], schema=_SET)

    return some.mapInArrow(run, "row_id long, seqs array<long>")


class Join:
    """The steps of one similarity join, for the queries that want pairs, classes or groups."""

    def __init__(self, nodes: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS):
        self.threshold = threshold
        self.words = worded(nodes, least_words)
        self.bits = _bits_for(self.words.agg(F.coalesce(F.sum(F.octet_length("words") / 8), F.lit(0)).cast("long").alias("n")).first().n)
        cells = nodes.sparkSession.sparkContext.broadcast(sketch(self.words.select("words"), _cells(self.bits), self.bits).tobytes())
        self.records = cut_lineage(self.words.mapInArrow(_records(cells, self.bits, threshold), _RECORD_DDL))
        self.reps = cut_lineage(
            self.records.groupBy("k1", "k2").agg(F.min("row_id").alias("rep"), F.first("n").alias("n"), F.first("grp").alias("grp"), F.first("prefix").alias("prefix"), F.first("often").alias("often"))
        )

    def candidates(self) -> DataFrame:
        """``rep_a < rep_b`` of classes that the matrix and then the members' prefixes leave."""
        t, reps = self.threshold, self.reps.where(F.size("prefix") > 0)
        entries = reps.select("rep", "n", "grp", F.explode("prefix").alias("token"))
        hot = cut_lineage(reps.select(F.explode("often").alias("token")).groupBy("token").agg(F.count("*").alias("held")).where(F.col("held") > HOT).select("token"))
        least = lambda n: F.least(F.lit(SHARED), F.ceil(n * t - 1e-9))

        def met_groups(entries: DataFrame, hot: bool) -> DataFrame:
            matrix = entries.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("held"))
            query = entries.select("token", "rep", "n", F.col("grp").alias("own"))
            both = blocked(query, matrix, ["token"], "rep", "grp") if hot else query.join(matrix, "token")
            return (
                both.where((F.col("own") != F.col("grp")) | (F.col("held") > 1))
                .where((F.col("least") * t <= F.col("n") + 1e-9) & (F.col("most") + 1e-9 >= F.col("n") * t))
                .groupBy("rep", "n", "grp").agg(F.count("*").alias("shared"), F.min("least").alias("least"))
            )

        if hot.limit(1).count():
            both = met_groups(entries.join(hot, "token", "left_anti").repartition("token"), False).unionByName(met_groups(entries.join(hot, "token", "left_semi"), True))
            shared = both.groupBy("rep", "n", "grp").agg(F.sum("shared").alias("shared"), F.min("least").alias("least"))
        else:
            shared = met_groups(entries.repartition("token"), False)
        opened = cut_lineage(shared.where(F.col("shared") >= F.least(least(F.col("n")), least(F.col("least")))).select("rep", "n", "grp"))
        members = reps.join(opened.select("grp").distinct(), "grp", "left_semi").select("grp", F.col("rep").alias("other"), F.col("n").alias("m"), F.col("prefix").alias("theirs"))
        met = blocked(opened, members, ["grp"], "rep", "other").where(F.col("rep") != F.col("other"))
        met = met.where((F.col("m") * t <= F.col("n") + 1e-9) & (F.col("n") * t <= F.col("m") + 1e-9)).join(reps.select("rep", "prefix"), "rep")
        return (
            met.where(F.size(F.array_intersect("prefix", "theirs")) >= F.least(least(F.col("n")), least(F.col("m"))))
            .select(F.least("rep", "other").alias("rep_a"), F.greatest("rep", "other").alias("rep_b")).distinct()
        )

    def class_pairs(self) -> DataFrame:
        """``rep_a, rep_b, similarity`` of the pairs of classes that reach the threshold."""
        pairs = cut_lineage(self.candidates())
        ids = pairs.select(F.col("rep_a").alias("rep")).union(pairs.select("rep_b"))
        sets = cut_lineage(whole_sets(self.words, ids).dropDuplicates(["row_id"]))
        both = F.size(F.array_intersect("a", "b"))
        joined = pairs.join(sets.select(F.col("row_id").alias("rep_a"), F.col("seqs").alias("a")), "rep_a").join(sets.select(F.col("row_id").alias("rep_b"), F.col("seqs").alias("b")), "rep_b")
        return (
            joined.select("rep_a", "rep_b", both.alias("both"), (F.size("a") + F.size("b")).alias("sum"))
            .select("rep_a", "rep_b", (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity"))
            .where(F.col("similarity") >= self.threshold)
        )

    def membership(self) -> DataFrame:
        """``row_id, id, rep`` of every record that takes part."""
        return self.records.select("row_id", "id", "k1", "k2").join(self.reps.select("k1", "k2", "rep"), ["k1", "k2"]).select("row_id", "id", "rep")

    def row_pairs(self) -> DataFrame:
        """``row_id_a < row_id_b`` of all rows of different ids whose texts are similar; copies are expanded here, in blocks."""
        pairs = cut_lineage(self.class_pairs())
        member = cut_lineage(self.membership())
        twins = member.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"))
        linked = pairs.select("rep_a", "rep_b").union(twins)
        left = blocked(linked, member.select(F.col("rep").alias("rep_a"), F.col("row_id").alias("x"), F.col("id").alias("id_x")), ["rep_a"], "rep_b", "x")
        both = blocked(left, member.select(F.col("rep").alias("rep_b"), F.col("row_id").alias("y"), F.col("id").alias("id_y")), ["rep_b"], "x", "y")
        return (
            both.where(~F.col("id_x").eqNullSafe(F.col("id_y")) & ((F.col("rep_a") != F.col("rep_b")) | (F.col("x") < F.col("y"))))
            .select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))
        )


def components(pairs: DataFrame) -> DataFrame:
    """``rep, grp``: connected components of class pairs, named by their least class.

    Each round takes the least label of the neighbours and then the label of that label, so the rounds grow with the logarithm of the
    longest chain; every round is written to the shared folder.
    """
    links = cut_lineage(pairs.select(F.col("rep_a").alias("x"), F.col("rep_b").alias("y")).union(pairs.select("rep_b", "rep_a")))
    labels = cut_lineage(links.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")))
    last = labels
    while True:
        near = links.join(labels.select(F.col("x").alias("y"), F.col("label").alias("theirs")), "y").groupBy("x").agg(F.min("theirs").alias("theirs"))
        low = labels.join(near, "x").select("x", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        jump = labels.select(F.col("x").alias("label"), F.col("label").alias("further"))
        step = cut_lineage(low.join(jump, "label", "left").select("x", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = step.where("old != label").limit(1).count()
        discard(last)
        last, labels = step, step.select("x", "label")
        if not changed:
            return labels.select(F.col("x").alias("rep"), F.col("label").alias("grp"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows of different notes with nearly the same text."""
    return Join(table(spark, folder, "nodes")).row_pairs()


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: its class of equal texts, its group of linked classes, and its class's number of links."""
    join = Join(table(spark, folder, "nodes"))
    pairs = cut_lineage(join.class_pairs())
    links = pairs.select(F.col("rep_a").alias("rep")).union(pairs.select("rep_b")).groupBy("rep").agg(F.count("*").alias("links"))
    return (
        join.membership().join(components(pairs), "rep", "left").join(links, "rep", "left")
        .select("row_id", F.col("rep").alias("class_id"), F.coalesce("grp", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
