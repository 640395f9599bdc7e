"""References to records that do not exist, per table, reason and month (problem 2).

Keys are normalised paths.  Per key range the distinct keys are dictionary-encoded as dense integers; for each
range and period the referring keys become a compressed bitmap, and the parent side one bitmap per state (there, removed).
``reference AND-NOT there`` and ``reference AND removed`` give the orphans, whose surviving bits are decoded to keys and
joined back to the references.  Only one row per distinct (key, period) enters a range, so a hot key costs no more
than a cold one; the number of ranges grows with the rows, so a range stays bounded.

Headings and blocks go through the same operator: the key is then path and subpath, the parents are the pairs that an
evaluation of the note's outline accepts.

Defined results: a null target or path is no reference; a null or blank subpath is none either; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsontext
from ..functions.arrow import per_value
from ..session import cut_lineage, table

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_LEAD = re.compile(r"^(?:\.?/|\s)+")

#: Rows of distinct (key, period) and parents that one key range is meant to hold.
RANGE_ROWS = 200_000


def _unescaped(m: re.Match) -> str:
    try:
        return unquote_to_bytes(m[0]).decode()
    except UnicodeDecodeError:
        return m[0]


def path_key(text: str | None, stubs: bool = True) -> str | None:
    """The path a spelling stands for; ``stubs``: also without ``_stub/`` in front."""
    if text is None:
        return None
    if "%" in text:
        text = _PERCENT.sub(_unescaped, text)
    text = text.replace("\\", "/").strip()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = _LEAD.sub("", text)
    while stubs and text.startswith("_stub/"):
        text = _LEAD.sub("", text[6:])
    return text if text.endswith(".md") else text + ".md"


path_key_column = per_value(path_key, T.StringType(), pa.string())
note_key_column = per_value(lambda t: path_key(t, stubs=False), T.StringType(), pa.string())
is_stub_column = per_value(lambda t: isinstance(o := jsontext.read(t), dict) and o.get("_stub") is True, T.BooleanType(), pa.bool_())

_OPEN = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_HEADING = re.compile(r"(#{1,6})\s+(\S.*)$")
_BLOCK = re.compile(r"(?:^|\s)\^([^\W_](?:[^\W_]|-)*|-[\w-]*)\s*$")
_BREAK = re.compile(r"\r\n|\n|\r")


def heading_key(text: str) -> str:
    return " ".join(text.lower().split())


def outline(content: str | None) -> list[dict]:
    """Headings (level, text) and block ids (level 0) of a text in order, those in code fences left out."""
    out: list[dict] = []
    if not content or "#" not in content and "^" not in content:
        return out
    fence = None
    for line in _BREAK.split(content):
        if fence:
            bare = line.strip()
            if len(bare) >= len(fence) and not bare.strip(fence[0]):
                fence = None
            continue
        if m := _OPEN.match(line):
            fence = m[1]
            continue
        if m := _HEADING.match(line):
            out.append({"level": len(m[1]), "name": heading_key(m[2])})
        if "^" in line and (m := _BLOCK.search(line)):
            out.append({"level": 0, "name": m[1]})
    return out


def anchor_there(entries: list[dict], subpath: str) -> bool:
    """Whether an outline has the block, the heading, or the headings one under the other; a ``#`` in a subpath always joins."""
    want = subpath.strip()
    if any(not e["level"] and e["name"] == want for e in entries):
        return True
    heads = [(e["level"], e["name"]) for e in entries if e["level"]]
    parts = [p for p in map(heading_key, want.split("#")) if p]
    ends = [next((j for j in range(i + 1, len(heads)) if heads[j][0] <= level), len(heads)) for i, (level, _) in enumerate(heads)] if len(parts) > 1 else heads
    within = [(-1, len(heads))]
    for n, part in enumerate(parts):
        within = [(i, ends[i] if n + 1 < len(parts) else i) for i, (_, name) in enumerate(heads) if name == part and any(a < i < b for a, b in within)]
    return bool(parts and within)


_OUTLINE_TYPE = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("name", T.StringType())]))
_OUTLINE = pa.list_(pa.struct([("level", pa.int32()), ("name", pa.string())]))


@F.arrow_udf(_OUTLINE_TYPE)
def outline_column(contents: pa.Array) -> pa.Array:
    return pa.array([outline(c) for c in contents.to_pylist()], type=_OUTLINE)


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def anchors_there(entries: pa.Array, subpaths: pa.Array) -> pa.Array:
    out = [[anchor_there(e or [], s) for s in asked] for e, asked in zip(entries.to_pylist(), subpaths.to_pylist())]
    return pa.array(out, type=pa.list_(pa.bool_()))


# ---- compressed bitmaps -------------------------------------------------------------------------------------------


class Bitmap:
    """A set of dense codes, kept as sorted integers while sparse and as deflated bits while dense."""

    __slots__ = ("size", "codes", "bits")

    def __init__(self, size: int, codes: np.ndarray):
        codes = np.unique(codes)
        self.size, self.codes, self.bits = size, None, None
        if len(codes) * 32 < size:
            self.codes = codes.astype(np.uint32)
        else:
            flags = np.zeros(size, bool)
            flags[codes] = True
            self.bits = zlib.compress(np.packbits(flags).tobytes(), 1)

    def flags(self) -> np.ndarray:
        if self.bits is not None:
            return np.unpackbits(np.frombuffer(zlib.decompress(self.bits), np.uint8), count=self.size).astype(bool)
        out = np.zeros(self.size, bool)
        out[self.codes] = True
        return out

    def and_not(self, other: Bitmap) -> Bitmap:
        if self.codes is not None:
            return Bitmap(self.size, self.codes[~other.flags()[self.codes]])
        return Bitmap(self.size, np.flatnonzero(self.flags() & ~other.flags()))

    def and_(self, other: Bitmap) -> Bitmap:
        if self.codes is not None:
            return Bitmap(self.size, self.codes[other.flags()[self.codes]])
        return Bitmap(self.size, np.flatnonzero(self.flags() & other.flags()))

    def decode(self) -> np.ndarray:
        return self.codes if self.codes is not None else np.flatnonzero(self.flags())


_FOUND = pa.schema([("ref_table", pa.string()), ("key", pa.string()), ("period", pa.string()), ("reason", pa.string()), ("first_loaded", pa.timestamp("us"))])
_FOUND_DDL = "ref_table string, key string, period string, reason string, first_loaded timestamp_ntz"


def _range_orphans(data: pa.Table) -> pa.Table:
    """Orphans of one key range.  Rows with a null ``ref_table`` are parents: ``removed`` and ``at`` (first load); the others
    are distinct references, ``at`` their earliest load."""
    coded = data.column("key").combine_chunks().dictionary_encode()
    code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    size = len(names)
    tables = data.column("ref_table").combine_chunks().dictionary_encode()
    periods = data.column("period").combine_chunks().dictionary_encode()
    parent = tables.is_null().to_numpy(zero_copy_only=False)
    at = data.column("at").cast(pa.timestamp("us")).cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()
    removed = data.column("removed").fill_null(False).to_numpy()
    there, gone = Bitmap(size, code[parent]), Bitmap(size, code[parent & removed])
    first = np.full(size, np.iinfo(np.int64).min)
    first[code[parent]] = at[parent]
    out: list[pa.RecordBatch] = []
    t = np.where(parent, -1, tables.indices.fill_null(-1).to_numpy(zero_copy_only=False))
    p = np.where(parent, -1, periods.indices.fill_null(-1).to_numpy(zero_copy_only=False))
    for ti, pi in np.unique(np.stack([t, p], 1)[~parent], axis=0):
        mine = (t == ti) & (p == pi) & ~parent
        refs = Bitmap(size, code[mine])
        early = Bitmap(size, code[mine & (at < first[code])])
        for reason, bits in (("missing", refs.and_not(there)), ("deleted", refs.and_(gone)), ("late", early.and_(there).and_not(gone))):
            if len(found := bits.decode()):
                out.append(pa.RecordBatch.from_arrays([
                    pa.array([tables.dictionary[int(ti)].as_py()] * len(found)), names.take(pa.array(found)),
                    pa.array([periods.dictionary[int(pi)].as_py() if pi >= 0 else None] * len(found), pa.string()),
                    pa.array([reason] * len(found)), pa.array(np.where(reason == "late", first[found], 0)).cast(pa.timestamp("us")),
                ], schema=_FOUND))
    return pa.Table.from_batches(out, schema=_FOUND)


def orphan_keys(refs: DataFrame, parents: DataFrame, ranges: int) -> DataFrame:
    """Orphan (table, key, period, reason) of ``refs(ref_table, key, period, at)`` against ``parents(key, removed, at)``."""
    distinct = refs.groupBy("ref_table", "key", "period").agg(F.min("at").alias("at"))
    both = distinct.withColumn("removed", F.lit(None).cast("boolean")).unionByName(
        parents.select(F.lit(None).cast("string").alias("ref_table"), "key", F.lit(None).cast("string").alias("period"), "at", "removed")
    )
    return both.withColumn("key_range", F.pmod(F.xxhash64("key"), F.lit(ranges))).groupBy("key_range").applyInArrow(_range_orphans, _FOUND_DDL)


def month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def note_states(nodes: DataFrame, library: DataFrame | None) -> DataFrame:
    """``key, removed, at, entries``: per note whether its latest row is removed, its first load, its latest outline."""
    cols = ["row_id", "id", "content", "frontmatter", "loaded_at", "removed_at"]
    every = nodes.select(*cols)
    if library is not None:
        every = every.unionByName(library.select(*cols))
    maybe = F.coalesce(F.col("frontmatter").contains("_stub"), F.lit(False))
    return (
        every.where(F.col("id").isNotNull())
        .withColumn("stub", F.when(maybe, is_stub_column(F.when(maybe, F.col("frontmatter")))).otherwise(False))
        .where(~F.coalesce("stub", F.lit(False)))
        .select(note_key_column("id").alias("key"), F.struct("loaded_at", "row_id").alias("turn"), F.col("removed_at").isNotNull().alias("removed"), "loaded_at", outline_column("content").alias("entries"))
        .groupBy("key")
        .agg(F.max_by(F.struct("removed", "entries"), "turn").alias("last"), F.min("loaded_at").alias("at"))
        .select("key", "last.removed", "at", "last.entries")
    )


#: Parts into which the references of one key and month are spread where they meet what was found of it.
SALTS = 16


def by_key(refs: DataFrame, found: DataFrame, also: list[str] = ()) -> DataFrame:
    """``refs`` with the other columns of ``found``, by key, month and ``also``.  What was found has a row per key and month, so it is
    repeated for every part, and a key with a third of all references goes to ``SALTS`` tasks."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    rest = [c for c in found.columns if c not in ("key", "period", *also)]
    right = found.select(F.col("key").alias("k"), blank("period").alias("p"), *(F.col(c).alias(f"_{c}") for c in also), *rest, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    left = refs.withColumn("salt", F.pmod(F.xxhash64("ref_key"), F.lit(SALTS)))
    on = (F.col("key") == F.col("k")) & (blank("period") == F.col("p")) & (F.col("salt") == F.col("part"))
    for c in also:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return left.join(right, on).drop("k", "p", "salt", "part", *(f"_{c}" for c in also))


def orphan_references(edges: DataFrame, sync: DataFrame, nodes: DataFrame, library: DataFrame | None) -> DataFrame:
    """``ref_table, ref_key, ref_field, reason, seen_month``: one row per broken reference."""
    links = edges.where(F.col("target_id").isNotNull()).select(
        F.lit("edges").alias("ref_table"), F.col("id").cast("string").alias("ref_key"), path_key_column("target_id").alias("key"),
        month(F.col("seen_at")).alias("period"), F.col("loaded_at").cast("timestamp_ntz").alias("at"),
        F.when(F.trim("target_subpath") != "", F.regexp_replace("target_subpath", r"^\s+|\s+$", "")).alias("subpath"),
    )
    paths = sync.where(F.col("path").isNotNull()).select(
        F.lit("sync_state").alias("ref_table"), F.col("path").alias("ref_key"), path_key_column("path").alias("key"),
        month(F.timestamp_millis("indexed_at")).alias("period"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(None).cast("string").alias("subpath"),
    )
    refs = cut_lineage(links.unionByName(paths))
    states = cut_lineage(note_states(nodes, library).withColumn("at", F.col("at").cast("timestamp_ntz")))
    ranges = 1 + (refs.count() + states.count()) // RANGE_ROWS

    broken = orphan_keys(refs, states.select("key", "removed", "at"), ranges)
    whole = (
        by_key(refs, broken, ["ref_table"])
        .where((F.col("reason") != "late") | (F.col("at") < F.col("first_loaded")))
        .select("ref_table", "ref_key", F.when(F.col("ref_table") == "edges", "target_id").otherwise("path").alias("ref_field"), "reason", F.col("period").alias("seen_month"))
    )

    # Anchors: the same operator over (path, subpath); its parents are the pairs the outline accepts.
    with_sub = refs.where(F.col("subpath").isNotNull() & (F.col("subpath") != ""))
    asked = with_sub.groupBy("key", "subpath").agg(F.count("*").alias("n"))
    # the subpaths asked of a note come together, in parts, so its outline is not copied to each of them
    listed = asked.groupBy("key", F.pmod(F.xxhash64("subpath"), F.lit(SALTS)).alias("part")).agg(F.collect_list("subpath").alias("subpaths"))
    judged = cut_lineage(
        listed.join(states.where(~F.col("removed")).select("key", "entries"), "key")
        .select("key", F.explode(F.arrays_zip("subpaths", anchors_there("entries", "subpaths").alias("there"))).alias("x")).select("key", F.col("x.subpaths").alias("subpath"), "x.there")
    )
    pair = F.concat_ws("\u0000", "key", "subpath").alias("key")
    sub_refs = with_sub.join(judged.select("key", "subpath"), ["key", "subpath"], "left_semi").select("ref_table", "ref_key", pair, "period", "at")
    accepted = judged.where("there").select(pair, F.lit(False).alias("removed"), F.lit(None).cast("timestamp_ntz").alias("at"))
    lost = orphan_keys(sub_refs.withColumn("at", F.lit(None).cast("timestamp_ntz")), accepted, ranges).where("reason = 'missing'").select("key", "period")
    anchors = (
        by_key(sub_refs, lost)
        .select("ref_table", "ref_key", F.lit("target_subpath").alias("ref_field"), F.lit("no_anchor").alias("reason"), F.col("period").alias("seen_month"))
    )
    return whole.unionByName(anchors)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every broken reference of ``edges`` and ``sync_state``."""
    return orphan_references(*(table(spark, folder, t) for t in ("edges", "sync_state", "nodes", "library")))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Broken references counted per table, field, reason and month."""
    return p2_found(spark, folder).groupBy("ref_table", "ref_field", "reason", "seen_month").agg(F.count("*").alias("n"))
