"""Incremental maintenance: snapshot differences, content-hash deltas, self-healing, sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M


def deleted(sync: DataFrame, disk: DataFrame) -> DataFrame:
    """Indexed paths that are gone."""
    return sync.join(disk.select("path"), "path", "left_anti").select("path")


def to_index(sync: DataFrame, disk: DataFrame) -> DataFrame:
    """Files to read again: new ones, and those whose time is later than the one indexed."""
    known = sync.groupBy("path").agg(F.max("mtime").alias("indexed"))
    return disk.join(known, "path", "left").where(F.col("indexed").isNull() | (F.col("indexed") < F.col("mtime"))).select("path", "mtime")


def changed_chunks(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks to embed: those whose id and hash are not stored."""
    return fresh.join(stored.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


def stale_chunks(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored chunks no longer made."""
    return stored.join(fresh.select("id"), "id", "left_anti").select("id")


def chunk_rows(notes: DataFrame) -> DataFrame:
    """A row per chunk, ``id`` as ``note::n``."""
    rows = notes.select(F.col("id").alias("node_id"), F.explode(M.chunks("content")).alias("c")).select("node_id", "c.*")
    return rows.withColumn("id", F.concat_ws("::", "node_id", F.col("chunk_index").cast("string")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` over ``old`` by key; written as a new snapshot by the caller."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def index_pass(old_notes: DataFrame, old_sync: DataFrame, disk: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(notes, sync, stats)`` after a full pass over ``disk(path, mtime, raw)``; equal to a rebuild from nothing."""
    todo = disk.join(to_index(old_sync, disk.select("path", "mtime")).select("path"), "path", "left_semi")
    gone = deleted(old_sync, disk)
    parsed = parse(todo)
    kept = old_notes.join(gone.select(F.col("path").alias("id")), "id", "left_anti")
    notes = upsert(kept, parsed, ["id"])
    sync = upsert(old_sync.join(gone, "path", "left_anti"), todo.select("path", "mtime"), ["path"])
    stats = todo.agg(F.count("*").alias("indexed")).crossJoin(gone.agg(F.count("*").alias("deleted"))).crossJoin(disk.agg(F.count("*").alias("seen")))  # three single rows
    return notes, sync, stats.select("indexed", (F.col("seen") - F.col("indexed")).alias("skipped"), "deleted")


def single_pass(notes: DataFrame, edges: DataFrame, sync: DataFrame, file: DataFrame, removed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(notes, edges, sync)`` after one file of ``file(path, mtime, raw)`` was written or removed.

    Links are resolved against the paths in ``sync`` and the file's own; those that lead nowhere go to a placeholder, and links that waited for this
    file's placeholder go to the file.  Edges are ``source_id, target_id, context``."""
    from ..sources.vault import links_of
    from .names import link_paths

    gone = file.select(F.col("path").alias("id"))
    kept_notes = notes.join(gone, "id", "left_anti")
    kept_edges = edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").select("source_id", "target_id", "context")
    kept_sync = sync.join(file.select("path"), "path", "left_anti")
    stub = F.concat(F.lit("_stub/"), "target_id")
    own = gone.select(F.col("id").alias("own"))
    if removed:
        pointed = kept_edges.join(own, F.col("target_id") == F.col("own"), "left").select("source_id", F.when(F.col("own").isNotNull(), stub).otherwise(F.col("target_id")).alias("target_id"), "context")
        return kept_notes, pointed, kept_sync
    fresh = parse(file)
    raw = links_of(fresh).select("source_id", F.col("target").alias("raw"), "context").where("raw != ''")
    known = sync.select(F.col("path").alias("id")).union(gone).distinct()
    made = raw.join(link_paths(raw, known), ["source_id", "raw"], "left").select("source_id", F.coalesce("path", F.concat(F.lit("_stub/"), F.regexp_replace("raw", r"\.md$", ""), F.lit(".md"))).alias("target_id"), "context")
    waited = own.withColumn("stub", F.concat(F.lit("_stub/"), "own"))
    pointed = kept_edges.join(waited, F.col("target_id") == F.col("stub"), "left").select("source_id", F.coalesce("own", "target_id").alias("target_id"), "context")
    return kept_notes.unionByName(fresh, allowMissingColumns=True), pointed.unionByName(made), kept_sync.unionByName(file.select("path", "mtime"), allowMissingColumns=True)


def parse(files: DataFrame) -> DataFrame:
    """``id, title, content, frontmatter`` of ``files(path, raw)``; the title is the frontmatter's, or the file's name."""
    from ..functions import text as X
    from ..sources.vault import parsed_column

    rows = files.select(F.col("path").alias("id"), parsed_column("raw").alias("p"))
    title = F.coalesce(F.try_variant_get(X.valid_json("p.frontmatter"), "$.title", "string"), X.stem("id"))
    return rows.select("id", title.alias("title"), F.col("p.content").alias("content"), F.col("p.frontmatter").alias("frontmatter"))


def heal(sync: DataFrame, unembedded: DataFrame) -> DataFrame:
    """I8: notes without vectors lose their sync row, so the next pass reads them again."""
    return sync.join(unembedded.select(F.col("id").alias("path")), "path", "left_anti")


@dataclass
class Budget:
    """The token budget of a chunk; halved after a failure, never under ``floor``, set back by a full pass."""

    advertised: int = 512
    discovered: int | None = None
    floor: int = 256

    @property
    def tokens(self) -> int:
        return int(0.9 * min(self.advertised, self.discovered or self.advertised))

    @property
    def chars(self) -> int:
        return int(self.tokens * 2.5)

    def failed(self) -> None:
        self.discovered = max(self.floor, (self.discovered or self.advertised) // 2)

    def reset(self) -> None:
        self.discovered = None


def compatibility(old: dict, new: dict, notes: int, chunks: int) -> set[str]:
    """What must be made again after a change of settings: ``all``, ``embeddings``, ``text``, or nothing."""
    if old.get("layout") != new.get("layout"):
        return {"all"}
    out = set()
    if any(old.get(k) != new.get(k) for k in ("model", "dim", "weights", "prefix")) or notes and not chunks:
        out.add("embeddings")
    if old.get("tokenizer") != new.get("tokenizer"):
        out.add("text")
    return out


def without_embeddings(chunks: DataFrame, sync: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(chunks, sync)`` with every vector dropped and nothing marked as indexed, so the next pass makes them all again.  The text index is
    rebuilt by ``search.TextIndex.build``, which writes over the old one."""
    kind = dict(chunks.dtypes).get("embedding", "array<double>")
    return chunks.withColumn("embedding", F.lit(None).cast(kind)), sync.limit(0)


def run_stats(notes: DataFrame, sync: DataFrame, edges: DataFrame, chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: notes indexed and skipped, edges, chunks made and skipped, placeholders."""
    disk = notes.select(F.col("id").alias("path"), F.unix_millis(F.col("mtime").cast("timestamp")).alias("mtime"))
    one = lambda rows, name: rows.agg(F.count("*").alias(name))
    fresh = to_index(sync, disk)
    from .links import stub_notes

    parts = one(fresh, "nodes_indexed").crossJoin(one(disk, "seen")).crossJoin(one(edges, "edges_indexed")).crossJoin(one(stub_notes(edges, notes), "stub_nodes_created"))
    parts = parts.crossJoin(one(changed_chunks(chunks, stored), "chunks_ok")).crossJoin(one(chunks, "chunks"))  # single rows
    return parts.select("nodes_indexed", (F.col("seen") - F.col("nodes_indexed")).alias("nodes_skipped"), "edges_indexed", "chunks_ok", (F.col("chunks") - F.col("chunks_ok")).alias("chunks_skipped"), "stub_nodes_created")


def dead_letters(chunks: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``(good, failed)``: chunks over the budget go to the dead letters with a reason."""
    long = F.length("content") > limit
    return chunks.where(~long), chunks.where(long).select(F.col("id").alias("chunk_id"), F.col("node_id").alias("note_id"), F.lit("too-long").alias("reason"))
