"""Link integrity: orphans, stubs, renames, degree of resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as X
from .names import link_paths


def orphaned(notes: DataFrame, edges: DataFrame, folder: str | None = None, exclude: list[str] = ()) -> DataFrame:
    """Notes no other note links to, with their links to others; links from excluded folders still count."""
    real = edges.where("source_id != target_id").select("source_id", "target_id")
    alone = notes.where(X.all_of([X.in_folder("id", folder), *(~X.in_folder("id", e) for e in exclude)])).select("id", "title")
    alone = alone.join(real.select(F.col("target_id").alias("id")), "id", "left_anti")
    out = real.groupBy(F.col("source_id").alias("id")).agg(F.countDistinct("target_id").alias("n"))
    return alone.join(out, "id", "left").select("id", "title", F.coalesce("n", F.lit(0)).alias("outgoing_links"))


def stub_notes(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """The placeholders there must be: one for each target without a note, with its links.  Recomputed as a whole, so
    resolving forward references and pruning need no step of their own."""
    gone = edges.join(notes.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    target = F.regexp_replace("target_id", "^_stub/", "")
    return gone.groupBy(F.concat(F.lit("_stub/"), target).alias("id")).agg(F.count("*").alias("inbound")).withColumn("title", F.regexp_replace(F.regexp_replace("id", "^_stub/", ""), r"\.md$", ""))


def resolve_stubs(stubs: DataFrame, notes: DataFrame) -> DataFrame:
    """``stub_id, id`` of stubs whose note is there: the same path, or the same base name, the least path of several."""
    s = stubs.select(F.col("id").alias("stub_id"), F.regexp_replace("id", "^_stub/", "").alias("want"))
    direct = s.join(notes.select(F.col("id").alias("want")), "want", "left_semi").select("stub_id", F.col("want").alias("id"))
    rest = s.join(direct.select("stub_id"), "stub_id", "left_anti").where(~F.col("want").contains("/"))
    named = rest.join(notes.select("id", X.basename("id").alias("want")), "want").groupBy("stub_id").agg(F.min("id").alias("id"))
    return direct.unionByName(named)


def rename(table: DataFrame, old: str, new: str, columns: list[str]) -> DataFrame:
    """One id replaced in the named columns; chunk ids keep their ``::n``."""
    out = table
    for c in columns:
        out = out.withColumn(c, F.when(F.col(c) == old, new).when(F.col(c).startswith(old + "::"), F.concat(F.lit(new), F.substring(F.col(c), len(old) + 1, 1 << 20))).otherwise(F.col(c)))
    return out


def broken_links(notes: DataFrame, folder: str | None = None, exclude: list[str] = (), attachments: DataFrame | None = None) -> DataFrame:
    """``source_id, line, link, reason`` of links in note texts that lead nowhere, one row per link.

    Links are taken from texts with code masked, embeds left out, and resolved as J9 does; one that names a file of ``attachments``, by path or
    name, is none to a note.  Of an anchor's parts the last tells its kind: a block alone, or headings that must all be there.  Distinct anchors
    are checked by an anti-join against the headings and blocks of all notes.
    """
    scanned = notes.where(X.all_of([X.in_folder("id", folder), *(~X.in_folder("id", e) for e in exclude)]))
    links = scanned.where(F.col("content").contains("[[")).select(F.col("id").alias("source_id"), F.explode(M.maintenance_links("content")).alias("l")).where("not l.embed")
    links = links.select("source_id", "l.line", "l.start", F.col("l.raw").alias("link"), F.col("l.target").alias("raw"), "l.subpath")
    found = link_paths(links.where("raw != ''"), notes)
    links = links.join(found, ["source_id", "raw"], "left").withColumn("path", F.when(F.col("raw") == "", F.col("source_id")).otherwise(F.col("path")))
    missing = links.where("path is null")
    if attachments is not None:
        known = attachments.select("path").union(attachments.select(X.basename("path"))).distinct()
        file = F.col("raw").rlike(r"\.[A-Za-z0-9]+$") & ~F.col("raw").endswith(".md")
        for asked in (F.col("raw"), X.basename("raw")):
            missing = missing.withColumn("file", F.when(file, asked)).join(known.withColumnRenamed("path", "file"), "file", "left_anti")
    anchors = notes.where(F.col("content").contains("#") | F.col("content").contains("^")).select(F.col("id").alias("path"), F.explode(M.anchors("content")).alias("anchor"))
    names = F.filter(F.transform(F.split("subpath", "#"), lambda p: X.js_trim(p)), lambda p: p != "")
    block = F.element_at("names", -1).startswith("^")
    wanted = F.when(block, F.array(F.element_at("names", -1))).otherwise(F.transform("names", lambda p: X.heading_key(p)))
    asked = (
        links.where("path is not null").withColumn("names", names).where(F.size("names") > 0)
        .select("source_id", "line", "start", "link", "path", block.alias("block"), F.explode(F.array_distinct(wanted)).alias("part"))
        .withColumn("anchor", F.when(F.col("block"), F.col("part")).otherwise(F.concat(F.lit("#"), "part")))
    )
    gone = asked.select("path", "anchor").distinct().join(anchors, ["path", "anchor"], "left_anti")
    lost = asked.join(gone, ["path", "anchor"], "left_semi").dropDuplicates(["source_id", "start"])
    lost = lost.select("source_id", "line", "link", F.when(F.col("block"), "block_not_found").otherwise("heading_not_found").alias("reason"))
    return missing.select("source_id", "line", "link", F.lit("note_not_found").alias("reason")).unionByName(lost)
