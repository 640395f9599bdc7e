"""Note relations: the current view of deliveries, scans, lists, projections, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as X
from .meta import info_tags


def latest(nodes: DataFrame) -> DataFrame:
    """The latest delivery of each id, removed ones too; one shuffle with map-side combine.

    Every column is an aggregate of its own, so Catalyst drops those a query does not use from the shuffle and the scan.
    """
    turn = F.struct("loaded_at", "row_id")
    return nodes.groupBy("id").agg(*(F.max_by(c, turn).alias(c) for c in nodes.columns if c != "id"))


def current(nodes: DataFrame, stubs: bool = False) -> DataFrame:
    """Notes as they are now: latest delivery, not removed; without stubs unless asked for.

    Whether a row is a stub or removed is told before the shuffle, so frontmatter crosses it only where it is used.
    """
    gone = F.col("removed_at").isNotNull()
    now = latest(nodes.withColumn("_out", gone if stubs else gone | X.is_stub("frontmatter")))
    return now.where(~F.col("_out")).drop("_out")


def list_paths(notes: DataFrame, folder: str | None = None, exclude: list[str] = ()) -> DataFrame:
    """Ids under a folder and under none of the excluded ones, stub paths left out."""
    keep = [X.in_folder("id", folder), ~F.col("id").startswith("_stub/"), *(~X.in_folder("id", e) for e in exclude)]
    return notes.where(X.all_of(keep)).select("id").orderBy("id")


def frontmatter_tags(frontmatter: Column | str) -> Column:
    """Array-valued ``tags`` only, as the note list shows them."""
    return F.coalesce(F.try_variant_get(X.valid_json(frontmatter), "$.tags", "array<string>"), F.array().cast("array<string>"))


def list_notes(notes: DataFrame, directory: str | None = None, tag: str | None = None, sort_by: str = "path", limit: int = 100) -> DataFrame:
    """notes of a directory with a tag, by path or by time, missing times last."""
    d = (directory or "").strip("/")
    rows = notes.select("id", "title", "frontmatter", "mtime", frontmatter_tags("frontmatter").alias("tags"))
    if d:
        rows = rows.where(F.col("id").startswith(d + "/") | (F.col("id") == d))
    if tag:
        rows = rows.where(X.has_tag(F.col("tags"), tag))
    return rows.orderBy("id").limit(limit) if sort_by == "path" else rows.orderBy(F.col("mtime").desc_nulls_last(), "id").limit(limit)


def read_notes(notes: DataFrame, names: list[str] | None = None, max_length: int = 2000) -> DataFrame:
    """content cut to a number of UTF-16 units, with a flag."""
    rows = notes if names is None else notes.where(F.col("id").isin(names))
    return rows.select("id", "title", X.utf16_prefix("content", max_length).alias("content"), F.coalesce(X.utf16_length("content") > max_length, F.lit(False)).alias("truncated"))


def live_edges(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Edges with both ends present.  Both joins hash the same ids, so the plan reuses one exchange and reads the notes once."""
    ids = notes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def titled_targets(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Distinct outgoing links with the target's title, or its id where there is no such note."""
    t = notes.select(F.col("id").alias("target_id"), "title")
    return edges.select("source_id", "target_id").distinct().join(t, "target_id", "left").select("source_id", "target_id", F.coalesce("title", "target_id").alias("title"))


def titled_sources(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Distinct backlinks with the source's title."""
    s = notes.select(F.col("id").alias("source_id"), "title")
    return edges.select("source_id", "target_id").distinct().join(s, "source_id", "left").select("target_id", "source_id", F.coalesce("title", "source_id").alias("title"))


def degrees(edges: DataFrame) -> DataFrame:
    """A4/A5: per id its links out and in, as a multiset, and its distinct linking notes."""
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_in"), F.countDistinct("source_id").alias("n_sources"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.join(into, "id", "full").select("id", zero("n_out"), zero("n_in"), zero("n_sources"))


def note_links(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per note its outgoing and incoming links as sorted lists of ids."""
    d = edges.select("source_id", "target_id").distinct()
    out = d.groupBy(F.col("source_id").alias("id")).agg(F.sort_array(F.collect_list("target_id")).alias("outgoing"))
    into = d.groupBy(F.col("target_id").alias("id")).agg(F.sort_array(F.collect_list("source_id")).alias("incoming"))
    empty = F.array().cast("array<string>")
    return notes.select("id", "title").join(out, "id", "left").join(into, "id", "left").select("id", "title", F.coalesce("outgoing", empty).alias("outgoing"), F.coalesce("incoming", empty).alias("incoming"))


def page(rows: DataFrame, by: list, offset: int = 0, limit: int = 50) -> tuple[DataFrame, int]:
    """One page in order, and the total before the cut; truncated when total > offset + limit."""
    return rows.orderBy(*by).offset(offset).limit(limit), rows.count()


def query_notes(records: DataFrame, condition: Column, sort: Column | str = "path", descending: bool = False, limit: int = 50) -> tuple[DataFrame, int]:
    """records that meet a compiled filter; missing sort values come last in either order, the path breaks ties."""
    key = X.col(sort)
    return page(records.where(F.coalesce(condition, F.lit(False))), [key.desc_nulls_last() if descending else key.asc_nulls_last(), "path"], 0, limit)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of an id, a chunk's or a setting's; the condition reaches the scan."""
    return rows.where(F.col(key) == value)


def edges_of(edges: DataFrame, source: str | None = None, target: str | None = None) -> DataFrame:
    """Edges by either end or both; the conditions reach the scan."""
    keep = [F.col(c) == v for c, v in (("source_id", source), ("target_id", target)) if v is not None]
    return edges.where(X.all_of(keep)).select("id", "source_id", "target_id", "context")


def with_total(page: DataFrame, every: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page with ``total`` rows there are, and whether some come after it; the count is a single row."""
    total = every.agg(F.count("*").alias("total"))
    return page.crossJoin(total).withColumn("truncated", F.col("total") > offset + limit)


def query_table(notes: DataFrame, condition: Column, fields: list[str] = (), sort: str = "path", descending: bool = False, limit: int = 50) -> DataFrame:
    """F1 as it is asked: ``path, title, <fields>, total, truncated``; ``sort`` is path, title, mtime or ``frontmatter.<key>``, missing ones last
    either way; a limit of 1 to 500."""
    if not 1 <= limit <= 500:
        raise ValueError("the limit is from 1 to 500")
    if sort not in ("path", "title", "mtime") and not sort.startswith("frontmatter."):
        raise ValueError(f"cannot sort by {sort!r}")
    value = lambda k: F.try_variant_get(X.valid_json("frontmatter"), f"$['{k}']", "string")
    rows = notes.where(F.coalesce(condition, F.lit(False)))
    if sort.startswith("frontmatter."):
        k = sort.removeprefix("frontmatter.")
        typed = F.try_variant_get(X.valid_json("frontmatter"), f"$['{k}']", "double")
        keys = [F.when(value(k).isNull(), 1).otherwise(0).asc(), *((c.desc_nulls_last() if descending else c.asc_nulls_last()) for c in (typed, value(k)))]
    else:
        c = F.col("id" if sort == "path" else sort)
        keys = [c.desc_nulls_last() if descending else c.asc_nulls_last()]
    page = rows.orderBy(*keys, "id").limit(limit).select(F.col("id").alias("path"), "title", *(value(f).alias(f) for f in fields))
    return with_total(page, rows, limit)


def read_note(notes: DataFrame, edges: DataFrame, note: str) -> DataFrame:
    """A12/G11/M15, full mode: ``direction, other, title, context`` of every link of a note, in and out, parallel ones each."""
    out = edges.where(F.col("source_id") == note).select(F.lit("outgoing").alias("direction"), F.col("target_id").alias("other"), "context")
    into = edges.where(F.col("target_id") == note).select(F.lit("incoming").alias("direction"), F.col("source_id").alias("other"), "context")
    titles = notes.select(F.col("id").alias("other"), "title")
    return out.unionByName(into).join(titles, "other", "left").select("direction", "other", F.coalesce("title", "other").alias("title"), "context")


def note_counts(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per note its outgoing, incoming and unresolved links, headings, tasks and tags."""
    ids = notes.select(F.col("id").alias("target_id"), F.lit(True).alias("there"))
    out = edges.join(ids, "target_id", "left").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("outgoing"), F.count_if(F.col("there").isNull()).alias("unresolved"))
    into = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("incoming"))
    own = notes.select("id", F.size(M.headings("content")).cast("long").alias("headings"), F.size(M.tasks("content")).cast("long").alias("tasks"), F.size(info_tags("frontmatter", "content")).cast("long").alias("tags"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(out, "id", "left").join(into, "id", "left").select("id", zero("outgoing"), zero("incoming"), zero("unresolved"), "headings", "tasks", "tags")
