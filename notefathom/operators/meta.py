"""Aggregations over metadata: tags, properties, overview, index status, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as X

_EMPTY = "array<string>"


def _listed(frontmatter: Column | str, key: str, split: str | None) -> Column:
    """A key's texts: the elements of a list, or a text, each split where ``split`` says so."""
    v = X.valid_json(frontmatter)
    found = F.coalesce(F.try_variant_get(v, f"$.{key}", "array<string>"), F.array(F.try_variant_get(v, f"$.{key}", "string")))
    parts = F.filter(found, lambda x: x.isNotNull())
    if split:
        parts = F.flatten(F.transform(parts, lambda x: F.split(x, split)))
    return F.coalesce(F.filter(F.transform(parts, lambda x: F.regexp_replace(F.trim(x), "^#", "")), lambda x: x != ""), F.array().cast(_EMPTY))


def note_tags(frontmatter: Column | str) -> Column:
    """U6, first reading: ``tags``, ``tag`` and ``inline_tags``, split at commas and blanks, first spelling kept."""
    every = F.concat(*(_listed(frontmatter, k, r"[,\s]+") for k in ("tags", "tag", "inline_tags")))
    return X.distinct_ci(every)


def record_tags(frontmatter: Column | str) -> Column:
    """U6, second reading: list elements stay whole, only texts are split at commas."""
    v = X.valid_json(frontmatter)
    parts = []
    for k in ("tags", "tag", "inline_tags"):
        whole = F.try_variant_get(v, f"$.{k}", "array<string>")
        parts.append(F.coalesce(whole, F.split(F.try_variant_get(v, f"$.{k}", "string"), ","), F.array().cast(_EMPTY)))
    clean = F.filter(F.transform(F.concat(*parts), lambda x: F.regexp_replace(F.trim(x), "^#", "")), lambda x: x.isNotNull() & (x != ""))
    return X.distinct_ci(clean)


def info_tags(frontmatter: Column | str, content: Column | str) -> Column:
    """Third reading: ``tags`` and ``tag``, where list elements that are texts stay whole and a text is split at commas and blanks, then the tags of
    the content; case tells spellings apart."""
    v, parts = X.valid_json(frontmatter), []
    for k in ("tags", "tag"):
        listed = F.try_variant_get(v, f"$.{k}", "array<variant>")
        texts = F.transform(F.filter(listed, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
        one = F.try_variant_get(v, f"$.{k}", "variant")
        split = F.when(F.schema_of_variant(one) == "STRING", F.split(F.try_variant_get(one, "$", "string"), r"(?U)[,\s\uFEFF]+"))
        parts.append(F.coalesce(texts, split, F.array().cast(_EMPTY)))
    clean = F.filter(F.transform(F.concat(*parts), lambda x: F.regexp_replace(X.js_trim(x), "^#", "")), lambda x: x != "")
    return F.array_distinct(F.concat(clean, F.coalesce(M.inline_tags(content), F.array().cast(_EMPTY))))


def count_tags(notes: DataFrame, parents: bool = True, prefix: str | None = None) -> DataFrame:
    """A1: notes per tag, case ignored; a parent counts once a note; the spelling of the least note id is shown."""
    tags = notes.select("id", F.posexplode(note_tags("frontmatter")).alias("at", "tag"))
    if parents:
        tags = tags.select("id", "at", F.explode(X.tag_with_parents("tag")).alias("tag"))
    once = tags.groupBy("id", F.lower("tag").alias("key")).agg(F.min(F.struct("at", "tag")).alias("x"))
    counted = once.groupBy("key").agg(F.count("*").alias("count"), F.min_by("x.tag", F.struct("id", "x.at")).alias("tag"))
    if prefix:
        counted = counted.where(F.col("tag").startswith(prefix.lstrip("#")))
    return counted.select("tag", "count")


def list_tags(notes: DataFrame, sort: str = "count", limit: int = 100, **how) -> DataFrame:
    """The tag list: most frequent or first by name."""
    rows = count_tags(notes, **how)
    return rows.orderBy(F.desc("count"), "tag").limit(limit) if sort == "count" else rows.orderBy("tag").limit(limit)


def tag_list(notes: DataFrame, sort: str = "count", limit: int = 100, **how) -> DataFrame:
    """A1 as it is asked: ``tag, count, total, truncated``."""
    rows = count_tags(notes, **how)
    page = rows.orderBy(F.desc("count"), "tag") if sort == "count" else rows.orderBy("tag")
    total = rows.agg(F.count("*").alias("total"))  # a single row
    return page.limit(limit).crossJoin(total).withColumn("truncated", F.col("total") > limit)


def property_values(notes: DataFrame, key: str, folder: str | None = None) -> DataFrame:
    """A2: distinct JSON-typed values of a key, lists taken apart, with counts."""
    v = F.try_variant_get(X.valid_json("frontmatter"), f"$['{key}']", "variant")
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    rows = notes.where(X.in_folder("id", folder)).select(F.explode(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.to_json(x))).alias("value"))
    return rows.where(F.col("value").isNotNull() & (F.col("value") != "null")).groupBy("value").agg(F.count("*").alias("count"))


def property_report(notes: DataFrame, key: str, folder: str | None = None, limit: int = 50) -> DataFrame:
    """A2 as it is asked: ``value, count, notes_with_key, total``; most frequent first, then by the value's JSON text."""
    rows = property_values(notes, key, folder)
    has = F.try_variant_get(X.valid_json("frontmatter"), f"$['{key}']", "variant").isNotNull()
    totals = notes.where(X.in_folder("id", folder)).agg(F.count_if(has).alias("notes_with_key")).crossJoin(rows.agg(F.count("*").alias("total")))  # two single rows
    return rows.orderBy(F.desc("count"), "value").limit(limit).crossJoin(totals)


def vault_overview(notes: DataFrame, attachments: DataFrame, tags: int = 15, latest: int = 10) -> DataFrame:
    """A3 as it is asked: ``section, name, n`` of notes, attachments, folders, top tags and the latest notes (n: milliseconds)."""
    part = lambda rows, section, name, n: rows.select(F.lit(section).alias("section"), name.cast("string").alias("name"), n.cast("long").alias("n"))
    every = F.lit(None)
    out = part(notes.agg(F.count("*").alias("n")), "notes", every, F.col("n"))
    out = out.union(part(attachments.agg(F.count("*").alias("n")), "attachments", every, F.col("n")))
    out = out.union(part(overview(notes), "folder", F.col("folder"), F.col("notes")))
    out = out.union(part(list_tags(notes, limit=tags), "tag", F.col("tag"), F.col("count")))
    return out.union(part(recent(notes, latest), "recent", F.col("id"), F.unix_millis(F.col("mtime").cast("timestamp"))))


def latest_failures(failed: DataFrame, most: int = 50, shown: int = 10) -> DataFrame:
    """The last failures, at most ``shown`` of the last ``most``; ``failed`` has a time ``at``."""
    return failed.orderBy(F.desc("at"), "note_id").limit(most).limit(shown)


def overview(notes: DataFrame) -> DataFrame:
    """A3: notes per top folder; ``(root)`` for those in none."""
    return notes.groupBy(X.top_folder("id").alias("folder")).agg(F.count("*").alias("notes"))


def recent(notes: DataFrame, n: int = 10) -> DataFrame:
    return notes.orderBy(F.col("mtime").desc_nulls_last(), "id").select("id", "mtime").limit(n)


def index_status(notes: DataFrame, chunks: DataFrame, failed: DataFrame) -> DataFrame:
    """One row of totals; ``chunks(node_id, has_vector)`` and ``failed(note_id, reason)``."""
    n = notes.agg(F.count("*").alias("notes_total"))
    c = chunks.agg(F.count("*").alias("chunks_total"), F.countDistinct(F.when(F.col("has_vector"), F.col("node_id"))).alias("with_embeddings"))
    f = failed.agg(F.countDistinct(F.when(F.col("reason") == "no-embeddable-content", F.col("note_id"))).alias("no_embeddable"))
    one = n.crossJoin(c).crossJoin(f)  # three single rows
    return one.withColumn("missing", F.greatest(F.col("notes_total") - F.col("with_embeddings") - F.col("no_embeddable"), F.lit(0)))


def without_vectors(notes: DataFrame, chunks: DataFrame, failed: DataFrame) -> DataFrame:
    """Notes with neither a vector nor a recorded failure."""
    have = chunks.where("has_vector").select(F.col("node_id").alias("id"))
    return notes.select("id").join(have, "id", "left_anti").join(failed.select(F.col("note_id").alias("id")), "id", "left_anti")


def attachment_references(attachments: DataFrame, links: DataFrame) -> DataFrame:
    """Per attachment the distinct notes that refer to it: by path, relative to the note, or by bare name (same folder
    first).  ``attachments(path)``, ``links(source_id, target)``."""
    files = attachments.select("path", X.basename("path").alias("name"))
    asked = links.select("source_id", "target").distinct().withColumn("relative", F.when(X.dirname("source_id") == "", F.col("target")).otherwise(F.concat_ws("/", X.dirname("source_id"), "target")))
    exact = asked.join(files.select("path"), F.col("target") == F.col("path")).select("source_id", "target", "path", F.lit(0).alias("turn"))
    near = asked.join(files.select("path"), F.col("relative") == F.col("path")).select("source_id", "target", "path", F.lit(1).alias("turn"))
    bare = asked.withColumn("name", X.basename("target")).join(files, "name").where(~F.col("target").contains("/") | F.col("path").endswith(F.concat(F.lit("/"), F.col("target"))))
    bare = bare.select("source_id", "target", "path", F.when(X.dirname("path") == X.dirname("source_id"), 2).otherwise(3).alias("turn"))
    chosen = exact.unionByName(near).unionByName(bare).groupBy("source_id", "target").agg(F.min(F.struct("turn", "path")).alias("x"))
    counts = chosen.groupBy(F.col("x.path").alias("path")).agg(F.countDistinct("source_id").alias("references"))
    return attachments.join(counts, "path", "left").withColumn("references", F.coalesce("references", F.lit(0)))
