"""Operators in the form a user asks for them, over the whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as X
from ..operators import graph, incremental, links, meta, names, notes, rewrite, search
from ..session import cut_lineage, table
from .jsonlogic import compile_filter
from .queries import _TAGS_SQL, CUR, LINES, TOP, _current, _edges, _HEADS, _pairs, _top_two, _TASKS, query

# ---- lookups and lists --------------------------------------------------------------------------------------------


@query("s5_titles", CUR + " SELECT id, title, mtime FROM cur")
def _(spark, d):
    return _current(spark, d).select("id", "title", "mtime")


@query("s7_lookup", CUR + " SELECT id, title FROM cur WHERE id = (SELECT min(id) FROM nodes)")
def _(spark, d):
    first = table(spark, d, "nodes").agg(F.min("id").alias("id")).first().id
    return notes.lookup(_current(spark, d), "id", first).select("id", "title")


@query("s8_edges_by_both", "SELECT id, source_id, target_id, context FROM edges WHERE source_id = (SELECT min(source_id) FROM edges WHERE target_id = 'Library/Home.md') AND target_id = 'Library/Home.md'")
def _(spark, d):
    e = _edges(spark, d)
    return notes.edges_of(e, e.where("target_id = 'Library/Home.md'").agg(F.min("source_id").alias("s")).first().s, "Library/Home.md")


@query("f1_query_table", CUR + """, r AS (SELECT id AS path, title, json_extract_string(frontmatter, '$.status') AS status, json_extract_string(frontmatter, '$.rating') AS rating FROM cur WHERE json_valid(frontmatter) AND starts_with(id, 'Projects/'))
 SELECT path, title, status, rating, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r) > 40 AS truncated FROM r ORDER BY rating IS NULL, try_cast(rating AS DOUBLE) DESC NULLS LAST, rating DESC NULLS LAST, path LIMIT 40""")
def _(spark, d):
    rows = _current(spark, d).where(X.valid_json("frontmatter").isNotNull())
    return notes.query_table(rows, F.col("id").startswith("Projects/"), ["status", "rating"], "frontmatter.rating", True, 40)


@query("f4_list_tagged", CUR + """, t AS (SELECT id, title, mtime, CASE WHEN json_valid(frontmatter) AND json_type(frontmatter, '$.tags') = 'ARRAY' THEN json_extract_string(frontmatter, '$.tags[*]') ELSE [] END AS tags FROM cur),
 top AS (SELECT lower(regexp_replace(trim(x), '^#', '')) AS tag FROM (SELECT unnest(tags) AS x FROM t) GROUP BY 1 HAVING tag <> '' ORDER BY count(*) DESC, 1 LIMIT 1)
 SELECT id, array_to_string(tags, '|') AS tags FROM t, top WHERE len(list_filter(tags, lambda x: lower(regexp_replace(trim(x), '^#', '')) = tag OR starts_with(lower(regexp_replace(trim(x), '^#', '')), tag || '/'))) > 0 ORDER BY id LIMIT 100""")
def _(spark, d):
    now = _current(spark, d)
    spelled = now.select(F.explode(notes.frontmatter_tags("frontmatter")).alias("t")).select(F.lower(F.regexp_replace(F.trim("t"), "^#", "")).alias("t")).where("t != ''")
    top = spelled.groupBy("t").count().orderBy(F.desc("count"), "t").first()
    return notes.list_notes(now, tag=top.t if top else "none").select("id", F.array_join("tags", "|").alias("tags"))


@query("f13_read_notes_text", CUR + """, c AS (SELECT id, content, length(content) + length(regexp_replace(content, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units FROM cur),
 k AS (SELECT id, count(*) FILTER (u <= 2000) AS keep FROM (SELECT id, sum(1 + (unicode(ch) > 65535)::INT) OVER (PARTITION BY id ORDER BY i) AS u FROM (SELECT id, unnest(string_split(left(content, 2000), '')) AS ch, generate_subscripts(string_split(left(content, 2000), ''), 1) AS i FROM c WHERE units > 2000)) GROUP BY id)
 SELECT c.id, md5(CASE WHEN units > 2000 THEN left(content, keep) ELSE content END) AS content, coalesce(units > 2000, false) AS truncated FROM c LEFT JOIN k USING (id)""")
def _(spark, d):
    return notes.read_notes(_current(spark, d)).select("id", F.md5("content").alias("content"), "truncated")


@query("q5_excerpts_cut", CUR + """, p AS (SELECT id, list_filter(string_split_regex(content, '\\n\\n+'), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#')) AS ps FROM cur),
 q AS (SELECT id, coalesce(trim(ps[1], ' ' || chr(9) || chr(10) || chr(13)), '') AS t FROM p), u AS (SELECT id, t, length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units FROM q)
 SELECT id, CASE WHEN units <= 60 THEN t ELSE left(t, 60) || '...' END AS excerpt FROM u WHERE units = length(t)""")
def _(spark, d):
    first = F.filter(F.split("content", r"\n\n+"), lambda p: (F.trim(p) != "") & ~F.trim(p).startswith("#"))
    astral = F.coalesce(F.try_element_at(first, F.lit(1)), F.lit("")).rlike(r"[\x{10000}-\x{10FFFF}]")
    return _current(spark, d).where(~astral | F.col("content").isNull()).select("id", X.note_excerpt("content", 60).alias("excerpt"))


@query("f5_grep_page", CUR + """, l AS (SELECT id, i, ls[i] AS text, coalesce(ls[i - 1], '') AS before, coalesce(ls[i + 1], '') AS after FROM (SELECT id, string_split_regex(content, '\\r?\\n') AS ls FROM cur) z, range(1, len(ls) + 1) r(i) WHERE regexp_matches(ls[i], '(?i)kettles?\\b')),
 f AS (SELECT id FROM l GROUP BY id ORDER BY id LIMIT 20), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r, count(*) OVER (PARTITION BY id) AS hits, length(regexp_extract(text, '(?i)^(.*?)kettles?\\b', 1)) AS hit_at FROM l WHERE id IN (SELECT id FROM f))
 SELECT id, i AS line, CASE WHEN length(text) <= 80 THEN text ELSE (CASE WHEN greatest(least(hit_at - 20, length(text) - 80), 0) > 0 THEN '…' ELSE '' END) || substr(text, greatest(least(hit_at - 20, length(text) - 80), 0) + 1, 80) || (CASE WHEN greatest(least(hit_at - 20, length(text) - 80), 0) + 80 < length(text) THEN '…' ELSE '' END) END AS text,
   CASE WHEN length(before) <= 80 THEN before ELSE left(before, 80) || '…' END AS before, CASE WHEN length(after) <= 80 THEN after ELSE left(after, 80) || '…' END AS after, hits > 2 AS more FROM n WHERE r <= 2""")
def _(spark, d):
    rows = search.grep_page(_current(spark, d), r"kettles?\b", regex=True, per_file=2, width=80)
    return rows.select("id", F.col("line").cast("long").alias("line"), "text", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"), "more")


# ---- aggregates ---------------------------------------------------------------------------------------------------

_COUNTED = _TAGS_SQL + """, up AS (SELECT id, place, array_to_string(list_slice(string_split(tag, '/'), 1, n), '/') AS tag FROM tags, range(1, len(string_split(tag, '/')) + 1) r(n)),
 once AS (SELECT id, lower(tag) AS key, arg_min(tag, place) AS tag FROM up GROUP BY 1, 2), counted AS (SELECT arg_min(tag, id) AS tag, count(*) AS count FROM once GROUP BY key)"""


@query("a1_tag_list", _COUNTED + " SELECT tag, count, (SELECT count(*) FROM counted) AS total, (SELECT count(*) FROM counted) > 100 AS truncated FROM counted ORDER BY count DESC, tag LIMIT 100")
def _(spark, d):
    return meta.tag_list(_current(spark, d))


@query("a2_property_report", CUR + """, v AS (SELECT unnest(CASE WHEN json_type(frontmatter, '$.rating') = 'ARRAY' THEN json_extract(frontmatter, '$.rating[*]') ELSE [json_extract(frontmatter, '$.rating')] END) AS value FROM cur WHERE json_valid(frontmatter)),
 g AS (SELECT CAST(value AS VARCHAR) AS value, count(*) AS count FROM v WHERE value IS NOT NULL AND CAST(value AS VARCHAR) <> 'null' GROUP BY 1)
 SELECT value, count, (SELECT count(*) FROM cur WHERE json_valid(frontmatter) AND json_exists(frontmatter, '$.rating')) AS notes_with_key, (SELECT count(*) FROM g) AS total FROM g ORDER BY count DESC, value LIMIT 50""")
def _(spark, d):
    return meta.property_report(_current(spark, d), "rating")


@query("a3_vault_overview", _COUNTED + """, o AS (SELECT 'notes' AS section, NULL AS name, count(*) AS n FROM cur UNION ALL SELECT 'attachments', NULL, count(DISTINCT target_id) FROM edges WHERE regexp_matches(target_id, '\\.(png|pdf|canvas)$')
 UNION ALL SELECT 'folder', CASE WHEN contains(id, '/') THEN string_split(id, '/')[1] ELSE '(root)' END, count(*) FROM cur GROUP BY 2),
 t AS (SELECT tag, count FROM counted ORDER BY count DESC, tag LIMIT 15), r AS (SELECT id, epoch_us(mtime) // 1000 AS n FROM cur ORDER BY mtime DESC NULLS LAST, id LIMIT 10)
 SELECT * FROM o UNION ALL SELECT 'tag', tag, count FROM t UNION ALL SELECT 'recent', id, n FROM r""")
def _(spark, d):
    files = _edges(spark, d).where(F.col("target_id").rlike(r"\.(png|pdf|canvas)$")).select("target_id").distinct()
    return meta.vault_overview(_current(spark, d), files)


@query("a7_latest_failures", "SELECT doc_id AS note_id, created_at AS at FROM (SELECT * FROM documents WHERE text IS NULL OR text = '' ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 50) ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 10")
def _(spark, d):
    failed = table(spark, d, "documents").where("text is null or text = ''").select(F.col("doc_id").alias("note_id"), F.col("created_at").alias("at"))
    return meta.latest_failures(failed)


_INFO_TAGS = ", fv AS (" + " UNION ALL ".join(f"SELECT id, json_type(frontmatter, '$.{k}') AS kind, json_extract(frontmatter, '$.{k}[*]') AS l, json_extract_string(frontmatter, '$.{k}') AS s FROM cur WHERE json_valid(frontmatter)" for k in ("tags", "tag")) + """),
 it2 AS (SELECT id, json_extract_string(x, '$') AS t FROM (SELECT id, unnest(l) AS x FROM fv WHERE kind = 'ARRAY') WHERE json_type(x) = 'VARCHAR' UNION ALL SELECT id, unnest(string_split_regex(s, '[,\\s]+')) FROM fv WHERE kind = 'VARCHAR'
  UNION ALL SELECT id, '#' || unnest(regexp_extract_all(content, '(?:^|[^A-Za-z0-9_])#([a-zA-Z][A-Za-z0-9_\\-/]*)', 1)) FROM cur),
 it3 AS (SELECT DISTINCT id, regexp_replace(trim(t), '^#', '') AS tag FROM it2 WHERE regexp_replace(trim(t), '^#', '') <> '')"""


@query("a12_note_counts", _TASKS + _HEADS + _INFO_TAGS + """, e AS (SELECT source_id AS id, count(*) AS outgoing, count(*) FILTER (target_id NOT IN (SELECT id FROM cur)) AS unresolved FROM edges GROUP BY 1), i AS (SELECT target_id AS id, count(*) AS incoming FROM edges GROUP BY 1)
 SELECT c.id, coalesce(e.outgoing, 0) AS outgoing, coalesce(i.incoming, 0) AS incoming, coalesce(e.unresolved, 0) AS unresolved, (SELECT count(*) FROM hd WHERE hd.id = c.id) AS headings, (SELECT count(*) FROM tt WHERE tt.id = c.id) AS tasks,
   (SELECT count(*) FROM it3 WHERE it3.id = c.id) AS tags
 FROM cur c LEFT JOIN e USING (id) LEFT JOIN i USING (id)""")
def _(spark, d):
    return notes.note_counts(_current(spark, d), _edges(spark, d))


@query("a14_rewrite_totals", CUR + " SELECT count(*) AS files, coalesce(sum(len(regexp_extract_all(content, '(\\w+) kettle'))), 0)::BIGINT AS occurrences FROM cur WHERE regexp_matches(content, '(\\w+) kettle')")
def _(spark, d):
    return rewrite.totals(rewrite.search_and_replace(_current(spark, d), r"(\w+) kettle", "kettle of $1", regex=True, include_code=True))


@query("m1_replace_everywhere", CUR + " SELECT id, md5(regexp_replace(content, '(\\w+) kettle', 'kettle of \\1', 'g')) AS content, len(regexp_extract_all(content, '(\\w+) kettle')) AS n FROM cur WHERE regexp_matches(content, '(\\w+) kettle')")
def _(spark, d):
    got = rewrite.search_and_replace(_current(spark, d), r"(\w+) kettle", "kettle of $1", regex=True, include_code=True)
    return got.select("id", F.md5("content").alias("content"), F.col("n").cast("long").alias("n"))


@query("a15_run_stats", CUR + """, disk AS (SELECT id AS path, epoch_us(mtime) // 1000 AS m FROM cur), s AS (SELECT path, max(mtime) AS m FROM sync_state GROUP BY 1)
 SELECT (SELECT count(*) FROM disk LEFT JOIN s USING (path) WHERE s.m IS NULL OR s.m < disk.m) AS nodes_indexed, (SELECT count(*) FROM disk) - (SELECT count(*) FROM disk LEFT JOIN s USING (path) WHERE s.m IS NULL OR s.m < disk.m) AS nodes_skipped,
  (SELECT count(*) FROM edges) AS edges_indexed, (SELECT count(DISTINCT '_stub/' || regexp_replace(target_id, '^_stub/', '')) FROM edges WHERE target_id NOT IN (SELECT id FROM cur)) AS stub_nodes_created,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS chunks_ok, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS chunks_skipped""")
def _(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("h").alias("content_hash"))
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("h").alias("content_hash"))
    return incremental.run_stats(_current(spark, d), table(spark, d, "sync_state"), _edges(spark, d), chunks, stored)


_RAW_TAGS = " UNION ALL ".join(f"SELECT id, {n} AS n, CASE json_type(frontmatter, '$.{k}') WHEN 'ARRAY' THEN json_extract_string(frontmatter, '$.{k}[*]') ELSE string_split(json_extract_string(frontmatter, '$.{k}'), ',') END AS l FROM cur WHERE json_valid(frontmatter)" for n, k in enumerate(("tags", "tag", "inline_tags")))


@query("u6_record_tags", CUR + ", v AS (" + _RAW_TAGS + """), x AS (SELECT id, n, i, regexp_replace(trim(l[i]), '^#', '') AS t FROM v, range(1, len(l) + 1) r(i) WHERE l[i] IS NOT NULL), y AS (SELECT id, lower(t) AS k, arg_min(t, (n, i)) AS tag FROM x WHERE t <> '' GROUP BY 1, 2)
 SELECT id, tag FROM y""")
def _(spark, d):
    return _current(spark, d).select("id", F.explode(meta.record_tags("frontmatter")).alias("tag"))


@query("w7_first_spelling", _TAGS_SQL + " SELECT lower(tag) AS key, min(tag) AS tag FROM tags GROUP BY 1")
def _(spark, d):
    rows = _current(spark, d).select(F.explode(meta.note_tags("frontmatter")).alias("tag"))
    return names.first_spelling(rows, "tag", "tag")


@query("w9_first_rows", "SELECT source_id, id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS r FROM edges) WHERE r = 1")
def _(spark, d):
    return names.first_rows(_edges(spark, d).select("source_id", "id", "target_id"), ["source_id"], ["id"])


@query("o6_locale_order", "SELECT p_partkey, row_number() OVER (ORDER BY replace(lower(p_name), ' ', chr(1)), p_partkey) AS place FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 200)")
def _(spark, d):
    first = table(spark, d, "part").orderBy("p_partkey").limit(200)
    return names.ranked_by(first, [X.locale_key("p_name"), "p_partkey"]).select("p_partkey", "place")


@query("o4_page", CUR + " SELECT id, (SELECT count(*) FROM cur) AS total, (SELECT count(*) FROM cur) > 150 AS truncated FROM cur ORDER BY title, id LIMIT 50 OFFSET 100")
def _(spark, d):
    now = _current(spark, d).select("id", "title")
    return notes.with_total(now.orderBy("title", "id").offset(100).limit(50), now, 50, 100).select("id", "total", "truncated")


# ---- links and graph ----------------------------------------------------------------------------------------------


@query("g9_path_hops", TOP + """, p1 AS (SELECT [x, y] AS p FROM adj WHERE x IN (SELECT id FROM s) AND y <> x), p2 AS (SELECT list_append(p, y) AS p FROM p1 JOIN adj ON adj.x = p[-1] WHERE p[-1] NOT IN (SELECT id FROM t) AND NOT list_contains(p, y)),
 every AS (SELECT p FROM p1 UNION ALL SELECT p FROM p2), paths AS (SELECT p FROM every WHERE p[-1] IN (SELECT id FROM t)), ctx AS (SELECT source_id, target_id, arg_max({'c': context}, id).c AS c FROM live GROUP BY 1, 2)
 SELECT array_to_string(p, ' > ') AS path, i - 1 AS hop, p[i] AS source_id, p[i + 1] AS target_id, CASE WHEN EXISTS (SELECT 1 FROM ctx WHERE source_id = p[i] AND target_id = p[i + 1]) THEN (SELECT c FROM ctx WHERE source_id = p[i] AND target_id = p[i + 1]) ELSE (SELECT c FROM ctx WHERE source_id = p[i + 1] AND target_id = p[i]) END AS context
 FROM paths, range(1, len(p)) r(i)""")
def _(spark, d):
    n, _, pairs = _pairs(spark, d)
    a, b = _top_two(spark, d, n)
    paths = graph.simple_paths(cut_lineage(pairs), a, b, 2)
    return graph.path_hops(paths, notes.live_edges(_edges(spark, d), n)).withColumn("hop", F.col("hop").cast("long"))


@query("g11_read_note", TOP + """ SELECT 'outgoing' AS direction, e.target_id AS other, coalesce(c.title, e.target_id) AS title, e.context FROM edges e LEFT JOIN cur c ON c.id = e.target_id WHERE e.source_id IN (SELECT id FROM s)
 UNION ALL SELECT 'incoming', e.source_id, coalesce(c.title, e.source_id), e.context FROM edges e LEFT JOIN cur c ON c.id = e.source_id WHERE e.target_id IN (SELECT id FROM s)""")
def _(spark, d):
    n = _current(spark, d)
    return notes.read_note(n, _edges(spark, d), _top_two(spark, d, n)[0])


@query("j10_resolve_stubs", CUR + """, sb AS (SELECT DISTINCT '_stub/' || regexp_replace(target_id, '^_stub/', '') AS stub_id, regexp_replace(target_id, '^_stub/', '') AS want FROM edges WHERE target_id NOT IN (SELECT id FROM cur))
 SELECT stub_id, want AS id FROM sb WHERE want IN (SELECT id FROM cur) UNION ALL
 SELECT stub_id, min(c.id) FROM sb JOIN cur c ON string_split(c.id, '/')[-1] = want WHERE NOT contains(want, '/') AND want NOT IN (SELECT id FROM cur) GROUP BY 1""")
def _(spark, d):
    now = _current(spark, d)
    return links.resolve_stubs(links.stub_notes(_edges(spark, d), now).select("id"), now)


@query("g15_rename_chunks", "SELECT doc_id, CASE WHEN id = 'a.md' THEN 'b.md' WHEN starts_with(id, 'a.md::') THEN 'b.md' || substr(id, 5) ELSE id END AS id FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a.md' WHEN 1 THEN 'a.md::' || doc_id ELSE 'a.md.md' END AS id FROM documents)")
def _(spark, d):
    k = F.col("doc_id") % 3
    ids = table(spark, d, "documents").select("doc_id", F.when(k == 0, "a.md").when(k == 1, F.concat(F.lit("a.md::"), F.col("doc_id").cast("string"))).otherwise("a.md.md").alias("id"))
    return links.rename(ids, "a.md", "b.md", ["id"])


@query("a6_attachment_references", """WITH a AS (SELECT 'Files/' || p_partkey || '.pdf' AS path FROM part), l AS (SELECT DISTINCT 'N/' || l_suppkey || '.md' AS source_id, 'Files/' || l_partkey || '.pdf' AS target FROM lineitem)
 SELECT a.path, count(DISTINCT l.source_id) AS references FROM a LEFT JOIN l ON l.target = a.path GROUP BY 1""")
def _(spark, d):
    file = lambda c: F.concat(F.lit("Files/"), F.col(c).cast("string"), F.lit(".pdf"))
    made = table(spark, d, "lineitem").select(F.concat(F.lit("N/"), F.col("l_suppkey").cast("string"), F.lit(".md")).alias("source_id"), file("l_partkey").alias("target"))
    return meta.attachment_references(table(spark, d, "part").select(file("p_partkey").alias("path")), made)


# ---- retrieval ----------------------------------------------------------------------------------------------------


@query("q3_chunk_hits", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), near AS (SELECT vec_id AS chunk_id, round(1 - sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - e[i]) ** 2))), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 30)
 SELECT n.chunk_id, p.p_name AS node_id, CASE WHEN length(p.p_name) <= 200 THEN p.p_name END AS excerpt, n.score FROM near n JOIN part p ON p.p_partkey = n.chunk_id""")
def _(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    text = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("node_id"), F.col("p_brand").alias("heading"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.col("p_name").alias("content"))
    first = [float(x) for x in v.where("chunk_id = 0").select("embedding").first()[0]]
    return search.chunk_hits(v, text, first, 30).select("chunk_id", "node_id", "excerpt", F.round("score", 6).alias("score"))


@query("q2_semantic_by_label", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), near AS (SELECT vec_id, label, round(1 - sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - e[i]) ** 2))), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 40)
 SELECT label AS node_id, vec_id AS chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM near) WHERE r = 1 ORDER BY score DESC, label LIMIT 10""")
def _(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    chunks = v.select(F.col("chunk_id").alias("id"), F.col("label").alias("node_id"), F.col("chunk_id").alias("chunk_index"))
    first = [float(x) for x in v.where("chunk_id = 0").select("embedding").first()[0]]
    return search.semantic_notes(v.select("chunk_id", "embedding"), chunks, first, 10).withColumn("score", F.round("score", 6))


@query("j3_note_vectors", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
 SELECT vec_id AS node_id, round(1 - sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - e[i]) ** 2))), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 15""")
def _(spark, d):
    v = table(spark, d, "embeddings")
    first = [float(x) for x in v.where("vec_id = 0").select("embedding").first()[0]]
    none = v.limit(0).select(F.col("vec_id").alias("chunk_id"), "embedding")
    got = search.semantic_notes(none, none.select(F.col("chunk_id").alias("id")), first, 15, v.select(F.col("vec_id").alias("node_id"), "embedding"))
    return got.select("node_id", F.round("score", 6).alias("score"))


# ---- incremental --------------------------------------------------------------------------------------------------


@query("s16_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT 1000000 + n_nationkey, n_name FROM nation")
def _(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name")
    fresh = old.where("c_custkey % 7 = 0").select("c_custkey", F.lit("new").alias("c_name")).union(table(spark, d, "nation").select((F.col("n_nationkey") + 1000000).cast("long"), "n_name"))
    return incremental.upsert(old, fresh, ["c_custkey"])


@query("s19_drop_embeddings", "SELECT vec_id, label FROM embeddings WHERE (SELECT count(*) FROM sync_state WHERE false) = 0")
def _(spark, d):
    chunks, sync = incremental.without_embeddings(table(spark, d, "embeddings"), table(spark, d, "sync_state"))
    left = sync.agg(F.count("*").alias("n"))  # a single row
    return chunks.where("embedding is null").crossJoin(left).where("n = 0").select("vec_id", "label")


@query("u5_stale_chunks", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500)")
def _(spark, d):
    return incremental.stale_chunks(table(spark, d, "documents").where("n_chars > 500").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id")))


@query("i8_heal", "SELECT path FROM sync_state WHERE path NOT IN (SELECT id FROM nodes WHERE title IS NULL OR content IS NULL OR content = '')")
def _(spark, d):
    bare = table(spark, d, "nodes").where("title is null or content is null or content = ''").select("id")
    return incremental.heal(table(spark, d, "sync_state"), bare).select("path")


@query("i7_dead_letters", "SELECT doc_id AS id, false AS failed FROM documents WHERE NOT length(text) > 1152 UNION ALL SELECT doc_id, true FROM documents WHERE length(text) > 1152")
def _(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("node_id"), F.col("text").alias("content"))
    good, failed = incremental.dead_letters(chunks, incremental.Budget().chars + 2)
    return good.select("id", F.lit(False).alias("failed")).union(failed.select("chunk_id", F.lit(True)))


@query("i5_index_pass", """WITH disk AS (SELECT path, mtime FROM sync_state WHERE length(path) % 5 <> 0 UNION ALL SELECT 'new/' || n_name || '.md', 1 FROM nation), up AS (SELECT path, mtime FROM disk WHERE starts_with(path, 'new/'))
 SELECT 'sync' AS kind, path AS id FROM disk UNION ALL SELECT 'note', path FROM up""")
def _(spark, d):
    sync = table(spark, d, "sync_state").select("path", "mtime")
    made = table(spark, d, "nation").select(F.concat(F.lit("new/"), "n_name", F.lit(".md")).alias("path"), F.lit(1).cast("long").alias("mtime"))
    disk = sync.where("length(path) % 5 != 0").union(made).withColumn("raw", F.lit("# text"))
    old = spark.createDataFrame([], "id string, title string, content string, frontmatter string")
    fresh, after, _ = incremental.index_pass(old, sync, disk)
    return after.select(F.lit("sync").alias("kind"), F.col("path").alias("id")).union(fresh.select(F.lit("note"), "id"))


# ---- masks and chunks ---------------------------------------------------------------------------------------------


@query("f8_mask_fences", LINES + " SELECT id, md5(string_agg(CASE WHEN inert THEN repeat(' ', length(line)) ELSE line END, chr(10) ORDER BY n)) AS masked FROM fl GROUP BY id")
def _(spark, d):
    return _current(spark, d).where("content is not null").select("id", F.md5(F.regexp_replace(M.masked_fences("content"), "\r\n", "\n")).alias("masked"))


@query("f10_inert_lines", LINES + " SELECT id, count(*) FILTER (inert) AS inert, count(*) AS lines FROM fl GROUP BY id")
def _(spark, d):
    flags = M.inert_flags("content")
    return _current(spark, d).where("content is not null").select("id", F.size(F.filter(flags, lambda x: x)).cast("long").alias("inert"), F.size(flags).cast("long").alias("lines"))


# ---- filters by operation -----------------------------------------------------------------------------------------

_T = "coalesce(tags, '') <> ''"
#: JsonLogic over note_records, and the same condition in SQL.
FILTERS = {
    "eq": ({"==": [{"var": "size"}, 1000]}, "size = 1000"),
    "eq_strict": ({"===": [{"var": "folder"}, "Ideas"]}, "coalesce(folder = 'Ideas', false)"),
    "ne": ({"!=": [{"var": "folder"}, None]}, "folder IS NOT NULL"),
    "ne_strict": ({"!==": [{"var": "name"}, "x"]}, "name IS DISTINCT FROM 'x'"),
    "less": ({"<": [{"var": "size"}, 700]}, "size < 700"),
    "between": ({"<=": [500, {"var": "size"}, 900]}, "size BETWEEN 500 AND 900"),
    "greater": ({">=": [{"var": "size"}, 2000]}, "size >= 2000"),
    "not": ({"!": {"var": "tags"}}, "NOT " + _T),
    "twice_not": ({"!!": {"var": "tags"}}, _T),
    "or": ({"or": [{">": [{"var": "size"}, 3000]}, {"!": {"var": "folder"}}]}, "size > 3000 OR coalesce(folder, '') = ''"),
    "if": ({"if": [{"var": "folder"}, {">": [{"var": "size"}, 1500]}, True]}, "CASE WHEN coalesce(folder, '') <> '' THEN size > 1500 ELSE true END"),
    "in_text": ({"in": ["Work", {"var": "path"}]}, "contains(path, 'Work')"),
    "in_list": ({"in": [{"var": "folder"}, ["Ideas", "Recipes"]]}, "folder IN ('Ideas', 'Recipes')"),
    "cat": ({"==": [{"cat": [{"var": "folder"}, "/", 1]}, "Ideas/1"]}, "folder || '/1' = 'Ideas/1'"),
    "substr": ({"==": [{"substr": [{"var": "path"}, 0, 5]}, "Areas"]}, "left(path, 5) = 'Areas'"),
    "plus": ({">": [{"+": [{"var": "size"}, 500]}, 2500]}, "size + 500 > 2500"),
    "minus": ({">": [{"-": [{"var": "size"}, 500]}, 1500]}, "size - 500 > 1500"),
    "times": ({">": [{"*": [{"var": "size"}, 2]}, 5000]}, "size * 2 > 5000"),
    "divided": ({">": [{"/": [{"var": "size"}, 3]}, 900]}, "size / 3.0 > 900"),
    "rest": ({"==": [{"%": [{"var": "size"}, 7]}, 3]}, "size % 7 = 3"),
    "max": ({">": [{"max": [{"var": "size"}, 1200]}, 1300]}, "greatest(size, 1200) > 1300"),
    "min": ({"<": [{"min": [{"var": "size"}, 600]}, 550]}, "least(size, 600) < 550"),
    "missing": ({"missing": ["folder", "tags"]}, "coalesce(folder, '') = '' OR coalesce(tags, '') = ''"),
    "missing_some": ({"missing_some": [2, ["folder", "tags", "mtime"]]}, "(coalesce(folder, '') <> '')::INT + (coalesce(tags, '') <> '')::INT + (coalesce(mtime, '') <> '')::INT < 2"),
    "merge": ({"in": [{"var": "folder"}, {"merge": [["Ideas"], "Recipes"]}]}, "folder IN ('Ideas', 'Recipes')"),
    "some": ({"some": [["Areas", "Daily"], {"==": [{"var": ""}, "Areas"]}]}, "true"),
    "none": ({"none": [[1, 2], {">": [{"var": ""}, 2]}]}, "true"),
    "all": ({"all": [[1, 2], {">": [{"var": ""}, 0]}]}, "true"),
    "filter": ({"filter": [[1, 2, 3], {">": [{"var": ""}, 2]}]}, "true"),
    "map_reduce": ({"==": [{"reduce": [{"map": [[1, 2, 3], {"*": [{"var": ""}, 2]}]}, {"+": [{"var": "current"}, {"var": "accumulator"}]}, 0]}, 12]}, "true"),
    "default": ({"==": [{"var": ["nowhere", "x"]}, "x"]}, "true"),
}

for _name, (_logic, _sql) in FILTERS.items():

    def _run(spark, d, logic=_logic):
        rows = table(spark, d, "note_records")
        return rows.where(F.coalesce(compile_filter(rows, logic), F.lit(False))).select("record_id")

    query(f"jl_{_name}", f"SELECT record_id FROM note_records WHERE {_sql}")(_run)
