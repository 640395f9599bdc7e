"""The reference's operators as queries over the test tables, each beside the SQL it is compared with where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as X
from ..operators import graph, incremental, links, meta, names, notes, rewrite, search
from ..session import cut_lineage, delete_at_exit, shared_folder, table
from ..sources import vault
from ..streaming import debounce
from .jsonlogic import compile_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CUR = """WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, row_id DESC) AS rn FROM nodes)
 WHERE rn = 1 AND removed_at IS NULL AND NOT coalesce(CASE WHEN json_valid(frontmatter) THEN json_extract_string(frontmatter, '$._stub') = 'true' END, false))"""
TOK = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
TOP = CUR + """, live AS (SELECT e.* FROM edges e WHERE e.source_id IN (SELECT id FROM cur) AND e.target_id IN (SELECT id FROM cur)),
 pairs AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM live),
 adj AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs WHERE a <> b),
 top AS (SELECT target_id AS id, row_number() OVER (ORDER BY count(*) DESC, target_id) AS r FROM live GROUP BY target_id),
 s AS (SELECT id FROM top WHERE r = 1), t AS (SELECT id FROM top WHERE r = 2)"""


#: Lines of the current notes, and whether each is in a fenced block: a fold over the lines that may open or close one.
LINES = CUR.replace("WITH", "WITH RECURSIVE", 1) + """, ln AS MATERIALIZED (SELECT id, i AS n, ls[i] AS line FROM (SELECT id, string_split_regex(content, '\\r?\\n') AS ls FROM cur WHERE content IS NOT NULL), range(1, len(ls) + 1) r(i)),
 fm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM (SELECT id, n, regexp_extract(line, '^[ \\t]{0,3}(`{3,}|~{3,})(.*)$', 1) AS mark, regexp_extract(line, '^[ \\t]{0,3}(`{3,}|~{3,})(.*)$', 2) AS rest FROM ln) WHERE mark <> ''),
 st AS (SELECT id, k, n, CASE WHEN mark[1] = '`' AND contains(rest, '`') THEN '' ELSE mark END AS fence FROM fm WHERE k = 1
  UNION ALL SELECT f.id, f.k, f.n, CASE WHEN s.fence = '' THEN CASE WHEN f.mark[1] = '`' AND contains(f.rest, '`') THEN '' ELSE f.mark END
    WHEN f.mark[1] = s.fence[1] AND length(f.mark) >= length(s.fence) AND trim(f.rest) = '' THEN '' ELSE s.fence END FROM st s JOIN fm f ON f.id = s.id AND f.k = s.k + 1),
 fl AS MATERIALIZED (SELECT l.id, l.n, l.line, coalesce(a.fence, '') <> '' OR coalesce(b.fence, '') <> '' AS inert FROM ln l ASOF LEFT JOIN st a ON l.id = a.id AND l.n > a.n LEFT JOIN st b ON b.id = l.id AND b.n = l.n)"""
_HEADS = """, hd AS (SELECT id, n AS line, length(regexp_extract(line, '^ {0,3}(#{1,6})\\s', 1)) AS level, regexp_extract(line, '^ {0,3}#{1,6}\\s+(.*?)\\s*#*\\s*$', 1) AS text FROM fl WHERE NOT inert AND regexp_matches(line, '^ {0,3}#{1,6}\\s+')),
 bk AS (SELECT id, n AS line, regexp_extract(line, '(?:^|\\s)\\^([A-Za-z0-9-]+)\\s*$', 1) AS block FROM fl WHERE NOT inert AND regexp_matches(line, '(?:^|\\s)\\^([A-Za-z0-9-]+)\\s*$'))"""


def _pagerank_sql(rounds: int) -> str:
    out = ", dg AS MATERIALIZED (SELECT x, count(*) AS d FROM adj GROUP BY 1), pr0 AS (SELECT x, 1.0::DOUBLE / (SELECT count(*) FROM dg) AS r FROM dg)"
    for k in range(1, rounds + 1):
        out += f""", pr{k} AS MATERIALIZED (SELECT dg.x, 0.15::DOUBLE / (SELECT count(*) FROM dg) + 0.85::DOUBLE * coalesce(m.g, 0) AS r FROM dg LEFT JOIN
 (SELECT adj.y, sum(p.r / g.d) AS g FROM adj JOIN pr{k - 1} p ON p.x = adj.x JOIN dg g ON g.x = adj.x GROUP BY 1) m ON m.y = dg.x)"""
    return out + f", pr AS (SELECT c.id, coalesce(p.r, 0) AS score FROM cur c LEFT JOIN pr{rounds} p ON p.x = c.id)"


def _betweenness_sql(levels: int) -> str:
    out = ", an AS MATERIALIZED (SELECT x, y FROM adj WHERE x <> y), b0 AS MATERIALIZED (SELECT DISTINCT x AS s, x AS v, 1.0::DOUBLE AS g FROM an)"
    for k in range(1, levels + 1):
        seen = " AND ".join(f"NOT EXISTS (SELECT 1 FROM b{j} o WHERE o.s = f.s AND o.v = an.y)" for j in range(max(0, k - 2), k))
        out += f", b{k} AS MATERIALIZED (SELECT f.s, an.y AS v, sum(f.g) AS g FROM b{k - 1} f JOIN an ON an.x = f.v WHERE {seen} GROUP BY 1, 2)"
    out += f", e{levels} AS MATERIALIZED (SELECT s, v, g, 0.0::DOUBLE AS d FROM b{levels})"
    for k in range(levels - 1, -1, -1):
        out += f""", e{k} AS MATERIALIZED (SELECT u.s, u.v, u.g, coalesce(t.d, 0) AS d FROM b{k} u LEFT JOIN (SELECT w.s, an.y AS v, sum(p.g / w.g * (1 + w.d)) AS d
 FROM e{k + 1} w JOIN an ON an.x = w.v JOIN b{k} p ON p.s = w.s AND p.v = an.y GROUP BY 1, 2) t ON t.s = u.s AND t.v = u.v)"""
    every = " UNION ALL ".join(f"SELECT s, v, d FROM e{k}" for k in range(1, levels + 1))
    return out + f", bt AS (SELECT c.id, coalesce((SELECT sum(d) FROM ({every}) z WHERE z.v = c.id AND z.s <> z.v), 0) / (((SELECT count(*) FROM cur) - 1)::DOUBLE * ((SELECT count(*) FROM cur) - 2)) AS score FROM cur c)"


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return put


def _current(spark: SparkSession, d: str) -> DataFrame:
    return notes.current(table(spark, d, "nodes"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges")


# ---- scans --------------------------------------------------------------------------------------------------------


@query("s4_note_scan", CUR + " SELECT id, title, frontmatter FROM cur")
def _(spark, d):
    return _current(spark, d).select("id", "title", "frontmatter")


@query("s6_folder_paths", CUR + " SELECT id FROM cur WHERE starts_with(id, 'Areas/') AND NOT starts_with(id, 'Areas/Work/') AND NOT starts_with(id, '_stub/')")
def _(spark, d):
    return notes.list_paths(_current(spark, d), "Areas", ["Areas/Work"])


@query("s8_edges_by_target", "SELECT id, source_id, context FROM edges WHERE target_id = 'Library/Home.md'")
def _(spark, d):
    return _edges(spark, d).where("target_id = 'Library/Home.md'").select("id", "source_id", "context")


@query("m14_list_vaults", """WITH s AS (SELECT DISTINCT id, arg_max(vault_id, (loaded_at, row_id)) AS vault_id, arg_max({'r': removed_at}, (loaded_at, row_id)).r AS removed_at FROM nodes GROUP BY id)
 SELECT v.vault_id, v.title, v.root, (SELECT count(*) FROM s WHERE s.vault_id = v.vault_id AND s.removed_at IS NULL) AS notes FROM vaults v""")
def _(spark, d):
    return vault.list_vaults(table(spark, d, "vaults"), notes.current(table(spark, d, "nodes"), stubs=True))


# ---- filters and projections --------------------------------------------------------------------------------------

_FILTER = {"and": [{">": [{"var": "size"}, 1000]}, {"in": ["Areas", {"var": "folder"}]}, {"!": [{"missing": ["tags"]}]}]}


@query("f1_filter_records", "SELECT record_id, path, size FROM note_records WHERE size > 1000 AND contains(folder, 'Areas') AND tags IS NOT NULL AND tags <> ''")
def _(spark, d):
    rows = table(spark, d, "note_records")
    return rows.where(compile_filter(rows, _FILTER)).select("record_id", "path", "size")


@query("f1_query_notes", "SELECT record_id, path, mtime FROM note_records WHERE size > 1000 AND contains(folder, 'Areas') AND tags IS NOT NULL AND tags <> '' ORDER BY mtime DESC NULLS LAST, path LIMIT 50")
def _(spark, d):
    rows = table(spark, d, "note_records")
    return notes.query_notes(rows, compile_filter(rows, _FILTER), "mtime", True, 50)[0].select("record_id", "path", "mtime")


@query("f1_filter_frontmatter", CUR + " SELECT id FROM cur WHERE json_valid(frontmatter) AND json_type(frontmatter, '$.rating') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'VARCHAR') AND try_cast(json_extract_string(frontmatter, '$.rating') AS DOUBLE) >= 4")
def _(spark, d):
    rows = _current(spark, d)
    return rows.where(compile_filter(rows, {"and": [{"!=": [{"var": "frontmatter.rating"}, None]}, {">=": [{"var": "frontmatter.rating"}, 4]}]})).select("id")


_ONE_KEY = """SELECT id, {n} AS kn, CASE json_type(frontmatter, '$.{k}') WHEN 'ARRAY' THEN json_extract_string(frontmatter, '$.{k}[*]') ELSE [json_extract_string(frontmatter, '$.{k}')] END AS vals FROM cur WHERE json_valid(frontmatter)"""
_TAGS_SQL = CUR + ", one AS (" + " UNION ALL ".join(_ONE_KEY.format(n=n, k=k) for n, k in enumerate(("tags", "tag", "inline_tags"))) + """),
 flat AS (SELECT id, kn, i, vals[i] AS val FROM one, range(1, len(vals) + 1) r(i) WHERE vals[i] IS NOT NULL),
 parts AS (SELECT id, kn, i, j, regexp_replace(trim(p[j]), '^#', '') AS tag FROM (SELECT *, string_split_regex(val, '[,\\s]+') AS p FROM flat), range(1, len(p) + 1) r(j)),
 tags AS (SELECT id, tag, row_number() OVER (PARTITION BY id ORDER BY kn, i, j) AS place FROM parts WHERE tag <> '')"""


@query("a1_list_tags", _TAGS_SQL + """, up AS (SELECT id, place, array_to_string(list_slice(string_split(tag, '/'), 1, n), '/') AS tag FROM tags, range(1, len(string_split(tag, '/')) + 1) r(n)),
 once AS (SELECT id, lower(tag) AS key, arg_min(tag, place) AS tag FROM up GROUP BY 1, 2)
 SELECT arg_min(tag, id) AS tag, count(*) AS count FROM once GROUP BY key""")
def _(spark, d):
    return meta.count_tags(_current(spark, d))


@query("f2_has_tag", _TAGS_SQL + " SELECT DISTINCT id FROM tags WHERE lower(tag) = 'shipment' OR starts_with(lower(tag), 'shipment/')")
def _(spark, d):
    return _current(spark, d).where(X.has_tag(meta.note_tags("frontmatter"), "#Shipment")).select("id")


@query("f4_list_notes", CUR + " SELECT id, title, mtime FROM cur WHERE starts_with(id, 'Projects/') ORDER BY mtime DESC NULLS LAST, id LIMIT 100")
def _(spark, d):
    return notes.list_notes(_current(spark, d), "Projects", sort_by="mtime").select("id", "title", "mtime")


@query("f5_grep", CUR + """, l AS (SELECT id, string_split_regex(content, '\r?\n') AS lines FROM cur WHERE contains(lower(content), 'kettle'))
 SELECT id, i AS line, lines[i] AS text, coalesce(lines[i - 1], '') AS before, coalesce(lines[i + 1], '') AS after FROM (SELECT id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l) WHERE contains(lower(lines[i]), 'kettle')""")
def _(spark, d):
    return search.grep(_current(spark, d), "kettle").withColumn("line", F.col("line").cast("long"))


@query("f9_strip_code", CUR + " SELECT id, md5(regexp_replace(regexp_replace(content, '```.*?```', '', 'gs'), '`[^`\n]*`', '', 'g')) AS plain FROM cur")
def _(spark, d):
    return _current(spark, d).select("id", F.md5(M.strip_code("content")).alias("plain"))


@query("f13_read_notes", CUR + " SELECT id, title, coalesce(length(content) + length(regexp_replace(content, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 2000, false) AS truncated FROM cur")
def _(spark, d):
    return notes.read_notes(_current(spark, d)).select("id", "title", "truncated")


# ---- joins and aggregates -----------------------------------------------------------------------------------------


@query("j4_outgoing_titles", CUR + " SELECT e.source_id, e.target_id, coalesce(c.title, e.target_id) AS title FROM (SELECT DISTINCT source_id, target_id FROM edges) e LEFT JOIN cur c ON c.id = e.target_id")
def _(spark, d):
    return notes.titled_targets(_edges(spark, d), _current(spark, d))


@query("j5_backlink_titles", CUR + " SELECT e.target_id, e.source_id, coalesce(c.title, e.source_id) AS title FROM (SELECT DISTINCT source_id, target_id FROM edges) e LEFT JOIN cur c ON c.id = e.source_id")
def _(spark, d):
    return notes.titled_sources(_edges(spark, d), _current(spark, d))


@query("j8_live_edges", CUR + " SELECT id, source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM cur) AND target_id IN (SELECT id FROM cur)")
def _(spark, d):
    return notes.live_edges(_edges(spark, d), _current(spark, d)).select("id", "source_id", "target_id")


_LINK_PATHS = """, lw AS (SELECT DISTINCT source_id, raw, CASE WHEN ends_with(raw, '.md') THEN raw ELSE raw || '.md' END AS with_md, string_split(raw, '/')[-1] AS last,
   CASE WHEN ends_with(raw, '.md') THEN left(raw, length(raw) - 3) ELSE raw END AS prefix, CASE WHEN contains(source_id, '/') THEN regexp_replace(source_id, '/[^/]*$', '') ELSE '' END AS home FROM asked),
 ls AS (SELECT id, regexp_replace(string_split(id, '/')[-1], '\\.md$', '') AS stem, CASE WHEN contains(id, '/') THEN regexp_replace(id, '/[^/]*$', '') ELSE '' END AS dir FROM cur),
 lp AS (SELECT source_id, raw, CASE WHEN with_md IN (SELECT id FROM cur) THEN with_md ELSE coalesce(
   CASE WHEN contains(raw, '/') THEN (SELECT min(id) FROM ls WHERE stem = last AND starts_with(id, prefix)) END,
   (SELECT min(id) FROM ls WHERE stem = last AND dir = home), (SELECT min(id) FROM ls WHERE stem = last)) END AS path FROM lw)"""


@query("j9_link_paths", CUR + ", asked AS (SELECT source_id, target_id AS raw FROM edges)" + _LINK_PATHS + " SELECT source_id, raw, path FROM lp")
def _(spark, d):
    return names.link_paths(_edges(spark, d).select("source_id", F.col("target_id").alias("raw")), _current(spark, d))


@query("a2_property_values", CUR + """, v AS (SELECT CASE WHEN json_type(frontmatter, '$.status') = 'ARRAY' THEN unnest(json_extract(frontmatter, '$.status[*]')) ELSE json_extract(frontmatter, '$.status') END AS value FROM cur WHERE json_valid(frontmatter))
 SELECT CAST(value AS VARCHAR) AS value, count(*) AS count FROM v WHERE value IS NOT NULL AND CAST(value AS VARCHAR) <> 'null' GROUP BY 1""".replace("CASE WHEN json_type(frontmatter, '$.status') = 'ARRAY' THEN unnest(json_extract(frontmatter, '$.status[*]')) ELSE json_extract(frontmatter, '$.status') END", "unnest(CASE WHEN json_type(frontmatter, '$.status') = 'ARRAY' THEN json_extract(frontmatter, '$.status[*]') ELSE [json_extract(frontmatter, '$.status')] END)"))
def _(spark, d):
    return meta.property_values(_current(spark, d), "status")


@query("a3_folder_overview", CUR + " SELECT CASE WHEN contains(id, '/') THEN string_split(id, '/')[1] ELSE '(root)' END AS folder, count(*) AS notes FROM cur GROUP BY 1")
def _(spark, d):
    return meta.overview(_current(spark, d))


@query("a4_degrees", """SELECT coalesce(o.id, i.id) AS id, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(n_sources, 0) AS n_sources FROM (SELECT source_id AS id, count(*) AS n_out FROM edges GROUP BY 1) o
 FULL JOIN (SELECT target_id AS id, count(*) AS n_in, count(DISTINCT source_id) AS n_sources FROM edges GROUP BY 1) i ON o.id = i.id""")
def _(spark, d):
    return notes.degrees(_edges(spark, d))


@query("a7_index_status", """SELECT (SELECT count(*) FROM documents) AS notes_total, (SELECT count(*) FROM embeddings) AS chunks_total, (SELECT count(DISTINCT vec_id) FROM embeddings) AS with_embeddings,
 (SELECT count(*) FROM documents WHERE text IS NULL OR text = '') AS no_embeddable, greatest((SELECT count(*) FROM documents) - (SELECT count(DISTINCT vec_id) FROM embeddings) - (SELECT count(*) FROM documents WHERE text IS NULL OR text = ''), 0) AS missing""")
def _(spark, d):
    docs = table(spark, d, "documents")
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").isNotNull().alias("has_vector"))
    failed = docs.where("text is null or text = ''").select(F.col("doc_id").alias("note_id"), F.lit("no-embeddable-content").alias("reason"))
    return meta.index_status(docs, chunks, failed)


@query("j7_without_vectors", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND text IS NOT NULL AND text <> ''")
def _(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.lit(True).alias("has_vector"))
    return meta.without_vectors(docs, chunks, docs.where("text is null or text = ''").select(F.col("id").alias("note_id")))


@query("a9_best_chunk", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT label, vec_id, round(1 - sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - e[i]) ** 2))), 6) AS score FROM embeddings, q)
 SELECT label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s) WHERE r = 1""")
def _(spark, d):
    v = table(spark, d, "embeddings")
    hits = v.select("label", "vec_id", F.round(1 - X.l2_distance(F.col("embedding"), X.vector(_vector(v))), 6).alias("score"))
    return search.best_chunk(hits, "label", order="vec_id").select("label", "vec_id", "score")


@query("a11_task_counts", CUR + """, m AS (SELECT id, regexp_extract_all(content, '(?m)^[ \\t]*(?:[-*+]|\\d+[.)])[ \\t]+\\[(.)\\](?:[ \\t]|$)', 1) AS marks FROM cur WHERE content IS NOT NULL)
 SELECT id, len(list_filter(marks, lambda x: x = ' ')) AS open, len(list_filter(marks, lambda x: x <> ' ')) AS done FROM m""")
def _(spark, d):
    return _current(spark, d).where("content is not null").select("id", M.task_counts("content").alias("t")).select("id", F.col("t.open").cast("long").alias("open"), F.col("t.done").cast("long").alias("done"))


@query("x6_aliases", CUR + """, v AS (SELECT id, CASE json_type(frontmatter, '$.aliases') WHEN 'ARRAY' THEN json_extract_string(frontmatter, '$.aliases[*]') ELSE string_split(json_extract_string(frontmatter, '$.aliases'), ',') END AS a FROM cur WHERE json_valid(frontmatter))
 SELECT id, alias FROM (SELECT DISTINCT id, trim(unnest(a)) AS alias FROM v) WHERE alias <> ''""")
def _(spark, d):
    return _current(spark, d).select("id", F.explode(names.loose_aliases("frontmatter")).alias("alias"))


# ---- retrieval ----------------------------------------------------------------------------------------------------


def _vector(vectors: DataFrame) -> list[float]:
    return [float(x) for x in vectors.where("vec_id = 0").select("embedding").first()[0]]


_BM25 = ("WITH d AS (SELECT doc_id, " + TOK.format("source") + " AS a, " + TOK.format("text") + """ AS b FROM documents), c AS (SELECT doc_id, len(a) + len(b) AS n, {hits} FROM d),
 g AS (SELECT count(*)::DOUBLE AS total, avg(n) AS mean, {df} FROM c)
 SELECT doc_id, round({score}, 6) AS score FROM c, g WHERE {every}""")


def _bm25_sql(terms: list[str], stems: bool = False) -> str:
    same = (lambda t: f"t IN ({', '.join(repr(w) for w in t.split())})") if stems else (lambda t: f"t = '{t}'")
    hits = ", ".join(f"5.0 * len(list_filter(a, lambda t: {same(t)})) + len(list_filter(b, lambda t: {same(t)})) AS f{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((total - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    every = " AND ".join(f"f{i} > 0" for i in range(len(terms)))
    return _BM25.replace("{hits}", hits).replace("{df}", df).replace("{score}", score).replace("{every}", every)


@query("q1_bm25", _bm25_sql(["bridge", "kettle"]))
def _(spark, d):
    return search.bm25(table(spark, d, "documents"), "Bridge kettle", "doc_id", "source", "text").select("doc_id", F.round("score", 6).alias("score"))


_INDEXES: dict[tuple[str, str], search.TextIndex] = {}


def _text_hits(spark, d, words: str) -> DataFrame:
    """By the stored index of the documents where the session has one, else in one pass over the texts; the scores are the same."""
    index = _INDEXES.get((spark.sparkContext.applicationId, d))
    return index.search(words, spark) if index else search.bm25(table(spark, d, "documents"), words, "doc_id", "source", "text")


def _index(spark, d) -> search.TextIndex:
    """The stored index of the documents, built by the first query of the session that asks for it."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _INDEXES:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        delete_at_exit(spark, path)
        _INDEXES[at] = search.TextIndex.build(table(spark, d, "documents"), path, "doc_id", "source", "text", 16)
    return _INDEXES[at]


@query("q1_bm25_indexed", _bm25_sql(["bridge", "kettle"]))
def _(spark, d):
    return _index(spark, d).search("Bridge kettle", spark).select("doc_id", F.round("score", 6).alias("score"))


@query("q1_bm25_stemmed", _bm25_sql(["bridge bridges bridged bridging", "kettle kettles kettled kettling"], stems=True))
def _(spark, d):
    docs = table(spark, d, "documents")
    return search.bm25(docs, " ".join(M.porter(t) for t in ("bridges", "kettles")), "doc_id", "source", "text", tokens=lambda c: M.stemmed_tokens(c)).select("doc_id", F.round("score", 6).alias("score"))


@query("q5_excerpts", CUR + """, p AS (SELECT id, list_filter(string_split_regex(content, '\\n\\n+'), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#')) AS ps FROM cur)
 SELECT id, coalesce(length(trim(ps[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279))), 0) AS n FROM p""")
def _(spark, d):
    return _current(spark, d).select("id", F.length(X.note_excerpt("content", 1 << 20)).cast("long").alias("n"))


_KNN = """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
 SELECT vec_id, round(1 - sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - e[i]) ** 2))), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 20"""


@query("q6_knn", _KNN)
def _(spark, d):
    v = table(spark, d, "embeddings")
    return search.knn(v, _vector(v), 20).select("vec_id", F.round("score", 6).alias("score"))


@query("q6_knn_batch", """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(1 - sqrt(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (CAST(v.embedding[i] AS DOUBLE) - q.embedding[i]) ** 2))), 9) AS score
 FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
 SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10""")
def _(spark, d):
    v = table(spark, d, "embeddings")
    return search.knn_batch(v, v.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("q4_hybrid", "WITH near AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (SELECT vec_id, 1 - sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - e[i]) ** 2))) AS score FROM embeddings, (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) q) ORDER BY score DESC, vec_id LIMIT 40), "
 "txt AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (" + _bm25_sql(["bridge", "kettle"]).replace("round(", "(").replace(", 6) AS score", ") AS score") + ") ORDER BY score DESC, doc_id LIMIT 40) "
 "SELECT doc_id, round(sum(part), 9) AS score FROM (SELECT doc_id, 1.0 / (60 + r) AS part, r AS seen FROM near UNION ALL SELECT doc_id, 1.0 / (60 + r), 1000000 + r FROM txt) GROUP BY 1 ORDER BY sum(part) DESC, min(seen) LIMIT 20")
def hybrid(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    near = v.withColumnRenamed("vec_id", "doc_id")
    text = search.top(_text_hits(spark, d, "bridge kettle"), "score", "doc_id", 40)
    return search.fuse([search.knn(near, _vector(v), 40, "doc_id"), text], "doc_id", 20).select("doc_id", F.round("score", 9).alias("score"))


@query("q2_semantic_notes")
def _(spark, d):
    chunks = incremental.chunk_rows(_current(spark, d))
    vectors = chunks.select("node_id", "chunk_index", "id", M.embed_text(M.chunk_text(F.col("heading"), F.col("content"))).alias("embedding"))
    hits = search.knn(vectors, M.hashed_embedding("narrow kettle estimate"), 80, "id").join(chunks.select("id", "node_id", "chunk_index"), "id")
    return search.best_chunk(hits).select("node_id", "chunk_index", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "node_id").limit(20)


_STRICT = "CASE json_type(frontmatter, '$.aliases') WHEN 'ARRAY' THEN json_extract_string(frontmatter, '$.aliases[*]') WHEN 'VARCHAR' THEN [json_extract_string(frontmatter, '$.aliases')] ELSE [] END"
_RESOLVE = CUR + """, al AS (SELECT id, title, CASE WHEN json_valid(frontmatter) THEN """ + _STRICT + """ ELSE [] END AS a FROM cur),
 h AS (SELECT id, title, CASE WHEN id IN ('{n}', '{m}') THEN 0 WHEN title = '{n}' THEN 1 WHEN string_split(id, '/')[-1] IN ('{n}', '{m}') THEN 2 WHEN lower(title) = lower('{n}') THEN 3
   WHEN len(list_filter(a, lambda x: lower(x) = lower('{n}'))) > 0 THEN 4 WHEN contains(lower(title), lower('{n}')) THEN 5 END AS tier FROM al)
 SELECT id, title, tier FROM h WHERE tier = (SELECT min(tier) FROM h)"""


@query("x1_resolve_name", _RESOLVE.format(n="kettle", m="kettle.md"))
def _(spark, d):
    return names.resolve(_current(spark, d), "kettle")


@query("x2_resolve_alias", "WITH f AS (SELECT min(lower(a)) AS name FROM (SELECT unnest(json_extract_string(frontmatter, '$.aliases[*]')) AS a FROM nodes WHERE json_valid(frontmatter) AND json_type(frontmatter, '$.aliases') = 'ARRAY') WHERE regexp_matches(a, '^[A-Za-z]{8,}$')), " + CUR[5:] + ", al AS (SELECT id, title, CASE WHEN json_valid(frontmatter) THEN " + _STRICT + """ ELSE [] END AS a FROM cur),
 h AS (SELECT id, title, CASE WHEN id IN (name, name || '.md') THEN 0 WHEN title = name THEN 1 WHEN string_split(id, '/')[-1] IN (name, name || '.md') THEN 2 WHEN lower(title) = name THEN 3
   WHEN len(list_filter(a, lambda x: lower(x) = name)) > 0 THEN 4 WHEN contains(lower(title), name) THEN 5 END AS tier FROM al, f)
 SELECT id, title, tier FROM h WHERE tier = (SELECT min(tier) FROM h)""")
def _(spark, d):
    every = table(spark, d, "nodes").select(F.explode(F.try_variant_get(X.valid_json("frontmatter"), "$.aliases", "array<string>")).alias("a"))
    name = every.where(F.col("a").rlike("^[A-Za-z]{8,}$")).agg(F.min(F.lower("a")).alias("a")).first().a
    return names.resolve(_current(spark, d), name or "kettle")


_SCORE = """CASE WHEN coalesce(c, '') = '' THEN 0.0 WHEN c = '{q}' THEN 1.0 WHEN starts_with(c, '{q}') THEN 0.9 WHEN contains(c, '{q}') THEN CASE WHEN regexp_matches(substr(c, strpos(c, '{q}') - 1, 1), '[\\s_/.-]') THEN 0.85 ELSE 0.8 END
 WHEN {words} THEN 0.7 ELSE greatest(CASE WHEN regexp_matches(c, '{span}') THEN 0.4 + 0.2 * {n} / length(regexp_extract(c, '{span}', 1)) ELSE 0.0 END,
 CASE WHEN 1 - levenshtein(c, '{q}') / greatest(length(c), {n})::DOUBLE >= 0.6 THEN 0.6 * (1 - levenshtein(c, '{q}') / greatest(length(c), {n})::DOUBLE) ELSE 0.0 END) END"""


def _score_sql(q: str) -> str:
    letters = q.replace(" ", "")
    span = f"^[^{letters[0]}]*({letters[0]}" + "".join(f"[^{c}]*{c}" for c in letters[1:]) + ")"
    return _SCORE.format(q=q, n=len(q), span=span, words=" AND ".join(f"contains(c, '{w}')" for w in q.split()))


@query("x3_find_by_name", CUR + """, al AS (SELECT id, CASE json_type(frontmatter, '$.aliases') WHEN 'ARRAY' THEN json_extract_string(frontmatter, '$.aliases[*]') ELSE string_split(json_extract_string(frontmatter, '$.aliases'), ',') END AS a FROM cur WHERE json_valid(frontmatter)),
 nm AS (SELECT id, regexp_replace(string_split(id, '/')[-1], '\\.md$', '') AS name, 0 AS turn, 'name' AS matched_on, NULL AS alias FROM cur UNION ALL SELECT id, title, -1, 'title', NULL FROM cur
   UNION ALL SELECT id, trim(a[i]), -2 - i, 'alias', trim(a[i]) FROM al, range(1, 200) r(i) WHERE i <= len(a) AND trim(a[i]) <> ''),
 sc AS (SELECT *, lower(name) AS c FROM nm), sr AS (SELECT *, round(""" + _score_sql("kettle of") + """, 3) AS score FROM sc),
 best AS (SELECT id, max(score) AS score, arg_max(matched_on, (score, turn)) AS matched_on, arg_max({'a': alias}, (score, turn)).a AS alias FROM sr GROUP BY id)
 SELECT b.id, c.title, b.score, b.matched_on, b.alias FROM best b JOIN cur c USING (id) WHERE score > 0 ORDER BY score DESC, length(id), id LIMIT 100""")
def _(spark, d):
    return names.find_by_name(_current(spark, d), "kettle of", limit=100)


@query("x4_similarity", "SELECT p_partkey, round(1 - levenshtein(lower(p_name), 'green almond') / greatest(length(p_name), 12)::DOUBLE, 6) AS score FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(names.similarity(F.col("p_name"), F.lit("green almond")), 6).alias("score"))


@query("x5_fuzzy_lines", CUR + """, l AS (SELECT id, i AS line, ls[i] AS text FROM (SELECT id, string_split(content, chr(10)) AS ls, contains(lower(content), 'the kettles') AS hit FROM cur WHERE content IS NOT NULL) z, range(1, len(ls) + 1) r(i)),
 hit AS (SELECT id FROM cur WHERE contains(lower(content), 'the kettles')),
 ex AS (SELECT id, line, unnest(regexp_extract_all(text, '(?i)the kettles')) AS text, 1.0 AS score FROM l WHERE id IN (SELECT id FROM hit)),
 w AS (SELECT id, line, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM l WHERE id NOT IN (SELECT id FROM hit)),
 p AS (SELECT id, line, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS text FROM w, range(1, len(ws) + 1) a(i), range(1, 5) b(n) WHERE i + n - 1 <= len(ws)),
 f AS (SELECT id, line, max(s) AS score, arg_max(text, (s, -i, -n)) AS text FROM (SELECT *, 1 - levenshtein(lower(text), 'the kettles') / greatest(length(text), 11)::DOUBLE AS s FROM p WHERE length(text) BETWEEN 7 AND 16) GROUP BY 1, 2)
 SELECT id, line, text, score FROM ex UNION ALL SELECT id, line, text, round(score, 6) FROM f WHERE score >= 0.7""")
def _(spark, d):
    return names.fuzzy_find(_current(spark, d), "the kettles").withColumn("line", F.col("line").cast("long"))


# ---- graph --------------------------------------------------------------------------------------------------------


def _pairs(spark, d):
    n = _current(spark, d)
    directed = graph.build(n, _edges(spark, d))
    return n, directed, graph.undirected(directed)


def _top_two(spark, d, n: DataFrame) -> list[str]:
    live = notes.live_edges(_edges(spark, d), n)
    return [r.target_id for r in live.groupBy("target_id").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "target_id").limit(2).collect()]


@query("g2_undirected", TOP + " SELECT a, b FROM pairs")
def _(spark, d):
    return _pairs(spark, d)[2]


_ROUNDS, _LEVELS = 20, 12


@query("g3_pagerank")
def _(spark, d):
    n, _, pairs = _pairs(spark, d)
    return graph.pagerank(n, pairs).select("id", F.round("score", 9).alias("score"))


@query("g3_pagerank_rounds", TOP + _pagerank_sql(_ROUNDS) + " SELECT id, round(score, 9) AS score FROM pr")
def _(spark, d):
    n, _, pairs = _pairs(spark, d)
    return graph.pagerank(n, pairs, rounds=_ROUNDS).select("id", F.round("score", 9).alias("score"))


@query("g4_betweenness", TOP + _betweenness_sql(_LEVELS) + " SELECT id, round(score, 9) AS score FROM bt")
def _(spark, d):
    n, _, pairs = _pairs(spark, d)
    return graph.betweenness(n, pairs).select("id", F.round("score", 9).alias("score"))


_BRIDGING = "least(greatest(score / ((SELECT count(*) FROM cur)::DOUBLE * ((SELECT count(*) FROM cur) - 1) / 2), 0), 1)"


@query("g5_bridging", TOP + _betweenness_sql(_LEVELS) + f" SELECT id, round({_BRIDGING}, 15) AS score FROM bt")
def _(spark, d):
    n = cut_lineage(_current(spark, d).select("id"))  # read five times below
    pairs = graph.undirected(graph.build(n, _edges(spark, d)))
    return graph.bridging(graph.betweenness(n, pairs), n.count()).select("id", F.round("score", 15).alias("score"))


@query("g6_rank_notes", TOP + _pagerank_sql(_ROUNDS) + _betweenness_sql(_LEVELS) + f""", lk AS (SELECT target_id AS id FROM (SELECT DISTINCT source_id, target_id FROM live) GROUP BY 1 HAVING count(*) >= 2),
 inf AS (SELECT 'influence' AS metric, pr.id, c.title, pr.score FROM pr JOIN cur c USING (id) WHERE id IN (SELECT id FROM lk) ORDER BY round(pr.score, 12) DESC, pr.id LIMIT 20),
 bri AS (SELECT 'bridging' AS metric, bt.id, c.title, {_BRIDGING.replace("score", "bt.score")} AS score FROM bt JOIN cur c USING (id) ORDER BY round({_BRIDGING.replace("score", "bt.score")}, 12) DESC, bt.id LIMIT 20)
 SELECT metric, id, title, round(score, 9) AS score FROM inf UNION ALL SELECT metric, id, title, round(score, 9) FROM bri""")
def _(spark, d):
    return graph.rank_notes(_current(spark, d), _edges(spark, d), rounds=_ROUNDS).select("metric", "id", "title", F.round("score", 9).alias("score"))


@query("g7_connections", TOP + """, one AS (SELECT DISTINCT y AS id FROM adj WHERE x IN (SELECT id FROM s) AND y NOT IN (SELECT id FROM s)),
 two AS (SELECT DISTINCT y AS id FROM adj WHERE x IN (SELECT id FROM one) AND y NOT IN (SELECT id FROM one) AND y NOT IN (SELECT id FROM s))
 SELECT id, 1 AS distance FROM one UNION ALL SELECT id, 2 FROM two""")
def _(spark, d):
    n, _, pairs = _pairs(spark, d)
    return graph.connections(cut_lineage(pairs), _top_two(spark, d, n)[0], 2)


@query("g8_subgraph", TOP + """, one AS (SELECT id FROM s UNION SELECT y FROM adj WHERE x IN (SELECT id FROM s)), last AS (SELECT source_id, target_id, arg_max(context, id) AS context FROM live GROUP BY 1, 2)
 SELECT source_id, target_id, context FROM last WHERE source_id IN (SELECT id FROM one) AND target_id IN (SELECT id FROM one)""")
def _(spark, d):
    n, directed, pairs = _pairs(spark, d)
    seed = _top_two(spark, d, n)[0]
    members = graph.connections(cut_lineage(pairs), seed, 1).select("id").union(spark.createDataFrame([(seed,)], "id string"))
    return graph.subgraph(graph.latest_context(notes.live_edges(_edges(spark, d), n)), members)


@query("g9_simple_paths", TOP + """, p1 AS (SELECT [x, y] AS p FROM adj WHERE x IN (SELECT id FROM s) AND y <> x), p2 AS (SELECT list_append(p, y) AS p FROM p1 JOIN adj ON adj.x = p[-1] WHERE p[-1] NOT IN (SELECT id FROM t) AND NOT list_contains(p, y)),
 p3 AS (SELECT list_append(p, y) AS p FROM p2 JOIN adj ON adj.x = p[-1] WHERE p[-1] NOT IN (SELECT id FROM t) AND NOT list_contains(p, y)), every AS (SELECT p FROM p1 UNION ALL SELECT p FROM p2 UNION ALL SELECT p FROM p3)
 SELECT array_to_string(p, ' > ') AS path, len(p) - 1 AS length FROM every WHERE p[-1] IN (SELECT id FROM t)""")
def _(spark, d):
    n, _, pairs = _pairs(spark, d)
    a, b = _top_two(spark, d, n)
    return graph.simple_paths(cut_lineage(pairs), a, b, 3).select(F.array_join("path", " > ").alias("path"), F.col("length").cast("long").alias("length"))


@query("g10_common_neighbours", TOP + " SELECT DISTINCT y AS id FROM adj WHERE x IN (SELECT id FROM s) AND y IN (SELECT y FROM adj WHERE x IN (SELECT id FROM t)) AND y NOT IN (SELECT id FROM s) AND y NOT IN (SELECT id FROM t)")
def _(spark, d):
    n, _, pairs = _pairs(spark, d)
    return graph.common_neighbours(cut_lineage(pairs), *_top_two(spark, d, n))


@query("g11_note_links", CUR + """, e AS (SELECT DISTINCT source_id, target_id FROM edges), o AS (SELECT source_id AS id, string_agg(target_id, '|' ORDER BY target_id) AS l FROM e GROUP BY 1), i AS (SELECT target_id AS id, string_agg(source_id, '|' ORDER BY source_id) AS l FROM e GROUP BY 1)
 SELECT c.id, coalesce(o.l, '') AS outgoing, coalesce(i.l, '') AS incoming FROM cur c LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def _(spark, d):
    rows = notes.note_links(_current(spark, d), _edges(spark, d))
    return rows.select("id", F.array_join("outgoing", "|").alias("outgoing"), F.array_join("incoming", "|").alias("incoming"))


@query("g12_orphans", CUR + """, r AS (SELECT source_id, target_id FROM edges WHERE source_id <> target_id)
 SELECT c.id, c.title, (SELECT count(DISTINCT target_id) FROM r WHERE r.source_id = c.id) AS outgoing_links FROM cur c WHERE c.id NOT IN (SELECT target_id FROM r)""")
def _(spark, d):
    return links.orphaned(_current(spark, d), _edges(spark, d))


@query("g14_stub_notes", CUR + """ SELECT '_stub/' || regexp_replace(target_id, '^_stub/', '') AS id, count(*) AS inbound, regexp_replace(regexp_replace('_stub/' || regexp_replace(target_id, '^_stub/', ''), '^_stub/', ''), '\\.md$', '') AS title
 FROM edges WHERE target_id NOT IN (SELECT id FROM cur) GROUP BY 1, 3""")
def _(spark, d):
    return links.stub_notes(_edges(spark, d), _current(spark, d))


@query("g15_rename", "SELECT id, source_id, CASE WHEN target_id = 'Library/Home.md' THEN 'Library/Start.md' ELSE target_id END AS target_id FROM edges")
def _(spark, d):
    return links.rename(_edges(spark, d), "Library/Home.md", "Library/Start.md", ["source_id", "target_id"]).select("id", "source_id", "target_id")


# ---- extraction ---------------------------------------------------------------------------------------------------

def _resolved_links(now: DataFrame) -> DataFrame:
    """``source_id, target_id`` of the links in note texts; a placeholder where nothing has the path."""
    raw = vault.links_of(now).select("source_id", F.col("target").alias("raw"))
    return names.link_paths(raw, now).select("source_id", F.coalesce("path", F.concat(F.lit("_stub/"), "raw", F.lit(".md"))).alias("target_id"))


_INDEX_LINKS = """, il AS (SELECT id AS source_id, content, regexp_replace(regexp_replace(regexp_replace(content, '```.*?```', '', 'gs'), '`[^`\n]*`', '', 'g'), '!\\[\\[[^\\]]+\\]\\]', '', 'g') AS t FROM cur WHERE contains(content, '[[')),
 ir AS (SELECT source_id, content, regexp_extract_all(t, '\\[\\[([^\\]]+)\\]\\]', 1) AS l FROM il),
 ix AS (SELECT source_id, content, i - 1 AS pos, trim(string_split(l[i], '|')[1]) AS raw FROM ir, range(1, len(l) + 1) r(i)),
 iy AS (SELECT *, regexp_extract(raw, '^([^#^]*)', 1) AS target, nullif(regexp_extract(raw, '^[^#^]*#?(\\^?.*)$', 1), '') AS subpath FROM ix)"""


@query("e3_index_links", CUR + _INDEX_LINKS + """, pg AS (SELECT *, list_filter(string_split_regex(content, '\\n\\s*\\n'), lambda p: contains(p, '[[' || raw))[1] AS p FROM iy)
 SELECT source_id, pos, raw, target, subpath, coalesce(trim(regexp_replace(regexp_replace(p, '\\[\\[(?:[^\\]|]*\\|)?([^\\]]*)\\]\\]', '\\1', 'g'), '\\s+', ' ', 'g')), raw) AS context FROM pg""")
def _(spark, d):
    return vault.links_of(_current(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query("g13_broken_links", LINES + _HEADS + """, lk AS (SELECT id, n AS line, row_number() OVER () AS k, unnest(regexp_extract_all(line, '!?\\[\\[[^\\[\\]]+\\]\\]')) AS link FROM fl WHERE NOT inert AND contains(line, '[[')),
 li AS (SELECT row_number() OVER () AS k, id AS source_id, line, link, string_split(substr(link, 3, length(link) - 4), '|')[1] AS inner_text FROM lk WHERE NOT starts_with(link, '!')),
 lt AS (SELECT *, trim(regexp_extract(inner_text, '^([^#^]*)', 1)) AS raw, regexp_replace(regexp_extract(inner_text, '^[^#^]*([#^].*)$', 1), '^#', '') AS sub FROM li),
 asked AS (SELECT DISTINCT source_id, raw FROM lt WHERE raw <> '')""" + _LINK_PATHS + """,
 ap AS (SELECT t.*, CASE WHEN t.raw = '' THEN t.source_id ELSE lp.path END AS path, list_filter(list_transform(string_split(sub, '#'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM lt t LEFT JOIN lp ON lp.source_id = t.source_id AND lp.raw = t.raw),
 hk AS (SELECT DISTINCT id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM hd),
 hp AS (SELECT ap.k, count(*) AS gone FROM ap, range(1, len(parts) + 1) r(i) WHERE NOT starts_with(parts[-1], '^') AND NOT EXISTS (SELECT 1 FROM hk WHERE hk.id = ap.path AND hk.key = lower(trim(regexp_replace(parts[i], '\\s+', ' ', 'g')))) GROUP BY 1)
 SELECT source_id, line, link, CASE WHEN path IS NULL THEN 'note_not_found' WHEN starts_with(parts[-1], '^') THEN 'block_not_found' ELSE 'heading_not_found' END AS reason FROM ap LEFT JOIN hp USING (k)
 WHERE path IS NULL OR len(parts) > 0 AND (starts_with(parts[-1], '^') AND NOT EXISTS (SELECT 1 FROM bk WHERE bk.id = ap.path AND bk.block = substr(parts[-1], 2)) OR hp.gone > 0)""")
def _(spark, d):
    return links.broken_links(_current(spark, d)).withColumn("line", F.col("line").cast("long"))


@query("e6_inline_tags", CUR + " SELECT DISTINCT id, unnest(regexp_extract_all(content, '(?:^|[^A-Za-z0-9_])#([a-zA-Z][A-Za-z0-9_\\-/]*)', 1)) AS tag FROM cur")
def _(spark, d):
    return _current(spark, d).select("id", F.explode(M.inline_tags("content")).alias("tag"))


@query("e7_inline_fields", CUR + """, c AS (SELECT id, regexp_replace(regexp_replace(content, '```.*?```', '', 'gs'), '`[^`\n]*`', '', 'g') AS t FROM cur WHERE contains(content, '::')),
 m AS (SELECT id, regexp_extract_all(t, '(?m)^([A-Za-z][A-Za-z0-9_ \\-]*)::[ \\t]+(\\S.*?)[ \\t\\r]*$', 1) AS k, regexp_extract_all(t, '(?m)^([A-Za-z][A-Za-z0-9_ \\-]*)::[ \\t]+(\\S.*?)[ \\t\\r]*$', 2) AS v FROM c)
 SELECT id, trim(k[i]) AS key, v[i] AS value FROM m, range(1, 100) r(i) WHERE i <= len(k) AND list_position(list_transform(k, lambda x: trim(x)), trim(k[i])) = i""")
def _(spark, d):
    return _current(spark, d).where(F.col("content").contains("::")).select("id", F.explode(M.inline_fields("content")).alias("key", "value"))


@query("e8_chunks")
def _(spark, d):
    return incremental.chunk_rows(_current(spark, d))


@query("e10_headings", LINES + _HEADS + " SELECT id, line, level, text FROM hd")
def _(spark, d):
    return _current(spark, d).select("id", F.explode(M.headings("content")).alias("h")).select("id", F.col("h.line").cast("long").alias("line"), F.col("h.level").cast("long").alias("level"), "h.text")


@query("e11_block_ids", LINES + _HEADS + " SELECT id, line, block FROM bk")
def _(spark, d):
    return _current(spark, d).where(F.col("content").contains("^")).select("id", F.explode(M.block_ids("content")).alias("b")).select("id", F.col("b.line").cast("long").alias("line"), "b.block")


@query("w5_sections", LINES + _HEADS + """, nl AS (SELECT id, max(n) AS n FROM ln GROUP BY 1)
 SELECT h.id, h.line, h.text, coalesce((SELECT min(g.line) - 1 FROM hd g WHERE g.id = h.id AND g.line > h.line AND g.level <= h.level), nl.n) AS "end" FROM hd h JOIN nl ON nl.id = h.id""")
def _(spark, d):
    return M.section_rows(_current(spark, d)).select("id", F.col("line").cast("long").alias("line"), "text", F.col("end").cast("long").alias("end"))


_TASKS = LINES + """, it AS (SELECT id, n, 1 + 0 * n AS one, regexp_extract(line, '^([ \\t]*)', 1) AS ws, line, regexp_matches(line, '^[ \\t]*(?:[-*+]|[0-9]+[.)])[ \\t]+\\[.\\](?:[ \\t]|$)') AS task FROM fl WHERE NOT inert AND regexp_matches(line, '^[ \\t]*(?:[-*+]|[0-9]+[.)])(?:[ \\t]|$)')),
 br AS (SELECT id, n FROM fl WHERE NOT inert AND regexp_matches(line, '^\\S') AND NOT regexp_matches(line, '^[ \\t]*(?:[-*+]|[0-9]+[.)])(?:[ \\t]|$)')),
 iw AS MATERIALIZED (SELECT i.*, length(ws) + 3 * (length(ws) - length(replace(ws, chr(9), ''))) AS width, coalesce(b.n, 0) AS since FROM it i ASOF LEFT JOIN br b ON b.id = i.id AND i.n > b.n),
 ip AS MATERIALIZED (SELECT i.*, (SELECT max(p.n) FROM iw p WHERE p.id = i.id AND p.n < i.n AND p.n > i.since AND p.width < i.width) AS above FROM iw i),
 dp AS (SELECT id, n, 0 AS depth, NULL::BIGINT AS inside, task FROM ip WHERE above IS NULL UNION ALL SELECT i.id, i.n, d.depth + 1, CASE WHEN d.task THEN d.n ELSE d.inside END, i.task FROM dp d JOIN ip i ON i.id = d.id AND i.above = d.n),
 tk AS (SELECT i.id, i.n AS line, regexp_extract(i.line, '\\[(.)\\]', 1) AS status, rtrim(regexp_extract(i.line, '^[ \\t]*(?:[-*+]|[0-9]+[.)])[ \\t]+\\[.\\](?:[ \\t]+(.*))?$', 1)) AS text, d.depth AS indent, d.inside AS parent_line FROM ip i JOIN dp d ON d.id = i.id AND d.n = i.n WHERE i.task),
 tt AS (SELECT *, CASE status WHEN 'x' THEN 'done' WHEN 'X' THEN 'done' WHEN '-' THEN 'cancelled' ELSE 'open' END AS state, nullif(regexp_extract(text, '📅\\s*([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS due FROM tk)"""


def _task_rows(spark, d):
    rows = _current(spark, d).where(F.col("content").contains("[")).select("id", F.explode(M.tasks("content")).alias("t")).select("id", "t.*")
    return rows.select("id", "status", "state", "text", "due", *(F.col(c).cast("long").alias(c) for c in ("line", "indent", "parent_line")))


@query("e12_list_tasks", _TASKS + " SELECT id, status, state, text, due, line, indent, parent_line FROM tt WHERE state = 'open'")
def _(spark, d):
    return _task_rows(spark, d).where("state = 'open'")


# ---- rewrites -----------------------------------------------------------------------------------------------------


@query("m1_search_and_replace", LINES + """, rl AS (SELECT id, n, CASE WHEN inert THEN line ELSE regexp_replace(line, '(\\w+) kettle', 'kettle of \\1', 'g') END AS line, CASE WHEN inert THEN 0 ELSE len(regexp_extract_all(line, '(\\w+) kettle')) END AS k FROM fl)
 SELECT id, md5(string_agg(line, chr(10) ORDER BY n)) AS content, sum(k)::BIGINT AS n FROM rl GROUP BY id HAVING sum(k) > 0""")
def _(spark, d):
    got = rewrite.search_and_replace(_current(spark, d), r"(\w+) kettle", "kettle of $1", regex=True)
    return got.select("id", F.md5(F.regexp_replace("content", "\r\n", "\n")).alias("content"), F.col("n").cast("long").alias("n"))


_TAG_IN_TEXT = "(?:^|[\\s])#([A-Za-z][A-Za-z0-9_-]*)"


@query("m2_rename_tag", CUR + f""", ti AS (SELECT lower(unnest(regexp_extract_all(content, '{_TAG_IN_TEXT}', 1))) AS t FROM cur),
 tf AS (SELECT lower(regexp_extract(trim(unnest(CASE WHEN json_type(frontmatter, '$.tags') = 'ARRAY' THEN json_extract_string(frontmatter, '$.tags[*]') ELSE [json_extract_string(frontmatter, '$.tags')] END)), '^#?([A-Za-z][A-Za-z0-9_-]*)', 1)) AS t FROM cur WHERE json_valid(frontmatter)),
 best AS (SELECT i.t FROM (SELECT t, count(*) AS n FROM ti GROUP BY 1) i JOIN (SELECT t, count(*) AS n FROM tf GROUP BY 1) f USING (t) WHERE length(t) > 4 ORDER BY least(i.n, f.n) DESC, t LIMIT 1),
 pt AS (SELECT '(^|[\\s])#(?i:' || t || ')($|[^\\p{{L}}\\p{{N}}_-])' AS a, '(["\\s,\\[])(#?)(?i:' || t || ')([^\\p{{L}}\\p{{N}}_-])' AS b FROM best),
 sg AS (SELECT *, regexp_extract(frontmatter, '"tags": (\\[[^\\]]*\\]|"(?:[^"\\\\]|\\\\.)*")', 1) AS x, regexp_extract(frontmatter, '"tag": (\\[[^\\]]*\\]|"(?:[^"\\\\]|\\\\.)*")', 1) AS y, coalesce(json_valid(frontmatter), false) AS good FROM cur, pt),
 rn AS (SELECT *, regexp_replace(content, a, '\\1#cargo\\2', 'g') AS c, coalesce(len(regexp_extract_all(content, a)), 0) AS m, CASE WHEN good THEN len(regexp_extract_all(x, b)) + len(regexp_extract_all(y, b)) ELSE 0 END AS k,
   replace(replace(frontmatter, '"tags": ' || x, '"tags": ' || regexp_replace(x, b, '\\1\\2cargo\\3', 'g')), '"tag": ' || y, '"tag": ' || regexp_replace(y, b, '\\1\\2cargo\\3', 'g')) AS f FROM sg)
 SELECT id, md5(c) AS content, md5(CASE WHEN good THEN f ELSE frontmatter END) AS frontmatter, m + k AS n FROM rn WHERE m + k > 0""")
def _(spark, d):
    now = _current(spark, d)
    inline = now.select(F.explode(F.regexp_extract_all("content", F.lit(_TAG_IN_TEXT), F.lit(1))).alias("t")).groupBy(F.lower("t").alias("t")).agg(F.count("*").alias("i"))
    tag = F.lower(F.regexp_extract(F.trim("t"), "^#?([A-Za-z][A-Za-z0-9_-]*)", 1))
    v = X.valid_json("frontmatter")
    listed = F.coalesce(F.try_variant_get(v, "$.tags", "array<string>"), F.array(F.try_variant_get(v, "$.tags", "string")))
    front = now.select(F.explode(listed).alias("t")).groupBy(tag.alias("t")).agg(F.count("*").alias("f"))
    best = inline.join(front, "t").where("length(t) > 4").orderBy(F.desc(F.least("i", "f")), "t").select("t").first()
    got = rewrite.rename_tag_whole(now, best.t if best else "shipment", "cargo")
    return got.select("id", F.md5("content").alias("content"), F.md5("frontmatter").alias("frontmatter"), F.col("n").cast("long").alias("n"))


@query("m4_move_note", CUR + _INDEX_LINKS + ", asked AS (SELECT source_id, target AS raw FROM iy)" + _LINK_PATHS + """,
 best AS (SELECT target AS t FROM iy WHERE target <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 src AS (SELECT DISTINCT source_id FROM lp, best WHERE coalesce(path, '_stub/' || raw || '.md') IN (t || '.md', '_stub/' || t || '.md') AND source_id NOT IN (t || '.md', 'Moved/New place.md')),
 pat AS (SELECT '(!?\\[\\[)[ \t]*' || regexp_escape(t) || '(?:\\.md)?[ \t]*((?:[#^][^\\]|\n]+)?(?:\\|[^\\]\n]*)?\\]\\])' AS whole, '(!?\\[\\[)[ \t]*' || regexp_escape(string_split(t, '/')[-1]) || '[ \t]*((?:[#^][^\\]|\n]+)?(?:\\|[^\\]\n]*)?\\]\\])' AS bare, contains(t, '/') AS deep FROM best)
 SELECT id, md5(regexp_replace(CASE WHEN deep THEN regexp_replace(content, whole, '\\1Moved/New place\\2', 'g') ELSE content END, bare, '\\1New place\\2', 'g')) AS content,
   len(regexp_extract_all(content, bare)) + CASE WHEN deep THEN len(regexp_extract_all(content, whole)) ELSE 0 END AS n
 FROM cur, pat WHERE id IN (SELECT source_id FROM src) AND (regexp_matches(content, bare) OR deep AND regexp_matches(content, whole))""")
def _(spark, d):
    now = _current(spark, d)
    links_now = cut_lineage(vault.links_of(now).select("source_id", "target"))
    most = links_now.where("target != ''").groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(1).collect()
    got = rewrite.move_note(now, f"{most[0].target}.md" if most else "x.md", "Moved/New place.md", _resolved_links(now))
    return got.select("id", F.md5("content").alias("content"), F.col("n").cast("long").alias("n"))


# ---- incremental and streaming ------------------------------------------------------------------------------------


@query("j15_deleted", CUR + " SELECT path FROM sync_state WHERE path NOT IN (SELECT id FROM cur)")
def _(spark, d):
    return incremental.deleted(table(spark, d, "sync_state"), _current(spark, d).select(F.col("id").alias("path")))


@query("j16_to_index", CUR + " SELECT c.id AS path, epoch_us(c.mtime) // 1000 AS mtime FROM cur c LEFT JOIN (SELECT path, max(mtime) AS m FROM sync_state GROUP BY 1) s ON s.path = c.id WHERE s.m IS NULL OR s.m < epoch_us(c.mtime) // 1000")
def _(spark, d):
    disk = _current(spark, d).select(F.col("id").alias("path"), F.unix_millis(F.col("mtime").cast("timestamp")).alias("mtime"))
    return incremental.to_index(table(spark, d, "sync_state"), disk)


@query("j17_changed_chunks")
def _(spark, d):
    every = table(spark, d, "nodes")
    before = every.groupBy("id").agg(F.min_by("content", F.struct("loaded_at", "row_id")).alias("content"))
    return incremental.changed_chunks(incremental.chunk_rows(_current(spark, d)), incremental.chunk_rows(before)).select("id", "content_hash")


_EVENTS = "SELECT 'u/' || user_id || '.md' AS path, CASE event_type WHEN 'error' THEN 'removed' WHEN 'signup' THEN 'created' ELSE 'changed' END AS kind, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq FROM events"


def _file_events(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "removed").when(F.col("event_type") == "signup", "created").otherwise("changed")
    return e.select(F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("seq"))


@query("i2_debounce", f"""WITH e AS ({_EVENTS}), n AS (SELECT *, ts_ms + CASE WHEN kind = 'removed' THEN 3000 ELSE 5000 END AS due, lead(ts_ms) OVER (PARTITION BY path ORDER BY ts_ms, seq) AS nxt FROM e)
 SELECT path, CASE kind WHEN 'removed' THEN 'unlink' WHEN 'created' THEN 'add' ELSE 'change' END AS kind, due AS fired_ms FROM n WHERE nxt IS NULL OR nxt >= due""")
def _(spark, d):
    return debounce.debounced_batch(_file_events(spark, d))


@query("i4_newest", f"WITH e AS ({_EVENTS}) SELECT path, max(ts_ms) AS mtime FROM e GROUP BY 1")
def _(spark, d):
    return debounce.newest(_file_events(spark, d).withColumnRenamed("ts_ms", "mtime"))
