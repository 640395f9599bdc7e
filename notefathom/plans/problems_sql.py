"""Problems 2 (broken references) and 4 (nested objects) in SQL, written from their statements."""

from __future__ import annotations


def _key(column: str, stubs: bool) -> str:
    lead = r"(?:\.?/|\s)"
    path = rf"regexp_replace(nfc_normalize(trim(replace(url_decode({column}), chr(92), '/'))), '^{lead}+', '')"
    path = f"regexp_replace({path}, '^(?:_stub/{lead}*)+', '')" if stubs else path
    return f"CASE WHEN ends_with({path}, '.md') THEN {path} ELSE {path} || '.md' END"


_MARK = r"^ {0,3}(`{3,}[^`]*|~{3,}.*)$"
_HEAD = r"^(#{1,6})\s+(\S.*)$"
_BLOCK = r"(?:^|\s)\^([A-Za-z0-9-]+)\s*$"

FOUND = rf"""WITH RECURSIVE every AS (SELECT row_id, id, content, frontmatter, loaded_at, removed_at FROM nodes UNION ALL SELECT row_id, id, content, frontmatter, loaded_at, removed_at FROM library),
 state AS MATERIALIZED (SELECT {_key("id", False)} AS k, arg_max({{'gone': removed_at IS NOT NULL, 'c': content}}, (loaded_at, row_id)) AS last, min(loaded_at) AS first FROM every
  WHERE id IS NOT NULL AND NOT coalesce(CASE WHEN json_valid(frontmatter) THEN json_type(frontmatter, '$._stub') = 'BOOLEAN' AND json_extract_string(frontmatter, '$._stub') = 'true' END, false) GROUP BY 1),
 refs AS MATERIALIZED (SELECT 'edges' AS ref_table, CAST(id AS VARCHAR) AS ref_key, {_key("target_id", True)} AS k, strftime(seen_at, '%Y-%m') AS seen_month, loaded_at AS at, trim(target_subpath, ' ' || chr(9) || chr(10) || chr(13)) AS sub FROM edges WHERE target_id IS NOT NULL
  UNION ALL SELECT 'sync_state', path, {_key("path", True)}, strftime(make_timestamp(indexed_at * 1000), '%Y-%m'), NULL, NULL FROM sync_state WHERE path IS NOT NULL),
 ln AS MATERIALIZED (SELECT k, i AS n, ls[i] AS line FROM (SELECT k, string_split_regex(last.c, '\r\n|\n|\r') AS ls FROM state WHERE NOT last.gone AND last.c IS NOT NULL AND k IN (SELECT k FROM refs WHERE sub <> '')), range(1, len(ls) + 1) r(i)),
 fm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS j FROM (SELECT k, n, trim(line) AS bare, regexp_matches(line, '{_MARK}') AS opens FROM ln WHERE contains(line, '```') OR contains(line, '~~~'))),
 st AS (SELECT k, j, n, CASE WHEN opens THEN regexp_extract(bare, '^(`+|~+)') ELSE '' END AS fence FROM fm WHERE j = 1
  UNION ALL SELECT f.k, f.j, f.n, CASE WHEN s.fence <> '' THEN CASE WHEN length(f.bare) >= length(s.fence) AND trim(f.bare, s.fence[1]) = '' THEN '' ELSE s.fence END WHEN f.opens THEN regexp_extract(f.bare, '^(`+|~+)') ELSE '' END FROM st s JOIN fm f ON f.k = s.k AND f.j = s.j + 1),
 fl AS (SELECT l.k, l.n, l.line FROM ln l ASOF LEFT JOIN st a ON l.k = a.k AND l.n > a.n LEFT JOIN st b ON b.k = l.k AND b.n = l.n WHERE coalesce(a.fence, '') = '' AND coalesce(b.fence, '') = ''),
 hd AS MATERIALIZED (SELECT *, coalesce((SELECT min(g.n) FROM h0 g WHERE g.k = h0.k AND g.n > h0.n AND g.level <= h0.level), 1000000000) AS stop FROM h0),
 bk AS MATERIALIZED (SELECT DISTINCT k, regexp_extract(line, '{_BLOCK}', 1) AS block FROM fl WHERE regexp_matches(line, '{_BLOCK}')),
 sp AS MATERIALIZED (SELECT DISTINCT k, sub, list_filter(list_transform(string_split(sub, '#'), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))), lambda x: x <> '') AS parts FROM refs WHERE sub <> ''),
 wi AS (SELECT sp.k, sp.sub, sp.parts, 1 AS i, hd.n, hd.stop FROM sp JOIN hd ON hd.k = sp.k AND hd.name = sp.parts[1] UNION SELECT w.k, w.sub, w.parts, w.i + 1, hd.n, hd.stop FROM wi w JOIN hd ON hd.k = w.k AND hd.name = w.parts[w.i + 1] AND hd.n > w.n AND hd.n < w.stop),
 good AS (SELECT k, sub FROM wi WHERE i = len(parts) UNION SELECT sp.k, sp.sub FROM sp JOIN bk ON bk.k = sp.k AND bk.block = sp.sub)
 SELECT ref_table, ref_key, CASE ref_table WHEN 'edges' THEN 'target_id' ELSE 'path' END AS ref_field, CASE WHEN s.k IS NULL THEN 'missing' WHEN s.last.gone THEN 'deleted' ELSE 'late' END AS reason, seen_month
 FROM refs r LEFT JOIN state s ON s.k = r.k WHERE s.k IS NULL OR s.last.gone OR coalesce(s.first > r.at, false)
 UNION ALL SELECT ref_table, ref_key, 'target_subpath', 'no_anchor', seen_month FROM refs r JOIN state s ON s.k = r.k WHERE NOT s.last.gone AND sub <> '' AND NOT EXISTS (SELECT 1 FROM good g WHERE g.k = r.k AND g.sub = r.sub)""".replace(
    " hd AS MATERIALIZED", rf" h0 AS MATERIALIZED (SELECT k, n, length(regexp_extract(line, '{_HEAD}', 1)) AS level, lower(trim(regexp_replace(regexp_extract(line, '{_HEAD}', 2), '\s+', ' ', 'g'))) AS name FROM fl WHERE regexp_matches(line, '{_HEAD}')),"
    "\n hd AS MATERIALIZED", 1
)

REPORT = f"SELECT ref_table, ref_field, reason, seen_month, count(*) AS n FROM ({FOUND}) GROUP BY ALL"

_TEXT = "CASE WHEN json_type(v) = 'VARCHAR' AND coalesce(TRY(json_type(json_extract_string(v, '$'))) IN ('OBJECT', 'ARRAY'), false) THEN json_extract_string(v, '$')::JSON ELSE v END"

#: Each value of a frontmatter is taken apart one level a round; a string that is the JSON text of an object or list counts as that.
OBJECTS = f"""WITH RECURSIVE t AS (SELECT row_id, frontmatter::JSON AS j, '$' AS path, '$' AS above FROM nodes WHERE json_valid(frontmatter)
 UNION ALL SELECT row_id, {_TEXT} AS j, path || step, CASE WHEN kind = 'OBJECT' THEN path ELSE above END FROM (
  SELECT row_id, path, above, 'OBJECT' AS kind, '.' || e.key AS step, e.value AS v FROM (SELECT row_id, path, above, unnest(map_entries(CAST(j AS MAP(VARCHAR, JSON)))) AS e FROM t WHERE json_type(j) = 'OBJECT')
  UNION ALL SELECT row_id, path, above, 'ARRAY', '[' || (i - 1) || ']', l[i] FROM (SELECT row_id, path, above, CAST(j AS JSON[]) AS l FROM t WHERE json_type(j) = 'ARRAY'), range(1, len(l) + 1) r(i)))
 SELECT row_id, path AS obj_path, above AS parent_path FROM t WHERE json_type(j) = 'OBJECT' AND path <> '$'"""
