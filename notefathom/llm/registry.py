"""Queries of this subpackage by name and the SQL they are compared with."""

from __future__ import annotations

from . import bpe, mixing, neardup, pii, splitting

QUERIES = {
    "p3_found": neardup.p3_found,
    "p3_groups": neardup.p3_groups,
    "p5_found": splitting.p5_found,
    "p5_pieces": splitting.p5_pieces,
    "p6_ids": bpe.p6_ids,
    "p7_mixture": mixing.p7_mixture,
    "p7_shares": mixing.p7_shares,
    "p8_found": pii.p8_found,
    "p8_redacted": pii.p8_redacted,
    "p8_surrogates": pii.p8_surrogates,
}
#: Whole sets of word sequences, every pair that shares one.
NEAR = """WITH w AS (SELECT row_id, id, regexp_extract_all(lower(CASE WHEN coalesce(title, '') = '' THEN content ELSE title || ' ' || content END), '[\\p{L}\\p{N}]+') AS ws FROM nodes WHERE content IS NOT NULL),
 s AS (SELECT DISTINCT row_id, id, hash(ws[i], ws[i + 1], ws[i + 2]) AS h FROM w, range(1, len(ws) - 1) r(i) WHERE len(ws) >= 30), n AS (SELECT row_id, count(*) AS n FROM s GROUP BY 1),
 b AS (SELECT x.row_id AS a, y.row_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.row_id < y.row_id AND x.id IS DISTINCT FROM y.id GROUP BY 1, 2)
 SELECT a AS row_id_a, b AS row_id_b FROM b JOIN n p ON p.row_id = a JOIN n q ON q.row_id = b WHERE k / (p.n + q.n - k)::DOUBLE >= 0.7"""

_UNITS = "length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
CUTS = f"""SELECT row_id, CASE WHEN list_max(list_transform(regexp_extract_all(content, '[^ \\t\\r\\n]+'), lambda x: {_UNITS.format("x")})) > 2000 THEN 'forced' ELSE 'natural' END AS cut
 FROM nodes WHERE {_UNITS.format("content")} > 2000"""

ORACLE: dict[str, str] = {"p3_found": NEAR, "p5_found": CUTS}
