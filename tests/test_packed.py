import json

import pytest

from notefathom.operators import packed

CASES = [
    ("a,b ; c|d·e", False, ["a", "b", "c", "d", "e"]),
    ("a b\tc", True, ["a", "b", "c"]),
    ("a b\tc", False, ["a b", "c"]),
    ("，x、y；z", False, ["x", "y", "z"]),
    ('"a, b"; c', False, ["a, b", "c"]),
    ("'ridge, saer', its'x", False, ["ridge, saer", "its'x"]),
    ("harvest's-spice | #p/q", True, ["harvest's-spice", "p/q"]),
    ('the, "x ""final"" y"', False, ["the", 'x "final" y']),
    (r'"x \"final\" y", z', False, ['x "final" y', "z"]),
    ("«a, b», „c;d“", False, ["a, b", "c;d"]),
    ("[a, b]", False, ["a", "b"]),
    ('["a b", "c|d"]', True, ["a b", "c|d"]),
    ("[[A, x]], [[B|c]]", False, ["[[A, x]]", "[[B|c]]"]),
    ("[[A]] [[B]]", False, ["[[A]]", "[[B]]"]),
    ("[[[A]], [[B]]]", False, ["[[A]]", "[[B]]"]),
    ("- a\n- #b\r\n- 'c d'", True, ["a", "b", "c d"]),
    (", ,; ", False, []),
    ("", False, []),
    ("#a ##b", True, ["a", "#b"]),
    ("x" * 50_000 + ",y", False, ["x" * 50_000, "y"]),
]


@pytest.mark.parametrize(("text", "blanks", "values"), CASES)
def test_dialects(text, blanks, values):
    got = packed.candidates(text, blanks)
    assert got[0][:2] == (values, 0)


def _chosen(spark, texts: list[tuple[str, bool]]) -> dict:
    units = spark.createDataFrame([(i, [t], "tags" if b else "aliases") for i, (t, b) in enumerate(texts)], "unit long, texts array<string>, field string")
    return {(r.text, r.blanks): r for r in packed.cheapest(packed.parsed(units)).collect()}


def test_cheapest_of_several_dialects(spark):
    got = _chosen(spark, [(t, b) for t, b, _ in CASES])
    assert all(got[t, b].vals == v for t, b, v in CASES)
    assert sum(r.n_cands > 1 for r in got.values()) > len(CASES) / 2


def test_counts_decide_between_parses_without_exceptions(spark):
    text = "'tis, 'twas"
    assert [left for _, left, _ in packed.candidates(text, False)][:2] == [0, 0]
    alone = _chosen(spark, [(text, False)])
    assert alone[text, False].vals == ["tis,", "twas"]
    often = _chosen(spark, [(text, False), *((f"'tis, x{i}", False) for i in range(60)), *((f"'twas, y{i}", False) for i in range(60))])
    assert often[text, False].vals == ["'tis", "'twas"]


def test_a_mark_left_inside_never_pays(spark):
    # the whole text comes as one element in many texts, its parts in no other
    texts = [(f"Quay, Anton; n{i}", False) for i in range(80)]
    got = _chosen(spark, [*texts, ("Quay, Anton", False)])
    assert got["Quay, Anton", False].vals == ["Quay", "Anton"] and all(got[t].vals == ["Quay", "Anton", f"n{i}"] for i, t in enumerate(texts))


def test_open_quote_has_several_readings():
    got = packed.candidates('"a, b and "c" d', False)
    assert len(got) > 1 or got[0][1] > 0


def test_unpack(spark):
    fm = [
        (1, json.dumps({"tags": ["x, y", None, 2025, {"no": 1}, True], "tag": "#a b", "other": "c"})),
        (1, json.dumps({"tags": "dup"})),
        (2, '{"tags": "cut'), (3, ""), (4, None), (5, "[1]"), (6, '{"aliases": NaN}'),
        (7, json.dumps({"related": "[[A]] · [[B]]", "tags": "", "keywords": None})),
    ]
    nodes = spark.createDataFrame(fm, "row_id long, frontmatter string").selectExpr("*", "'clash' as val", "1 as pos", "2 as unit", "3 as field")
    records = spark.createDataFrame([(1, "p; q"), (2, None), (3, " ")], "record_id long, tags string")
    got = sorted(map(tuple, packed.unpack(nodes, records).collect()))
    assert got == sorted([
        ("nodes", 1, "tags", 0, "x"), ("nodes", 1, "tags", 1, "y"), ("nodes", 1, "tags", 2, "2025"), ("nodes", 1, "tags", 3, "true"),
        ("nodes", 1, "tag", 0, "a"), ("nodes", 1, "tag", 1, "b"), ("nodes", 1, "tags", 0, "dup"),
        ("nodes", 7, "related", 0, "[[A]]"), ("nodes", 7, "related", 1, "[[B]]"), ("note_records", 1, "tags", 0, "p"), ("note_records", 1, "tags", 1, "q"),
    ])


def test_code_lengths_decide_open_fields(spark):
    # the corpus knows "left" and "right side"; the stray quote is read so that they come out
    known = [(i, json.dumps({"keywords": ["left", "right side"]})) for i in range(50)]
    nodes = spark.createDataFrame([*known, (99, json.dumps({"keywords": 'left, "right side'}))], "row_id long, frontmatter string")
    got = packed.unpack(nodes, spark.createDataFrame([], "record_id long, tags string")).where("rec_id = 99").orderBy("pos").collect()
    assert got[0].val == "left" and len(got) == 2


def test_empty_tables(spark):
    assert packed.unpack(spark.createDataFrame([], "row_id long, frontmatter string"), spark.createDataFrame([], "record_id long, tags string")).count() == 0
