import datetime as dt

import numpy as np
import pytest

from notefathom.operators import references as R

T0 = dt.datetime(2024, 5, 1)


@pytest.mark.parametrize(("written", "key"), [
    ("A/b.md", "A/b.md"), ("./A/b", "A/b.md"), ("/A\\b.md ", "A/b.md"), ("A%2Fb%20c", "A/b c.md"), ("_stub/A/b", "A/b.md"), ("./_stub\\A.md", "A.md"),
    ("Café.md", "Café.md"), ("a%zz", "a%zz.md"), ("%ff.md", "%ff.md"), ("a.MD", "a.MD.md"), (".hidden", ".hidden.md"), (" ./ /x", "x.md"),
])
def test_path_key(written, key):
    assert R.path_key(written) == key


def test_outline():
    text = "# One  two\r\n\r\ntext ^b-1\n```py\n# no ^no\n~~~\n```\n## Sub\n^alone\n~~~\n# never closed"
    assert R.outline(text) == [{"level": 1, "name": "one two"}, {"level": 0, "name": "b-1"}, {"level": 2, "name": "sub"}, {"level": 0, "name": "alone"}]
    o = R.outline("# A\n### B\n## C\n# D\n## B")
    there = lambda s: R.anchor_there(o, s)
    assert there("A#b") and there("a#C") and there("D#B") and there(" b ")
    assert not there("A#D") and not there("C#B") and not there("x")
    # a "#" in a subpath always joins, so a heading that holds one itself is reached by none
    assert not R.anchor_there(R.outline("## One # two\n# One"), "One # two") and R.anchor_there(R.outline("# One\n## Two"), "#One # two#")
    deep = R.outline("# A\n## B\n### C\n## D\n# B\n## C")
    assert R.anchor_there(deep, "A#B#C") and R.anchor_there(deep, "A#C") and not R.anchor_there(deep, "A#D#C") and not R.anchor_there(deep, "#")


def test_bitmaps_against_sets():
    rng = np.random.default_rng(1)
    for size, density in ((1, 1), (500, 0.5), (5000, 0.001), (5000, 0.9)):
        a, b = (np.flatnonzero(rng.random(size) < density) for _ in "ab")
        x, y = R.Bitmap(size, a), R.Bitmap(size, b)
        assert set(x.and_not(y).decode()) == set(a) - set(b)
        assert set(x.and_(y).decode()) == set(a) & set(b)


def tables(spark):
    nodes = [
        (1, "A.md", "# Top\ntext ^blk", "{}", T0, None), (2, "B.md", "old # x", None, T0, None), (3, "B.md", None, "{}", T0 + dt.timedelta(days=9), None),
        (4, "C.md", "c", '{"_stub": true}', T0, None), (5, "D.md", "d", "{bad", T0, None), (6, "D.md", "d", "{}", T0, T0), (7, "L.md", "l", '{"_stub": false}', T0 + dt.timedelta(days=60), None),
    ]
    edges = [
        (1, "A", None, T0, T0), (2, "_stub/A.md", "BLK", T0, T0), (3, "A.md", "blk", T0, T0), (4, "./A.md", " top ", T0, T0), (5, "B", "x", T0, T0),
        (6, "C.md", "q", T0, T0), (7, "D.md", "q", T0, T0), (8, "L.md", "q", T0, T0), (9, None, "q", T0, T0), (10, "nowhere", None, None, None), (11, "A.md", " ", T0, T0),
        *((100 + i, "hot missing", None, T0, T0) for i in range(300)),
    ]
    n = spark.createDataFrame(nodes, "row_id long, id string, content string, frontmatter string, loaded_at timestamp_ntz, removed_at timestamp_ntz").selectExpr("*", "'x' as key", "'y' as entries")
    e = spark.createDataFrame(edges, "id long, target_id string, target_subpath string, seen_at timestamp_ntz, loaded_at timestamp_ntz").selectExpr("*", "'x' as key", "1 as at")
    s = spark.createDataFrame([("A.md", 0, 1714521600000), ("nowhere.md", 0, 1714521600000), (" D", 0, None)], "path string, mtime long, indexed_at long")
    return e, s, n


def test_orphans(spark):
    e, s, n = tables(spark)
    got = sorted((r.ref_table, r.ref_key, r.ref_field, r.reason, r.seen_month or "") for r in R.orphan_references(e, s, n, None).collect())
    assert [g for g in got if len(g[1]) < 3 or not g[1].startswith(("1", "2", "3"))] == [
        ("edges", "10", "target_id", "missing", ""), ("edges", "2", "target_subpath", "no_anchor", "2024-05"), ("edges", "5", "target_subpath", "no_anchor", "2024-05"),
        ("edges", "6", "target_id", "missing", "2024-05"), ("edges", "7", "target_id", "deleted", "2024-05"), ("edges", "8", "target_id", "late", "2024-05"), ("edges", "8", "target_subpath", "no_anchor", "2024-05"),
        ("sync_state", " D", "path", "deleted", ""), ("sync_state", "nowhere.md", "path", "missing", "2024-05"),
    ]
    assert sum(g[1].startswith(("1", "2", "3")) and len(g[1]) == 3 for g in got) == 300


def test_empty(spark):
    e, s, n = (t.limit(0) for t in tables(spark))
    assert R.orphan_references(e, s, n, None).count() == 0
