import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notefathom.plans import jsonlogic as J

FM = {"rating": 4, "n": "7", "list": [1, 2, "3"], "o": {"p": None, "q": [{"z": 1}, {"z": 3}]}, "b": True, "e": []}
DATA = [
    {"path": "a/b.md", "tags": ["area/work", "Book"], "size": 5, "title": "Abc", "frontmatter": json.dumps(FM)},
    {"path": "c.md", "tags": [], "size": 0, "title": None, "frontmatter": "{}"},
    {"path": "d.md", "tags": None, "size": None, "title": "", "frontmatter": '{"rating": "4", "list": "abc", "b": false, "n": ""}'},
    {"path": "e.md", "tags": ["x"], "size": 1, "title": "5", "frontmatter": "{bad"},
]
V = lambda p: {"var": p}
LOGIC = [
    {"==": [V("frontmatter.rating"), 4]}, {"===": [V("frontmatter.rating"), 4]}, {">": [V("frontmatter.rating"), 3]}, {"<": [1, V("size"), 6]}, {"has_tag": ["area"]}, {"has_tag": [V("tags"), "#book"]},
    {"in": ["b", V("title")]}, {"in": ["x", V("tags")]}, {"in": [2, V("frontmatter.list")]}, {"!": [V("frontmatter.e")]}, {"!!": [V("frontmatter.b")]}, {"and": [V("size"), V("title")]}, {"or": [V("title"), "else"]},
    {"if": [V("size"), "y", "n"]}, {"+": [V("frontmatter.n"), 1]}, {"-": [V("size")]}, {"/": [V("size"), 0]}, {"%": [7, V("size")]}, {"cat": ["<", V("title"), ">", V("size")]}, {"substr": [V("path"), -3]},
    {"substr": [V("path"), 1, -1]}, {"missing": ["title", "frontmatter.rating"]}, {"missing_some": [1, ["title", "size"]]}, {"min": [V("size"), 3]}, {"max": []}, {"merge": [[1], 2, V("tags")]},
    {"filter": [V("frontmatter.list"), {">": [V(""), 1]}]}, {"map": [V("frontmatter.list"), {"*": [V(""), 2]}]}, {"all": [V("tags"), {"!!": [V("")]}]}, {"none": [V("tags"), {"==": [V(""), "x"]}]},
    {"some": [V("frontmatter.o.q"), {"==": [V("z"), 3]}]}, {"reduce": [V("frontmatter.list"), {"+": [V("current"), V("accumulator")]}, 0]}, V("tags.0"), V("tags.length"), {"var": ["frontmatter.zz", "d"]},
    {"!=": [None, V("frontmatter.o.p")]}, {"==": ["", 0]}, {"==": [None, 0]}, {"==": [[1], "1"]}, {"!": ["0"]}, {"log": [V("path")]},
]


def record(d):
    try:
        return d | {"frontmatter": json.loads(d["frontmatter"])}
    except ValueError:
        return d | {"frontmatter": None}


def same(kind, n, s, b, j, e):
    if kind != J._kind(e) or b != J._truthy(e):
        return False
    if kind == "number":
        return n == e or math.isnan(n) and math.isnan(e)
    if kind == "string":
        return s == e
    return kind != "array" or json.loads(j) == json.loads(json.dumps(e))


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(DATA, "path string, tags array<string>, size long, title string, frontmatter string")


def check(frame, logics):
    c = J.Compiler(frame.schema)
    vals = [c.compile(x, c.column) for x in logics]
    rows = frame.select(*(getattr(v, f).alias(f"{f}{i}") for i, v in enumerate(vals) for f in "tnsbj")).collect()
    by_path = {d["path"]: record(d) for d in DATA}
    for r, d in zip(rows, DATA):
        for i, x in enumerate(logics):
            e = J.interpret(x, by_path[d["path"]])
            assert same(*(r[f"{f}{i}"] for f in "tnsbj"), e), (x, d["path"], e)


@pytest.mark.parametrize("at", range(0, len(LOGIC), 6))
def test_compiled_equals_interpreted(frame, at):
    check(frame, LOGIC[at : at + 6])


LEAF = st.sampled_from([V("size"), V("title"), V("tags"), V("frontmatter.rating"), V("frontmatter.n"), V("frontmatter.b"), 0, 4, "4", "", "b", True, None])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.recursive(LEAF, lambda s: st.builds(lambda op, a, b: {op: [a, b]}, st.sampled_from(["==", "===", "<", ">=", "and", "or", "!=", "-", "in"]), s, s), max_leaves=3), min_size=1, max_size=3))
def test_random_filters(frame, logics):
    check(frame, logics)


def test_unknown_operation(frame):
    with pytest.raises(J.UnknownOperation, match="Unrecognized operation nope"):
        J.compile_filter(frame, {"nope": [1]})
    with pytest.raises(ValueError, match="one operation"):
        J.compile_filter(frame, {"a": 1, "b": 2})


def test_filter_reaches_the_scan(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    frame.write.parquet(path)
    df = spark.read.parquet(path)
    df = df.where(J.compile_filter(df, {"==": [{"var": "path"}, "c.md"]}))
    assert [r.path for r in df.collect()] == ["c.md"]
