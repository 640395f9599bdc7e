import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notefathom.functions import markdown as M
from notefathom.functions import text as X
from pyspark.sql import functions as F


@pytest.mark.parametrize(("raw", "matter", "body"), [
    ("---\na: 1\n---\nbody", "a: 1\n", "body"), ("---\na: 1", "a: 1", ""), ("----\nx", None, "----\nx"), ("plain", None, "plain"), ("---\n---\nb", "", "b"), ("﻿---\na: 1\n---\nb", "a: 1\n", "b"),
])
def test_frontmatter(raw, matter, body):
    assert M.split_frontmatter(raw) == (matter, body)


def test_yaml_as_javascript_reads_it():
    fm = json.loads(M.parse_note("---\nd: 2024-01-02\nn: 0123\nm: 1:30\ny: yes\nt: true\nf: 1.50\nx: ~\nl: [a, 2]\n---\nb")["frontmatter"])
    assert fm == {"d": "2024-01-02T00:00:00.000Z", "n": 83, "m": 90, "y": "yes", "t": True, "f": 1.5, "x": None, "l": ["a", 2]}
    for bad in ("---\na: 1\na: 2\n---\nb", "---\na: [\n---\nb", "---\n- list\n---\nb"):
        assert M.parse_note(bad) == {"frontmatter": "{}", "content": bad}


def test_mask_keeps_positions():
    text = "a `[[x]]` b\n```\n[[y]]\n```\n[[z|w]] ![[e#h]] [[p^q]]\n~~~\nopen"
    masked = M.mask_code(text)
    assert len(masked) == len(text) and "x" not in masked and "y" not in masked and "open" not in masked
    got = M.find_links(text)
    assert [(x["embed"], x["target"], x["subpath"], x["alias"], x["line"]) for x in got] == [(False, "z", None, "w", 5), (True, "e", "h", None, 5), (False, "p", "^q", None, 5)]
    assert all(text[x["start"] : x["stop"]] == x["raw"] for x in got)


def test_tasks():
    text = "---\n- [ ] no\n---\n- [ ] a 📅 2024-01-01\n  - [x] b\n- plain\n  * [-] c\n1. [/] d\n```\n- [ ] no\n```\n\t- [?] e\r\n- [] no\n- [xx] no\n- [ ]"
    got = [(t["line"], t["status"], t["state"], t["text"], t["indent"], t["parent_line"], t["due"]) for t in M.find_tasks(text)]
    assert got == [(4, " ", "open", "a 📅 2024-01-01", 0, None, "2024-01-01"), (5, "x", "done", "b", 1, 4, None), (7, "-", "cancelled", "c", 1, None, None), (8, "/", "open", "d", 0, None, None), (12, "?", "open", "e", 1, 8, None), (15, " ", "open", "", 0, None, None)]


def test_parts():
    text = "# A\none\n## B\ntwo ^id1\n# C\n- item\n  more ^id2\n\npara\n\n^id3"
    assert M.read_part(text, heading="A > b") == "## B\ntwo ^id1"
    assert M.read_part(text, heading="A").endswith("^id1")
    assert M.read_part(text, block="id1") == "two ^id1"
    assert M.read_part(text, start=2, end=3) == "one\n## B"
    with pytest.raises(LookupError):
        M.read_part(text, heading="nope")


BLOCKS = st.lists(st.sampled_from(["para one two three.", "# Head", "## Sub", "```\ncode # no\n\nmore\n```", "$$\nx^2\n$$", "word " * 90, "日本語。" * 20]), min_size=1, max_size=12)


@settings(max_examples=100, deadline=None)
@given(BLOCKS)
def test_chunks(blocks):
    text = "\n\n".join(blocks)
    got = M.chunk(text, 250, 1)
    assert [c["chunk_index"] for c in got] == list(range(len(got)))
    for fence in ("```\ncode # no\n\nmore\n```", "$$\nx^2\n$$"):
        assert sum(c["content"].count(fence) for c in got) == text.count(fence)
    assert all(len(c["content"]) <= 250 or "```" in c["content"] or "$$" in c["content"] for c in got)
    assert all(len(c["content_hash"]) == 64 for c in got)


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("adjustment", "adjust"), ("rate", "rate"), ("controlling", "control"), ("été", "été")])
def test_porter(word, stem):
    assert M.porter(word) == stem


def test_columns(spark):
    df = spark.createDataFrame([("#a #b/c `#d` x#no #a\nk:: v one \r\nk:: w\n```\nz:: q\n```\n[[A#h|al]] ![[E]] [[B]]",), (None,), ("",)], "content string")
    r = df.select(M.inline_tags("content").alias("t"), M.inline_fields("content").alias("f"), M.index_links("content").alias("l"), M.file_links("content").alias("a")).collect()
    assert r[0].t == ["a", "b/c", "d"] and r[0].f == {"k": "v one"} and r[0].l == ["A#h", "B"] and r[0].a == ["A", "E", "B"]
    assert r[2].t == [] and r[1].a == []


def test_text_columns(spark):
    df = spark.createDataFrame([("🌱🌱ab", "A/b c.md"), ("", "x.md"), (None, None)], "t string, p string")
    r = df.select(X.utf16_length("t"), X.utf16_prefix("t", 3), X.basename("p"), X.stem("p"), X.dirname("p"), X.top_folder("p"), X.js_trim(F.lit("  a ")), X.heading_key(F.lit(" A  b "))).collect()
    assert tuple(r[0]) == (6, "🌱", "b c.md", "b c", "A", "A", "a", "a b") and r[1][5] == "(root)"
    names = ["b", "a", "B", "1", "_x", " y", "A"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.locale_key("n")).collect()]
    assert got == [" y", "_x", "1", "a", "A", "b", "B"]
    r = spark.range(1).select(X.tag_with_parents(F.lit("a/b/c")), X.distinct_ci(F.array(F.lit("x"), F.lit("X"), F.lit("y"))), X.iso_from_ms(F.lit(1)), X.cosine(X.vector([1, 0]), X.vector([0, 0]))).first()
    assert list(r) == [["a", "a/b", "a/b/c"], ["x", "y"], "1970-01-01T00:00:00.001Z", None]


def test_embedding():
    v = M.hashed_embedding("the kettle and the kettle river")
    assert abs(sum(x * x for x in v) - 1) < 1e-12 and M.hashed_embedding("") == M.hashed_embedding("Used for THE") == [1.0] + [0.0] * 63
    assert M.fnv1a("") == 0x811C9DC5 and M.fnv1a("a") == 0xE40C292C and M.fnv1a("foobar") == 0xBF9CF968
    assert M.mean_pool([[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]], [1, 1, 0]) == pytest.approx([2**-0.5, 2**-0.5])


TASK_TEXT = "- [ ] a\n-\n\t* [x] b 📅 2024-01-02 \r\n\t  1. [-] c\n- plain\n  - [/] d\nprose\n  + [ ] e\n```\n- [ ] no\n```\n١. [ ] no\n- [ ]\n-[ ] no"


def test_tasks():
    got = [(t["line"], t["state"], t["text"], t["indent"], t["parent_line"], t["due"]) for t in M.find_tasks(TASK_TEXT)]
    assert got == [
        (1, "open", "a", 0, None, None), (3, "done", "b 📅 2024-01-02", 1, None, "2024-01-02"), (4, "cancelled", "c", 2, 3, None),
        (6, "open", "d", 1, None, None), (8, "open", "e", 0, None, None), (13, "open", "", 0, None, None),
    ]


def test_a_lone_carriage_return_ends_no_line():
    assert [h["line"] for h in M.find_headings("a\r# no\n# yes\r\n# too")] == [2, 3]


def test_excerpt_counts_units(spark):
    r = spark.range(1).select(X.excerpt(F.lit("🌱" * 150)).alias("long"), X.excerpt(F.lit("🌱" * 100)).alias("short")).first()
    assert r.long == "🌱" * 100 + "..." and r.short == "🌱" * 100


def test_functions_in_sql(spark):
    from notefathom.functions.register import register

    assert "scan_tasks" in register(spark)
    spark.createDataFrame([("# H ^b\n- [x] done [[A#h|al]]",)], "content string").createOrReplaceTempView("some_notes")
    r = spark.sql("select scan_tasks(content)[0].state as s, scan_headings(content)[0].text as h, extract_links(content)[0].target as t, size(chunk_markdown(content)) as n, porter_tokens('running cats') as p from some_notes").first()
    assert (r.s, r.h, r.t, r.p) == ("done", "H ^b", "A", ["run", "cat"])
