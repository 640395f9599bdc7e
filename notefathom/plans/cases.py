"""Operators on single texts, as tables of literal cases: the query runs the operator on each input, the SQL lists the results by hand.

The results are stated from the descriptions of the operators; where an operator refuses an input, the case holds ``error``.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown as M
from ..functions import text as X
from ..operators import incremental, rewrite, search
from ..sources import vault
from ..streaming import debounce
from .queries import query


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _sql(expected: list[str | None]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_quoted(e)}::VARCHAR)" for i, e in enumerate(expected)) + ") t(n, got)"


def columns(name: str, fn: Callable[[Column], Column], cases: list[tuple[str | None, str | None]]) -> None:
    """Cases of a column function of one text."""

    def run(spark, _):
        rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "n long, x string")
        return rows.select("n", fn(F.col("x")).cast("string").alias("got"))

    query(name, _sql([e for _, e in cases]))(run)


def texts(name: str, fn: Callable, cases: list[tuple[tuple, str | None]]) -> None:
    """Cases of a function of plain arguments; its result as text, lists and objects as JSON."""

    def told(args: tuple) -> str | None:
        try:
            got = fn(*args)
        except Exception:
            return "error"
        return got if got is None or isinstance(got, str) else json.dumps(got, ensure_ascii=False)

    def run(spark, _):
        @F.arrow_udf(T.StringType())
        def out(numbers: pa.Array) -> pa.Array:
            return pa.array([told(cases[n][0]) for n in numbers.to_pylist()], pa.string())

        return spark.range(len(cases)).select(F.col("id").alias("n"), out("id").alias("got"))

    query(name, _sql([e for _, e in cases]))(run)


# ---- reading notes ------------------------------------------------------------------------------------------------

_NOTE = "---\ntitle: A b\ntags: [x, 2]\nwhen: 2024-05-01\nn: 1.5\n---\n# Body\n"
texts("e1_frontmatter", lambda t: M.parse_note(t)["frontmatter"], [
    ((_NOTE,), '{"title": "A b", "tags": ["x", 2], "when": "2024-05-01T00:00:00.000Z", "n": 1.5}'), (("no matter",), "{}"), (("---\na: [\n---\nx",), "{}"), (("---\n- a\n---\nx",), "{}"),
    (("---\n---\nx",), "{}"), (("---\na: 1\nnever closed",), "{}"), (("",), "{}"), ((None,), "{}"), (("---\na: yes\nb: ~\n---\n",), '{"a": "yes", "b": null}'),
])
texts("e2_parse_note", lambda t: M.parse_note(t)["content"], [((_NOTE,), "# Body\n"), (("plain",), "plain"), (("---\na: [\n---\nx",), "---\na: [\n---\nx"), (("",), ""), ((None,), None)])
columns("e6_inline_tag_cases", lambda x: F.array_join(M.inline_tags(x), "|"), [("#a #b/c x#d `#e` #1 #a-b_c", "a|b/c|e|a-b_c"), ("", ""), ("##x", "x"), ("é#f", "f")])
columns("e9_chunk_text", lambda x: M.chunk_text(F.nullif(F.split(x, r"\|")[0], F.lit("")), F.split(x, r"\|")[1]), [("Head|body text", "Head\n\nbody text"), ("|only", "only")])
columns("e9_note_text", lambda x: M.note_text(F.lit("T"), F.array(F.lit("a"), F.lit("b")), x), [("# H\n\nfirst para\n\nsecond", "T\na b\nfirst para"), ("# H", "T\na b")])

texts("e9_fallback_text", M.fallback_text, [
    (("Title", '{"tags": ["a", 5, "b"], "status": " open ", "n": 3, "ok": true, "_x": 1, "l": [1], "z": null}', "![[p.png|9]] [[q#h]] [[ ]]"), "Title\na, b\nstatus: open\nn: 3\nok: true\nLinks: p.png, q"),
    (("", "{}", ""), ""), (("ab", None, None), ""), (("abc", "{bad", "[[a]][[b]][[c]][[d]][[e]][[f]]"), "abc\nLinks: a, b, c, d, e"),
])

_PART = "# A\none\n## B\ntwo ^id1\n# C\n- item\n  more ^id2\n\npara\n\n^id3\n## B\nlast"
texts("e13_read_part", lambda how: M.read_part(_PART, **how), [
    (({"heading": "A > B"},), "## B\ntwo ^id1"), (({"heading": "a"},), "# A\none\n## B\ntwo ^id1"), (({"heading": "B"},), "error"), (({"heading": "none"},), "error"), (({"start": 2, "end": 3},), "one\n## B"),
    (({"start": 12},), "## B\nlast"), (({"block": "id1"},), "two ^id1"), (({"block": "id3"},), "para\n\n^id3"), (({"block": "x"},), "error"),
])
texts("e13_outline", lambda t: [[h["line"], h["level"], h["text"], h["end"]] for h in M.sections(t)], [
    (("# A\nx\n## B\n# C #\n",), '[[1, 1, "A", 3], [3, 2, "B", 3], [4, 1, "C", 5]]'), (("```\n# no\n```",), "[]"), (("",), "[]"), (("#no\n   ### yes\n    # no",), '[[2, 3, "yes", 3]]'),
])
texts("e14_attachment_targets", M.attachment_targets, [
    (("![[a.png|100]] [[n#h]] [t](b%20c.pdf?x#y) [u](https://e.test/x.png) ![](<d.jpg>) `[[no.png]]`",), '["a.png", "n", "b c.pdf", "d.jpg"]'), (("",), "[]"), (("[[#own]] [m](mailto:x@y.test)",), "[]"),
])
columns("e15_fragment", lambda x: F.concat_ws("|", M.fragment(x)[0], F.coalesce(M.fragment(x)[1], F.lit("-"))), [("A", "A|-"), ("A#h", "A|h"), ("A#h#i", "A|h#i"), ("A#^b", "A|^b"), ("A^b", "A|^b"), ("#h", "|h")])
texts("e16_hashed_embedding", lambda t: M.hashed_embedding(t, 8), [
    (("a",), "[1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]"), (("Foobar foobar",), "[1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]"), (("b",), "[0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0]"),
    (("c the USED for",), "[0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]"), (("",), "[1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]"),
])
texts("e17_mean_pool", M.mean_pool, [
    (([[3.0, 0.0], [3.0, 8.0], [9.0, 9.0]], [1, 1, 0]), "[0.6, 0.8]"), (([[1.0, 2.0]], [0]), "[0.0, 0.0]"), (([[0.0, 2.0]], [1]), "[0.0, 1.0]"), (([], []), "[]"),
])
texts("e18_bookmarks", lambda t: [[b["type"], b["title"], b["path"], b["group"]] for b in vault._bookmarks(t)], [
    (('{"items": [{"type": "file", "path": "a.md", "title": "A"}, {"type": "group", "title": "G", "items": [{"type": "search", "query": "q"}, {"type": "group", "title": "H", "items": [{"type": "file", "path": "b.md"}]}]}]}',),
     '[["file", "A", "a.md", ""], ["group", "G", null, ""], ["search", null, "q", "G"], ["group", "H", null, "G"], ["file", null, "b.md", "G/H"]]'),
    (("{bad",), "[]"), (("[]",), "[]"), (("{}",), "[]"),
])
texts("a13_bookmark_count", lambda t: sum(b["type"] != "group" for b in vault._bookmarks(t)), [
    (('{"items": [{"type": "file", "path": "a.md"}, {"type": "group", "items": [{"type": "file", "path": "b.md"}]}]}',), "2"), (("{}",), "0"),
])
texts("e19_read_canvas", vault.read_canvas, [
    (("",), '{"nodes": [], "edges": []}'), (('{"nodes": [{"id": "a"}]}',), '{"nodes": [{"id": "a"}], "edges": []}'), (('{"nodes": 1}',), "error"), (("{",), "error"), (('{"x": 1}',), '{"x": 1, "nodes": [], "edges": []}'),
])
texts("s12_write_canvas", lambda t: vault.write_canvas(vault.read_canvas(t)), [(("",), '{\n\t"nodes": [],\n\t"edges": []\n}'), (('{"nodes":[{"id":"a"}],"k":1}',), '{\n\t"nodes": [\n\t\t{"id": "a"}\n\t],\n\t"edges": [],\n\t"k": 1\n}')])
_CANVAS = {"nodes": [{"id": "a", "x": 0, "width": 100}, {"id": "b"}], "edges": [{"id": "e", "fromNode": "a", "toNode": "b"}]}
texts("m11_edit_canvas", lambda op, how: (lambda d: [[n["id"] for n in d["nodes"]], [e["id"] for e in d["edges"]], d["nodes"][-1].get("x")])(vault.edit_canvas(_CANVAS, op, **how)), [
    (("add_node", {"id": "c"}), '[["a", "b", "c"], ["e"], 140]'), (("add_node", {"id": "a"}), "error"), (("update_node", {"id": "b", "x": 7}), '[["a", "b"], ["e"], 7]'), (("update_node", {"id": "z"}), "error"),
    (("delete_node", {"id": "b"}), '[["a"], [], 0]'), (("delete_node", {"id": "z"}), "error"), (("connect", {"id": "f", "fromNode": "b", "toNode": "a"}), '[["a", "b"], ["e", "f"], null]'),
    (("connect", {"id": "f", "fromNode": "b", "toNode": "z"}), "error"), (("disconnect", {"id": "e"}), '[["a", "b"], [], null]'), (("turn", {}), "error"),
])

# ---- tasks and blocks ---------------------------------------------------------------------------------------------

_LIST = "- [ ] a\n-\n\t* [x] b 📅 2024-01-02 \r\n\t  1. [-] c\n- plain\n  - [/] d\nprose\n  + [ ] e\n```\n- [ ] no\n```\n- [ ]\n-[ ] no"
texts("e12_task_cases", lambda t: [[x["line"], x["state"], x["text"], x["indent"], x["parent_line"], x["due"]] for x in M.find_tasks(t)], [
    ((_LIST,), '[[1, "open", "a", 0, null, null], [3, "done", "b 📅 2024-01-02", 1, null, "2024-01-02"], [4, "cancelled", "c", 2, 3, null], [6, "open", "d", 1, null, null], [8, "open", "e", 0, null, null], [12, "open", "", 0, null, null]]'),
    (("",), "[]"), (("1) [X] n\n   - [?] m",), '[[1, "done", "n", 0, null, null], [2, "open", "m", 1, 1, null]]'),
])
texts("m10_set_task_status", rewrite.set_task_status, [
    (("x\n- [ ] a\r\n", 2, "x"), "x\n- [x] a\r\n"), (("x\n- [ ] a", 1, "x"), "error"), (("- [ ] a", 1, "-", "a"), "- [-] a"), (("- [ ] a", 1, "-", "b"), "error"), (("- [ ] a", 9, "x"), "error"),
])
texts("m10_ensure_block_id", lambda t, n, b: list(rewrite.ensure_block_id(t, n, b)), [
    (("a\nb  \n", 2, "k"), '["a\\nb ^k\\n", "k"]'), (("a ^old", 1, "k"), '["a ^old", "old"]'), (("a\nb ^k", 1, "k"), "error"),
])

# ---- edits --------------------------------------------------------------------------------------------------------

_TEXT = "---\na: 1\ntags:\n  - x\n---\n# H\none\n## I\ntwo\n# J"
texts("m5_edit", lambda mode, content, how: rewrite.edit(_TEXT, mode, content, **how), [
    (("append", "z", {}), _TEXT + "\nz"), (("prepend", "z", {}), _TEXT.replace("# H\n", "z\n# H\n")), (("replace_window", "z", {"search": "one"}), _TEXT.replace("one", "z")),
    (("replace_window", "z", {"search": "#"}), "error"), (("replace_window", "z", {"search": "ane"}), "error"), (("replace_window", "z", {"search": "onne", "fuzzy": 0.7}), _TEXT.replace("one", "z")),
    (("patch_heading", "z", {"heading": "h"}), _TEXT.replace("one\n## I\ntwo", "z")), (("patch_heading", "z", {"heading": "H", "scope": "body"}), _TEXT.replace("one", "z")),
    (("patch_heading", "z", {"heading": "I", "op": "before"}), _TEXT.replace("## I", "z\n## I")), (("patch_heading", "z", {"heading": "I", "op": "after"}), _TEXT.replace("two", "two\nz")), (("patch_heading", "z", {"heading": "no"}), "error"),
    (("patch_frontmatter", "", {"key": "a", "value": 2}), _TEXT.replace("a: 1", "a: 2")), (("patch_frontmatter", "", {"key": "b", "value": ["p", "q"]}), _TEXT.replace("  - x\n", "  - x\nb: [p, q]\n")),
    (("at_line", "z", {"line": 7}), _TEXT.replace("one", "z")), (("at_line", "z", {"line": 7, "op": "after"}), _TEXT.replace("one", "one\nz")), (("at_line", "z", {"line": 99}), "error"),
    (("append", "z", {"expected": "other"}), "error"), (("turn", "z", {}), "error"),
])
texts("m5_edit_batch", lambda edits: rewrite.edit_batch("a\nb", edits), [
    (([{"mode": "append", "content": "c"}, {"mode": "at_line", "line": 3, "content": "d"}],), "a\nb\nd"), (([],), "a\nb"), (([{"mode": "append", "content": "c"}, {"mode": "at_line", "line": 9, "content": "d"}],), "error"),
])


def _previews(most: int, seconds: float, steps: list) -> list:
    held, out = rewrite.Previews(most, seconds), []
    for name, at, current in steps:
        try:
            out.append(held.put(name, f"{name}.md", "old", "new", at) if current is None else list(held.take(name, current, at)))
        except Exception as e:
            out.append(type(e).__name__)
    return out


texts("m6_previews", _previews, [
    ((2, 300.0, [("a", 0, None), ("a", 10, "old"), ("a", 11, "old")]), '[null, ["a.md", "new"], "KeyError"]'),
    ((2, 300.0, [("a", 0, None), ("b", 1, None), ("c", 2, None), ("a", 3, "old"), ("c", 3, "old")]), '[null, null, null, "KeyError", ["c.md", "new"]]'),
    ((2, 300.0, [("a", 0, None), ("a", 301, "old")]), '[null, "LookupError"]'), ((2, 300.0, [("a", 0, None), ("a", 1, "changed")]), '[null, "ValueError"]'),
])
texts("m7_update_properties", rewrite.update_properties, [
    ((_TEXT, {"a": 5}), _TEXT.replace("a: 1", "a: 5")), ((_TEXT, None, ["tags"]), _TEXT.replace("tags:\n  - x\n", "")), (("body", {"k": "v w"}), "---\nk: v w\n---\nbody"), (("body", None, ["k"]), "body"),
])
_AT = datetime.datetime(2024, 5, 6, 7, 8, 9)
texts("m8_render_template", lambda t: vault.render_template(t, "My note", _AT, {"who": "Ada"}), [
    (("# {{title}} {{date}} {{time}}",), "# My note 2024-05-06 07:08"), (("{{date:YYYY/MM/DD dddd [at] H:mm}}",), "2024/05/06 Monday at 7:08"), (("{{who}} {{ nobody }}",), "Ada {{ nobody }}"), (("",), ""),
])
texts("m9_link_notes", rewrite.link_notes, [(("a\n\n", "X/Y.md", "see"), "a\n\nsee [[X/Y]]\n"), (("", "Z", "c"), "\n\nc [[Z]]\n")])
texts("m12_diff", rewrite.diff, [(("a\nb\n", "a\nc\n"), "--- note\n+++ note\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n"), (("same", "same"), "")])


def _rename_heading(spark, _):
    rows = [("A.md", "# Old\nx [[#Old]]\n## Other"), ("B.md", "[[A#Old|a]] [[A#old]] [[C#Old]] `[[A#Old]]`"), ("C.md", "# Old")]
    got = rewrite.rename_heading(spark.createDataFrame(rows, "id string, content string"), "A.md", "old", "New")
    return got.select("id", "content", F.col("n").cast("long").alias("n"))


query("m3_rename_heading", "SELECT * FROM (VALUES ('A.md', '# New' || chr(10) || 'x [[#Old]]' || chr(10) || '## Other', 1::BIGINT), ('B.md', '[[A#New|a]] [[A#New]] [[C#Old]] `[[A#Old]]`', 2::BIGINT)) t(id, content, n)")(_rename_heading)

# ---- guards and hints ---------------------------------------------------------------------------------------------

texts("f11_safe_pattern", search.safe_pattern, [(("a+b",), "a+b"), (("(a+)+",), "error"), (("(?<x>a)",), "(?<x>a)"), (("(",), "error"), (("a" * 501,), "error")])
texts("f12_escape_query", search.escape_query, [(("plain words",), "plain words"), (('say "hi"',), '"say ""hi"""'), (("a-b",), '"a-b"'), (("pre*",), "pre*")])
texts("q7_simplified", search.simplified, [(("how to fix the kettle in town",), "fix kettle town"), (("kettle",), None), (("the of",), None)])
columns("q1_snippet", lambda x: search.snippet(x, ["kettle"], 8), [("one two  three four kettle five six seven eight nine", "...three four >>>kettle<<< five six seven eight nine"), ("kettle a", ">>>kettle<<< a"), ("Kettles a KETTLE b", "Kettles a >>>KETTLE<<< b")])

# ---- incremental and streaming ------------------------------------------------------------------------------------


def _budget(steps: str) -> list[int]:
    b, out = incremental.Budget(), []
    for step in steps:
        if step == "f":
            b.failed()
        elif step == "r":
            b.reset()
        out.append(b.chars)
    return out


texts("i7_budget", _budget, [(("-",), "[1150]"), (("-ffr",), "[1150, 575, 575, 1150]")])
texts("i9_compatibility", lambda old, new, notes, chunks: sorted(incremental.compatibility(old, new, notes, chunks)), [
    (({"layout": 1}, {"layout": 2}, 1, 1), '["all"]'), (({"model": "a"}, {"model": "b"}, 1, 1), '["embeddings"]'), (({"tokenizer": "a"}, {"tokenizer": "b"}, 1, 1), '["text"]'), (({}, {}, 3, 0), '["embeddings"]'), (({}, {}, 0, 0), "[]"),
    (({"weights": 1, "tokenizer": 1}, {"weights": 2, "tokenizer": 2}, 1, 1), '["embeddings", "text"]'),
])
texts("i3_classified", debounce.classified, [(("removed",), "unlink"), (("created",), "add"), (("changed",), "change")])


def _wanted(spark, _):
    paths = ["a.md", "x/b.md", "x/b.txt", ".settings/c.md", "node_modules/d.md", "e/attachments/f.md", ".trash/g.md", "h.MD"]
    return debounce.wanted(spark.createDataFrame([(p,) for p in paths], "path string"))


query("i1_wanted", "SELECT * FROM (VALUES ('a.md'), ('x/b.md')) t(path)")(_wanted)

def _single_pass(removed: bool):
    def run(spark, _):
        notes = spark.createDataFrame([("A.md", "A", "x", "{}"), ("B.md", "B", "old", "{}")], "id string, title string, content string, frontmatter string")
        edges = spark.createDataFrame([("A.md", "_stub/C.md", "c"), ("B.md", "A.md", "b"), ("A.md", "B.md", "d")], "source_id string, target_id string, context string")
        sync = spark.createDataFrame([("A.md", 1), ("B.md", 1), ("x/D.md", 1)], "path string, mtime long")
        file = spark.createDataFrame([("B.md" if removed else "C.md", 2, "see [[A]] and [[D]]\n\n[[nowhere]]")], "path string, mtime long, raw string")
        n, e, s = incremental.single_pass(notes, edges, sync, file, removed)
        return n.select(F.lit("note").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b")).union(e.select(F.lit("edge"), "source_id", "target_id")).union(s.select(F.lit("sync"), "path", F.col("mtime").cast("string")))

    return run


query("i6_single_write", """SELECT * FROM (VALUES ('note', 'A.md', ''), ('note', 'B.md', ''), ('note', 'C.md', ''), ('edge', 'A.md', 'C.md'), ('edge', 'B.md', 'A.md'), ('edge', 'A.md', 'B.md'), ('edge', 'C.md', 'A.md'), ('edge', 'C.md', 'x/D.md'), ('edge', 'C.md', '_stub/nowhere.md'),
 ('sync', 'A.md', '1'), ('sync', 'B.md', '1'), ('sync', 'x/D.md', '1'), ('sync', 'C.md', '2')) t(kind, a, b)""")(_single_pass(False))
query("i6_single_remove", "SELECT * FROM (VALUES ('note', 'A.md', ''), ('edge', 'A.md', '_stub/C.md'), ('edge', 'A.md', '_stub/B.md'), ('sync', 'A.md', '1'), ('sync', 'x/D.md', '1')) t(kind, a, b)")(_single_pass(True))

# ---- scalar functions ---------------------------------------------------------------------------------------------

columns("fn_number_to_string", lambda x: X.number_to_string(x.cast("double")), [
    ("1", "1"), ("-0", "0"), ("0.1", "0.1"), ("1e21", "1e+21"), ("123456789012345680000", "123456789012345680000"), ("1e-6", "0.000001"), ("1.5e-7", "1.5e-7"), ("-12.50", "-12.5"), ("1e300", "1e+300"), ("NaN", "NaN"), ("-Infinity", "-Infinity"),
    ("123.456", "123.456"), ("100", "100"), ("5e-324", "5e-324"), ("1.7976931348623157e308", "1.7976931348623157e+308"),
])
columns("fn_parse_int", X.parse_int, [("42", "42"), (" -7x", "-7"), ("+8", "8"), ("x", None), ("", None), ("1.9", "1"), ("99999999999999999999", None), (None, None), ("+-3", None)])
columns("fn_js_number", lambda x: F.when(F.isnan(X.js_number(x)), "NaN").otherwise(X.number_to_string(X.js_number(x))), [("", "0"), (" 12 ", "12"), ("1e3", "1000"), ("abc", "NaN"), ("1,5", "NaN"), ("-.5", "-0.5")])
columns("fn_posix_normalize", X.posix_normalize, [("", "."), ("a//b/./c", "a/b/c"), ("a/../b", "b"), ("../a", "../a"), ("/../a", "/a"), ("a/b/", "a/b/"), ("/", "/"), ("a/..", "."), ("./", "./"), ("a/../../b", "../b"), ("/a/b/../", "/a/")])
columns("fn_js_object_order", lambda x: F.array_join(X.js_object_order(F.split(x, ",")), ","), [("b,10,a,2,01,0", "0,2,10,b,a,01"), ("x", "x"), ("4294967294,4294967295", "4294967294,4294967295"), ("-1,1", "1,-1")])
columns("fn_clip", lambda x: X.clip(x, F.locate("K", x) - 1, 8), [("short K", "short K"), ("0123456789K123456789", "…89K12345…"), ("K23456789", "K2345678…"), ("12345678K", "…2345678K")])
columns("fn_utf16", lambda x: F.concat_ws("|", X.utf16_length(x).cast("string"), X.utf16_prefix(x, 3)), [("abcd", "4|abc"), ("🌱🌱", "4|🌱"), ("", "0|"), ("a🌱b", "4|a🌱")])
columns("fn_js_trim", lambda x: F.concat(F.lit("["), X.js_trim(x), F.lit("]")), [("  a b﻿\n", "[a b]"), (" x　", "[x]"), ("", "[]")])
columns("fn_tag_with_parents", lambda x: F.array_join(X.tag_with_parents(x), " "), [("a/b/c", "a a/b a/b/c"), ("a", "a")])
columns("fn_heading_key", X.heading_key, [("  A  b\tC ", "a b c"), ("x", "x")])
columns("fn_short_hash", X.short_hash, [("abc", "ba7816bf8f01cfea"), ("", "e3b0c44298fc1c14")])
columns("fn_sha256", X.sha256_hex, [("abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")])
columns("fn_iso_from_ms", lambda x: X.iso_from_ms(x.cast("long")), [("0", "1970-01-01T00:00:00.000Z"), ("1714979289123", "2024-05-06T07:08:09.123Z"), ("-1", "1969-12-31T23:59:59.999Z")])
texts("fn_format_date", lambda p: vault.format_date(_AT, p), [(("YYYY-MM-DD HH:mm:ss",), "2024-05-06 07:08:09"), (("D/M/YY Q [Q]",), "6/5/24 2 Q"), (("ddd MMM W",), "Mon May 19")])


def _utf16_order(spark, _):
    rows = spark.createDataFrame([(c,) for c in ("！", "🌱", "a", "é", "B")], "x string")
    first = rows.agg(F.sort_array(F.collect_list(F.struct(X.utf16_key("x").alias("k"), "x"))).alias("l"))
    return first.select(F.posexplode("l").alias("n", "e")).select(F.col("n").cast("long").alias("n"), F.col("e.x").alias("got"))


query("o7_utf16_order", _sql(["B", "a", "é", "🌱", "！"]))(_utf16_order)
columns("fn_stem", lambda x: F.concat_ws("|", X.basename(x), X.stem(x), X.dirname(x), X.top_folder(x)), [("A/b c.md", "b c.md|b c|A|A"), ("x.md", "x.md|x||(root)"), ("A/B/c", "c|c|A/B|A")])


def _vectors(spark, _):
    v = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("a"), F.array(F.lit(0.0), F.lit(4.0)).alias("b"), F.array(F.lit(0.0), F.lit(0.0)).alias("z"))
    return v.select(X.l2_norm(F.col("a")).alias("norm"), X.l2_distance(F.col("a"), F.col("b")).alias("distance"), X.cosine(F.col("a"), F.col("b")).alias("cosine"), X.cosine(F.col("a"), F.col("z")).alias("none"))


query("fn_vectors", "SELECT 5.0::DOUBLE AS norm, 3.0::DOUBLE AS distance, 0.8::DOUBLE AS cosine, NULL::DOUBLE AS none")(_vectors)
