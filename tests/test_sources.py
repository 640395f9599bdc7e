import base64
import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from notefathom.operators import incremental
from notefathom.session import cut_lineage, discard, shared_folder
from notefathom.sources import vault
from notefathom.streaming import debounce


@pytest.fixture
def root(tmp_path):
    files = {"A.md": "---\ntitle: Alpha\n---\nsee [[B|b]] and [[C#h]]", "sub/B é.md": "x", "sub/.hidden/N.md": "x", ".settings/t.md": "x", "attachments/q.md": "x", "img/p.PNG": "1234", "z.txt": "1"}
    for k, v in files.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(v)
    return str(tmp_path)


def test_vault(spark, root):
    files = vault.read_vault(spark, root)
    assert sorted(r.path for r in files.collect()) == ["A.md", "sub/B é.md"]
    notes = incremental.parse(files)
    assert {r.id: (r.title, r.content) for r in notes.collect()}["A.md"] == ("Alpha", "see [[B|b]] and [[C#h]]")
    got = [(r.pos, r.raw, r.target, r.subpath, r.context) for r in vault.links_of(notes).orderBy("pos").collect()]
    assert got == [(0, "B", "B", None, "see b and C#h"), (1, "C#h", "C", "h", "see b and C#h")]
    assert sorted((r.path, r.extension, r.size) for r in vault.attachments(spark, root).collect()) == [("img/p.PNG", "png", 4), ("z.txt", "txt", 1)]


def test_writing(root):
    assert vault.create_note(root, "New: note", "body", "sub", {"k": [1]}) == "sub/New- note.md"
    assert vault.file_info(root, "sub/New- note.md")["kind"] == "note"
    with pytest.raises(FileExistsError):
        vault.create_note(root, "New: note", "again", "sub")
    for bad in ("../x.md", ".settings/x.md", "/etc/x"):
        with pytest.raises(PermissionError):
            vault.write_note(root, bad, "x")
    assert vault.create_attachment(root, "a/b.bin", base64.b64encode(b"123").decode()) == 3
    with pytest.raises(ValueError):
        vault.create_attachment(root, "a/c.bin", "***")
    assert vault.create_folder(root, "f/g") and not vault.create_folder(root, "f/g")
    with pytest.raises(OSError):
        vault.delete_folder(root, "f")
    assert vault.delete_folder(root, "f", recursive=True) == {"files": 0, "folders": 2, "notes": 0}


def test_templates():
    at = dt.datetime(2024, 3, 5, 14, 7)
    assert vault.render_template("{{title}} {{date}} {{date:D MMM [of] YYYY}} {{time}} {{who}} {{no}}", "T", at, {"who": "me"}) == "T 2024-03-05 5 Mar of 2024 14:07 me {{no}}"


def test_canvas():
    doc = vault.read_canvas("")
    for i in "ab":
        doc = vault.edit_canvas(doc, "add_node", id=i, type="text", text=i)
    doc = vault.edit_canvas(doc, "connect", id="e", fromNode="a", toNode="b")
    assert vault.read_canvas(vault.write_canvas(doc)) == doc and doc["nodes"][1]["x"] == 440
    assert vault.edit_canvas(doc, "delete_node", id="a")["edges"] == []
    with pytest.raises(ValueError):
        vault.read_canvas('{"nodes": 1}')
    with pytest.raises(LookupError):
        vault.edit_canvas(doc, "connect", id="f", fromNode="a", toNode="z")


def test_bookmarks(spark):
    text = json.dumps({"items": [{"type": "file", "path": "a"}, {"type": "group", "title": "G", "items": [{"type": "search", "query": "q"}, {"type": "group", "title": "H", "items": [{"type": "file", "path": "b"}]}]}]})
    df = spark.createDataFrame([(text,), ("bad",), (None,)], "text string")
    assert [(r.type, r.path, r.group) for r in vault.list_bookmarks(df).collect()] == [("file", "a", ""), ("search", "q", "G"), ("file", "b", "G/H")]
    assert [r.title for r in vault.list_bookmarks(df, ["group"]).collect()] == ["G", "H"]


B = 1_000_000  # not at the epoch, where a stream's first watermark stands
EVENTS = [("a.md", "created", B), ("a.md", "changed", B + 1000), ("a.md", "removed", B + 2000), ("a.md", "created", B + 9000), ("b.md", "changed", B), ("b.md", "changed", B + 5000), (".git/x.md", "changed", B), ("c.txt", "changed", B)]
EFFECTS = {("a.md", "unlink", B + 5000), ("a.md", "add", B + 14000), ("b.md", "change", B + 5000), ("b.md", "change", B + 10000)}


def test_debounce_batch(spark):
    df = spark.createDataFrame([(*e, i) for i, e in enumerate(EVENTS)], "path string, kind string, ts_ms long, seq int")
    assert {tuple(r) for r in debounce.debounced_batch(df).collect()} == EFFECTS
    assert debounce.debounced_batch(df.limit(0)).count() == 0


def test_debounce_stream(spark, tmp_path):
    df = spark.createDataFrame(EVENTS + [("z.md", "changed", 10_000_000)], "path string, kind string, ts_ms long").withColumn("ts", F.timestamp_millis("ts_ms")).select("path", "kind", "ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    seen = set()
    q = debounce.run(debounce.debounced(stream), lambda b, _: seen.update(tuple(r) for r in b.collect()), str(tmp_path / "cp"))
    q.awaitTermination(90)
    q.stop()
    assert EFFECTS <= seen


def test_cut_lineage(spark):
    df = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.count() == 5 and shared_folder(spark) in df.inputFiles()[0]
    kept = cut_lineage(spark.range(3))
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
    discard(df)
    assert not folder.exists() and kept.count() == 3
