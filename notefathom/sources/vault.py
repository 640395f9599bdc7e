"""Vault folders, attachments, canvases, bookmarks and templates."""

from __future__ import annotations

import base64
import binascii
import datetime
import json
import os
import re
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown as M
from ..functions import text as X

# Folders that hold no notes.
EXCLUDED = ("_FileOrganizer2000", "attachments")
MOST_ATTACHMENT = 10 * 1024 * 1024


def _files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = re.sub(r"/+$", "", re.sub(r"^file:", "", root))
    rel = F.expr(f"substring(regexp_replace(path, '^[a-z]+:/*', '/'), {len(base) + 2})")
    return rows.withColumn("rel", F.try_url_decode(F.regexp_replace(rel, r"\+", "%2B"))).withColumn("rel", F.coalesce("rel", rel))


def _visible(rel):
    return ~F.exists(F.split(rel, "/"), lambda p: p.startswith("."))


def read_vault(spark: SparkSession, root: str, subdir: str | None = None) -> DataFrame:
    """``path, mtime, raw`` of the notes under a root, hidden and excluded folders left out."""
    rows = _files(spark, root, "*.md").where(_visible(F.col("rel")) & ~F.exists(F.split("rel", "/"), lambda p: p.isin(*EXCLUDED)) & X.in_folder("rel", subdir))
    return rows.select(F.col("rel").alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("raw"))


_PARSED = T.StructType([T.StructField("frontmatter", T.StringType()), T.StructField("content", T.StringType())])


@F.arrow_udf(_PARSED)
def parsed_column(raws: pa.Array) -> pa.Array:
    return pa.array([M.parse_note(r) for r in raws.to_pylist()], type=pa.struct([("frontmatter", pa.string()), ("content", pa.string())]))


def links_of(notes: DataFrame) -> DataFrame:
    """``source_id, pos, raw, target, subpath, context`` of the links in note texts, in order; nothing is de-duplicated."""
    rows = notes.where(F.col("content").contains("[[")).select(F.col("id").alias("source_id"), "content", F.posexplode(M.index_links("content")).alias("pos", "raw"))
    target, sub = M.fragment("raw")
    return rows.select("source_id", "pos", "raw", target.alias("target"), sub.alias("subpath"), M.edge_context(F.col("content"), F.col("raw")).alias("context"))


def attachments(spark: SparkSession, root: str, folder: str | None = None, extensions: list[str] | None = None) -> DataFrame:
    """Files that are no notes; contents are not read.  The file source leaves out empty files."""
    rows = _files(spark, root).where(_visible(F.col("rel")) & ~F.lower("rel").endswith(".md") & X.in_folder("rel", folder))
    ext = F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1))
    rows = rows.select(F.col("rel").alias("path"), ext.alias("extension"), F.col("length").alias("size"))
    return rows.where(F.col("extension").isin([e.lower().lstrip(".") for e in extensions])) if extensions else rows


def attachment_count(spark: SparkSession, root: str) -> int:
    """Visible files that do not end in ``.md``, case told apart."""
    return _files(spark, root).where(_visible(F.col("rel")) & ~F.col("rel").endswith(".md")).count()


def file_info(root: str, path: str) -> dict:
    """S14."""
    p = safe_path(root, path)
    s = p.stat()
    return {"path": path, "kind": "directory" if p.is_dir() else "note" if path.endswith(".md") else "attachment", "size": s.st_size, "mtime": int(s.st_mtime * 1000), "children": sorted(x.name for x in p.iterdir()) if p.is_dir() else None}


def safe_path(root: str, path: str) -> Path:
    """A path inside a vault: no way out, no links, nothing hidden."""
    base = Path(root).resolve()
    p = (base / path).resolve()
    if p != base and base not in p.parents or any(x.startswith(".") for x in Path(path).parts) or (base / path).is_symlink():
        raise PermissionError(f"{path!r} is outside the vault")
    return p


def write_note(root: str, path: str, text: str, overwrite: bool = True) -> str:
    """Written beside and renamed over, so a reader sees the old or the new file."""
    p = safe_path(root, path)
    if p.exists() and not overwrite:
        raise FileExistsError(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=p.parent, prefix=".tmp-")
    with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(name, p)
    return path


def create_attachment(root: str, path: str, content: str, overwrite: bool = False) -> int:
    """base64 to a file of at most 10 MB."""
    try:
        data = base64.b64decode(content, validate=True)
    except binascii.Error as e:
        raise ValueError("content is not base64") from e
    if len(data) > MOST_ATTACHMENT:
        raise ValueError("the attachment is over 10 MB")
    p = safe_path(root, path)
    if path.endswith(".md") or p.exists() and not overwrite:
        raise FileExistsError(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data)
    return len(data)


def create_folder(root: str, path: str) -> bool:
    """M9."""
    p = safe_path(root, path)
    there = p.is_dir()
    p.mkdir(parents=True, exist_ok=True)
    return not there


def delete_folder(root: str, path: str, recursive: bool = False, dry_run: bool = False) -> dict:
    """M9: what goes with a folder; without ``recursive`` it must be empty."""
    p = safe_path(root, path)
    inside = sorted(p.rglob("*"), reverse=True)
    files = [x for x in inside if x.is_file()]
    if inside and not recursive:
        raise OSError("the folder is not empty")
    if not dry_run:
        for x in inside:
            x.unlink() if x.is_file() else x.rmdir()
        p.rmdir()
    return {"files": len(files), "folders": len(inside) - len(files) + 1, "notes": sum(x.suffix == ".md" for x in files)}


def delete_note(root: str, path: str) -> None:
    safe_path(root, path).unlink()


def create_note(root: str, title: str, content: str, directory: str = "", frontmatter: dict | None = None) -> str:
    """M8: a new note, with frontmatter where there is any."""
    from ..operators.rewrite import update_properties

    name = re.sub(r'[\\/:*?"<>|]', "-", title).strip() or "Untitled"
    return write_note(root, f"{directory.strip('/')}/{name}.md".lstrip("/"), update_properties(content, frontmatter) if frontmatter else content, overwrite=False)


# Date format letters of templates, in the platform's spelling.
_DATE_PARTS = {"YYYY": "%Y", "YY": "%y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "DD": "%d", "dddd": "%A", "ddd": "%a", "HH": "%H", "hh": "%I", "mm": "%M", "ss": "%S", "A": "%p"}


def format_date(at: datetime.datetime, pattern: str) -> str:
    """A moment's letters; text in brackets stays."""
    special = {"M": str(at.month), "D": str(at.day), "H": str(at.hour), "m": str(at.minute), "s": str(at.second), "Q": str((at.month + 2) // 3), "WW": f"{at.isocalendar()[1]:02d}", "W": str(at.isocalendar()[1])}
    return re.sub(r"\[([^\]]*)\]|YYYY|YY|MMMM|MMM|MM|M|dddd|ddd|DD|D|HH|H|hh|mm|m|ss|s|A|Q|WW|W", lambda m: m[1] if m[1] is not None else special.get(m[0]) or at.strftime(_DATE_PARTS[m[0]]), pattern)


def render_template(template: str, title: str, at: datetime.datetime, variables: dict[str, str] | None = None) -> str:
    """``{{title}}``, ``{{date:FMT}}``, ``{{time:FMT}}`` and named variables; unknown ones stay."""
    known = variables or {}

    def put(m: re.Match) -> str:
        name, _, fmt = m[1].strip().partition(":")
        if name == "title":
            return title
        if name in ("date", "time"):
            return format_date(at, fmt or ("YYYY-MM-DD" if name == "date" else "HH:mm"))
        return str(known.get(name, m[0]))

    return re.sub(r"\{\{([^{}]+)\}\}", put, template)


def template_folder(root: str, settings: str) -> str:
    """The folder that ``templates.json`` in the vault's settings folder names."""
    p = Path(root, settings, "templates.json")
    return json.loads(p.read_text()).get("folder", "Templates") if p.exists() else "Templates"


# ---- canvases -----------------------------------------------------------------------------------------------------


def read_canvas(text: str) -> dict:
    """An empty file is an empty canvas; nodes and edges must be lists."""
    doc = json.loads(text) if text.strip() else {}
    for key in ("nodes", "edges"):
        if not isinstance(doc.setdefault(key, []), list):
            raise ValueError(f"{key} is not a list")
    return doc


def write_canvas(doc: dict) -> str:
    """One line per element."""
    part = lambda key: "[" + (("\n\t\t" + ",\n\t\t".join(json.dumps(x, ensure_ascii=False) for x in doc[key]) + "\n\t") if doc[key] else "") + "]"
    rest = "".join(f",\n\t{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}" for k, v in doc.items() if k not in ("nodes", "edges"))
    return f'{{\n\t"nodes": {part("nodes")},\n\t"edges": {part("edges")}{rest}\n}}'


def edit_canvas(doc: dict, op: str, **a) -> dict:
    """add_node, update_node, delete_node, connect, disconnect."""
    nodes, edges = doc["nodes"], doc["edges"]
    ids = {n["id"] for n in nodes}
    match op:
        case "add_node":
            node = {"width": 400, "height": 200, **a}
            if node["id"] in ids:
                raise ValueError("the id is taken")
            if "x" not in node:
                node["x"] = max((n.get("x", 0) + n.get("width", 0) for n in nodes), default=-40) + 40
            node.setdefault("y", 0)
            return {**doc, "nodes": [*nodes, node]}
        case "update_node":
            if a["id"] not in ids:
                raise LookupError(a["id"])
            return {**doc, "nodes": [{k: v for k, v in (n | a).items() if v is not None} if n["id"] == a["id"] else n for n in nodes]}
        case "delete_node":
            if a["id"] not in ids:
                raise LookupError(a["id"])
            return {**doc, "nodes": [n for n in nodes if n["id"] != a["id"]], "edges": [e for e in edges if a["id"] not in (e["fromNode"], e["toNode"])]}
        case "connect":
            if not {a["fromNode"], a["toNode"]} <= ids:
                raise LookupError("both ends must be there")
            return {**doc, "edges": [*edges, {"fromEnd": "none", "toEnd": "arrow", **a}]}
        case "disconnect":
            return {**doc, "edges": [e for e in edges if e["id"] != a["id"]]}
    raise ValueError(op)


def canvas_nodes(canvases: DataFrame) -> DataFrame:
    """E19 over many files: ``path, pos, node`` from ``canvases(path, text)``."""
    v = F.try_parse_json("text")
    return canvases.select("path", F.posexplode(F.try_variant_get(v, "$.nodes", "array<variant>")).alias("pos", "node")).select("path", "pos", F.to_json("node").alias("node"))


# ---- bookmarks ----------------------------------------------------------------------------------------------------

_MARK = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("title", T.StringType()), T.StructField("path", T.StringType()), T.StructField("group", T.StringType())]))


def _bookmarks(text: str) -> Iterator[dict]:
    try:
        doc = json.loads(text)
    except ValueError:
        return
    todo = [(x, "") for x in reversed(doc.get("items", []) if isinstance(doc, dict) else [])]
    while todo:
        x, group = todo.pop()
        if not isinstance(x, dict):
            continue
        yield {"type": x.get("type"), "title": x.get("title"), "path": x.get("path") or x.get("query"), "group": group}
        if x.get("type") == "group":
            inner = f"{group}/{x.get('title') or ''}".strip("/")
            todo += [(y, inner) for y in reversed(x.get("items") or [])]


bookmark_rows = M.array_udf(lambda t: list(_bookmarks(t)), _MARK, pa.list_(pa.struct([("type", pa.string()), ("title", pa.string()), ("path", pa.string()), ("group", pa.string())])))


def list_bookmarks(files: DataFrame, types: list[str] | None = None) -> DataFrame:
    """``type, title, path, group`` of ``files(text)``; groups flatten unless asked for."""
    rows = files.select(F.posexplode(bookmark_rows("text")).alias("pos", "b")).select("pos", "b.*")
    return rows.where(F.col("type").isin(types)) if types else rows.where("type != 'group'")


def list_vaults(vaults: DataFrame, notes: DataFrame) -> DataFrame:
    """Vaults with the number of ids in ``notes``, the current view with its stubs."""
    n = notes.groupBy("vault_id").agg(F.count("*").alias("notes"))
    return vaults.join(n, "vault_id", "left").select("vault_id", "title", "root", F.coalesce("notes", F.lit(0)).alias("notes"))
