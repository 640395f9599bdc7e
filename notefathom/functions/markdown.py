"""Reading Markdown notes: frontmatter, code, links, tags, headings, tasks, chunks.

Plain functions over one text, and Arrow functions and columns over them.  What a regular expression can say stays in the JVM.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

# ---- frontmatter (E1, E2) -----------------------------------------------------------------------------------------


def split_frontmatter(raw: str) -> tuple[str | None, str]:
    """The matter between ``---`` lines and the body; a matter that never ends takes all."""
    text = raw.removeprefix("﻿")
    if not text.startswith("---") or text[3:4] == "-":
        return None, raw
    first = text.find("\n")
    if first < 0:
        return "", ""
    end = text.find("\n---", first - 1 if text[first - 1 : first] == "\n" else first)
    if end < 0:
        return text[first + 1 :], ""
    after = text.find("\n", end + 1)
    return text[first + 1 : end + 1] if end >= first else "", text[after + 1 :] if after >= 0 else ""


class _Loader(yaml.SafeLoader):
    """YAML 1.1 as JavaScript loaders read it: only true and false are booleans, dates stay dates, a repeated key is an error."""


_Loader.yaml_implicit_resolvers = {k: [r for r in v if r[0] not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:int", "tag:yaml.org,2002:float")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
_Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^[-+]?(?:0b[01_]+|0x[0-9a-fA-F_]+|0[0-7_]+|(?:0|[1-9][0-9_]*)|[1-9][0-9_]*(?::[0-5]?[0-9])+)$"), list("-+0123456789"))
_Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^[-+]?(?:[0-9][0-9_]*\.[0-9_]*(?:[eE][-+]?[0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+]?[0-9]+)?|[0-9][0-9_]*[eE][-+]?[0-9]+|\.(?:inf|Inf|INF))$|^\.(?:nan|NaN|NAN)$"), list("-+.0123456789"))


def _mapping(loader: _Loader, node: yaml.MappingNode) -> dict:
    loader.flatten_mapping(node)
    out: dict = {}
    own = set()
    for k, v in node.value:
        key = loader.construct_object(k, deep=True)
        key = key if isinstance(key, str) else json.dumps(_plain(key))
        if key in own and k.start_mark and v.start_mark:
            raise yaml.constructor.ConstructorError(None, None, f"repeated key {key!r}", k.start_mark)
        own.add(key)
        out[key] = loader.construct_object(v, deep=True)
    return out


_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)


def _plain(v):
    """A loaded value as JSON has it: times in ISO form with milliseconds, UTC."""
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set)):
        return [_plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        v = v.astimezone(datetime.UTC).replace(tzinfo=None) if v.tzinfo else v
        return v.strftime("%Y-%m-%dT%H:%M:%S.") + f"{v.microsecond // 1000:03d}Z"
    if isinstance(v, datetime.date):
        return f"{v.isoformat()}T00:00:00.000Z"
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, bytes):
        return v.decode("utf-8", "replace")
    return v


def parse_note(raw: str | None) -> dict:
    """``frontmatter`` as JSON text and ``content``; a broken matter leaves the whole text as content."""
    if raw is None:
        return {"frontmatter": "{}", "content": None}
    matter, body = split_frontmatter(raw)
    if matter is None:
        return {"frontmatter": "{}", "content": raw}
    try:
        loaded = yaml.load(matter, _Loader) if matter.strip() else {}
    except (yaml.YAMLError, ValueError, RecursionError):
        return {"frontmatter": "{}", "content": raw}
    if loaded is None:
        loaded = {}
    if not isinstance(loaded, dict):
        return {"frontmatter": "{}", "content": raw}
    return {"frontmatter": json.dumps(_plain(loaded), ensure_ascii=False), "content": body}


# ---- code and lines (F8-F10) --------------------------------------------------------------------------------------

_FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})(.*)$")
_BREAKS = re.compile(r"\r?\n")


def fence_lines(lines: list[str]) -> list[bool]:
    """Which lines are in a fenced block, its marks included; one that is never closed runs to the end."""
    out, fence = [], None
    for line in lines:
        m = _FENCE.match(line)
        if fence:
            out.append(True)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
            out.append(True)
        else:
            out.append(False)
    return out


def frontmatter_end(lines: list[str]) -> int:
    """Number of lines the frontmatter takes; it closes at ``---`` or ``...``."""
    if not lines or lines[0].removeprefix("﻿").rstrip() != "---":
        return 0
    return next((i + 1 for i in range(1, len(lines)) if lines[i].rstrip() in ("---", "...")), 0)


def inert_lines(text: str) -> list[bool]:
    """Lines that hold no prose: frontmatter and fenced blocks."""
    lines = _BREAKS.split(text)
    end = frontmatter_end(lines)
    return [True] * end + fence_lines(lines[end:])


_INLINE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.DOTALL)


def mask_code(text: str, fenced_only: bool = False) -> str:
    """F8: code blanked, every other character where it was."""
    out, at = [], 0
    lines = re.split(r"(\r?\n)", text)
    flags = fence_lines(lines[::2])
    for i, part in enumerate(lines):
        out.append(part if i % 2 or not flags[i // 2] else " " * len(part))
        at += len(part)
    masked = "".join(out)
    if fenced_only:
        return masked
    return _INLINE.sub(lambda m: m[0] if "\n\n" in m[0] else re.sub(r"[^\r\n]", " ", m[0]), masked)


def _text_udf(fn):
    """An Arrow function of one text column to text; null gives null."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fn(t) for t in texts.to_pylist()], pa.string())

    return run


masked_text = _text_udf(mask_code)
masked_fences = _text_udf(lambda t: mask_code(t, fenced_only=True))


def strip_code(content: Column | str) -> Column:
    """fences and code spans taken out, by the simpler rule."""
    return F.regexp_replace(F.regexp_replace(X.col(content), r"(?s)```.*?```", ""), r"`[^`\n]*`", "")


# ---- links (E3-E5, E14, E15) --------------------------------------------------------------------------------------


def index_links(content: Column | str) -> Column:
    """Targets of ``[[...]]`` in order, embeds left out, cut at the first bar."""
    return F.transform(F.regexp_extract_all(strip_code(content), F.lit(r"(?<!!)\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.trim(F.split(x, r"\|")[0]))


def fragment(raw: Column | str) -> tuple[Column, Column]:
    """A link without its anchor, and the anchor; ``^`` belongs to a block's."""
    return F.regexp_extract(X.col(raw), r"^([^#^]*)", 1), F.nullif(F.regexp_extract(X.col(raw), r"^[^#^]*#?(\^?.*)$", 1), F.lit(""))


_LINK = re.compile(r"(!?)\[\[([^\[\]\n]+?)\]\]")
_LINK_TYPE = T.ArrayType(T.StructType([T.StructField("embed", T.BooleanType()), T.StructField("target", T.StringType()), T.StructField("subpath", T.StringType()), T.StructField("alias", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("raw", T.StringType())]))
_LINK_ARROW = pa.list_(pa.struct([("embed", pa.bool_()), ("target", pa.string()), ("subpath", pa.string()), ("alias", pa.string()), ("line", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("raw", pa.string())]))


def find_links(text: str) -> list[dict]:
    """Links and embeds outside code, with positions, anchors and aliases."""
    out, masked, line, at = [], mask_code(text), 1, 0
    for m in _LINK.finditer(masked):
        line += masked.count("\n", at, m.start())
        at = m.start()
        inner, _, alias = text[m.start(2) : m.end(2)].partition("|")
        cut = re.search(r"[#^]", inner)
        sub = inner[cut.start() :].removeprefix("#") if cut else None
        out.append({"embed": bool(m[1]), "target": (inner[: cut.start()] if cut else inner).strip(), "subpath": sub, "alias": alias or None, "line": line, "start": m.start(), "stop": m.end(), "raw": text[m.start() : m.end()]})
    return out


def array_udf(fn, kind: T.DataType, arrow: pa.DataType):
    """An Arrow function of one text column; null gives an empty list."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fn(x) if x is not None else [] for x in batch.to_pylist()], type=arrow)

    return run


inert_flags = array_udf(inert_lines, T.ArrayType(T.BooleanType()), pa.list_(pa.bool_()))
maintenance_links = array_udf(find_links, _LINK_TYPE, _LINK_ARROW)

_ATX = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_BLOCK_ID = re.compile(r"(?:^|\s)\^([A-Za-z0-9-]+)\s*$")


def find_headings(text: str) -> list[dict]:
    """Headings with level, text and line in the file."""
    lines = _BREAKS.split(text)
    inert = inert_lines(text)
    return [{"line": i + 1, "level": len(m[1]), "text": m[2]} for i, line in enumerate(lines) if not inert[i] and (m := _ATX.match(line))]


def find_block_ids(text: str) -> list[dict]:
    """Block ids at line ends, outside code."""
    lines = _BREAKS.split(text)
    inert = inert_lines(text)
    return [{"line": i + 1, "block": m[1]} for i, line in enumerate(lines) if not inert[i] and (m := _BLOCK_ID.search(line))]


def find_anchors(text: str) -> list[str]:
    """Headings as ``#key`` and blocks as ``^id``."""
    return list({"#" + " ".join(h["text"].lower().split()) for h in find_headings(text)} | {"^" + b["block"] for b in find_block_ids(text)})


headings = array_udf(find_headings, T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())])), pa.list_(pa.struct([("line", pa.int32()), ("level", pa.int32()), ("text", pa.string())])))
block_ids = array_udf(find_block_ids, T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("block", T.StringType())])), pa.list_(pa.struct([("line", pa.int32()), ("block", pa.string())])))
anchors = array_udf(find_anchors, T.ArrayType(T.StringType()), pa.list_(pa.string()))


def edge_context(content: Column, raw: Column) -> Column:
    """E5: the first paragraph with the link, its own syntax taken off, blanks collapsed."""
    hit = F.filter(F.split(content, r"\n\s*\n"), lambda p: F.contains(p, F.concat(F.lit("[["), raw)))
    plain = F.regexp_replace(F.try_element_at(hit, F.lit(1)), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    return F.coalesce(F.trim(F.regexp_replace(plain, r"\s+", " ")), raw)


def attachment_targets(text: str) -> list[str]:
    """Link targets that may be files: wiki and Markdown links without anchors, sizes, queries or schemes."""
    out = []
    for m in re.finditer(r"!?\[\[([^\[\]\n]+)\]\]|!?\[[^\]\n]*\]\(\s*<?([^)\s>]+)>?[^)]*\)", mask_code(text)):
        target = re.split(r"[|#^]", m[1])[0] if m[1] else unquote(re.split(r"[?#]", m[2])[0])
        if target.strip() and not re.match(r"[A-Za-z][\w+.\-]*:|//", target):
            out.append(target.strip())
    return out


file_links = array_udf(attachment_targets, T.ArrayType(T.StringType()), pa.list_(pa.string()))

# ---- tags and fields (E6, E7) -------------------------------------------------------------------------------------


def inline_tags(content: Column | str) -> Column:
    """``#tag`` in prose and code alike, first spelling of each, in order."""
    return F.array_distinct(F.regexp_extract_all(X.col(content), F.lit(r"(?<![A-Za-z0-9_])#([a-zA-Z][A-Za-z0-9_\-/]*)"), F.lit(1)))


def inline_fields(content: Column | str) -> Column:
    """``key:: value`` at a line's start as a map, the first of a key wins."""
    plain = strip_code(content)
    pattern = r"(?m)^([A-Za-z][A-Za-z0-9_ \-]*)::[ \t]+(\S.*?)[ \t\r]*$"
    keys, values = F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), F.regexp_extract_all(plain, F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    return F.map_from_entries(F.filter(F.transform(pairs, lambda p: F.struct(F.trim(p["k"]).alias("k"), p["v"].alias("v"))), lambda p, i: F.array_position(F.transform(keys, lambda k: F.trim(k)), p["k"]) == i + 1))


# ---- tasks (E12, A11, W4) -----------------------------------------------------------------------------------------

_MARK = r"([ \t]*)(?:[-*+]|[0-9]+[.)])"
_TASK = re.compile(_MARK + r"[ \t]+\[(.)\](?:[ \t]+(.*))?$")
_ITEM = re.compile(_MARK + r"(?:[ \t]|$)")
_DUE = re.compile(r"📅\s*([0-9]{4}-[0-9]{2}-[0-9]{2})")
# What the marks of a box mean; all others are open.
_STATES = {"x": "done", "X": "done", "-": "cancelled"}


def list_items(text: str) -> list[tuple[int, int, re.Match | None, int]]:
    """``(line, width, task, above)`` of the list items of a text: the task's match if it is one, and the index of the nearest item before it
    that is less indented, -1 at the top.  A line of prose at the margin ends a list."""
    items: list[tuple[int, int, re.Match | None, int]] = []
    first = 0  # where the current list begins
    for at, (line, inert) in enumerate(zip(_BREAKS.split(text), inert_lines(text)), 1):
        if inert:
            continue
        if m := _ITEM.match(line):
            width = m[1].count(" ") + 4 * m[1].count("\t")
            above = len(items) - 1
            while above >= first and items[above][1] >= width:
                above = items[above][3]
            items.append((at, width, _TASK.match(line), above if above >= first else -1))
        elif line and not line[0].isspace():
            first = len(items)
    return items


def find_tasks(text: str) -> list[dict]:
    """Tasks with state, depth below other list items, the nearest enclosing task's line and the due date."""
    items, out = list_items(text), []
    depth, inside = [0] * len(items), [None] * len(items)
    for i, (line, _, task, above) in enumerate(items):
        if above >= 0:
            depth[i] = depth[above] + 1
            inside[i] = items[above][0] if items[above][2] else inside[above]
        if task:
            body = (task[3] or "").rstrip(X.JS_SPACE)
            due = _DUE.search(body)
            out.append({"line": line, "status": task[2], "state": _STATES.get(task[2], "open"), "text": body, "indent": depth[i], "parent_line": inside[i], "due": due and due[1]})
    return out


_TASK_FIELDS = [("line", T.IntegerType(), pa.int32()), ("status", T.StringType(), pa.string()), ("state", T.StringType(), pa.string()), ("text", T.StringType(), pa.string()), ("indent", T.IntegerType(), pa.int32()), ("parent_line", T.IntegerType(), pa.int32()), ("due", T.StringType(), pa.string())]
tasks = array_udf(find_tasks, T.ArrayType(T.StructType([T.StructField(n, k) for n, k, _ in _TASK_FIELDS])), pa.list_(pa.struct([(n, a) for n, _, a in _TASK_FIELDS])))


def task_counts(content: Column | str) -> Column:
    """Open and done by the second classifier, in which everything but a blank is done."""
    marks = F.regexp_extract_all(X.col(content), F.lit(r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+\[(.)\](?:[ \t]|$)"), F.lit(1))
    return F.struct(F.size(F.filter(marks, lambda m: m == " ")).alias("open"), F.size(F.filter(marks, lambda m: m != " ")).alias("done"))


# ---- sections (E13, W5) -------------------------------------------------------------------------------------------


def sections(text: str) -> list[dict]:
    """Headings with the last line of their section."""
    heads, n = find_headings(text), len(_BREAKS.split(text))
    for i, h in enumerate(heads):
        h["end"] = next((g["line"] - 1 for g in heads[i + 1 :] if g["level"] <= h["level"]), n)
    return heads


_SECTION_TYPE = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("end", T.IntegerType())]))
section_list = array_udf(sections, _SECTION_TYPE, pa.list_(pa.struct([("line", pa.int32()), ("level", pa.int32()), ("text", pa.string()), ("end", pa.int32())])))


def section_rows(notes: DataFrame) -> DataFrame:
    """``id, line, level, text, end`` of every section of the notes, the outline of each."""
    return notes.where(F.col("content").contains("#")).select("id", F.explode(section_list("content")).alias("s")).select("id", "s.*")


def read_part(text: str, heading: str | None = None, start: int | None = None, end: int | None = None, block: str | None = None) -> str:
    """A section by (nested, ``A > B``) heading, lines by number, or the block with an id."""
    lines = _BREAKS.split(text)
    if heading is not None:
        lo, hi, found = 1, len(lines), None
        for part in (" ".join(p.lower().split()) for p in heading.split(">")):
            hits = [h for h in sections(text) if lo <= h["line"] <= hi and " ".join(h["text"].lower().split()) == part]
            if len(hits) != 1:
                raise LookupError(f"heading {part!r} was found {len(hits)} times")
            found = hits[0]
            lo, hi = found["line"] + 1, found["end"]
        return "\n".join(lines[found["line"] - 1 : found["end"]])
    if block is not None:
        hit = next((b for b in find_block_ids(text) if b["block"] == block), None)
        if hit is None:
            raise LookupError(f"no block {block!r}")
        lo = hi = hit["line"] - 1
        if not lines[hi].strip().removeprefix("^" + block).strip() and lo:
            lo -= 1  # an id alone stands for the block above
        if not _ITEM.match(lines[lo]):
            while lo and lines[lo - 1].strip() and not _ATX.match(lines[lo - 1]):
                lo -= 1
        return "\n".join(lines[lo : hi + 1])
    return "\n".join(lines[max(0, (start or 1) - 1) : end or len(lines)])


# ---- chunks (E8, E9) ----------------------------------------------------------------------------------------------


def _u16(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def _guarded(body: str) -> list[tuple[str, bool]]:
    """Blocks of a section in order; fences and display formulas are kept whole (``True``)."""
    lines = body.split("\n")
    flags = fence_lines(lines)
    out: list[tuple[str, bool]] = []
    i = 0
    while i < len(lines):
        j = i
        if flags[i]:
            while j < len(lines) and flags[j] and (j == i or not _opens(lines, flags, j)):
                j += 1
            out.append(("\n".join(lines[i:j]), True))
        elif lines[i].strip().startswith("$$"):
            j += 1
            if lines[i].strip() == "$$" or not lines[i].strip().endswith("$$"):
                while j < len(lines) and not lines[j].strip().endswith("$$"):
                    j += 1
                j = min(j + 1, len(lines))
            out.append(("\n".join(lines[i:j]), True))
        else:
            while j < len(lines) and not flags[j] and lines[j].strip() and not lines[j].strip().startswith("$$"):
                j += 1
            if j > i:
                out.append(("\n".join(lines[i:j]), False))
            else:
                j = i + 1
        i = j
    return out


def _opens(lines: list[str], flags: list[bool], j: int) -> bool:
    """Whether a fence line begins a block right after one that just ended."""
    return bool(_FENCE.match(lines[j])) and fence_lines(lines[: j]) and not fence_lines([*lines[:j], "x"])[-1]


def _hard(text: str, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def _small(block: str, size: int) -> list[str]:
    if _u16(block) <= size:
        return [block]
    out: list[str] = []
    for s in re.split(r"(?<=[.!?。！？])\s+", block):
        for piece in [s] if _u16(s) <= size else _hard(s, size):
            if out and _u16(out[-1]) + 1 + _u16(piece) <= size:
                out[-1] += " " + piece
            else:
                out.append(piece)
    return out


def chunk(content: str, size: int = 1000, least: int = 50, depth: int = 4) -> list[dict]:
    """Sections at headings up to ``depth``, cut at paragraphs, sentences or hard, packed up to ``size`` units; fenced blocks
    and formulas stay whole; pieces under ``least`` units are dropped."""
    _, body = split_frontmatter(content)
    lines = body.split("\n")
    flags = fence_lines(lines)
    heads = [(i, len(m[1]), m[2]) for i, line in enumerate(lines) if not flags[i] and (m := _ATX.match(line)) and len(m[1]) <= depth]
    marks = [(0, None, None)] if not heads or heads[0][0] else []
    marks += heads
    out: list[dict] = []
    for n, (at, level, name) in enumerate(marks):
        stop = marks[n + 1][0] if n + 1 < len(marks) else len(lines)
        blocks = _guarded("\n".join(lines[at + (level is not None) : stop]))
        packed: list[str] = []
        for block, whole in blocks:
            for piece in [block] if whole else _small(block, size):
                if packed and _u16(packed[-1]) + 2 + _u16(piece) <= size:
                    packed[-1] += "\n\n" + piece
                else:
                    packed.append(piece)
        cursor = at + 1
        for text in packed:
            if _u16(text.strip()) < least:
                continue
            first = next((i + 1 for i in range(cursor - 1, stop) if lines[i].strip() and text.lstrip().startswith(lines[i].strip()[:40])), cursor)
            last = min(stop, first + text.count("\n"))
            cursor = first
            out.append({"chunk_index": len(out), "heading": name, "heading_level": level, "content": text, "content_hash": hashlib.sha256(f"{name or ''} {text}".encode()).hexdigest(), "start_line": first, "end_line": last})
    return out


_CHUNK_FIELDS = [("chunk_index", T.IntegerType(), pa.int32()), ("heading", T.StringType(), pa.string()), ("heading_level", T.IntegerType(), pa.int32()), ("content", T.StringType(), pa.string()), ("content_hash", T.StringType(), pa.string()), ("start_line", T.IntegerType(), pa.int32()), ("end_line", T.IntegerType(), pa.int32())]
chunks = array_udf(chunk, T.ArrayType(T.StructType([T.StructField(n, k) for n, k, _ in _CHUNK_FIELDS])), pa.list_(pa.struct([(n, a) for n, _, a in _CHUNK_FIELDS])))


def chunk_text(heading: Column, content: Column) -> Column:
    """What is embedded for a chunk."""
    return F.concat_ws("\n\n", heading, content)


def note_text(title: Column, tags: Column, content: Column) -> Column:
    """What is embedded for a note: title, tags, first paragraph."""
    return F.concat_ws("\n", title, F.nullif(F.array_join(tags, " "), F.lit("")), F.nullif(X.note_excerpt(content, 1 << 20), F.lit("")))


def fallback_text(title: str | None, frontmatter: str | None, content: str | None) -> str:
    """What is embedded for a note without chunks, a line each: title, listed tags, single values of other keys, up to five link targets; empty
    where that comes to under three units."""
    try:
        fm = json.loads(frontmatter or "{}")
    except ValueError:
        fm = {}
    fm = fm if isinstance(fm, dict) else {}
    tags = fm.get("tags")
    lines = [title or "", ", ".join(t for t in tags if isinstance(t, str)) if isinstance(tags, list) else ""]
    for key, value in fm.items():
        if key != "tags" and not key.startswith("_"):
            told = value.strip(X.JS_SPACE) if isinstance(value, str) else json.dumps(value) if isinstance(value, (bool, int, float)) else ""
            lines.append(f"{key}: {told}" if told else "")
    targets = [t for m in re.findall(r"!?\[\[([^\]|#^]+)", content or "") if (t := m.strip(X.JS_SPACE))]
    lines.append("Links: " + ", ".join(targets[:5]) if targets else "")
    text = "\n".join(x for x in lines if x)
    return text if _u16(text.strip(X.JS_SPACE)) >= 3 else ""


# ---- embedding without a model (E16, E17, S15) --------------------------------------------------------------------

# Words that are not counted.
_STOP = frozenset("a an and the of with to in for used".split())


@lru_cache(200_000)
def fnv1a(word: str) -> int:
    """The public 32-bit FNV-1a hash of the word's UTF-8 bytes."""
    h = 2166136261
    for b in word.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 % (1 << 32)
    return h


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """Words hashed into ``dim`` counts, scaled to length 1; a text without words points along the first axis."""
    v = [0.0] * dim
    for w in re.findall(r"[^\W_]+", text):
        if (w := w.lower()) not in _STOP:
            v[fnv1a(w) % dim] += 1.0
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else [1.0] + v[1:]


def mean_pool(vectors: list[list[float]], mask: list[int]) -> list[float]:
    """Mean over the unmasked tokens, scaled to length 1."""
    live = [v for v, m in zip(vectors, mask) if m]
    if not live:
        return [0.0] * (len(vectors[0]) if vectors else 0)
    mean = [sum(c) / len(live) for c in zip(*live)]
    norm = math.sqrt(sum(x * x for x in mean)) or 1.0
    return [x / norm for x in mean]


embed_text = array_udf(hashed_embedding, T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))


# ---- Porter stemming (Q1) -----------------------------------------------------------------------------------------


def _measure(stem: str) -> int:
    form = "".join("v" if c in "aeiou" or c == "y" and i and stem[i - 1] not in "aeiou" else "c" for i, c in enumerate(stem))
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", form)))


def _vowel(stem: str) -> bool:
    return any(c in "aeiou" or c == "y" and i and stem[i - 1] not in "aeiou" for i, c in enumerate(stem))


def _cvc(stem: str) -> bool:
    if len(stem) < 3 or stem[-1] in "wxy":
        return False
    is_v = lambda i: stem[i] in "aeiou" or stem[i] == "y" and i and stem[i - 1] not in "aeiou"
    n = len(stem)
    return not is_v(n - 1) and is_v(n - 2) and not is_v(n - 3)


# Suffix pairs of the published algorithm's steps 2 and 3, and the suffixes of step 4.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


@lru_cache(200_000)
def porter(word: str) -> str:
    """The stem of an English word by Porter's published algorithm; words of other alphabets stay as they are."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for pair in sorted(table.split(), key=lambda p: -len(p)):
            old, _, new = pair.partition(":")
            if w.endswith(old):
                if _measure(w[: -len(old)]) > 0:
                    w = w[: -len(old)] + new
                break
    for old in sorted(_STEP4.split(), key=len, reverse=True):
        if w.endswith(old):
            base = w[: -len(old)]
            if _measure(base) > 1 and (old != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _stemmed(text: str) -> list[str]:
    return [porter(w) for w in re.findall(r"[^\W_]+", text.lower())]


stemmed_tokens = array_udf(_stemmed, T.ArrayType(T.StringType()), pa.list_(pa.string()))
