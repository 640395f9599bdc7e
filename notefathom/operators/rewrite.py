"""Text rewrites over many notes, as plans (M1-M4, A14), and single-note edits as functions.

Plans give a row per note that changes, with the new text and counts; nothing is written here.
"""

from __future__ import annotations

import difflib
import json
import re

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown as M
from ..functions import text as X
from .search import safe_pattern

_PLAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("samples", T.ArrayType(T.StringType()))])
_PLAN_ARROW = pa.struct([("text", pa.string()), ("n", pa.int32()), ("samples", pa.list_(pa.string()))])


def _planned(fn):
    """An Arrow function of one text column giving the new text, the number of changes and up to three samples."""

    @F.arrow_udf(_PLAN)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else dict(zip(("text", "n", "samples"), fn(t))) for t in texts.to_pylist()], type=_PLAN_ARROW)

    return run


def _plan(notes: DataFrame, fn, where) -> DataFrame:
    got = notes.where(where).select("id", "content", fn("content").alias("p"))
    return got.where("p.n > 0").select("id", F.col("p.text").alias("content"), F.col("p.n").alias("n"), F.col("p.samples").alias("samples"))


def _spans_of_prose(text: str, include_frontmatter: bool, include_code: bool) -> list[tuple[int, int]]:
    """Stretches in which text may be replaced."""
    lines, at, out = re.split(r"(\r?\n)", text), 0, []
    body = lines[::2]
    head = M.frontmatter_end(body)
    fenced = [False] * head + M.fence_lines(body[head:])
    masked = text if include_code else M.mask_code(text)
    for i, line in enumerate(body):
        skip = (i < head and not include_frontmatter) or (fenced[i] and not include_code)
        if not skip:
            cursor = 0
            part = masked[at : at + len(line)]
            for a, b in _blanked(line, part):
                out.append((at + cursor, at + a))
                cursor = b
            out.append((at + cursor, at + len(line)))
        at += len(line) + (len(lines[2 * i + 1]) if 2 * i + 1 < len(lines) else 0)
    return out


def _blanked(line: str, masked: str) -> list[tuple[int, int]]:
    """Where code was blanked in a line."""
    out, i = [], 0
    while i < len(line):
        if line[i] != masked[i]:
            j = i
            while j < len(line) and (line[j] != masked[j] or masked[j] == " " and line[j] == " "):
                j += 1
            out.append((i, j))
            i = j
        i += 1
    return out


def _template(replacement: str) -> str:
    """``$1``, ``$<name>``, ``$&`` and ``$$`` in Python's spelling."""
    out = replacement.replace("\\", "\\\\")
    return re.sub(r"\$(\$|&|\d{1,2}|<([A-Za-z]\w*)>)", lambda m: "$" if m[1] == "$" else r"\g<0>" if m[1] == "&" else rf"\g<{m[2] or m[1]}>", out)


def search_and_replace(notes: DataFrame, pattern: str, replacement: str, regex: bool = False, case_sensitive: bool = True, folder: str | None = None, include_frontmatter: bool = False, include_code: bool = False) -> DataFrame:
    """M1: ``id, content, n, samples``; prose only unless frontmatter or code is asked for."""
    flags = 0 if case_sensitive else re.IGNORECASE
    needle = re.compile(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", safe_pattern(pattern)) if regex else re.escape(pattern), flags)
    put = _template(replacement) if regex else replacement.replace("\\", "\\\\")

    def fn(text: str) -> tuple[str, int, list[str]]:
        out, at, n, samples = [], 0, 0, []
        for a, b in _spans_of_prose(text, include_frontmatter, include_code):
            if a < at:
                continue
            new, k = needle.subn(put, text[a:b])
            out += (text[at:a], new)
            at, n = b, n + k
            if k and len(samples) < 3:
                m = needle.search(text, a, b)
                samples.append(text[max(a, m.start() - 80) : min(b, m.end() + 80)] if m else new[:160])
        return "".join([*out, text[at:]]), n, samples

    jvm = ("" if case_sensitive else "(?i)") + (pattern if regex else re.escape(pattern).replace("\\ ", " "))
    return _plan(notes, _planned(fn), X.in_folder("id", folder) & F.col("content").rlike(jvm))


def totals(plan: DataFrame) -> DataFrame:
    """A14."""
    return plan.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))


def tag_name(tag: str) -> str:
    """A tag without blanks and ``#`` around it; an error if it is none: letters, digits, ``_-/``, not digits alone, no empty level."""
    name = tag.strip(X.JS_SPACE).lstrip("#")
    if not re.fullmatch(r"[\w\-/]+", name) or all(c.isnumeric() for c in name) or name[0] == "/" or name[-1] == "/" or "//" in name:
        raise ValueError(f"{tag!r} is no tag")
    return name


def _inline_tags(old: str, new: str, nested: bool):
    """Tags after white space or at the start, ended by anything that cannot go on in one; ``/`` goes on in a nested one."""
    inline = re.compile(rf"(?:\A|(?<=[\s\ufeff]))#{re.escape(old)}(?![\w\-{'' if nested else '/'}])", re.IGNORECASE)

    def fn(text: str) -> tuple[str, int, list[str]]:
        at, out = 0, []
        places = [m.span() for m in inline.finditer(M.mask_code(text))]
        for start, end in places:
            out += (text[at:start], "#", new)
            at = end
        return "".join([*out, text[at:]]), len(places), [text[a:b] for a, b in places[:3]]

    return fn


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_GAP = re.compile(r"[ \t\r\n]*")


def _members(text: str):
    """Key, start and end of the value of each member of the JSON object that is the whole of ``text``."""
    read = json.JSONDecoder()
    at = _GAP.match(text).end() + 1
    while text[at := _GAP.match(text, at).end()] != "}":
        key, at = read.raw_decode(text, at)
        at = _GAP.match(text, _GAP.match(text, at).end() + 1).end()
        _, end = read.raw_decode(text, at)
        yield key, at, end
        at = _GAP.match(text, end).end()
        at += text[at] == ","


def _frontmatter_tags(old: str, new: str, nested: bool):
    end = "" if nested else "/"
    value = re.compile(rf"(?:\A|(?<=[\s\ufeff,\[\]\"']))(#?){re.escape(old)}(?![\w\-{end}])", re.IGNORECASE)

    def fn(text: str) -> tuple[str, int, list[str]]:
        try:
            if not isinstance(json.loads(text), dict):
                return text, 0, []
        except ValueError:
            return text, 0, []
        out, last, n = [], 0, 0
        for key, start, stop in _members(text):
            for m in _STRING.finditer(text, start, stop) if key.lower() in ("tags", "tag") else ():
                put, k = value.subn(lambda x: x[1] + new, json.loads(m[0]))
                if k:
                    written = json.dumps(put, ensure_ascii=any("\ud800" <= c <= "\udfff" for c in put))
                    out += (text[last : m.start()], written)
                    last, n = m.end(), n + k
        return "".join([*out, text[last:]]), n, []

    return fn


def _has_inline_tag(old: str):
    return F.lower("content").contains("#" + old.lower())


def _has_frontmatter_tag(old: str):
    """A backslash may hide any character."""
    return F.lower("frontmatter").contains(old.lower()) | F.col("frontmatter").contains("\\")


def rename_tag(notes: DataFrame, old: str, new: str, nested: bool = True) -> DataFrame:
    """M2, inline side: tags in the content outside code, case ignored; children follow when ``nested``."""
    old, new = tag_name(old), tag_name(new)
    return _plan(notes, _planned(_inline_tags(old, new, nested)), _has_inline_tag(old))


def rename_tag_frontmatter(notes: DataFrame, old: str, new: str, nested: bool = True) -> DataFrame:
    """M2, frontmatter side: ``id, frontmatter, n``.  Whole tags in the values of ``tags`` and ``tag``, also several in one string, where
    white space, a comma, a bracket or a quote stands before each; all other JSON stays as written."""
    old, new = tag_name(old), tag_name(new)
    got = notes.where(_has_frontmatter_tag(old)).select("id", _planned(_frontmatter_tags(old, new, nested))("frontmatter").alias("p"))
    return got.where("p.n > 0").select("id", F.col("p.text").alias("frontmatter"), F.col("p.n").alias("n"))


def rename_tag_whole(notes: DataFrame, old: str, new: str, nested: bool = True) -> DataFrame:
    """M2: ``id, content, frontmatter, n`` of each note in which either side changes; ``n`` counts both."""
    old, new = tag_name(old), tag_name(new)
    inline, front = _planned(_inline_tags(old, new, nested)), _planned(_frontmatter_tags(old, new, nested))
    got = notes.where(_has_inline_tag(old) | _has_frontmatter_tag(old)).select("id", "content", "frontmatter", inline("content").alias("c"), front("frontmatter").alias("f"))
    n = F.coalesce("c.n", F.lit(0)) + F.coalesce("f.n", F.lit(0))
    return got.select("id", F.col("c.text").alias("content"), F.col("f.text").alias("frontmatter"), n.alias("n")).where("n > 0")


def rename_heading(notes: DataFrame, note: str, old: str, new: str) -> DataFrame:
    """M3: the heading in its note, and links to it in all notes.  A missing, repeated or already used heading is an error."""
    own = notes.where(F.col("id") == note).select("content").first()
    heads = M.find_headings(own.content if own and own.content else "")
    key = " ".join(old.lower().split())
    hits = [h for h in heads if " ".join(h["text"].lower().split()) == key]
    if len(hits) != 1:
        raise LookupError(f"heading {old!r} was found {len(hits)} times")
    if any(" ".join(h["text"].lower().split()) == " ".join(new.lower().split()) for h in heads):
        raise ValueError(f"heading {new!r} is there already")
    stem = re.escape(re.sub(r"\.md$", "", note.rsplit("/", 1)[-1]))
    path = re.escape(re.sub(r"\.md$", "", note))
    link = re.compile(rf"(\[\[(?:{path}|{stem})(?:\.md)?(?:#[^\[\]|#]*)*?#\s*)({re.escape(old)})(\s*(?=[#|\]]))", re.IGNORECASE)
    head = re.compile(rf"^( {{0,3}}#{{1,6}}\s+){re.escape(hits[0]['text'])}(\s*#*\s*)$")
    at = hits[0]["line"] - 1

    @F.arrow_udf(_PLAN)
    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for i, t in zip(ids.to_pylist(), texts.to_pylist()):
            masked = M.mask_code(t)
            parts, pos, n = [], 0, 0
            for m in link.finditer(masked):
                parts += (t[pos : m.start(2)], new)
                pos, n = m.end(2), n + 1
            t2 = "".join([*parts, t[pos:]])
            if i == note:
                lines = re.split(r"(\r\n|\n|\r)", t2)
                lines[2 * at] = head.sub(lambda m: m[1] + new + m[2], lines[2 * at])
                t2, n = "".join(lines), n + 1
            out.append({"text": t2, "n": n, "samples": []})
        return pa.array(out, type=_PLAN_ARROW)

    got = notes.where((F.col("id") == note) | F.lower("content").contains("#" + old.lower())).where(F.col("content").isNotNull()).select("id", run("id", "content").alias("p"))
    return got.where("p.n > 0").select("id", F.col("p.text").alias("content"), F.col("p.n").alias("n"))


def move_note(notes: DataFrame, old: str, new: str, edges: DataFrame) -> DataFrame:
    """M4: ``id, content, n`` of the notes that link to a moved one in ``edges(source_id, target_id)``, their links rewritten.

    ``[[stem]]`` gets the new stem if that changed, ``[[path]]`` and ``[[path.md]]`` the new path without ``.md``; embeds, aliases and anchors
    stay.  Both are fixed texts, so it is done in the JVM.
    """
    old_path, new_path = old.removesuffix(".md"), new.removesuffix(".md")
    old_stem, new_stem = old_path.rsplit("/", 1)[-1], new_path.rsplit("/", 1)[-1]
    quoted = lambda t: re.sub(r"([^\w\s])", r"\\\1", t)
    put = lambda t: re.sub(r"([\\$])", r"\\\1", t)
    blank, rest = r"[^\S\n]*", r"((?:[#^][^\]|\n]+)?(?:\|[^\]\n]*)?\]\])"
    forms = []
    if old_path != new_path and old_path != old_stem:
        forms.append((rf"(?U)(!?\[\[){blank}{quoted(old_path)}(?:\.md)?{blank}{rest}", new_path))
    elif old_path != new_path:
        forms.append((rf"(?U)(!?\[\[){blank}{quoted(old_path)}\.md{blank}{rest}", new_path))
    if old_stem != new_stem:
        forms.append((rf"(?U)(!?\[\[){blank}{quoted(old_stem)}{blank}{rest}", new_stem))
    sources = edges.where(F.col("target_id").isin(old, f"_stub/{old}") & ~F.col("source_id").isin(old, new)).select(F.col("source_id").alias("id")).distinct()
    content, n = F.col("content"), F.lit(0)
    for pattern, to in forms:
        n = n + F.regexp_count(content, F.lit(pattern))
        content = F.regexp_replace(content, F.lit(pattern), F.lit(f"$1{put(to)}$2"))
    return notes.where(F.contains(F.col("content"), F.lit(old_stem))).join(sources, "id", "left_semi").select("id", content.alias("content"), n.alias("n")).where("n > 0")


# ---- one note at a time -------------------------------------------------------------------------------------------


def diff(old: str, new: str, name: str = "note") -> str:
    """A unified diff."""
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), name, name))


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edit(text: str, mode: str, content: str = "", *, search: str | None = None, fuzzy: float | None = None, heading: str | None = None, op: str = "replace", scope: str = "section", index: int = 0, line: int | None = None, key: str | None = None, value=None, expected: str | None = None) -> str:
    """M5: append, prepend, replace_window, patch_heading, patch_frontmatter or at_line; ``expected`` must equal the text as it is."""
    if expected is not None and expected != text:
        raise ValueError("the note has changed")
    lines = text.split("\n")
    head = M.frontmatter_end(lines)
    match mode:
        case "append":
            return text + ("" if text.endswith("\n") or not text else "\n") + content
        case "prepend":
            return "\n".join([*lines[:head], content, *lines[head:]])
        case "replace_window":
            if text.count(search or "\0") == 1:
                return text.replace(search, content)
            if text.count(search or "\0") > 1:
                raise LookupError("the text to replace is there more than once")
            if fuzzy is None:
                raise LookupError("the text to replace was not found")
            width = len((search or "").split("\n"))
            scored = [(1 - levenshtein("\n".join(lines[i : i + width]).lower(), search.lower()) / max(len(search), len("\n".join(lines[i : i + width])), 1), -i) for i in range(len(lines) - width + 1)]
            best, at = max(scored)
            if best < fuzzy:
                raise LookupError("no stretch is like the text to replace")
            return "\n".join([*lines[:-at], content, *lines[-at + width :]])
        case "patch_heading":
            hits = [h for h in M.sections(text) if " ".join(h["text"].lower().split()) == " ".join((heading or "").lower().split())]
            if not hits:
                raise LookupError(f"no heading {heading!r}")
            h = hits[index]
            end = h["end"] if scope == "section" else next((g["line"] - 1 for g in M.sections(text) if g["line"] > h["line"]), len(lines))
            at = {"replace": (h["line"], end), "before": (h["line"] - 1, h["line"] - 1), "after": (end, end)}[op]
            return "\n".join([*lines[: at[0]], content, *lines[at[1] :]])
        case "patch_frontmatter":
            return update_properties(text, {key: value})
        case "at_line":
            if not line or not 1 <= line <= len(lines):
                raise IndexError(f"no line {line}")
            at = {"before": (line - 1, line - 1), "after": (line, line), "replace": (line - 1, line)}[op]
            return "\n".join([*lines[: at[0]], content, *lines[at[1] :]])
    raise ValueError(f"unknown mode {mode}")


def edit_batch(text: str, edits: list[dict]) -> str:
    """M5, several edits of one note: each sees the text the one before left; if one fails, none is made."""
    for how in edits:
        text = edit(text, **how)
    return text


def update_properties(text: str, put: dict | None = None, remove: list[str] = ()) -> str:
    """M7: frontmatter keys set or removed in place; other lines stay as they are."""
    lines = text.split("\n")
    end = M.frontmatter_end(lines)
    matter = lines[1 : end - 1] if end else []
    spans: dict[str, tuple[int, int]] = {}
    at = None
    for i, line in enumerate([*matter, "\0:"]):
        if m := re.match(r"([^\s#:][^:]*):(?:\s|$)|\0", line):
            if at is not None:
                spans[at[0]] = (at[1], i)
            at = ((m[1] or "").strip("\"' "), i)
    for key in remove:
        if key in spans:
            a, b = spans[key]
            matter[a:b] = [None] * (b - a)
    added = []
    for key, value in (put or {}).items():
        flow = yaml.safe_dump(value, allow_unicode=True, sort_keys=False, default_flow_style=True, width=1 << 20).removesuffix("...\n").strip()
        made = [f"{key}: {flow}"]
        if key in spans and matter[spans[key][0]] is not None:
            a, b = spans[key]
            matter[a:b] = ["\n".join(made), *[None] * (b - a - 1)]
        else:
            added += made
    kept = [x for x in matter if x is not None] + added
    body = lines[end:]
    return "\n".join((["---", *kept, "---"] if kept or end else []) + body)


def set_task_status(text: str, line: int, status: str, expected: str | None = None) -> str:
    """The mark of the task on a line."""
    lines = re.split(r"(\r?\n)", text)
    m = M._TASK.match(lines[2 * (line - 1)]) if 0 < line <= (len(lines) + 1) // 2 else None
    if not m:
        raise LookupError(f"line {line} is no task")
    if expected is not None and (m[3] or "").strip() != expected.strip():
        raise ValueError("the task has changed")
    raw = lines[2 * (line - 1)]
    lines[2 * (line - 1)] = raw[: m.start(2)] + status + raw[m.end(2) :]
    return "".join(lines)


def ensure_block_id(text: str, line: int, block: str) -> tuple[str, str]:
    """The block id on a line, added where there is none."""
    lines = re.split(r"(\r?\n)", text)
    raw = lines[2 * (line - 1)]
    if m := M._BLOCK_ID.search(raw):
        return text, m[1]
    if any(b["block"] == block for b in M.find_block_ids(text)):
        raise ValueError(f"block id {block!r} is taken")
    lines[2 * (line - 1)] = raw.rstrip() + f" ^{block}"
    return "".join(lines), block


def link_notes(text: str, target: str, context: str) -> str:
    """M9: context and link appended to a note."""
    return text.rstrip("\n") + f"\n\n{context} [[{re.sub(r'.md$', '', target)}]]\n"


class Previews:
    """M6: edits held for a while before they are applied, the oldest given up first."""

    def __init__(self, most: int = 50, seconds: float = 300.0):
        self.most, self.seconds, self.held = most, seconds, {}

    def put(self, name: str, path: str, old: str, new: str, now: float) -> None:
        self.held = {k: v for k, v in self.held.items() if now - v[3] <= self.seconds}
        while len(self.held) >= self.most:
            self.held.pop(next(iter(self.held)))
        self.held[name] = (path, old, new, now)

    def take(self, name: str, current: str, now: float) -> tuple[str, str]:
        path, old, new, at = self.held.pop(name)
        if now - at > self.seconds:
            raise LookupError("the preview has expired")
        if current != old:
            raise ValueError("the note has changed")
        return path, new
