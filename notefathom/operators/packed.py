"""Several values packed in one field: one row per value, with its position (problem 1).

Every distinct field text is parsed with every dialect: which kinds of marks divide, whether blanks do, how quotes are read.  The
distinct parses are its candidates, and the cheapest by description length is taken.

* A value costs ``log2(T / n)`` bits, where ``n`` is the number of distinct texts in which any dialect reads that value and ``T`` the sum of
  all ``n``; both are counted over the whole corpus in a distributed aggregate.
* A dividing mark, or the mark of a quote, that is written bare inside a value is an exception.  It costs ``log2(T) + 1`` bits, what it takes
  to name one value that comes only once, and one more.
* A stray apostrophe is no exception but a doubtful reading; it costs ``APOSTROPHE_BITS``, so how often the values come decides.

The statement fixes that all marks divide and that quotes bind.  The cost of an exception is the least that says so at any size: two values
read as one come in no more texts than either, so leaving a mark inside saves less than ``log2(T)``.  Where a
parse without exceptions is there it therefore wins, and where several are, or none, the counts decide.

Defined results: null, empty and blank fields give no rows; frontmatter that is not a JSON object gives no rows;
objects inside the listed keys give no rows; booleans count as their JSON text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontext
from ..session import cut_lineage, table

KEYS = ("tags", "tag", "aliases", "keywords", "related", "contributors")
BLANK_KEYS = frozenset({"tags", "tag"})

# Marks that divide, by kind.
COMMAS = ",，、､،﹐﹑︐︑՝፣߸᠂᠈꘍꛵⸲⸴⹁⹌"
SEMICOLONS = ";；؛﹔︔⁏⸵;፤꛶"
BARS = "|｜¦￨∣│┃❘❙⏐‖"
DOTS = "·•‣‧∙⋅・･·⸱⸳●◦▪"
LINES = "\n\r\t\x0b\x0c\x1c\x1d\x1e\x85  "
# Opening and closing marks of quotes.
QUOTES = {
    '"': '"', "'": "'", "“": "”“", "‘": "’", "„": "“”", "‚": "‘’", "«": "»", "»": "«", "‹": "›",
    "›": "‹", "「": "」", "『": "』", "＂": "＂", "＇": "＇", "〝": "〞〟", "”": "”", "《": "》", "`": "`",
}
# Dashes that start a list item.
DASHES = "-‐‑‒–—−*+"

#: Cost of an apostrophe at a word's edge that is read as a letter, and of each dialect after the first.
APOSTROPHE_BITS = 4.0
DIALECT_BITS = 0.01

_MARKS = {"comma": COMMAS, "semicolon": SEMICOLONS, "bar": BARS, "dot": DOTS, "line": LINES}
ALL_MARKS = "".join(_MARKS.values())
_KIND = {c: kind for kind, marks in _MARKS.items() for c in marks}
QUOTE_MARKS = frozenset("".join(o + c for o, c in QUOTES.items()))


@lru_cache(64)
def _cut(marks: str, blanks: bool) -> re.Pattern:
    return re.compile(rf"[{re.escape(marks)}" + (r"\s]" if blanks else "]"))


@lru_cache(64)
def _pattern(marks: str, blanks: bool, reading: str) -> re.Pattern:
    """One value at a time: an optional dash and hash, then a quoted stretch, a link or a bare run."""
    cut = re.escape(marks) + (r"\s" if blanks else "")
    opens = "".join(re.escape(x) for x in QUOTES if x != "`")
    ends = rf"(?=\s*(?:[{cut}]|$)|\s+(?:\[\[|[{opens}]))" if not blanks else rf"(?=[{cut}]|$)"
    after = ends if reading == "paired" else ""
    quoted = "|".join(
        rf"{re.escape(o)}(?:[^{re.escape(c)}\\]|\\.|" + "|".join(re.escape(x) * 2 for x in c) + (r"|(?<=\w)'(?=\w)" if o == "'" else r"|(?<=\w)’(?=\w)" if "’" in c else "") + rf")*[{re.escape(c)}]{after}"
        for o, c in QUOTES.items()
    )
    link = r"\[\[(?:(?!\]\]).)*\]\]"
    dash = rf"(?:(?P<dash>[{re.escape(DASHES)}])\s+)?"
    bare = rf"(?:{link}|[^{cut}])+"
    some = rf"(?P<q>\#?(?:{quoted}))|" if reading != "literal" else ""
    return re.compile(rf"\s*{dash}\s*(?:{some}(?P<link>{link}){ends}|(?P<bare>{bare}))", re.DOTALL)


def _unquote(text: str) -> str:
    """Without its quotes and the escapes of their own mark."""
    head = "#" if text[0] == "#" else ""
    text = text[len(head):]
    o, c, inner = text[0], text[-1], text[1:-1]
    for mark in {o, c}:
        inner = inner.replace("\\" + mark, mark).replace(mark * 2, mark) if mark in inner else inner
    return head + inner.strip()


_LINK = re.compile(r"\[\[(?:(?!\]\]).)*\]\]", re.DOTALL)


@lru_cache(2)
def _exceptions(blanks: bool) -> re.Pattern:
    """Dividing marks and marks of quotes, apostrophes aside."""
    opens = "".join(re.escape(x) for x in QUOTES if x not in "'’‘")
    return re.compile(rf"[{re.escape(ALL_MARKS)}{opens}]" + (r"|\s" if blanks else ""))


_STRAY = re.compile(r"(?<!\w)['‘]|['’](?!\w)")


def _strip_list(text: str) -> str:
    """Without list brackets around the whole field; the brackets of a link are none."""
    text = text.strip()
    if len(text) >= 2 and text[0] == "[" and text[-1] == "]" and (text[1:2] != "[" or text[:3] == "[[["):
        return text[1:-1].strip()
    return text


def parse(text: str, marks: str, blanks: bool, reading: str, field_blanks: bool) -> tuple[list[str], int, int]:
    """Values of one dialect, and how many exceptions and stray apostrophes it left inside unquoted ones.

    ``blanks`` tells whether blanks divide in this dialect, ``field_blanks`` whether they should in this field."""
    text = _strip_list(text)
    out, left, stray, at = [], 0, 0, 0
    if "[[" not in text and QUOTE_MARKS.isdisjoint(text):
        for v in _cut(marks, blanks).split(text):
            v = v.strip()
            if len(v) > 1 and v[0] in DASHES and v[1].isspace():
                v = v[2:].lstrip()
            if marks != ALL_MARKS or blanks != field_blanks:
                left += len(_exceptions(field_blanks).findall(v))
            if field_blanks and v[:1] == "#":
                v = v[1:].strip()
            if v and not (len(v) == 1 and v in DASHES):
                out.append(v)
        return out, left, 0
    pattern, exceptions = _pattern(marks, blanks, reading), _exceptions(field_blanks)
    while at < len(text):
        m = pattern.match(text, at)
        if not m or m.end() == at:
            at += 1
            continue
        at = m.end()
        if m.lastgroup == "q" or m["bare"] is None and m["link"] is None:
            v = _unquote(m["q"])
        elif m["link"] is not None:
            v = m["link"]
        else:
            v = m["bare"].strip()
            bare = _LINK.sub("", v) if "[[" in v else v
            left += len(exceptions.findall(bare))
            stray += len(_STRAY.findall(bare))
        if field_blanks and v[:1] == "#":
            v = v[1:].strip()
        if v and not (len(v) == 1 and v in DASHES):
            out.append(v)
    return out, left, stray


_PLAIN = re.compile(r"[\w\-.&+ ]*")
_SPACE = re.compile(r"\s")


def dialects(text: str, blanks: bool) -> list[tuple[str, bool, str]]:
    """``(marks, blanks, reading)`` of the dialects that can differ on a text, the statement's own first."""
    kinds = sorted({_KIND[c] for c in set(text) if c in _KIND})
    quoted = not QUOTE_MARKS.isdisjoint(text)
    spaced = blanks and _SPACE.search(text.strip()) is not None
    out = [(ALL_MARKS, blanks, "paired")]
    if quoted:
        out += [(ALL_MARKS, blanks, "anywhere"), (ALL_MARKS, blanks, "literal")]
    if len(kinds) > 1:
        out += [("".join(m for k, m in _MARKS.items() if k != kind), blanks, "paired") for kind in kinds]
    if kinds:
        out.append(("\0", blanks, "paired"))
    if spaced:
        out.append((ALL_MARKS, False, "paired"))
    return out


def candidates(text: str, blanks: bool) -> list[tuple[list[str], int, float]]:
    """Distinct parses of a text: values, exceptions, and the bits that no corpus changes."""
    if not blanks and _PLAIN.fullmatch(text) and text.strip()[:1] not in DASHES:
        v = text.strip()  # nothing divides, quotes or starts an item: all dialects agree
        return [([v] if v else [], 0, 0.0)]
    seen: list[tuple[list[str], int, float]] = []
    for n, (marks, divide, reading) in enumerate(dialects(text, blanks)):
        vals, left, stray = parse(text, marks, divide, reading, blanks)
        if all(vals != v for v, _, _ in seen):
            seen.append((vals, left, stray * APOSTROPHE_BITS + n * DIALECT_BITS))
    return seen


def elements(value, key: str) -> list[str]:
    """Texts of a field: its own, or each element's of a real list; nulls and objects give none."""
    out = []
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo.extend(reversed(v))
        elif isinstance(v, bool):
            out.append("true" if v else "false")
        elif isinstance(v, str):
            out.append(v)
    return out


_UNIT = pa.schema([("rec_table", pa.string()), ("rec_id", pa.int64()), ("field", pa.string()), ("texts", pa.list_(pa.string()))])
_UNIT_DDL = "rec_table string, rec_id long, field string, texts array<string>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _frontmatter_units(batches):
    for batch in batches:
        rows = []
        for rec_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            obj = jsontext.read(text)
            if isinstance(obj, dict):
                for key in KEYS:
                    if key in obj and (texts := [jsontext.clean(t) for t in elements(obj[key], key) if t]):
                        rows.append(("nodes", rec_id, key, texts))
        yield _batch(rows, _UNIT)


_PARSED = pa.schema([
    ("text", pa.string()), ("blanks", pa.bool_()),
    ("cands", pa.list_(pa.struct([("vals", pa.list_(pa.string())), ("left", pa.int32()), ("bits", pa.float64())]))), ("every", pa.list_(pa.string())),
])
_PARSED_DDL = "text string, blanks boolean, cands array<struct<vals: array<string>, left: int, bits: double>>, every array<string>"


def _parses(batches):
    for batch in batches:
        rows = []
        for text, blanks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = candidates(text, blanks)
            rows.append((text, blanks, [{"vals": v, "left": left, "bits": bits} for v, left, bits in got], list({v for vals, _, _ in got for v in vals})))
        yield _batch(rows, _PARSED)


def texts_of(units: DataFrame) -> DataFrame:
    """``text, blanks`` of every distinct field text."""
    return units.select(F.explode("texts").alias("text"), F.col("field").isin(*BLANK_KEYS).alias("blanks")).distinct()


def parsed(units: DataFrame) -> DataFrame:
    """``tid, text, blanks, cands, every``: the candidates of every distinct text, parsed once and numbered."""
    return cut_lineage(texts_of(units).mapInArrow(_parses, _PARSED_DDL).withColumn("tid", F.monotonically_increasing_id()))


def cheapest(parses: DataFrame) -> DataFrame:
    """``text, blanks, vals, cand, n_cands``: the candidate of least description length of each text."""
    known = parses.select(F.explode("every").alias("val")).groupBy("val").agg(F.count("*").alias("n"))
    total = float(parses.agg(F.coalesce(F.sum(F.size("every")), F.lit(0)).alias("n")).first().n or 1)
    one = parses.where(F.size("cands") == 1).select("text", "blanks", F.col("cands")[0]["vals"].alias("vals"), F.lit(0).alias("cand"), F.lit(1).alias("n_cands"))
    several = parses.where(F.size("cands") > 1)
    # each text's values meet their counts once, however many dialects read them
    lengths = (
        several.select("tid", F.explode("every").alias("val")).join(known, "val")
        .groupBy("tid").agg(F.map_from_entries(F.collect_list(F.struct("val", F.log2(F.lit(total) / F.col("n"))))).alias("lengths"))
    )
    exception = F.log2(F.lit(total)) + 1
    cost = lambda c, m: c["bits"] + c["left"] * exception + F.aggregate(c["vals"], F.lit(0.0), lambda s, v: s + m[v])
    chosen = several.join(lengths, "tid", "left").select(
        "text", "blanks", F.array_min(F.transform("cands", lambda c, i: F.struct(F.coalesce(cost(c, F.col("lengths")), c["bits"]).alias("cost"), i.alias("cand"), c["vals"].alias("vals")))).alias("x"), F.size("cands").alias("n_cands")
    )
    return one.unionByName(chosen.select("text", "blanks", "x.vals", "x.cand", "n_cands"))


def unpack(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """``rec_table, rec_id, field, pos, val``: one row per value of the packed fields of both tables."""
    fm = nodes.where(F.col("frontmatter").isNotNull() & (F.col("frontmatter") != "") & F.col("frontmatter").rlike('"(tags?|aliases|keywords|related|contributors)"|\\\\u'))
    units = cut_lineage(
        fm.select(F.col("row_id").cast("long"), F.col("frontmatter").cast("string")).mapInArrow(_frontmatter_units, _UNIT_DDL)
        .unionByName(records.where(F.col("tags") != "").select(F.lit("note_records").alias("rec_table"), F.col("record_id").cast("long").alias("rec_id"), F.lit("tags").alias("field"), F.array(F.col("tags").cast("string")).alias("texts")))
        .withColumn("unit", F.monotonically_increasing_id())
    )
    cols = ["unit", "rec_table", "rec_id", "field"]
    best = cut_lineage(cheapest(parsed(units)).select("text", "blanks", "vals"))
    asked = units.select(*cols, (F.size("texts") > 1).alias("listed"), F.posexplode("texts").alias("elem", "text")).withColumn("blanks", F.col("field").isin(*BLANK_KEYS))
    read = asked.join(best, ["text", "blanks"]).where(F.size("vals") > 0)
    # only the elements of a list have to come together again, to be counted through
    lists = (
        read.where("listed").groupBy(*cols).agg(F.sort_array(F.collect_list(F.struct("elem", "vals"))).alias("elems"))
        .select(*cols, F.flatten(F.transform("elems", lambda e: e["vals"])).alias("vals"))
    )
    every = read.where("not listed").select(*cols, "vals").unionByName(lists)
    return every.select("rec_table", "rec_id", "field", F.posexplode("vals").alias("pos", "val"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the packed fields of ``nodes`` and ``note_records``."""
    return unpack(table(spark, folder, "nodes"), table(spark, folder, "note_records"))
