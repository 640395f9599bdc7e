"""Splitting oversized texts at natural boundaries, with overlap (problem 5).

Recursive bisection: a stretch over the limit is cut at the strongest boundary near its midpoint, and its halves are cut
again while they exceed the limit minus the overlap; then each piece gets the last units of the one before in front.  Lengths
are UTF-16 units; no surrogate pair is split.

Boundary strengths, strongest first: sections, fenced blocks, paragraphs, line ends, sentences, white space; inside a
fenced block only line ends and white space count, below sentences.  A cut is forced only inside a stretch without any boundary.

No piece can hold a run over the limit without white space, so a text has such a run exactly if one of its cuts lies within one.  That is how
``p5_found`` tells forced from natural: each cut is looked at with the unbroken stretch around it.

Defined results: null, empty and short texts give no rows; a text over the limit always gives two pieces or more.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

LIMIT, OVERLAP = 2000, 200

SECTION, FENCE, PARAGRAPH, LINE, SENTENCE, FENCED_LINE, SPACE = 7, 6, 5, 4, 3, 2, 1

_LINES = re.compile(r"\r\n|\n|\r")
_FENCE_OPEN = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"#{1,6}\s")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|[。！？][」』）]*")
_SPACES = re.compile(r"\s+")
BLANKS = " \t\r\n"


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code-point positions before which a text may be cut, ascending, and their strengths."""
    strength: dict[int, int] = {}

    def put(at: int, s: int) -> None:
        if 0 < at < len(text) and strength.get(at, 0) < s:
            strength[at] = s

    fence, start, fenced, blank = None, 0, [], False
    ends = [m.end() for m in _LINES.finditer(text)] + [len(text)]
    for end in ends:
        line = text[start:end]
        bare = line.strip()
        if fence:
            put(start, FENCED_LINE)
            if len(bare) >= len(fence) and bare and not bare.strip(fence[0]):
                fence = None
                put(end, FENCE)
                fenced[-1][1] = end
        elif m := _FENCE_OPEN.match(line):
            fence = m[1]
            put(start, FENCE)
            fenced.append([start, len(text)])
        else:
            put(start, SECTION if _HEADING.match(line) else PARAGRAPH if blank and bare else LINE)
        blank = not fence and not bare
        start = end
    inside = iter([*fenced, [len(text) + 1, len(text) + 1]])
    a, b = next(inside)
    for m in _SENTENCE.finditer(text):
        while b <= m.end():
            a, b = next(inside)
        if not a < m.end() < b:
            put(m.end(), SENTENCE)
    for m in _SPACES.finditer(text):
        put(m.end(), SPACE)
    at = np.fromiter(strength, np.int64, len(strength))
    order = np.argsort(at)
    return at[order], np.fromiter(strength.values(), np.int64, len(strength))[order]


def unit_offsets(text: str) -> np.ndarray | None:
    """UTF-16 offset of each code point and of the end; ``None`` where both agree."""
    if text.isascii() or max(text) <= "￿":
        return None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (points > 0xFFFF))])


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """``(start, fresh, end, forced)`` of each piece in code points: its overlap is ``start:fresh``; ``forced`` tells how it ends."""
    units = unit_offsets(text)
    n = len(text) if units is None else int(units[-1])
    if n <= limit:
        return [(0, 0, len(text), False)] if text else []
    at, strength = boundaries(text)
    where = at if units is None else units[at]
    fresh = limit - overlap
    forced: dict[int, bool] = {}
    todo, leaves = [(0, n)], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= (limit if lo == 0 else fresh):
            leaves.append((lo, hi))
            continue
        mid, quarter = (lo + hi) / 2, (hi - lo) / 4
        i, j = np.searchsorted(where, [lo + quarter, hi - quarter])
        if i >= j:
            # a first piece shorter than the overlap would come again whole, so it would gain nothing
            i, j = np.searchsorted(where, lo, "right") if lo else np.searchsorted(where, overlap), np.searchsorted(where, hi)
        if i < j:
            # nearest to the midpoint among the strongest of the window
            best = np.flatnonzero(strength[i:j] == strength[i:j].max()) + i
            cut = int(where[best[np.argmin(np.abs(where[best] - mid))]])
            forced[cut] = False
        else:
            cut = int(mid)
            if units is not None:
                cut = int(units[np.searchsorted(units, cut, "right") - 1])
            if cut <= lo:
                cut = int(units[np.searchsorted(units, lo, "right")])
            forced[cut] = True
        todo += [(cut, hi), (lo, cut)]
    out, last = [], 0
    for lo, hi in leaves:
        start = max(last, lo - overlap)
        if units is not None:
            start = int(units[np.searchsorted(units, start)])
        out.append((start, lo, hi, forced.get(hi, False)))
        last = start
    if units is None:
        return out
    return [(*(int(x) for x in np.searchsorted(units, p[:3])), p[3]) for p in out]


def stretch(text: str, cut: int, limit: int) -> int:
    """UTF-16 length of the stretch without blanks around a cut, looked at up to ``limit`` code points and one more on either side."""
    before, after = text[max(0, cut - limit - 1) : cut], text[cut : cut + limit + 1]
    left = len(before) - 1 - max(before.rfind(c) for c in BLANKS)
    right = min((x for c in BLANKS if (x := after.find(c)) >= 0), default=len(after))
    return _units(text[cut - left : cut + right])


_PIECE = pa.schema([("row_id", pa.int64()), ("piece", pa.int32()), ("n_units", pa.int32()), ("overlap_units", pa.int32()), ("text", pa.string()), ("ends", pa.string()), ("stretch", pa.int32())])
_PIECE_DDL = "row_id long, piece int, n_units int, overlap_units int, text string, ends string, stretch int"


def _units(text: str) -> int:
    return len(text) + (0 if text.isascii() else sum(c > "￿" for c in text))


def pieces(nodes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of each content over ``limit``: ordinal, text with its overlap, and how it ends (natural or forced)."""

    def run(batches):
        for batch in batches:
            rows = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if _units(text) > limit:
                    parts = split(text, limit, overlap)
                    longest = max(stretch(text, fresh, limit) for _, fresh, _, _ in parts[1:])
                    for k, (start, fresh, end, hard) in enumerate(parts):
                        piece = text[start:end]
                        rows.append((rid, k, _units(piece), _units(text[start:fresh]), piece, "forced" if hard else "natural", longest))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_PIECE), _PIECE)], schema=_PIECE)

    # UTF-8 never takes fewer bytes than UTF-16 takes units, so short texts stay in the JVM.
    long = nodes.where(F.octet_length("content") > limit)
    return long.select(F.col("row_id").cast("long"), F.col("content").cast("string")).mapInArrow(run, _PIECE_DDL)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that were split, and whether one of their cuts lies in a run over the limit; each row's first piece stands for it."""
    got = pieces(table(spark, folder, "nodes")).where("piece = 0")
    return got.select("row_id", F.when(F.col("stretch") > LIMIT, "forced").otherwise("natural").alias("cut"))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all oversized contents."""
    return pieces(table(spark, folder, "nodes")).drop("stretch")
