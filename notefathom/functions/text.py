"""Scalar column builders: strings, paths, JSON, vectors, dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the reference's host language trims it.
JS_SPACE = "\t\n\x0b\x0c\r \xa0                　﻿"
WORD_BREAK = r"[^\p{L}\p{N}]+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_trim(x: Column | str) -> Column:
    return F.trim(col(x), F.lit(JS_SPACE))


def utf16_length(x: Column | str) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(col(x), "UTF-16BE")) / 2).cast("int")


def utf16_prefix(x: Column | str, n: int) -> Column:
    """The first ``n`` UTF-16 units, a split surrogate pair dropped; code points decide where none is astral."""
    x = col(x)
    astral = x.rlike(r"[\x{10000}-\x{10FFFF}]")
    units = F.encode(x, "UTF-16BE")
    last = F.hex(F.substring(units, 2 * n - 1, 1))
    size = F.when((last >= "D8") & (last <= "DB"), 2 * n - 2).otherwise(2 * n)
    return F.when(astral, F.decode(F.substring(units, F.lit(1), size), "UTF-16BE")).otherwise(F.substring(x, 1, n))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """Base name without ``.md``."""
    return F.regexp_replace(basename(path), r"\.md$", "")


def dirname(path: Column | str) -> Column:
    return F.when(col(path).contains("/"), F.regexp_replace(col(path), r"/[^/]*$", "")).otherwise("")


def top_folder(path: Column | str) -> Column:
    return F.when(col(path).contains("/"), F.split(col(path), "/")[0]).otherwise("(root)")


def in_folder(path: Column | str, folder: str | None) -> Column:
    folder = (folder or "").strip("/")
    return F.lit(True) if not folder else col(path).startswith(folder + "/")


def excerpt(x: Column | str, n: int = 200) -> Column:
    """The trimmed text's first ``n`` units, with ``...`` where text was left out."""
    x = js_trim(x)
    return F.when(utf16_length(x) > n, F.concat(utf16_prefix(x, n), F.lit("..."))).otherwise(x)


def clip(x: Column | str, at: Column | int, n: int = 400) -> Column:
    """a window of ``n`` characters that begins a quarter of it before the 0-based ``at``, with ``…`` where text was left out."""
    x, at = col(x), F.lit(at) if isinstance(at, int) else at
    start = F.greatest(F.least(at - n // 4, F.length(x) - n), F.lit(0))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(x, start + 1, F.lit(n)), F.when(start + n < F.length(x), "…").otherwise(""))
    return F.when(F.length(x) <= n, x).otherwise(cut)


def note_excerpt(content: Column | str, n: int = 200) -> Column:
    """First non-empty paragraph that is no heading (Q5)."""
    paragraphs = F.filter(F.split(col(content), r"\n\n+"), lambda p: (F.trim(p) != "") & ~F.trim(p).startswith("#"))
    return F.coalesce(excerpt(F.trim(F.try_element_at(paragraphs, F.lit(1))), n), F.lit(""))


def heading_key(x: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(x), r"\s+", " ")))


def tokens(x: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(col(x), F.lit(""))), WORD_BREAK), lambda t: t != "")


def valid_json(x: Column | str) -> Column:
    """The text as a variant, null where it is not JSON."""
    return F.try_parse_json(col(x))


def json_value(x: Column | str, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(valid_json(x), "$." + key, kind)


def is_stub(frontmatter: Column | str) -> Column:
    """one definition in place of the reference's several: ``_stub`` is true."""
    fm = col(frontmatter)
    return F.when(fm.contains("_stub"), F.coalesce(json_value(fm, "_stub", "boolean"), F.lit(False))).otherwise(F.lit(False))


def tag_with_parents(tag: Column | str) -> Column:
    """``a/b/c`` as ``[a, a/b, a/b/c]``."""
    parts = F.split(col(tag), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def has_tag(tags: Column, wanted: str) -> Column:
    """ignores case and a leading ``#``; a parent matches its children."""
    w = wanted.lstrip("#").strip().lower()
    norm = lambda t: F.lower(F.regexp_replace(F.trim(t), "^#", ""))
    return F.coalesce(F.exists(tags, lambda t: (norm(t) == w) | norm(t).startswith(w + "/")), F.lit(False))


def distinct_ci(values: Column) -> Column:
    """First of each spelling, case ignored, order kept."""
    low = F.transform(values, lambda v: F.lower(v))
    return F.filter(values, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def locale_key(x: Column | str) -> Column:
    """Sort key in which blanks come before punctuation, digits and letters, and case only breaks ties."""
    x = col(x)
    spread = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), r"(\s)", "\u0001$1"), r"([^\s\u0001\p{L}\p{N}])", "\u0002$1"), r"(\p{N})", "\u0003$1")
    lower_first = F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.struct(F.regexp_replace(spread, r"(\p{L})", "\u0004$1"), lower_first)


def utf16_key(x: Column | str) -> Column:
    """Sort key of UTF-16 order, in which astral characters come before U+E000."""
    return F.encode(col(x), "UTF-16BE")


def posix_normalize(path: Column | str) -> Column:
    """A path without empty, ``.`` and resolvable ``..`` parts; one fold over the parts."""
    p = col(path)
    absolute = p.startswith("/")
    up = lambda s: (F.size(s) > 0) & (F.try_element_at(s, F.lit(-1)) != "..")
    step = lambda s, x: (
        F.when((x == "") | (x == "."), s)
        .when(x != "..", F.concat(s, F.array(x)))
        .when(up(s), F.slice(s, F.lit(1), F.size(s) - 1))
        .when(absolute, s)
        .otherwise(F.concat(s, F.array(x)))
    )
    out = F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
    tail = F.when(p.endswith("/"), "/").otherwise("")
    return F.when(p == "", ".").when(absolute, F.when(out == "", "/").otherwise(F.concat(F.lit("/"), out, tail))).when(out == "", F.concat(F.lit("."), tail)).otherwise(F.concat(out, tail))


def parse_int(x: Column | str) -> Column:
    """Leading digits after blanks and a sign; null where there are none or they are over 64 bits."""
    found = F.regexp_extract(js_trim(x), r"^\+?(-?[0-9]+)", 1)
    plain = js_trim(x).rlike(r"^\+?-?[0-9]") & ~js_trim(x).startswith("+-")
    return F.when(plain, found.try_cast("long"))


def js_number(x: Column | str) -> Column:
    """The number a text stands for: an empty one is 0, anything else that is none is NaN, and so is null."""
    t = js_trim(x)
    good = t.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")
    return F.when(t == "", 0.0).when(good, t.try_cast("double")).otherwise(F.lit(float("nan")))


def number_to_string(x: Column | str) -> Column:
    """A double as ECMAScript writes it: shortest digits, plain from 1e-6 up to 1e21, ``-0`` as ``0``."""
    v = col(x).cast("double")
    # the fewest digits that give the number back; Java's own text has more for some
    exact = [F.format_string(f"%.{p}e", F.abs(v)) for p in range(17)]
    written = F.coalesce(*(F.when(x.cast("double") == F.abs(v), x) for x in exact))
    mantissa, power = F.split(written, "e")[0], F.split(written, "e")[1].cast("int")
    whole, part = F.split(mantissa, r"\.")[0], F.coalesce(F.try_element_at(F.split(mantissa, r"\."), F.lit(2)), F.lit(""))
    digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
    # n: where the point stands, counted from the first digit that is not 0
    n = F.length(whole) + power - (F.length(F.concat(whole, part)) - F.length(digits))
    digits = F.regexp_replace(digits, "0+$", "")
    k = F.length(digits)
    e = F.abs(n - 1).cast("string")
    science = F.concat(F.substring(digits, 1, 1), F.when(k > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), k))).otherwise(""), F.when(n > 0, "e+").otherwise("e-"), e)
    body = (
        F.when((k <= n) & (n <= 21), F.rpad(digits, n, "0"))
        .when((n > 0) & (n <= 21), F.concat(F.substring(digits, F.lit(1), n), F.lit("."), F.substring(digits, n + 1, k)))
        .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), digits))
        .otherwise(science)
    )
    sign = F.when(v < 0, "-").otherwise("")
    return F.when(F.isnan(v), "NaN").when(v == 0, "0").when(F.abs(v) == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, body))


def js_object_order(keys: Column) -> Column:
    """Keys as an object lists them: array indexes first, ascending, then the others as they came."""
    index = lambda k: k.rlike(r"^(?:0|[1-9][0-9]{0,9})$") & (k.try_cast("long") < 4294967295)
    first = F.transform(F.array_sort(F.transform(F.filter(keys, index), lambda k: k.cast("long"))), lambda n: n.cast("string"))
    return F.concat(first, F.filter(keys, lambda k: ~index(k)))


def iso_from_ms(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(col(ms).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def sha256_hex(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(" ", *map(col, parts)), 256)


def short_hash(x: Column | str) -> Column:
    return F.substring(F.sha2(col(x), 256), 1, 16)


def vector(values: list[float]) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot, l2_norm(a) * l2_norm(b))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
