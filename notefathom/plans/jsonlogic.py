"""JsonLogic filters compiled once to Catalyst columns (F1, F2 and the operator table of SURVEY 2.2).

Each expression becomes a ``Value``: its type, number, text and truth as columns, each foldable on its own, so a comparison of two texts
becomes a plain column comparison after optimisation and reaches the scan.  ``interpret`` evaluates the same language row
by row in Python; it is what the tests hold the compiler against.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAZY = ("if", "?:", "and", "or", "filter", "map", "all", "none", "some", "reduce")
EAGER = ("==", "!=", "===", "!==", ">", ">=", "<", "<=", "!!", "!", "%", "-", "/", "+", "*", "min", "max", "merge", "in", "cat", "substr", "var", "missing", "missing_some", "log", "has_tag")
NAN = float("nan")


class UnknownOperation(ValueError):
    """An operation that is not in the language."""


def operation(logic: Any) -> tuple[str, list] | None:
    """The operation of a one-key object and its arguments; anything else is data."""
    if not isinstance(logic, dict) or len(logic) != 1:
        return None
    op, args = next(iter(logic.items()))
    if op not in LAZY and op not in EAGER:
        raise UnknownOperation(f"Unrecognized operation {op}")
    return op, args if isinstance(args, list) else [args]


# ---- columns ------------------------------------------------------------------------------------------------------


@dataclass
class Value:
    """A JavaScript value as columns: ``t`` its type, ``n`` as a number, ``s`` as a text, ``b`` its truth, ``items`` its elements, ``j`` as JSON text."""

    t: Column
    n: Column
    s: Column
    b: Column
    items: Column
    j: Column
    path: Callable[[str], Value] | None = None


_NONE_ITEMS = "array<variant>"


def _no_items() -> Column:
    return F.lit(None).cast(_NONE_ITEMS)


def _number_of(text: Column) -> Column:
    low = F.trim(text)
    return F.when(low == "", 0.0).when(low.rlike(r"^[-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|Infinity)$"), low.try_cast("double")).otherwise(NAN)


def _text_of(number: Column) -> Column:
    whole = (number == F.floor(number)) & (F.abs(number) < 1e21)
    return F.when(F.isnan(number), "NaN").when(whole, number.try_cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))


def _quoted(text: Column) -> Column:
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def null() -> Value:
    return Value(F.lit("null"), F.lit(0.0), F.lit("null"), F.lit(False), _no_items(), F.lit("null"))


#: Longer expressions are bound to a name before they are used more than once.
_LONG = 300


def _bound(make: Callable[[Column], Value], c: Column) -> Value:
    """``make(c)`` with a long ``c`` evaluated once per part, by way of an array of one; a column itself stays plain and can be pushed down."""
    if len(c._jc.toString()) < _LONG:
        return make(c)

    def part(name: str) -> Column:
        return F.element_at(F.transform(F.array(c), lambda x: getattr(make(x), name)), 1)

    shape = make(F.lit(None).cast("variant") if make in (_dynamic,) else F.lit(None).cast("array<variant>") if make is _array else F.lit(None).cast("string"))
    return Value(*(part(x) for x in ("t", "n", "s", "b", "items", "j")), (lambda p: _bound(dynamic, F.try_variant_get(c, p, "variant"))) if shape.path else None)


def flag(c: Column) -> Value:
    """A truth value that is never null."""
    txt = F.when(c, "true").otherwise("false")
    return Value(F.lit("boolean"), F.when(c, 1.0).otherwise(0.0), txt, c, _no_items(), txt)


def text(c: Column) -> Value:
    return _bound(_text, c)


def number(c: Column) -> Value:
    return _bound(_number, c)


def boolean(c: Column) -> Value:
    return _bound(_boolean, c)


def array(items: Column) -> Value:
    return _bound(_array, items)


def dynamic(v: Column) -> Value:
    return _bound(_dynamic, v)


def _text(c: Column) -> Value:
    there = c.isNotNull()
    return Value(F.when(there, "string").otherwise("null"), F.when(there, _number_of(c)).otherwise(0.0), F.coalesce(c, F.lit("null")), F.coalesce(c != "", F.lit(False)), _no_items(), F.when(there, _quoted(c)).otherwise("null"))


def _number(c: Column) -> Value:
    c = c.cast("double")
    there = c.isNotNull()
    return Value(F.when(there, "number").otherwise("null"), F.coalesce(c, F.lit(0.0)), F.when(there, _text_of(c)).otherwise("null"), F.coalesce((c != 0) & ~F.isnan(c), F.lit(False)), _no_items(), F.when(there, _text_of(c)).otherwise("null"))


def _boolean(c: Column) -> Value:
    there = c.isNotNull()
    return Value(F.when(there, "boolean").otherwise("null"), F.coalesce(c.cast("double"), F.lit(0.0)), F.coalesce(c.cast("string"), F.lit("null")), F.coalesce(c, F.lit(False)), _no_items(), F.coalesce(c.cast("string"), F.lit("null")))


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))), ",")


def _array(items: Column) -> Value:
    there = items.isNotNull()
    s = _joined(items)
    js = F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.coalesce(F.to_json(x), F.lit("null"))), ","), F.lit("]"))
    return Value(F.when(there, "array").otherwise("null"), F.when(there, _number_of(s)).otherwise(0.0), F.when(there, s).otherwise("null"), F.coalesce(F.size(items) > 0, F.lit(False)), items, F.coalesce(js, F.lit("null")))


def _dynamic(v: Column) -> Value:
    """A variant; its type is known per row only."""
    kind = F.schema_of_variant(v)
    t = (
        F.when(v.isNull() | kind.isin("VOID") | F.is_variant_null(v), "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )
    s = F.try_variant_get(v, "$", "string")
    d = F.try_variant_get(v, "$", "double")
    items = F.try_variant_get(v, "$", _NONE_ITEMS)
    n = F.when(t == "null", 0.0).when(t == "string", _number_of(s)).when(t == "boolean", F.try_variant_get(v, "$", "boolean").cast("double")).when(t == "array", _number_of(_joined(items))).when(t == "object", NAN).otherwise(d)
    txt = F.when(t == "null", "null").when(t == "array", _joined(items)).when(t == "object", "[object Object]").when(t == "number", _text_of(d)).otherwise(s)
    b = F.when(t == "null", False).when(t == "string", s != "").when(t == "array", F.size(items) > 0).when(t == "object", True).when(t == "boolean", F.try_variant_get(v, "$", "boolean")).otherwise((d != 0) & ~F.isnan(d))
    return Value(t, n, txt, F.coalesce(b, F.lit(False)), F.when(t == "array", items), F.coalesce(F.to_json(v), F.lit("null")), lambda p: dynamic(F.try_variant_get(v, p, "variant")))


def constant(v: Any) -> Value:
    if v is None:
        return null()
    if isinstance(v, bool):
        return boolean(F.lit(v))
    if isinstance(v, (int, float)):
        return number(F.lit(float(v)))
    if isinstance(v, str):
        return text(F.lit(v))
    return dynamic(F.parse_json(F.lit(json.dumps(v))))


def of_column(c: Column, kind: T.DataType) -> Value:
    if isinstance(kind, T.StringType):
        return text(c)
    if isinstance(kind, T.BooleanType):
        return boolean(c)
    if isinstance(kind, T.NumericType):
        return number(c)
    if isinstance(kind, T.VariantType):
        return dynamic(c)
    if isinstance(kind, T.ArrayType):
        return array(F.transform(c, lambda x: x.cast("variant")))
    return dynamic(F.try_parse_json(F.to_json(c)))


def _choose(cases: list[tuple[Column, Value]], last: Value) -> Value:
    """The first value whose condition holds; every part of it is chosen on its own."""

    def part(name: str) -> Column:
        out = getattr(last, name)
        for cond, v in reversed(cases):
            out = F.when(cond, getattr(v, name)).otherwise(out)
        return out

    return Value(*(part(x) for x in ("t", "n", "s", "b", "items", "j")))


def _loose(a: Value, b: Value) -> Column:
    nothing = (a.t == "null") | (b.t == "null")
    compound = a.t.isin("array", "object") & b.t.isin("array", "object")
    texts = ((a.t == "string") & b.t.isin("string", "array", "object")) | ((b.t == "string") & a.t.isin("array", "object"))
    return F.when(nothing, (a.t == "null") & (b.t == "null")).when(compound, False).when(texts, a.s == b.s).otherwise((a.n == b.n) & ~F.isnan(a.n))


def _strict(a: Value, b: Value) -> Column:
    return F.when(a.t != b.t, False).when(a.t == "string", a.s == b.s).when(a.t == "null", True).when(a.t.isin("array", "object"), False).otherwise((a.n == b.n) & ~F.isnan(a.n))


def _less(a: Value, b: Value, equal: bool) -> Column:
    texts, nums = (a.s <= b.s, a.n <= b.n) if equal else (a.s < b.s, a.n < b.n)
    return F.when((a.t == "string") & (b.t == "string"), texts).when(F.isnan(a.n) | F.isnan(b.n), False).otherwise(nums)


def _leading(v: Value) -> Column:
    """The number a text begins with."""
    return F.coalesce(F.nullif(F.regexp_extract(v.s, r"^\s*([-+]?(?:Infinity|\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?))", 1), F.lit("")).try_cast("double"), F.lit(NAN))


class Compiler:
    """Compiles against the columns of a table; a JSON text column may be declared as data."""

    def __init__(self, schema: T.StructType, json_columns: tuple[str, ...] = ("frontmatter",)):
        self.schema, self.json_columns = schema, json_columns

    def condition(self, logic: Any) -> Column:
        """A boolean column for a filter; the filter must be an operation."""
        if not isinstance(logic, dict) or len(logic) != 1:
            raise ValueError("a filter is an object with one operation")
        return self.compile(logic, self.column).b

    def column(self, path: str) -> Value:
        head, _, rest = path.partition(".")
        if head not in self.schema.fieldNames():
            return null()
        field = self.schema[head]
        v = dynamic(F.try_parse_json(F.col(head))) if head in self.json_columns and isinstance(field.dataType, T.StringType) else of_column(F.col(head), field.dataType)
        return _walk(v, rest) if rest else v

    def compile(self, logic: Any, scope: Callable[[str], Value]) -> Value:
        if isinstance(logic, list):
            parts = [self.compile(x, scope) for x in logic]
            return array(F.array(*(F.parse_json(p.j) for p in parts)) if parts else F.array().cast(_NONE_ITEMS))
        found = operation(logic)
        if found is None:
            return constant(logic)
        op, args = found
        if op in LAZY:
            return self._lazy(op, args, scope)
        if op == "var":
            return self._var(args, scope)
        vals = [self.compile(a, scope) for a in args]
        one = lambda i: vals[i] if i < len(vals) else null()
        match op:
            case "==":
                return flag(_loose(one(0), one(1)))
            case "!=":
                return flag(~_loose(one(0), one(1)))
            case "===":
                return flag(_strict(one(0), one(1)))
            case "!==":
                return flag(~_strict(one(0), one(1)))
            case ">" | ">=":
                return flag(_less(one(1), one(0), op == ">="))
            case "<" | "<=":
                both = _less(one(0), one(1), op == "<=")
                return flag(both & _less(one(1), one(2), op == "<=") if len(vals) > 2 else both)
            case "!!":
                return flag(one(0).b)
            case "!":
                return flag(~one(0).b)
            case "%":
                return number(F.when(one(1).n == 0, NAN).otherwise(F.try_mod(one(0).n, one(1).n)))
            case "-":
                return number(-one(0).n if len(vals) == 1 else one(0).n - one(1).n)
            case "/":
                zero = F.when(F.isnan(one(0).n) | (one(0).n == 0), NAN).otherwise(F.signum(one(0).n) * F.lit(math.inf))
                return number(F.when(one(1).n == 0, zero).otherwise(F.try_divide(one(0).n, one(1).n)))
            case "+" | "*":
                out = _leading(one(0)) if vals else F.lit(0.0 if op == "+" else 1.0)
                for v in vals[1:]:
                    out = out + _leading(v) if op == "+" else out * _leading(v)
                return number(out)
            case "min" | "max":
                if not vals:
                    return number(F.lit(math.inf if op == "min" else -math.inf))
                bad = F.lit(False)
                for v in vals:
                    bad = bad | F.isnan(v.n)
                pick = vals[0].n if len(vals) == 1 else (F.least if op == "min" else F.greatest)(*(v.n for v in vals))
                return number(F.when(bad, NAN).otherwise(pick))
            case "merge":
                return array(F.concat(*(F.coalesce(v.items, F.array(F.parse_json(v.j))) for v in vals)) if vals else F.array().cast(_NONE_ITEMS))
            case "in":
                a, b = one(0), one(1)
                member = F.coalesce(F.exists(b.items, lambda x: _strict(dynamic(x), a)), F.lit(False))
                return flag(F.when(b.t == "string", (b.s != "") & F.contains(b.s, a.s)).when(b.t == "array", member).otherwise(False))
            case "cat":
                return text(F.concat(*(F.when(v.t == "null", "").otherwise(v.s) for v in vals)) if vals else F.lit(""))
            case "substr":
                s, start = one(0).s, one(1).n.cast("int")
                size = F.length(s)
                begin = F.when(start < 0, F.greatest(size + start, F.lit(0))).otherwise(F.least(start, size))
                if len(vals) < 3:
                    return text(F.substring(s, begin + 1, F.greatest(size, F.lit(0))))
                count = one(2).n.cast("int")
                return text(F.substring(s, begin + 1, F.greatest(F.when(count < 0, size - begin + count).otherwise(count), F.lit(0))))
            case "missing" | "missing_some":
                return self._missing(op, args, scope)
            case "has_tag":
                return flag(self._has_tag(args, vals, scope))
            case _:
                return one(0)

    def _var(self, args: list, scope: Callable[[str], Value]) -> Value:
        key = args[0] if args else ""
        if isinstance(key, dict):
            raise ValueError("var needs a path that is known when the filter is compiled")
        path = "" if key is None else str(key)
        v = scope(path)
        if len(args) < 2:
            return v
        return _choose([(v.t != "null", v)], self.compile(args[1], scope))

    def _lazy(self, op: str, args: list, scope: Callable[[str], Value]) -> Value:
        if op in ("if", "?:"):
            cases = [(self.compile(args[i], scope).b, self.compile(args[i + 1], scope)) for i in range(0, len(args) - 1, 2)]
            return _choose(cases, self.compile(args[-1], scope) if len(args) % 2 else null())
        if op in ("and", "or"):
            vals = [self.compile(a, scope) for a in args]
            if not vals:
                return null()
            return _choose([(v.b if op == "or" else ~v.b, v) for v in vals[:-1]], vals[-1])
        over = self.compile(args[0], scope) if args else null()
        body = args[1] if len(args) > 1 else None
        inner = lambda x: self.compile(body, lambda p: _walk(dynamic(x), p) if p else dynamic(x))
        items = F.coalesce(over.items, F.array().cast(_NONE_ITEMS))
        match op:
            case "filter":
                return array(F.filter(items, lambda x: inner(x).b))
            case "map":
                return array(F.transform(items, lambda x: F.parse_json(inner(x).j)))
            case "all":
                return flag((F.size(items) > 0) & F.coalesce(F.forall(items, lambda x: inner(x).b), F.lit(False)))
            case "none":
                return flag(~F.exists(items, lambda x: inner(x).b))
            case "some":
                return flag(F.exists(items, lambda x: inner(x).b))
        first = self.compile(args[2], scope) if len(args) > 2 else null()

        def step(acc: Column, x: Column) -> Column:
            def at(p: str) -> Value:
                head, _, rest = p.partition(".")
                v = dynamic(x) if head == "current" else dynamic(F.parse_json(acc)) if head == "accumulator" else null()
                return _walk(v, rest) if rest else v

            return self.compile(body, at).j

        got = dynamic(F.parse_json(F.aggregate(items, first.j, step)))
        return _choose([(over.items.isNotNull(), got)], first)

    def _missing(self, op: str, args: list, scope: Callable[[str], Value]) -> Value:
        need, keys = (1, args) if op == "missing" else (args[0], args[1])
        if op == "missing" and len(keys) == 1 and isinstance(keys[0], list):
            keys = keys[0]
        gone = [(k, (v := scope(str(k))).t.isin("null") | ((v.t == "string") & (v.s == ""))) for k in keys]
        lost = F.filter(F.array(*(F.when(c, F.lit(str(k))) for k, c in gone)) if gone else F.array().cast("array<string>"), lambda x: x.isNotNull())
        if op == "missing_some":
            lost = F.when(F.lit(len(keys)) - F.size(lost) >= need, F.array().cast("array<string>")).otherwise(lost)
        return array(F.transform(lost, lambda x: x.cast("variant")))

    def _has_tag(self, args: list, vals: list[Value], scope: Callable[[str], Value]) -> Column:
        tags = vals[0] if len(vals) > 1 else scope("tags")
        wanted = F.lower(F.regexp_replace(F.trim((vals[1] if len(vals) > 1 else vals[0]).s), "^#", ""))
        norm = lambda x: F.lower(F.regexp_replace(F.trim(F.try_variant_get(x, "$", "string")), "^#", ""))
        return F.coalesce(F.exists(tags.items, lambda x: (norm(x) == wanted) | F.startswith(norm(x), F.concat(wanted, F.lit("/")))), F.lit(False))


def _walk(v: Value, path: str) -> Value:
    """A dotted path into a value: keys, list positions, ``length``."""
    for part in path.split("."):
        if part == "length":
            size = F.when(v.t == "array", F.size(v.items)).when(v.t == "string", F.length(v.s))
            plain = v.path("$['length']") if v.path else null()
            v = _choose([(v.t.isin("array", "string"), number(size))], plain)
        elif v.path:
            v = v.path(f"$[{part}]" if part.isdigit() else f"$['{part}']")
        elif part.isdigit():
            got = dynamic(F.try_element_at(v.items, F.lit(int(part) + 1)))
            v = _choose([(v.t == "string", text(F.nullif(F.substring(v.s, int(part) + 1, 1), F.lit(""))))], got)
        else:
            return null()
    return v


def compile_filter(df: DataFrame, logic: Any, json_columns: tuple[str, ...] = ("frontmatter",)) -> Column:
    """A boolean column over ``df``."""
    return Compiler(df.schema, json_columns).condition(logic)


# ---- row by row, for tests ----------------------------------------------------------------------------------------


def _truthy(v: Any) -> bool:
    return bool(v) if not isinstance(v, (list, dict, float)) else len(v) > 0 if isinstance(v, list) else True if isinstance(v, dict) else v != 0 and not math.isnan(v)


def _js_text(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(int(v)) if not math.isinf(v) and not math.isnan(v) and v == int(v) else "NaN" if math.isnan(v) else str(v)
    if isinstance(v, list):
        return ",".join("" if x is None else _js_text(x) for x in v)
    return "[object Object]" if isinstance(v, dict) else v


def _js_number(v: Any) -> float:
    if v is None:
        return 0.0
    if isinstance(v, (bool, int, float)):
        return float(v)
    if isinstance(v, dict):
        return NAN
    s = _js_text(v).strip()
    if not s:
        return 0.0
    return float(s) if re.fullmatch(r"[-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|Infinity)", s) else NAN


def _js_leading(v: Any) -> float:
    m = re.match(r"\s*([-+]?(?:Infinity|\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?))", _js_text(v))
    return float(m[1]) if m else NAN


def _kind(v: Any) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _eq(a: Any, b: Any, strict: bool) -> bool:
    ka, kb = _kind(a), _kind(b)
    if strict and ka != kb:
        return False
    if "null" in (ka, kb):
        return ka == kb
    if ka in ("array", "object") and kb in ("array", "object"):
        return False
    if "string" in (ka, kb) and {ka, kb} <= {"string", "array", "object"}:
        return _js_text(a) == _js_text(b)
    return _js_number(a) == _js_number(b)


def _lt(a: Any, b: Any, equal: bool) -> bool:
    if isinstance(a, str) and isinstance(b, str):
        return a <= b if equal else a < b
    x, y = _js_number(a), _js_number(b)
    return x <= y if equal else x < y


def _get(data: Any, path: Any) -> Any:
    if path in ("", None):
        return data
    for part in str(path).split("."):
        if isinstance(data, dict):
            data = data.get(part)
        elif isinstance(data, (list, str)) and part == "length":
            data = len(data)
        elif isinstance(data, (list, str)) and part.isdigit():
            data = data[int(part)] if int(part) < len(data) else None
        else:
            return None
    return data


def interpret(logic: Any, data: Any) -> Any:
    """The value of an expression over one record."""
    if isinstance(logic, list):
        return [interpret(x, data) for x in logic]
    found = operation(logic)
    if found is None:
        return logic
    op, args = found
    run = lambda x: interpret(x, data)
    if op in ("if", "?:"):
        for i in range(0, len(args) - 1, 2):
            if _truthy(run(args[i])):
                return run(args[i + 1])
        return run(args[-1]) if len(args) % 2 else None
    if op in ("and", "or"):
        v = None
        for a in args:
            v = run(a)
            if _truthy(v) == (op == "or"):
                break
        return v
    if op in LAZY:
        over = run(args[0]) if args else None
        items, body = over if isinstance(over, list) else [], args[1] if len(args) > 1 else None
        if op == "reduce":
            acc = run(args[2]) if len(args) > 2 else None
            for x in items:
                acc = interpret(body, {"current": x, "accumulator": acc})
            return acc
        if op == "map":
            return [interpret(body, x) for x in items]
        hits = [x for x in items if _truthy(interpret(body, x))]
        return {"filter": hits, "all": bool(items) and len(hits) == len(items), "none": not hits, "some": bool(hits)}[op]
    if op == "var":
        v = _get(data, args[0] if args else "")
        return run(args[1]) if v is None and len(args) > 1 else v
    v = [run(a) for a in args]
    one = lambda i: v[i] if i < len(v) else None
    match op:
        case "==" | "!=":
            return _eq(one(0), one(1), False) == (op == "==")
        case "===" | "!==":
            return _eq(one(0), one(1), True) == (op == "===")
        case ">" | ">=":
            return _lt(one(1), one(0), op == ">=")
        case "<" | "<=":
            return _lt(one(0), one(1), op == "<=") and (len(v) < 3 or _lt(one(1), one(2), op == "<="))
        case "!!" | "!":
            return _truthy(one(0)) == (op == "!!")
        case "%":
            a, b = _js_number(one(0)), _js_number(one(1))
            return math.fmod(a, b) if b and not math.isnan(b) and not math.isinf(a) else NAN
        case "-":
            return -_js_number(one(0)) if len(v) == 1 else _js_number(one(0)) - _js_number(one(1))
        case "/":
            a, b = _js_number(one(0)), _js_number(one(1))
            return a / b if b else NAN if not a or math.isnan(a) else math.copysign(math.inf, a)
        case "+":
            return sum(map(_js_leading, v), 0.0)
        case "*":
            return math.prod(map(_js_leading, v))
        case "min" | "max":
            n = list(map(_js_number, v))
            return NAN if any(map(math.isnan, n)) else (min if op == "min" else max)(n, default=math.inf if op == "min" else -math.inf)
        case "merge":
            return [y for x in v for y in (x if isinstance(x, list) else [x])]
        case "in":
            hay = one(1)
            return bool(hay) and _js_text(one(0)) in hay if isinstance(hay, str) else isinstance(hay, list) and any(_eq(x, one(0), True) for x in hay)
        case "cat":
            return "".join("" if x is None else _js_text(x) for x in v)
        case "substr":
            s, start = _js_text(one(0)), int(_js_number(one(1)))
            start = max(0, len(s) + start) if start < 0 else start
            end = len(s) if len(v) < 3 else len(s) + int(v[2]) if v[2] < 0 else start + int(v[2])
            return s[start : max(start, end)]
        case "missing":
            keys = v[0] if len(v) == 1 and isinstance(v[0], list) else v
            return [k for k in keys if _get(data, k) in (None, "")]
        case "missing_some":
            gone = [k for k in v[1] if _get(data, k) in (None, "")]
            return [] if len(v[1]) - len(gone) >= v[0] else gone
        case "has_tag":
            tags, wanted = (v[0], v[1]) if len(v) > 1 else (_get(data, "tags"), v[0])
            w = _js_text(wanted).strip().removeprefix("#").lower()
            norm = [str(t).strip().removeprefix("#").lower() for t in tags or []]
            return any(t == w or t.startswith(w + "/") for t in norm)
    return one(0)
