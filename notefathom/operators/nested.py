"""Nested semi-structured records as flat tables with parent links (problem 4).

Each object gets a Merkle identity: its canonical text is built bottom-up, with nested objects replaced by their own
identities, and hashed.  Identical objects are stored once (``subtree_objects``); each occurrence is kept as a bridge row
(``subtree_bridge``) with parent, key and ordinal.  With the rows of the roots beside them, ``rebuilt`` puts the records together again.

Defined results: null, empty, cut-off or otherwise invalid JSON and roots without objects give no rows; a string whose
text is a JSON object or list counts as that value; repeated keys of one object keep the last value.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsontext
from ..session import cut_lineage, table

_MAYBE = re.compile(r"\s*[\[{]")

_BRIDGE = pa.schema([
    ("row_id", pa.int64()), ("obj_path", pa.string()), ("parent_path", pa.string()), ("obj_key", pa.string()),
    ("ordinal", pa.int32()), ("obj_hash", pa.string()), ("parent_hash", pa.string()), ("canonical", pa.string()),
])
_BRIDGE_DDL = "row_id long, obj_path string, parent_path string, obj_key string, ordinal int, obj_hash string, parent_hash string, canonical string"


def _inside(v):
    """The object or list that a string's text is, else the value itself."""
    if isinstance(v, str) and not isinstance(v, jsontext.Number) and _MAYBE.match(v):
        got = jsontext.read(v)
        if isinstance(got, (dict, list)):
            return got
    return v


def _scalar(v) -> str:
    if isinstance(v, jsontext.Number):
        return str(v)
    return json.dumps(v, ensure_ascii=True)


def flatten(root, whole: bool = False) -> list[tuple]:
    """``(path, parent_path, key, ordinal, hash, parent_hash, canonical)`` of each object below ``root``, in document order; with ``whole`` also of
    the root itself, which has no parent.

    Walks with an explicit stack, so depth is not bounded by the interpreter.
    """
    root = _inside(root)
    if not isinstance(root, (dict, list)):
        return []
    # entry: value, path, index of nearest object, key in that object, ordinal in that object, index of container
    found: list[list] = []
    order: list[tuple] = []  # containers in document order, for the bottom-up pass
    stack = [(root, "$", -1, "", 0, -1)]
    while stack:
        v, path, owner, key, ordinal, holder = stack.pop()
        here = len(order)
        order.append((v, holder, owner if not isinstance(v, dict) or path == "$" else len(found)))
        if isinstance(v, dict):
            if path != "$":
                found.append([path, found[owner][0] if owner >= 0 else "$", key, ordinal, None, owner, None])
                owner = len(found) - 1
            items = [(f"{path}.{k}", k, n, x) for n, (k, x) in enumerate(v.items())]
        else:
            items = [(f"{path}[{n}]", key, n, x) for n, x in enumerate(v)]
        for p, k, n, x in reversed(items):
            x = _inside(x)
            if isinstance(x, (dict, list)):
                stack.append((x, p, owner, k, n, here))
    top = text = ""
    below: dict[int, dict[int, str]] = {}
    for n in range(len(order) - 1, -1, -1):
        v, holder, mine = order[n]
        nested = iter(sorted(below.pop(n, {}).items()))
        parts = []
        for k, x in sorted(v.items()) if isinstance(v, dict) else enumerate(v):
            x = _inside(x)
            parts.append((k, None if isinstance(x, (dict, list)) else _scalar(x)))
        if isinstance(v, dict):
            names_of = dict(zip([k for k, x in v.items() if isinstance(_inside(x), (dict, list))], [s for _, s in nested]))
            text = "{" + ",".join(json.dumps(k) + ":" + (s if s is not None else names_of[k]) for k, s in parts) + "}"
        else:
            text = "[" + ",".join(s if s is not None else next(nested)[1] for _, s in parts) + "]"
        if isinstance(v, dict):
            name = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]
            if n:
                found[mine][4], found[mine][6] = name, text
            else:
                top = name
            name = f"#{name}"
        else:
            name = text
        if holder >= 0:
            below.setdefault(holder, {})[n] = name
    out = [(p, pp, k, o, h, found[up][4] if up >= 0 else top, c) for p, pp, k, o, h, up, c in found]
    if whole:
        out.append(("$", None, "", 0, top or hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32], None, text))
    return out


def _bridge(whole: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (root := jsontext.read(text)) is not jsontext.INVALID:
                    rows += [(rid, *x) for x in flatten(root, whole)]
            cols = list(zip(*rows)) if rows else [[]] * len(_BRIDGE)
            cols = [[jsontext.clean(v) if isinstance(v, str) else v for v in c] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _BRIDGE)], schema=_BRIDGE)

    return run


def _texts(nodes: DataFrame, mark: str = "{") -> DataFrame:
    return nodes.where(F.col("frontmatter").contains(mark)).select(F.col("row_id").cast("long"), F.col("frontmatter").cast("string"))


def subtree_bridge(nodes: DataFrame, roots: bool = False) -> DataFrame:
    """One row per occurrence of an object: where it is, its parent, its identity and canonical text; ``roots`` adds a row with path ``$`` per record."""
    return _texts(nodes, "" if roots else "{").mapInArrow(_bridge(roots), _BRIDGE_DDL)


def subtree_objects(bridge: DataFrame) -> DataFrame:
    """Each distinct object once, with the number of its occurrences."""
    return bridge.groupBy("obj_hash").agg(F.first("canonical").alias("canonical"), F.count("*").alias("occurrences"))


_IDENTITY = re.compile(r'"(?:[^"\\]|\\.)*"|#([0-9a-f]{32})')


@F.arrow_udf(T.StringType())
def _expanded(roots: pa.Array, objects: pa.Array) -> pa.Array:
    out = []
    for text, known in zip(roots.to_pylist(), objects.to_pylist()):
        texts = {o["obj_hash"]: o["canonical"] for o in known or []}
        parts, todo = [], [text]
        while todo:  # a stack of texts left to read, so depth is not bounded
            piece, at = todo.pop(), 0
            for m in _IDENTITY.finditer(piece):
                if m[1]:
                    parts.append(piece[at : m.start()])
                    todo += [piece[m.end() :], texts[m[1]]]
                    break
            else:
                parts.append(piece)
        out.append("".join(parts))
    return pa.array(out, pa.string())


def rebuilt(bridge: DataFrame, objects: DataFrame) -> DataFrame:
    """``row_id, record``: the canonical JSON of each record, from a bridge with roots (its canonical texts are not read) and the distinct objects.

    ``row_id`` must be unique; what comes together per record is the objects of that record."""
    each = bridge.select("row_id", "obj_path", "obj_hash").join(objects.select("obj_hash", "canonical"), "obj_hash")
    per = each.groupBy("row_id").agg(F.collect_set(F.when(F.col("obj_path") != "$", F.struct("obj_hash", "canonical"))).alias("known"), F.max(F.when(F.col("obj_path") == "$", F.col("canonical"))).alias("root"))
    return per.select("row_id", _expanded("root", "known").alias("record"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each object inside the frontmatter of ``nodes`` with its parent's path, through the identity bridge."""
    return subtree_bridge(table(spark, folder, "nodes")).select("row_id", "obj_path", "parent_path")


def p4_objects(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct objects of all frontmatter, stored once."""
    return subtree_objects(subtree_bridge(table(spark, folder, "nodes")))


def p4_bridge(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of those objects with parent identity, key and ordinal."""
    return subtree_bridge(table(spark, folder, "nodes")).drop("canonical")


def p4_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every frontmatter that is an object or list, in canonical form, put together from the stored objects and the bridge."""
    bridge = cut_lineage(subtree_bridge(table(spark, folder, "nodes"), roots=True))
    return rebuilt(bridge, subtree_objects(bridge))
