"""Arrow-batched helpers: Python runs once per distinct value of a batch, never once per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

_CACHE_ENTRIES = 200_000


def mapped_values(values: pa.Array, fn: Callable, kind: pa.DataType, cache: dict) -> pa.Array:
    """``fn`` of each value, computed once per distinct one; ``cache`` lives as long as the task and is bounded."""
    coded = values.dictionary_encode()
    out = []
    for v in coded.dictionary.to_pylist():
        if v not in cache:
            if len(cache) >= _CACHE_ENTRIES:
                cache.clear()
            cache[v] = fn(v)
        out.append(cache[v])
    return pa.array(out, type=kind).take(coded.indices)


def per_value(fn: Callable, returns: DataType, kind: pa.DataType) -> Callable[..., Column]:
    """A column function that maps each distinct non-null string of an Arrow batch through ``fn``; null gives null."""

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict = {}
        for batch in batches:
            yield mapped_values(batch, fn, kind, cache)

    return run


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema, kind: pa.Schema) -> DataFrame:
    """``mapInArrow`` with plain lists: ``fn`` gets one batch as name -> list and gives the output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fn(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in kind], schema=kind)

    return df.mapInArrow(run, schema)
