"""Counting sketches of a fixed size, summed over all rows in a distributed aggregate.

A sketch has ``2 ** bits`` cells.  Tasks count into dense cells and send their non-empty slices; slices are summed per slice number in
levels of at most ``FAN`` parts, so no task ever holds one part per input task.  They come to the driver as one byte per cell, so
what is collected and broadcast never grows with the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BITS = 16
#: Parts of one slice that a task sums.
FAN = 64
_SLICE = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
_SLICE_DDL = "slice int, part int, counts binary"


def coded(counts: np.ndarray) -> np.ndarray:
    """One byte per count, in order of size: exact to 127, then in steps of a fifth of a doubling."""
    c = counts.astype(np.float64)
    return np.where(c <= 127, c, np.minimum(255, 127 + np.ceil(5 * np.log2(np.maximum(c, 127) / 127)))).astype(np.uint8)


def decoded(codes: np.ndarray) -> np.ndarray:
    """About the count of each code, from above."""
    c = codes.astype(np.float64)
    return np.where(c <= 127, c, 127 * 2 ** ((c - 127) / 5))


def sketch(rows: DataFrame, cells_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], bits: int) -> np.ndarray:
    """Coded counts; ``cells_of`` gives the cells of a batch and how often each is hit, cells in any order, repeats allowed."""
    wide = 1 << min(bits, SLICE_BITS)

    def partial(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            cells, hits = cells_of(batch)
            if len(cells):
                cells, at = np.unique(cells, return_inverse=True)
                counts[cells] += np.bincount(at, weights=hits).astype(np.uint32)
        part = TaskContext.get().partitionId()
        for k in range(len(counts) // wide):
            some = counts[k * wide : (k + 1) * wide]
            if some.any():
                yield _slice(k, part, zlib.compress(some.astype(np.uint64).tobytes(), 1))

    def total(data: pa.Table) -> np.ndarray:
        out = np.zeros(wide, np.uint64)
        for part in data.column("counts"):
            out += np.frombuffer(zlib.decompress(part.as_py()), np.uint64)
        return out

    def level(data: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_slice(data.column("slice")[0].as_py(), data.column("part")[0].as_py() // FAN, zlib.compress(total(data).tobytes(), 1))])

    def last(data: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_slice(data.column("slice")[0].as_py(), 0, zlib.compress(coded(total(data)).tobytes(), 1))])

    sums = rows.mapInArrow(partial, _SLICE_DDL)
    parts = rows._jdf.queryExecution().toRdd().getNumPartitions()
    while parts > FAN:
        sums = sums.groupBy("slice", F.floor(F.col("part") / FAN).alias("of")).applyInArrow(level, _SLICE_DDL)
        parts = -(-parts // FAN)
    cells = np.zeros(1 << bits, np.uint8)
    for r in sums.groupBy("slice").applyInArrow(last, _SLICE_DDL).collect():  # 2 ** bits bytes at most
        cells[r.slice * wide : (r.slice + 1) * wide] = np.frombuffer(zlib.decompress(r.counts), np.uint8)
    return cells


def _slice(k: int, part: int, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([counts], pa.binary())], schema=_SLICE)
