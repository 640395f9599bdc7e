"""Encoding a whole corpus with a byte-level BPE vocabulary (problem 6).

Text is cut into pre-tokens by a JVM regular expression; each Arrow batch is dictionary-encoded, so Python merges each distinct
pre-token once, and the ids are gathered back by index arithmetic.  Merging uses a hierarchical-bitmap
rank queue: a bucket per merge rank holds linked-list positions, find-first-set over three bitmap levels picks the next
rank, and stale positions are skipped, so a pre-token of n bytes takes O(n) queue steps however long it is.

Defined results: null and empty texts give an empty list; text that looks like a special token is plain text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public pre-token pattern of the vocabulary, white space spelled as the Unicode property.
PRETOKEN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|"
    r"\p{IsWhite_Space}+(?![^\p{IsWhite_Space}])|\p{IsWhite_Space}+"
)
_CACHE_ENTRIES = 200_000


class RankQueue:
    """Positions by rank, smallest rank first; three levels of 64-bit words show which ranks have any."""

    __slots__ = ("buckets", "levels")

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.levels: tuple[dict[int, int], dict[int, int], dict[int, int]] = ({}, {}, {})

    def push(self, rank: int, at: int) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(at)
            return
        self.buckets[rank] = [at]
        for level in self.levels:
            word = level.get(rank >> 6, 0)
            level[rank >> 6] = word | 1 << (rank & 63)
            rank >>= 6

    def pop(self) -> tuple[int, list[int]] | None:
        """The smallest rank and its positions, left to right."""
        word = self.levels[2].get(0, 0)
        if not word:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        found, key = self.buckets.pop(rank), rank
        for level in self.levels:
            word = level[key >> 6] & ~(1 << (key & 63))
            level[key >> 6] = word
            if word:
                break
            key >>= 6
        found.sort()
        return rank, found


class Encoder:
    """Ids of pre-tokens by the ranks of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        n = len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue()
        for i in range(n - 1):
            if (r := ranks.get(word[i : i + 2])) is not None:
                queue.push(r, i)
        while got := queue.pop():
            rank, places = got
            for i in places:
                left, j = part[i], after[i]
                if left is None or j >= n or ranks.get(left + part[j]) != rank:
                    continue  # stale: one side has been merged since
                part[i], part[j] = left + part[j], None
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (r := ranks.get(part[i] + part[k])) is not None:
                        queue.push(r, i)
                if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                    queue.push(r, h)
        return tuple(ranks[p] for p in part if p is not None)

    def ids(self, pretoken: str) -> tuple[int, ...]:
        found = self.cache.get(pretoken)
        if found is None:
            word = pretoken.encode()
            whole = self.ranks.get(word)
            found = (whole,) if whole is not None else self.merge(word)
            if len(word) <= 64:
                if len(self.cache) >= _CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[pretoken] = found
        return found


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def _gathered(batch: pa.ListArray, enc: Encoder, values: bool) -> tuple[np.ndarray | None, np.ndarray]:
    """Ids of all documents in a row (if asked for), and the number of ids of each document."""
    sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = batch.flatten()
    ends = np.cumsum(sizes)
    if not len(flat):
        return np.empty(0, np.int32), np.zeros(len(sizes), np.int64)
    coded = flat.dictionary_encode()
    pieces = [enc.ids(x) for x in coded.dictionary.to_pylist()]
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    index = coded.indices.to_numpy()
    counts = lengths[index]
    total = np.concatenate([[0], np.cumsum(counts)])
    per_doc = total[ends] - total[ends - sizes]
    if not values:
        return None, per_doc
    every = np.fromiter((i for p in pieces for i in p), np.int32, int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(starts[index] - total[:-1], counts) + np.arange(total[-1])
    return every[at], per_doc


def _ids_udf(path: str):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path)
        for batch in batches:
            ids, per_doc = _gathered(batch, enc, True)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32()), pa.array(ids, pa.int32()))

    return run


def _count_udf(path: str):
    @F.arrow_udf(T.LongType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path)
        for batch in batches:
            yield pa.array(_gathered(batch, enc, False)[1], pa.int64())

    return run


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PRETOKEN), F.lit(0))


def token_ids(text: Column, path: str = VOCABULARY) -> Column:
    """Ids of a text, without special tokens."""
    return _ids_udf(path)(pretokens(text))


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of ids of a text."""
    return _count_udf(path)(pretokens(text))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document."""
    return table(spark, folder, "documents").select("doc_id", token_ids(F.col("text")).alias("ids"))
