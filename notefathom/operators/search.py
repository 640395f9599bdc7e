"""Retrieval: weighted BM25, nearest neighbours, rank fusion, line search."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage

K1, B = 1.2, 0.75

# Words left out when a query is simplified.
STOP_WORDS = frozenset("a an and are as at be by for from how in is it of on or that the this to was what when where which who why with".split())


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, in order."""
    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))


def escape_query(query: str) -> str:
    """as it is when plain, else one quoted phrase."""
    return query if re.fullmatch(r"[A-Za-z0-9_*\s]+", query) else '"' + query.replace('"', '""') + '"'


def simplified(query: str) -> str | None:
    """Q7: a shorter query without stop words, or ``None`` where nothing would be left out."""
    terms = query.split()
    keep = [t for t in terms if t.lower() not in STOP_WORDS][: max(2, -(-len(terms) // 2))]
    return " ".join(keep) if 0 < len(keep) < len(terms) else None


def bm25(docs: DataFrame, query: str, key: str = "id", title: str = "title", body: str = "content", title_weight: float = 5.0, tokens=X.tokens) -> DataFrame:
    """Q1: ``key, score`` of documents with all terms; column weights multiply the term frequency, lengths count both columns.

    For one search over texts without an index.  Only the counts of the query's terms are kept per document, written once, so texts are cut
    into terms once and no posting list is shuffled; ``TextIndex`` serves many searches.  ``tokens`` may be any text-to-array column function (a stemmer, say).
    """
    terms = query_terms(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    both = docs.select(key, tokens(title).alias("a"), tokens(body).alias("b"))
    hits = lambda arr, t: F.size(F.filter(arr, lambda w: w == t))
    counted = cut_lineage(both.select(key, (F.size("a") + F.size("b")).alias("len"), *(F.struct(hits(F.col("a"), t).alias("a"), hits(F.col("b"), t).alias("b")).alias(f"t{i}") for i, t in enumerate(terms))))
    any_of = lambda i: (F.col(f"t{i}.a") + F.col(f"t{i}.b")) > 0
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(any_of(i)).alias(f"d{i}") for i in range(len(terms)))).first()
    if not stats.n or not stats.mean:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        score = score + _gain(stats.n, stats[f"d{i}"], F.col(f"t{i}.a") * title_weight + F.col(f"t{i}.b"), F.col("len"), stats.mean)
    return counted.where(X.all_of([any_of(i) for i in range(len(terms))])).select(key, score.alias("score"))


def _gain(n: int, df: int, tf: Column, length: Column, mean: float) -> Column:
    """What a term adds to a document's score."""
    idf = F.greatest(F.log((F.lit(float(n)) - df + 0.5) / (F.lit(float(df)) + 0.5)), F.lit(1e-6))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def inverted_index(docs: DataFrame, key: str = "id", title: str = "title", body: str = "content", tokens=X.tokens) -> DataFrame:
    """``term, key, len, tf_title, tf_body``; counts combine before the shuffle, which is by term and document, so no term is hot."""
    listed = docs.select(key, tokens(title).alias("a"), tokens(body).alias("b")).withColumn("len", F.size("a") + F.size("b"))
    pair = lambda arr, a, b: F.transform(arr, lambda t: F.struct(t.alias("term"), F.lit(a).alias("a"), F.lit(b).alias("b")))
    words = listed.select(key, "len", F.explode(F.concat(pair("a", 1, 0), pair("b", 0, 1))).alias("w"))
    return words.groupBy("w.term", key, "len").agg(F.sum("w.a").cast("int").alias("tf_title"), F.sum("w.b").cast("int").alias("tf_body"))


class TextIndex:
    """Q1 on stored postings: built once, written to ``path`` by term bucket and sorted by term, so a search reads its terms' pages only.

    A bucket takes several files, so that the postings of a term that most documents have are not written by one task.
    """

    def __init__(self, path: str, key: str, schema, buckets: int, documents: int, mean: float):
        self.path, self.key, self.schema, self.buckets, self.documents, self.mean = path, key, schema, buckets, documents, mean

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: str = "id", title: str = "title", body: str = "content", buckets: int = 64, tokens=X.tokens) -> TextIndex:
        postings = inverted_index(docs, key, title, body, tokens).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        postings.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(path)
        stored = docs.sparkSession.read.schema(postings.schema).parquet(path)
        own = stored.agg(F.coalesce(F.sum(F.col("tf_title") + F.col("tf_body")), F.lit(0)).alias("words")).first()
        n = docs.count()
        return cls(path, key, postings.schema, buckets, n, own.words / n if n else 0.0)

    def search(self, query: str, spark, title_weight: float = 5.0) -> DataFrame:
        """``key, score`` of the documents with all terms."""
        terms = query_terms(query)
        found = spark.read.schema(self.schema).parquet(self.path)
        buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).distinct().collect()]
        found = found.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        counts = {r.term: r.n for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}
        if not terms or len(counts) < len(terms):
            return found.select(self.key, F.lit(0.0).alias("score")).limit(0)
        gain: Column = F.lit(0.0)
        for t in terms:
            gain = F.when(F.col("term") == t, _gain(self.documents, counts[t], F.col("tf_title") * title_weight + F.col("tf_body"), F.col("len"), self.mean)).otherwise(gain)
        # terms in the query's order, so that sums do not hang on the order of rows
        got = found.groupBy(self.key).agg(*(F.sum(F.when(F.col("term") == t, gain)).alias(f"g{i}") for i, t in enumerate(terms)))
        every = [F.col(f"g{i}") for i in range(len(terms))]
        return got.where(X.all_of([g.isNotNull() for g in every])).select(self.key, sum(every[1:], every[0]).alias("score"))


def snippet(content: Column | str, terms: list[str], words: int = 40) -> Column:
    """Words around the first hit, hits in ``>>>``/``<<<``, cut ends as ``...``."""
    w = F.split(F.trim(F.regexp_replace(X.col(content), r"\s+", " ")), " ")
    hit = lambda x: F.exists(X.tokens(x), lambda t: t.isin(terms))
    marked = F.transform(w, lambda x: F.when(hit(x), F.concat(F.lit(">>>"), x, F.lit("<<<"))).otherwise(x))
    at = F.array_position(F.transform(w, hit), F.lit(True))
    start = F.greatest(at.cast("int") - words // 4, F.lit(1))
    return F.concat(F.when(start > 1, "...").otherwise(""), F.array_join(F.slice(marked, start, F.lit(words)), " "), F.when(start + words <= F.size(w), "...").otherwise(""))


def top(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """O1/O2: the best ``k``, ties by key; runs as a bounded heap per partition."""
    return rows.orderBy(F.col(score).desc(), key).limit(k)


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", metric: str = "l2") -> DataFrame:
    """Q6: ``key, score`` with score 1 - distance."""
    v = F.col("embedding")
    score = 1 - X.l2_distance(v, X.vector(query)) if metric == "l2" else X.cosine(v, X.vector(query))
    return top(vectors.where(v.isNotNull() & (F.size(v) == len(query))).select(key, score.alias("score")), "score", key, k)


#: Queries that are broadcast (512 bytes each at 64 dimensions); more meet the vectors in a grid of blocks.
QUERY_BLOCK = 4096
#: Vectors of one block of that grid.
VECTOR_BLOCK = 65_536


def _nearest(ids: np.ndarray, q: np.ndarray, base: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, vectors and distances of the best ``k`` of each query, ties with the last kept; itself left out."""
    d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T, 0))
    d[ids[:, None] == base[None, :]] = np.inf
    most = min(k, d.shape[1])
    cut = np.partition(d, most - 1, axis=1)[:, most - 1 : most]
    qi, vi = np.nonzero((d <= cut + 1e-12) & np.isfinite(d))
    return ids[qi], base[vi], d[qi, vi]


def _matrix(column) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """``query_id, key, score``: exact neighbours of many queries, itself left out; the vectors are scanned once.

    Few queries are broadcast and every Arrow batch of vectors meets all of them in a matrix product.  More are cut into blocks, as are the vectors, and
    each pair of blocks is a task of its own; what crosses the shuffle is each side once per block of the other.  Either way a
    task sends on its best ``k`` a query only.  Compared are all pairs of a query and a vector, which the answer needs.
    """
    spark, names = vectors.sparkSession, ["query_id", key, "score"]
    schema = f"query_id long, {key} long, score double"
    width = queries.agg(F.max(F.size("embedding")).alias("n")).first().n or 0  # vectors of another size are no neighbours
    usable = F.col("embedding").isNotNull() & (F.size("embedding") == max(1, width))
    asked = queries.where(usable).select(F.col(key).cast("long"), "embedding")
    held = vectors.where(usable).select(F.col(key).cast("long"), "embedding")
    n = asked.count()
    if n <= QUERY_BLOCK:
        got = asked.orderBy(key).toArrow()
        if not n:
            return held.select(F.lit(0).cast("long").alias("query_id"), key, F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        sent = spark.sparkContext.broadcast((got.column(0).to_numpy(), _matrix(got.column(1))))

        def scan(batches):
            ids, q = sent.value
            for batch in batches:
                if batch.num_rows:
                    a, b, d = _nearest(ids, q, batch.column(0).to_numpy(), _matrix(batch.column(1)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(1 - d)], names)

        out = held.mapInArrow(scan, schema)
    else:
        rows, cols = -(-n // QUERY_BLOCK), max(1, -(-held.count() // VECTOR_BLOCK))
        own = lambda size: F.pmod(F.xxhash64(key), F.lit(size)).cast("int")
        each = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
            a, b, d = _nearest(left.column(key).to_numpy(), _matrix(left.column("embedding")), right.column("base").to_numpy(), _matrix(right.column("vector")), k)
            return pa.table([pa.array(a), pa.array(b), pa.array(1 - d)], names)

        left = asked.withColumn("row", own(rows)).withColumn("col", each(cols)).groupBy("row", "col")
        # names of its own: both sides may come from one table
        right = held.select(F.col(key).alias("base"), F.col("embedding").alias("vector"), own(cols).alias("vcol"), each(rows).alias("vrow")).groupBy("vrow", "vcol")
        out = left.cogroup(right).applyInArrow(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_chunk(hits: DataFrame, note: str = "node_id", score: str = "score", order: str = "chunk_index") -> DataFrame:
    """The best hit of each note, the earlier of equals."""
    rest = [c for c in hits.columns if c != note]
    return hits.groupBy(note).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(order))).alias("x")).select(note, "x.*")


def fuse(lists: list[DataFrame], key: str, k: int, constant: int = 60) -> DataFrame:
    """Q4: reciprocal rank fusion of ranked lists ``key, score``; the first list a document is in gives it its place among equals."""
    parts = []
    for n, rows in enumerate(lists):
        rank = F.row_number().over(Window.orderBy(F.col("score").desc(), key))  # lists are cut to a few rows before
        parts.append(rows.select(key, (1.0 / (constant + rank)).alias("part"), (rank + F.lit(n * 1_000_000)).alias("seen")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key).agg(F.sum("part").alias("score"), F.min("seen").alias("seen")).orderBy(F.desc("score"), "seen").limit(k).select(key, "score")


def chunk_hits(vectors: DataFrame, chunks: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """Q3: the nearest chunks themselves: ``chunk_id, node_id, heading, start_line, end_line, excerpt, score``."""
    near = knn(vectors, query, k, "chunk_id")
    rows = chunks.select(F.col("id").alias("chunk_id"), "node_id", "heading", "start_line", "end_line", X.excerpt("content").alias("excerpt"))
    return near.join(rows, "chunk_id").select("chunk_id", "node_id", "heading", "start_line", "end_line", "excerpt", "score").orderBy(F.desc("score"), "chunk_id")


def semantic_notes(vectors: DataFrame, chunks: DataFrame, query: list[float], k: int = 20, note_vectors: DataFrame | None = None) -> DataFrame:
    """The best notes by their best chunk, from four times as many chunks; with no chunks at all, by the notes' own vectors."""
    if note_vectors is not None and not vectors.limit(1).count():
        return knn(note_vectors, query, k, "node_id").select("node_id", F.lit(None).cast("int").alias("chunk_index"), "score")
    hits = knn(vectors, query, 4 * k, "chunk_id").join(chunks.select(F.col("id").alias("chunk_id"), "node_id", "chunk_index"), "chunk_id")
    return best_chunk(hits).select("node_id", "chunk_index", "score").orderBy(F.desc("score"), "node_id").limit(k)


def search_notes(docs: DataFrame, scores: DataFrame, query: str, key: str = "id", title: str = "title", body: str = "content") -> DataFrame:
    """Scored documents with title and snippet, best first."""
    rows = docs.select(key, F.col(title).alias("title"), snippet(body, query_terms(query)).alias("snippet"))
    return scores.join(rows, key).select(key, "title", "score", "snippet").orderBy(F.desc("score"), key)


def with_chunks(fused: DataFrame, hits: DataFrame, key: str = "node_id") -> DataFrame:
    """Q4, ``unique=chunks``: the fields of each note's best chunk beside its fused score."""
    best = best_chunk(hits, key).select(key, "chunk_id", "heading", "start_line", "end_line", "excerpt")
    return fused.join(best, key, "left").orderBy(F.desc("score"), key)


def grep_page(notes: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = False, context: int = 1, per_file: int = 5, files: int = 20, width: int = 400) -> DataFrame:
    """F5 as it is asked: ``id, line, text, before, after, more``: the first ``per_file`` hits of the first ``files`` notes that have any, long
    lines clipped around the hit; ``more`` tells of hits left out.  The notes are cut before their lines are taken apart."""
    needle = ("" if case_sensitive else "(?i)") + (safe_pattern(pattern) if regex else re.escape(pattern).replace("\\ ", " "))
    lines = F.split("content", r"\r?\n")
    some = notes.where(F.exists(lines, lambda x: x.rlike(needle))).orderBy("id").limit(files).select("id", lines.alias("lines"))
    hit = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), F.regexp_instr(x, F.lit(needle)).alias("first"))), lambda h: F.get("lines", h["at"]).rlike(needle))
    rows = some.select("id", "lines", hit.alias("hits")).select("id", "lines", (F.size("hits") > per_file).alias("more"), F.explode(F.slice("hits", 1, per_file)).alias("h"))
    clipped = lambda a, n: F.transform(F.slice("lines", a, n), lambda x: X.clip(x, 0, width))
    start = F.greatest(F.col("h.at") - context, F.lit(0))
    return rows.select(
        "id", (F.col("h.at") + 1).alias("line"), X.clip(F.get("lines", F.col("h.at")), F.greatest(F.col("h.first") - 1, F.lit(0)), width).alias("text"),
        clipped(start + 1, F.col("h.at") - start).alias("before"), clipped(F.col("h.at") + 2, F.lit(context)).alias("after"), "more",
    )


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float], k: int = 20, key: str = "id") -> DataFrame:
    """Q4 over both searches, each asked for twice as many."""
    text = top(bm25(docs, query, key), "score", key, 2 * k)
    near = knn(vectors, vector, 2 * k, key)
    return fuse([near, text], key, k)


def grep(notes: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = False, context: int = 1, per_file: int | None = None) -> DataFrame:
    """``id, line, text, before, after`` of matching lines; context stays inside the note's own array, so nothing is shuffled
    unless ``per_file`` cuts."""
    needle = (pattern if regex else re.escape(pattern).replace("\\ ", " ")) if case_sensitive else "(?i)" + (pattern if regex else re.escape(pattern).replace("\\ ", " "))
    lines = F.split("content", r"\r?\n")
    rows = notes.where(F.col("content").rlike(needle)).select("id", lines.alias("lines")).select("id", "lines", F.posexplode("lines").alias("at", "text")).where(F.col("text").rlike(needle))
    part = lambda a, n: F.array_join(F.slice("lines", a, n), "\n")
    first = F.greatest(F.col("at") - context, F.lit(0))
    rows = rows.select("id", (F.col("at") + 1).alias("line"), "text", part(first + 1, F.col("at") - first).alias("before"), part(F.col("at") + 2, F.lit(context)).alias("after"))
    if per_file is not None:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("line"))).where(F.col("r") <= per_file).drop("r")
    return rows


_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[+*}](?:[^()\\]|\\.)*\)[+*{]")


def safe_pattern(pattern: str, most: int = 500) -> str:
    """a pattern that is short, compiles and has no nested quantifiers; named groups in the JVM's spelling."""
    if len(pattern) > most:
        raise ValueError(f"pattern is longer than {most} characters")
    if _NESTED.search(pattern):
        raise ValueError("pattern has nested quantifiers")
    try:
        re.compile(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", pattern))
    except re.error as e:
        raise ValueError(f"pattern does not compile: {e}") from None
    return pattern
