"""The vector lane: exact, two-stage and hashed nearest neighbours by dot product.

Frames: vectors (doc_id, embedding); queries (query, vector); hits (query, rank, doc_id, score).
Scores are raw dot products in every mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import ranked

#: Queries that travel to every task at once; more are dealt into blocks instead.
BLOCK_QUERIES = 4096
#: Scores that a task holds at a time.
TILE = 1 << 22
HITS = "query long, doc_id string, score double"
_HITS = pa.schema([("query", pa.int64()), ("doc_id", pa.string()), ("score", pa.float64())])


def preview_limit(k: int, n: int) -> int:
    """Candidates of the two-stage search."""
    return min(max(16 * k, 64), n)


def approximate_limit(k: int, n: int) -> int:
    """Candidates of the hashed search."""
    return min(max(8 * k, 64), n)


def auto_mode(n: int, approximate: bool, preview: bool) -> str:
    """exact up to 64 vectors; beyond that the fastest that is there."""
    if n <= 64:
        return "exact"
    return "approximate" if approximate else "preview" if preview else "exact"


def runtime_mode(mode: str, n: int, approximate: bool = False, preview: bool = False, cold: bool = False) -> str:
    """The mode that runs: auto resolves, cold starts under auto are exact, missing backends fall back to exact."""
    if mode == "auto":
        return "exact" if cold else auto_mode(n, approximate, preview)
    if mode == "approximate" and not approximate or mode == "preview" and not preview:
        return "exact"
    return mode


def check_dimensions(expected: int, got: int) -> None:
    if expected != got:
        raise ValueError(f"query vector dimensions do not match lane dimensions: expected {expected}, got {got}")


def invalid_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Rows that an ingest refuses: wrong length, or an id that is there twice."""
    wrong = vectors.where(F.coalesce(F.size("embedding") != dimensions, F.lit(True))).select("doc_id", F.lit("dimensions").alias("reason"))
    twice = vectors.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit("duplicate").alias("reason"))
    return wrong.unionByName(twice)


def _matrix(column) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.empty((0, 0))


def _best(ids: np.ndarray, query_ids: np.ndarray, scores: np.ndarray, k: int) -> pa.RecordBatch:
    """Per query the k best of a block, by score and then id; a score of minus infinity is no hit."""
    out_q, out_d, out_s = [], [], []
    for q in range(len(query_ids)):
        row = scores[q]
        near = np.flatnonzero((row >= np.partition(row, len(row) - k)[len(row) - k]) & (row > -np.inf)) if len(row) > k else np.flatnonzero(row != -np.inf)
        order = sorted(near.tolist(), key=lambda i: (-row[i], ids[i].encode()))[:k]
        out_q += [int(query_ids[q])] * len(order)
        out_d += [ids[i] for i in order]
        out_s += [float(row[i]) for i in order]
    return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_d, pa.string()), pa.array(out_s, pa.float64())], schema=_HITS)


def _buckets(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(table, row): the signs of the random projections as bits of a bucket's number."""
    tables, bits, dimensions = planes.shape
    sides = (vectors @ planes.reshape(-1, dimensions).T > 0).reshape(-1, tables, bits)
    return np.ascontiguousarray((sides << np.arange(bits)).sum(axis=2).T.astype(np.uint16))


def _tiles(ids: np.ndarray, query_ids: np.ndarray, points: np.ndarray, vectors: np.ndarray, k: int, planes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The k best of each query, from products of at most TILE scores at a time; planes: among those alone that share a bucket in some table."""
    step = max(1, TILE // len(ids))
    if planes is not None:
        of, asked = _buckets(vectors, planes), _buckets(points, planes)
    for a in range(0, len(query_ids), step):
        scores = points[a : a + step] @ vectors.T
        if planes is not None:
            mates = np.zeros(scores.shape, bool)
            for t in range(len(of)):
                mates |= asked[t, a : a + step, None] == of[t]
            scores[~mates] = -np.inf
        yield _best(ids, query_ids[a : a + step], scores, k)


def search_exact(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int = 32_768, planes: np.ndarray | None = None) -> DataFrame:
    """The k largest dot products of each query over all vectors (planes: over those that share a bucket with it, see search_hashed).

    Up to BLOCK_QUERIES queries go to the tasks that scan the vectors, which pass on k rows a batch
    and query. More queries are dealt into blocks, and so are the vectors; each pair of blocks is a
    task's matrix product. Either way a window picks the k best.
    """
    if k == 0:
        return queries.sparkSession.createDataFrame([], "query long, rank int, doc_id string, score double")
    vectors = vectors.select(F.col("doc_id").cast("string").alias("doc_id"), "embedding")
    queries = queries.select(F.col("query").cast("long").alias("query"), "vector")
    few = queries.limit(BLOCK_QUERIES + 1).toArrow()
    if len(few) <= BLOCK_QUERIES:
        query_ids, points = np.asarray(few["query"]), _matrix(few["vector"])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(query_ids):
                    yield from _tiles(np.array(batch.column("doc_id").to_pylist(), object), query_ids, points, _matrix(batch.column("embedding")), k, planes)

        found = vectors.mapInArrow(scan, HITS)
    else:
        parts, blocks = -(-queries.count() // BLOCK_QUERIES), max(1, -(-vectors.count() // block_rows))
        tasks = parts * blocks
        left = queries.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = vectors.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

        def grid(q: pa.Table, v: pa.Table) -> pa.Table:
            if not len(q) or not len(v):
                return _HITS.empty_table()
            return pa.Table.from_batches(list(_tiles(np.array(v["doc_id"].to_pylist(), object), np.asarray(q["query"]), _matrix(q["vector"]), _matrix(v["embedding"]), k, planes)))

        # by number, so that no small shuffle is gathered into a few tasks
        left, right = (x.repartition(tasks, "part", "block") for x in (left, right))
        found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(grid, HITS)
    return ranked(found, k).select("query", "rank", "doc_id", "score")


def rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact scores of candidates (query, doc_id), k best a query."""
    from ..functions.vectors import dot

    pairs = candidates.select("query", "doc_id").join(vectors.select(F.col("doc_id").cast("string").alias("doc_id"), "embedding"), "doc_id").join(queries.select("query", "vector"), "query")
    return ranked(pairs.select("query", "doc_id", dot(F.col("embedding"), F.col("vector")).alias("score")), k).select("query", "rank", "doc_id", "score")


def search_preview(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Two stages: candidates by the product with byte-quantised vectors, then exact scores."""
    from ..functions.vectors import quantized

    limit = preview_limit(k, vectors.count())
    small = vectors.select("doc_id", quantized(F.col("embedding")).alias("embedding"))
    return rerank(search_exact(queries, small, limit), queries, vectors, k)


#: Bits of a hash at most; a search uses the first of them.
MAX_BITS = 16


def hash_planes(dimensions: int, tables: int, seed: int = 7) -> np.ndarray:
    """Random planes (table, bit, dimension); fewer bits are a prefix of more."""
    return np.random.default_rng(seed).standard_normal((tables, MAX_BITS, dimensions))


def calibrated_bits(queries: DataFrame, vectors: DataFrame, k: int, dimensions: int, tables: int, recall: float, sample: int = 64) -> int:
    """Most bits at which the tables offer `recall` of the exact k best of a sample of the queries; 0 if none do.

    Rows that equal their query are left out: they share every bucket.
    """
    asked = queries.orderBy(F.xxhash64("query"), "query").limit(sample).select("query", "vector")
    asked = queries.sparkSession.createDataFrame(asked.toArrow(), asked.schema)
    best = search_exact(asked, vectors, k + 1).select("query", "doc_id", "rank").join(vectors.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")), "doc_id")
    pairs = best.join(asked.select("query", F.col("vector").cast("array<double>").alias("vector")), "query").where("embedding <> vector").orderBy("query", "rank").toArrow()
    if not len(pairs):
        return MAX_BITS
    query = np.asarray(pairs["query"])
    first = np.searchsorted(query, query)
    kept = np.arange(len(query)) - first < k
    planes = hash_planes(dimensions, tables).reshape(-1, dimensions)
    equal = ((_matrix(pairs["vector"])[kept] @ planes.T > 0) == (_matrix(pairs["embedding"])[kept] @ planes.T > 0)).reshape(-1, tables, MAX_BITS)
    shared = np.sort(np.logical_and.accumulate(equal, axis=2).sum(axis=2).max(axis=1))[::-1]
    return int(shared[int(np.ceil(recall * len(shared))) - 1])


def search_hashed(queries: DataFrame, vectors: DataFrame, k: int, dimensions: int, tables: int = 12, recall: float = 0.96) -> DataFrame:
    """Approximate: all rows that share a bucket in some table, by exact scores.

    The bits of a bucket are calibrated so that the recall of sampled queries is reached at any size;
    where no number of bits reaches it, the search is exact. Bucket mates are told by comparing the
    numbers of buckets in the blocks of search_exact, so no row a pair is written: vectors without structure
    take few bits, and then a query has most of the table as mates.
    """
    bits = calibrated_bits(queries, vectors, k, dimensions, tables, recall)
    return search_exact(queries, vectors, k, planes=hash_planes(dimensions, tables)[:, :bits] if bits else None)


def search(queries: DataFrame, vectors: DataFrame, k: int, dimensions: int, mode: str = "auto", cold: bool = False) -> DataFrame:
    """Any mode; auto chooses by the number of vectors."""
    chosen = runtime_mode(mode, vectors.count() if mode == "auto" else 0, True, True, cold)
    if k == 0 or dimensions == 0 or chosen == "exact":
        return search_exact(queries, vectors, k if dimensions else 0)
    return search_preview(queries, vectors, k) if chosen == "preview" else search_hashed(queries, vectors, k, dimensions)
