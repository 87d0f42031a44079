"""Feature-hash embeddings: token counts in hashed buckets, scaled to unit length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.hashing import fnv1a_bucket, fnv1a_many
from ..functions.text import tokens

#: Counts and tokens that a task holds at a time, and words whose hashes it remembers.
TILE = 1 << 20
MOST_WORDS = 400_000


def _counted(documents: DataFrame, dimensions: int) -> DataFrame:
    """(doc_id, bucket, n, squares) of each row's buckets that are not zero; squares: the sum of the row's n * n. A narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            sizes = np.asarray(batch.column("tokens").value_lengths(), np.int64)
            rows = max(1, TILE // dimensions)
            group = np.maximum.accumulate((np.cumsum(sizes) - sizes) // TILE) * len(sizes) + np.arange(len(sizes)) // rows
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:]):
                coded = batch.column("tokens").slice(a, b - a).flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                if len(known) > MOST_WORDS:
                    known.clear()
                new = [w for w in words if w not in known]
                known.update(zip(new, (fnv1a_many(new) % np.uint64(dimensions)).tolist()))
                bucket = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[np.asarray(coded.indices, np.int64)]
                counts = np.bincount(np.repeat(np.arange(b - a), sizes[a:b]) * dimensions + bucket, minlength=(b - a) * dimensions).reshape(b - a, dimensions)
                owner, held = np.nonzero(counts)
                squares = (counts * counts).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).take(pa.array(owner)), pa.array(held, pa.int64()), pa.array(counts[owner, held], pa.int64()), pa.array(squares[owner], pa.int64())], ["doc_id", "bucket", "n", "squares"])

    rows = documents.select("doc_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], *(StructField(c, LongType()) for c in ("bucket", "n", "squares"))]))


def sparse(documents: DataFrame, dimensions: int) -> DataFrame:
    """(doc_id, bucket, weight) of the buckets that are not zero; texts without tokens have no row.

    A row is counted where it lies. Only rows whose id occurs again (or is null) are shuffled, since
    rows of one id count as one document.
    """
    weight = lambda squares: (F.col("n") / F.sqrt(squares.cast("double"))).alias("weight")
    again = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("again"))
    if again.isEmpty():
        return _counted(documents, dimensions).select("doc_id", "bucket", weight(F.col("squares")))
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    once = _counted(documents.join(again, same, "left_anti"), dimensions).select("doc_id", "bucket", weight(F.col("squares")))
    summed = _counted(documents.join(again, same, "left_semi"), dimensions).groupBy("doc_id", "bucket").agg(F.sum("n").alias("n"))
    squares = F.sum(F.col("n") * F.col("n")).over(W.partitionBy("doc_id"))
    return once.unionByName(summed.select("doc_id", "bucket", weight(squares)))


def embed(documents: DataFrame, dimensions: int) -> DataFrame:
    """documents with an embedding column: array<float> of unit length, zeros for texts without tokens, empty for 0 dimensions.

    All in one row's expressions, without a shuffle: occurrences per bucket by counting equal buckets.
    """
    if dimensions == 0:
        return documents.withColumn("embedding", F.array().cast("array<float>"))
    hashed = documents.withColumn("_b", F.array_sort(F.transform(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")), lambda t: fnv1a_bucket(t, dimensions).cast("int"))))
    start = F.transform(F.sequence(F.lit(1), F.lit(dimensions)), lambda _: F.lit(0.0))
    # runs of equal buckets in the sorted array become (bucket, count) pairs
    runs = F.transform(F.array_distinct("_b"), lambda b: F.struct(b.alias("b"), F.size(F.filter("_b", lambda x: x == b)).cast("double").alias("n")))
    sums = F.map_from_entries(F.col("_runs"))
    norm = F.sqrt(F.aggregate(F.col("_runs"), F.lit(0.0), lambda s, r: s + r["n"] * r["n"]))
    dense = F.transform(start, lambda _, i: F.coalesce(F.try_element_at(F.col("_sums"), i) / F.col("_norm"), F.lit(0.0)).cast("float"))
    return hashed.withColumn("_runs", runs).withColumn("_sums", sums).withColumn("_norm", norm).withColumn("embedding", dense).drop("_b", "_runs", "_sums", "_norm")
