"""Reciprocal-rank fusion and the limits around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import ranked

#: Fixed value: the constant of reciprocal-rank fusion.
RRF_K = 60


def hybrid_text_limit(k: int, documents: int) -> int:
    """Text candidates of an interactive hybrid search; the vector lane takes k."""
    return min(documents, max(10 * k, 100)) if k and documents else 0


def filtered_limit(k: int, documents: int) -> int:
    """Candidates of a lane whose hits are filtered afterwards."""
    return min(max(64 * k, 64), 4096, documents) if k else 0


def fuse(text_hits: DataFrame, vector_hits: DataFrame, k: int | None) -> DataFrame:
    """(query, rank, doc_id, text_rank, vector_rank, score): sum of 1 / (60 + rank) over the lanes, the k best (None: all)."""
    text = text_hits.select("query", "doc_id", F.col("rank").alias("text_rank"))
    vector = vector_hits.select("query", "doc_id", F.col("rank").alias("vector_rank"))
    share = lambda c: F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0))
    both = text.join(vector, ["query", "doc_id"], "full_outer").withColumn("score", share("text_rank") + share("vector_rank"))
    return ranked(both, k).select("query", "rank", "doc_id", "text_rank", "vector_rank", "score")
