"""Retrieval quality: graded metrics per query and their means.

Frames: qrels (query_id, doc_id, relevance 0..3); results (query_id, rank, doc_id), ranks from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("ndcg_at_10", "ndcg_at_20", "recall_at_10", "recall_at_100", "precision_at_10", "mrr_at_10", "success_at_1", "success_at_3")


def _gain(relevance: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1.0)


def per_query(qrels: DataFrame, results: DataFrame) -> DataFrame:
    """One row a judged query with all metrics and its unrated hits (whole list, in rank order); queries without results score 0."""
    hits = results.join(qrels.select("query_id").distinct(), "query_id", "left_semi").join(qrels, ["query_id", "doc_id"], "left")
    relevance, good = F.coalesce("relevance", F.lit(0)), F.coalesce(F.col("relevance") > 0, F.lit(False))
    upto = lambda k: F.col("rank") <= k
    dcg = lambda k: F.coalesce(F.sum(F.when(upto(k), _gain(relevance, F.col("rank")))), F.lit(0.0)).alias(f"dcg_{k}")
    found = lambda k: F.count_if(good & upto(k)).alias(f"found_{k}")
    got = hits.groupBy("query_id").agg(dcg(10), dcg(20), found(1), found(3), found(10), found(100), F.min(F.when(good & upto(10), F.col("rank"))).alias("first"), F.count_if(F.col("relevance").isNull()).alias("unrated"), F.array_sort(F.collect_list(F.when(F.col("relevance").isNull(), F.struct("rank", "doc_id")))).alias("unrated_hits"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    best = qrels.withColumn("place", place)
    ideal = best.groupBy("query_id").agg(*[F.sum(F.when(F.col("place") <= k, _gain(F.col("relevance"), F.col("place")))).alias(f"ideal_{k}") for k in (10, 20)], F.count_if(F.col("relevance") > 0).alias("relevant"))
    both = ideal.join(got, "query_id", "left")
    share = lambda a, b: F.when(b > 0, F.coalesce(a, F.lit(0)) / b).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        "query_id",
        *[share(F.col(f"dcg_{k}"), F.col(f"ideal_{k}")).alias(f"ndcg_at_{k}") for k in (10, 20)],
        *[share(F.col(f"found_{k}"), F.col("relevant")).alias(f"recall_at_{k}") for k in (10, 100)],
        (zero(F.col("found_10")) / 10.0).alias("precision_at_10"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr_at_10"),
        *[(zero(F.col(f"found_{k}")) > 0).cast("double").alias(f"success_at_{k}") for k in (1, 3)],
        zero(F.col("unrated")).alias("unrated"),
        F.coalesce(F.transform("unrated_hits", lambda h: h["doc_id"]), F.array().cast("array<string>")).alias("unrated_hits"),
    )


def summary(qrels: DataFrame, results: DataFrame) -> DataFrame:
    """Means over the judged queries; one row."""
    return per_query(qrels, results).agg(F.count(F.lit(1)).alias("query_count"), F.sum("unrated").alias("unrated_hit_count"), *[F.avg(m).alias(m) for m in METRICS])


def coverage_errors(queries: DataFrame, qrels: DataFrame, results: DataFrame) -> DataFrame:
    """(reason, query_id, doc_id) of everything that keeps an evaluation from being sound; empty if it is."""
    none = F.lit(None).cast("string")
    ids = lambda f: f.select("query_id").distinct()
    row = lambda f, reason, doc=none: f.select(F.lit(reason).alias("reason"), "query_id", doc.alias("doc_id"))
    found = [
        row(queries.groupBy("query_id").count().where("count > 1"), "duplicate query_id"),
        row(ids(queries).subtract(ids(qrels)).union(ids(qrels).subtract(ids(queries))), "qrels file must align with query ids"),
        row(ids(queries).subtract(ids(results)).union(ids(results).subtract(ids(queries))), "results must align with query ids"),
        row(qrels.groupBy("query_id", "doc_id").count().where("count > 1"), "qrels file contains duplicate query_id/doc_id", F.col("doc_id")),
        row(qrels.where("relevance is null or relevance not between 0 and 3"), "qrels file contains invalid relevance", F.col("doc_id")),
        row(results.groupBy("query_id", "doc_id").count().where("count > 1"), "results contain duplicate hits", F.col("doc_id")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
