"""Corpus and query-set profiles, id and offset tables, duplicate checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def corpus_profile(documents: DataFrame) -> DataFrame:
    """Number of documents and the distribution of their UTF-8 lengths; one row, zeros for an empty corpus."""
    sized = documents.select(F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    zero = lambda c, z: F.coalesce(c, F.lit(z))
    ratio = lambda cond: F.count_if(cond) / F.greatest(F.count(F.lit(1)), F.lit(1))
    size = F.col("bytes")
    return sized.agg(
        F.count(F.lit(1)).alias("doc_count"),
        zero(F.sum(size), 0).alias("total_bytes"),
        zero(F.avg(size), 0.0).alias("mean_bytes"),
        zero(F.expr("percentile_disc(0.5) within group (order by bytes)"), 0).cast("long").alias("p50_bytes"),
        zero(F.expr("percentile_disc(0.95) within group (order by bytes)"), 0).cast("long").alias("p95_bytes"),
        zero(F.max(size), 0).alias("max_bytes"),
        ratio(size <= 64).alias("short_ratio"),
        ratio((size > 64) & (size <= 256)).alias("medium_ratio"),
        ratio(size > 256).alias("long_ratio"),
    )


def facet_profile(documents: DataFrame, *facets: str) -> DataFrame:
    """(facet, cardinality, null_ratio) of string columns."""
    out = None
    for name in facets:
        row = documents.agg(F.lit(name).alias("facet"), F.count_distinct(name).alias("cardinality"), (F.count_if(F.col(name).isNull()) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("null_ratio"))
        out = row if out is None else out.unionByName(row)
    return out


def query_set_summary(queries: DataFrame) -> DataFrame:
    """Number of queries, their classes in order, and how many are easy, medium and hard; one row."""
    hard = lambda d: F.count_if(F.col("difficulty") == d).alias(d)
    return queries.agg(F.count(F.lit(1)).alias("query_count"), F.array_sort(F.collect_set("query_class")).alias("classes"), hard("easy"), hard("medium"), hard("hard"))


def byte_offsets(lines: DataFrame, file_rows: int = 100_000) -> DataFrame:
    """(doc_id, offset, length) of lines (line, doc_id, length): running sums of the lengths before.

    Sums of blocks of `file_rows` lines are accumulated first and added to the sums within a
    block, so no task orders all lines.
    """
    blocks = lines.withColumn("block", F.floor(F.col("line") / file_rows))
    totals = blocks.groupBy("block").agg(F.sum("length").alias("total"))
    # a row for each block: the number of lines over file_rows
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("block").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return blocks.join(starts, "block").select("doc_id", (F.col("start") + F.coalesce(F.sum("length").over(within), F.lit(0))).alias("offset"), "length")


def duplicate_ids(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reject_duplicates(rows: DataFrame, context: str, key: str = "doc_id", shown: int = 20) -> None:
    """Raises with the sorted ids that occur twice; the message names `shown` of them."""
    found = [r[0] for r in duplicate_ids(rows, key).orderBy(key).limit(shown).collect()]
    if found:
        raise ValueError(f"{context} received duplicate {key}s: {', '.join(map(str, found))}")


def segment_statistics(documents: DataFrame) -> DataFrame:
    """Ranges and counts of a segment of rows (internal_id, timestamp_ms, deleted); one row."""
    return documents.agg(F.min("internal_id").alias("min_id"), F.max("internal_id").alias("max_id"), F.min("timestamp_ms").alias("min_timestamp_ms"), F.max("timestamp_ms").alias("max_timestamp_ms"), F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("tombstones"))
