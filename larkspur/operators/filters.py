"""Metadata filters: conjunctions of string equalities, and lane routing."""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.json import field_value


def parse_filter(spec: str | dict | None) -> dict[str, str]:
    """Clauses whose value is a string; others are dropped, so a filter of only such ones filters nothing."""
    found = json.loads(spec) if isinstance(spec, str) else spec or {}
    return {k: v for k, v in found.items() if isinstance(v, str)}


def matches(document: Column, clauses: dict[str, str]) -> Column:
    """Whether a VARIANT document meets every clause; a missing field meets none."""
    return reduce(and_, [F.coalesce(field_value(document, k) == v, F.lit(False)) for k, v in sorted(clauses.items())], F.lit(True))


def filter_hits(hits: DataFrame, documents: DataFrame, clauses: dict[str, str], k: int | None = None) -> DataFrame:
    """Hits (query, rank, ...) whose document (doc_id, payload VARIANT) meets the clauses, in order, ranked anew, k a query."""
    if clauses:
        fits = documents.where(matches(F.col("payload"), clauses)).select("doc_id")
        hits = hits.join(fits, "doc_id", "left_semi")
    again = F.row_number().over(W.partitionBy("query").orderBy("old"))
    hits = hits.withColumnRenamed("rank", "old").withColumn("rank", again).drop("old")
    return hits if k is None else hits.where(F.col("rank") <= k)


def routed(queries: DataFrame) -> DataFrame:
    """queries with their lane: hybrid, then vector without text, then text, else none."""
    on = lambda lane: F.coalesce(F.col(f"lane_eligibility.{lane}"), F.lit(False))
    return queries.withColumn("lane", F.when(on("hybrid"), "hybrid").when(on("vector") & ~on("text"), "vector").when(on("text"), "text").otherwise("none"))
