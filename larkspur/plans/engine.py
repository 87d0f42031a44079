"""Search requests over a store: text, vector and hybrid lanes, filters, previews."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.json import field_value
from ..operators import embedding, filters, fusion, lexical, merge, vector
from ..sources.store import Store


MOST_FIELDS = 200


@dataclass(frozen=True)
class SearchRequest:
    mode: str = "text"  # text, vector or hybrid
    text_query: str | None = None
    vector_query: list[float] | None = None
    top_k: int = 5
    include_preview: bool = False
    filter: dict = field(default_factory=dict)


def check(request: SearchRequest) -> None:
    """What a mode needs is checked before anything else, also for top_k = 0."""
    if request.mode not in ("text", "vector", "hybrid"):
        raise ValueError(f"unknown search mode {request.mode}")
    if request.mode in ("text", "hybrid") and request.text_query is None:
        raise ValueError(f"text_query is required for {request.mode} search")
    if request.mode in ("vector", "hybrid") and request.vector_query is None:
        raise ValueError(f"vector_query is required for {request.mode} search")


def search(store: Store, request: SearchRequest) -> DataFrame:
    """(rank, doc_id, score, preview) of one request; the store's generation is read anew each time."""
    check(request)
    spark = store.spark
    if request.top_k == 0:
        return spark.createDataFrame([], "rank int, doc_id string, score double, preview string")
    documents = store.documents()
    live = documents.count() if request.mode == "hybrid" or request.filter else 0
    k = fusion.filtered_limit(request.top_k, live) if filters.parse_filter(request.filter) else request.top_k
    lanes: dict[str, DataFrame] = {}
    if request.mode != "vector":
        asked = spark.createDataFrame([(0, request.text_query)], "query long, query_text string")
        limit = max(k, fusion.hybrid_text_limit(request.top_k, live)) if request.mode == "hybrid" else k
        lanes["text"] = lexical.search(asked, store.postings(), limit)
    if request.mode != "text":
        vectors = store.vectors()
        sample = vectors.select(F.size("embedding")).first()
        if sample:
            vector.check_dimensions(sample[0], len(request.vector_query))
        lanes["vector"] = vector.search_exact(spark.createDataFrame([(0, request.vector_query)], "query long, vector array<double>"), vectors, k)
    hits = fusion.fuse(lanes["text"], lanes["vector"], k) if len(lanes) == 2 else next(iter(lanes.values()))
    payloads = documents.select("doc_id", F.parse_json("payload").alias("payload"))
    hits = filters.filter_hits(hits, payloads, filters.parse_filter(request.filter), request.top_k)
    hits = hits.select("query", "rank", "doc_id", F.col("score").cast("double").alias("score"))
    out = merge.hydrate(hits, documents) if request.include_preview else hits.withColumn("preview", F.lit(None).cast("string"))
    return out.select("rank", "doc_id", "score", "preview").orderBy("rank")


def search_batch(queries: DataFrame, documents: DataFrame, vectors: DataFrame | None, dimensions: int, mode: str = "auto") -> DataFrame:
    """(query, query_id, rank, doc_id) of a whole query set: each lane is one job for all of its queries.

    queries: query, query_id, query_text, top_k, clauses (map of strings), lane_eligibility. Vector and hybrid
    queries are embedded from their text. Queries with clauses fetch more candidates, are filtered, then cut.
    """
    n = documents.count()
    routed = filters.routed(queries)
    filtered = F.coalesce(F.size("clauses") > 0, F.lit(False))
    wide = F.least(F.greatest(64 * F.col("top_k"), F.lit(64)), F.lit(4096), F.lit(n))
    routed = routed.withColumn("limit", F.when(filtered & (F.col("top_k") > 0), wide).otherwise(F.col("top_k")))
    text = routed.where("lane in ('text', 'hybrid')").select("query", "query_text", F.col("limit").alias("top_k"))
    text_hits = lexical.search_documents(text, documents).select("query", "rank", "doc_id")
    near = routed.where("lane in ('vector', 'hybrid')")
    top = near.agg(F.max("limit")).first()[0]
    if top and vectors is not None:
        asked = embedding.embed(near.select("query", F.col("query_text").alias("text")), dimensions).select("query", F.col("embedding").alias("vector"))
        vector_hits = vector.search(asked, vectors, int(top), dimensions, mode)
        vector_hits = vector_hits.join(near.select("query", "limit"), "query").where("rank <= limit").select("query", "rank", "doc_id")
    else:
        vector_hits = text_hits.where("false")
    hybrid = routed.where("lane = 'hybrid'").select("query")
    fused = fusion.fuse(text_hits.join(hybrid, "query", "left_semi"), vector_hits.join(hybrid, "query", "left_semi"), None).select("query", "rank", "doc_id")
    single = text_hits.unionByName(vector_hits).join(hybrid, "query", "left_anti")
    hits = single.unionByName(fused).join(routed.select("query", "query_id", "top_k", "limit", "clauses"), "query").where("rank <= limit")
    # a hit stays if no clause of its query misses in its document
    clauses = hits.select("query", "doc_id", F.explode("clauses").alias("field", "wanted"))
    # the fields that filters name are a handful; each is one expression, and only JSON strings count
    fields = [r[0] for r in queries.select(F.explode(F.map_keys("clauses")).alias("f")).distinct().limit(MOST_FIELDS + 1).collect()]
    if len(fields) > MOST_FIELDS:
        raise ValueError(f"filters name more than {MOST_FIELDS} fields")
    payloads = documents.select("doc_id", F.parse_json("payload").alias("payload"))
    value = F.lit(None).cast("string")
    for f in fields:
        value = F.when(F.col("field") == f, field_value(F.col("payload"), f)).otherwise(value)
    missed = clauses.join(payloads, "doc_id", "left").where(~F.coalesce(value == F.col("wanted"), F.lit(False))).select("query", "doc_id").distinct()
    kept = hits.join(missed, ["query", "doc_id"], "left_anti").withColumnRenamed("rank", "old")
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("old")))
    return kept.where("rank <= top_k").select("query", "query_id", "rank", "doc_id")
