"""Line-delimited JSON sources. Schemas are fixed; malformed lines are errors, blank lines are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens

SYSTEM_KEYS = ("doc_id", "text", "metadata", "timestamp_ms")
LANES = "struct<text:boolean,vector:boolean,hybrid:boolean>"
QUERY_SCHEMA = f"query_id string, query_class string, difficulty string, query_text string, top_k int, filter_spec map<string,variant>, preview_expected boolean, embedding_available boolean, lane_eligibility {LANES}"
QUERY_VECTOR_SCHEMA = f"query_id string, query_text string, top_k int, vector array<float>, lane_eligibility {LANES}"
QREL_SCHEMA = "query_id string, doc_id string, relevance int"
RESULT_SCHEMA = "query_id string, hits array<struct<doc_id:string>>"
POSTING_SCHEMA = "token string, doc_ids array<string>"
VECTOR_SCHEMA = "doc_id string, values array<float>"
FACT_SCHEMA = "record_id bigint, subject string, predicate string, value variant, status string, provenance struct<source:string,asserted_at_ms:bigint>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines that are not blank; line orders a file's lines."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    return rows.where(F.trim("value") != "")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a fixed schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _required_string(document: Column, key: str) -> Column:
    value = F.try_variant_get(document, f"$.{key}", "variant")
    fine = F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))
    return F.when(fine, F.try_variant_get(document, f"$.{key}", "string")).otherwise(F.raise_error(F.lit(f"a document line lacks the string {key}")).cast("string"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(ord, doc_id, text, metadata, timestamp_ms, payload) of a corpus file; payload is the whole object as JSON.

    doc_id and text must be strings (doc_id not empty); everything else is kept as it is. metadata is {} where it is missing.
    """
    rows = lines(spark, path).select(F.col("line").alias("ord"), F.parse_json("value").alias("v"))
    doc_id = _required_string(F.col("v"), "doc_id")
    doc_id = F.when(doc_id == "", F.raise_error(F.lit("a document has an empty doc_id")).cast("string")).otherwise(doc_id)
    metadata = F.coalesce(F.to_json(F.try_variant_get("v", "$.metadata", "variant")), F.lit("{}"))
    return rows.select("ord", doc_id.alias("doc_id"), _required_string(F.col("v"), "text").alias("text"), metadata.alias("metadata"), F.try_variant_get("v", "$.timestamp_ms", "bigint").alias("timestamp_ms"), F.to_json("v").alias("payload"))


def document_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids alone; an empty one is an error, as in documents."""
    doc_id = _required_string(F.parse_json("value"), "doc_id")
    return lines(spark, path).select(F.col("line").alias("ord"), F.when(doc_id == "", F.raise_error(F.lit("a document has an empty doc_id")).cast("string")).otherwise(doc_id).alias("doc_id"))


def payload(doc_id: Column, text: Column, metadata: Column, timestamp_ms: Column, extra: Column) -> Column:
    """A document's JSON object: extra fields (a JSON object) with the system keys put over them."""
    own = F.map_filter(F.coalesce(F.parse_json(extra).cast("map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, _: ~k.isin(*SYSTEM_KEYS))
    variant = lambda c: F.parse_json(F.to_json(F.struct(c.alias("x"))))
    at = lambda c: F.try_variant_get(variant(c), "$.x", "variant")
    system = F.create_map(F.lit("doc_id"), at(doc_id), F.lit("text"), at(text), F.lit("metadata"), F.parse_json(F.coalesce(metadata, F.lit("{}"))))
    timed = F.when(timestamp_ms.isNotNull(), F.create_map(F.lit("timestamp_ms"), at(timestamp_ms))).otherwise(F.create_map().cast("map<string,variant>"))
    return F.to_json(F.map_concat(own, system, timed))


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """Queries with an ordinal `query`, so that repeated ids stay apart; a null filter is an empty one."""
    rows = spark.read.schema(QUERY_SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("query"), *[c for c in rows.columns])


def string_clauses(filter_spec: Column) -> Column:
    """The clauses of a filter whose values are strings, as a map; others are dropped."""
    kept = F.map_filter(filter_spec, lambda _, v: F.schema_of_variant(v) == "STRING")
    return F.transform_values(kept, lambda _, v: v.cast("string"))


def ranked_results(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rank, doc_id) of a result file, a JSON array or one object a line; an empty file is an error."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not head:
        raise ValueError("ranked results must not be empty")
    as_array = head[0][0].lstrip().startswith("[")
    rows = spark.read.schema(RESULT_SCHEMA).option("mode", "FAILFAST").option("multiLine", str(as_array).lower()).json(path)
    return rows.select("query_id", F.posexplode("hits").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), "hit.doc_id")


def raw_vectors(spark: SparkSession, ids_path: str, matrix_path: str, dimensions: int) -> DataFrame:
    """(doc_id, embedding) of an id list and a row-major matrix of little-endian floats.

    The matrix length must be ids x dimensions. Its rows are fixed-length records, which a file of
    any size is split at; they meet the ids by their position.
    """
    import numpy as np

    ids = lines(spark, ids_path).select("line", F.try_variant_get(F.parse_json("value"), "$.doc_id", "string").alias("doc_id"))
    # positions of the ids: counts of the partitions before, then the place within
    part = F.shiftright("line", 33)
    sizes = sorted((r["part"], r["count"]) for r in ids.groupBy(part.alias("part")).count().collect())
    starts, before = [], 0
    for p, n in sizes:
        starts.append((p, before))
        before += n
    length = spark.read.format("binaryFile").load(matrix_path).agg(F.sum("length")).first()[0]
    if length != before * dimensions * 4:
        raise ValueError("vector payload length must match ids and dimensions")
    if not before:
        return spark.createDataFrame([], "doc_id string, embedding array<float>")
    records = spark.sparkContext.binaryRecords(matrix_path, dimensions * 4).zipWithIndex()
    vectors = spark.createDataFrame(records.map(lambda r: (r[1], np.frombuffer(r[0], "<f4").tolist())), "at long, embedding array<float>")
    numbered = ids.withColumn("part", part).join(F.broadcast(spark.createDataFrame(starts, "part long, start long")), "part")
    numbered = numbered.withColumn("at", F.col("start") + F.row_number().over(W.partitionBy("part").orderBy("line")) - 1)
    return numbered.join(vectors, "at").select("doc_id", "embedding")


def postings(spark: SparkSession, path: str) -> DataFrame:
    """(token, doc_id) of a posting file."""
    return read(spark, path, POSTING_SCHEMA).select("token", F.explode("doc_ids").alias("doc_id"))


def write_postings(documents: DataFrame, path: str) -> None:
    """Writes {token, doc_ids} lines, tokens in ranges over the files."""
    rows = documents.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    rows.groupBy("token").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids")).orderBy("token").write.json(path)
