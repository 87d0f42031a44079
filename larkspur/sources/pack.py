"""Dataset packs: documents, query sets and vectors as tables, with a manifest that describes and guards them."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embedding, profile
from ..functions.vectors import quantized
from . import ndjson

# The vocabularies of a manifest.
TIERS = ("small", "medium", "large", "xlarge")
CLASSES = ("keyword", "prefix", "fuzzy_keyword", "topical", "vector", "hybrid", "metadata_filtered", "no_hit", "high_recall")
DIFFICULTIES = ("easy", "medium", "hard")
METRICS = ("cosine", "dot", "l2")
DTYPES = ("f32", "i8", "u8")


def sha256_label(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def spec_dimensions(spec_id: str) -> int | None:
    """The number before f32, i8 or u8 in an embedding's name, such as minilm-l6-384-f32-cosine."""
    found = re.search(r"(\d+)-?(?:f32|i8|u8)", spec_id)
    return int(found[1]) if found else None


def spec_metric(spec_id: str) -> str:
    return spec_id.rsplit("-", 1)[-1]


def synthetic_spec(dimensions: int, dtype: str = "f32", metric: str = "cosine") -> str:
    return f"feature-hash-stub-{dimensions}-{dtype}-{metric}"


def is_inside(path: str) -> bool:
    """Relative and without steps upwards."""
    parts = PurePosixPath(path).parts
    return bool(parts) and not PurePosixPath(path).is_absolute() and not {"..", "."} & set(parts)


def dirty_profile(name: str) -> dict:
    """Labels of a corpus' state; they describe, documents are not changed."""
    profiles = {"clean": {"delete_ratio": 0.0, "update_ratio": 0.0, "compaction_state": "clean"}, "dirty_light": {"delete_ratio": 0.05, "update_ratio": 0.05, "compaction_state": "pending", "seed": 7}}
    if name not in profiles:
        raise ValueError(f"unknown dirty profile {name}")
    return {"profile": name, **profiles[name]}


def fairness_fingerprint(tier: str, variant: str, clean_id: str) -> str:
    return sha256_label(json.dumps([tier, variant, clean_id]).encode())


def write_pack(spark: SparkSession, documents_path: str, query_paths: dict[str, str], out: str, dimensions: int = 384, tier: str = "small", variant: str = "clean") -> dict:
    """Writes documents, ids, offsets, postings, vectors (float and byte) and query vectors under out; returns the manifest.

    Query sets are taken in order of their names. At least one query must be eligible for vectors.
    """
    documents = ndjson.documents(spark, documents_path)
    profile.reject_duplicates(documents, "write_pack")
    documents.write.parquet(f"{out}/documents")
    stored = spark.read.parquet(f"{out}/documents")
    lines = ndjson.lines(spark, documents_path)
    sized = lines.select("line", F.try_variant_get(F.parse_json("value"), "$.doc_id", "string").alias("doc_id"), (F.octet_length("value") + 1).cast("long").alias("length"))
    profile.byte_offsets(sized, 1 << 33).write.parquet(f"{out}/document_offsets")
    ndjson.write_postings(stored, f"{out}/text_postings")
    embedding.embed(stored.select("doc_id", "text"), dimensions).select("doc_id", "embedding").write.parquet(f"{out}/document_vectors")
    vectors = spark.read.parquet(f"{out}/document_vectors")
    vectors.select("doc_id", quantized(F.col("embedding")).alias("preview")).write.parquet(f"{out}/document_vectors_preview")
    sets, vector_queries = [], 0
    for name, path in sorted(query_paths.items()):
        queries = ndjson.query_set(spark, path)
        summary = profile.query_set_summary(queries).first().asDict()
        if summary["easy"] + summary["medium"] + summary["hard"] != summary["query_count"]:
            raise ValueError(f"query set {name} has an unknown difficulty")
        eligible = queries.where("lane_eligibility.vector or lane_eligibility.hybrid")
        vector_queries += eligible.count()
        made = embedding.embed(eligible.withColumnRenamed("query_text", "text"), dimensions).withColumnRenamed("text", "query_text")
        made.select("query", "query_id", "query_text", "top_k", F.col("embedding").alias("vector"), "lane_eligibility").write.parquet(f"{out}/query_vectors/{name}")
        sets.append({"query_set_id": name, "path": path} | summary)
    if not vector_queries:
        raise ValueError("no query of any set is eligible for vectors")
    corpus = profile.corpus_profile(stored).first().asDict()
    clean_id = sha256_label(json.dumps([corpus, sets], sort_keys=True).encode())
    manifest = {"dataset_tier": tier, "variant_id": variant, "dirty_profile": dirty_profile(variant), "corpus": corpus, "vector_profile": {"enabled": True, "embedding_spec_id": synthetic_spec(dimensions), "embedding_dimensions": dimensions, "distance_metric": "cosine", "vector_count": corpus["doc_count"]}, "query_sets": sets, "fairness_fingerprint": fairness_fingerprint(tier, variant, clean_id), "clean_id": clean_id}
    problems = validate_manifest(manifest)
    if problems:
        raise ValueError("; ".join(problems))
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{out}/manifest")
    return manifest


def validate_manifest(m: dict) -> list[str]:
    """What is wrong with a manifest, in the order of its parts."""
    out: list[str] = []
    names = [q["query_set_id"] for q in m.get("query_sets", [])]
    if len(set(names)) != len(names):
        out.append("duplicate query_set_id")
    if m.get("dataset_tier") not in TIERS:
        out.append("invalid dataset_tier")
    v = m.get("vector_profile", {})
    if v.get("enabled"):
        if spec_dimensions(v["embedding_spec_id"]) != v["embedding_dimensions"]:
            out.append("embedding_dimensions does not match embedding_spec_id")
        if v.get("distance_metric") not in METRICS:
            out.append("invalid distance_metric")
    elif v.get("vector_count") or v.get("embedding_dimensions"):
        out.append("vector_count must be 0 when vectors are disabled")
    dirty = m.get("dirty_profile", {})
    if dirty.get("profile") != m.get("variant_id"):
        out.append("variant_id must match dirty_profile.profile")
    if dirty.get("profile") == "clean" and (dirty.get("delete_ratio") or dirty.get("update_ratio") or dirty.get("compaction_state") != "clean"):
        out.append("a clean profile has zero ratios and the clean compaction state")
    for q in m.get("query_sets", []):
        out += [f"invalid query class {c}" for c in q.get("classes", []) if c not in CLASSES]
    files = m.get("files", [])
    paths = [f["path"] for f in files]
    if len(set(paths)) != len(paths):
        out.append("duplicate file path")
    for f in files:
        if not is_inside(f["path"]):
            out.append("file paths must stay within the dataset pack root")
        if not re.fullmatch("sha256:[0-9a-f]{64}", f.get("checksum", "")):
            out.append("file checksum must use sha256 format")
    return out


def query_set_errors(queries: DataFrame, ground_truth: DataFrame, expected: int) -> DataFrame:
    """(reason, query_id) of a query set and its ground truth (query_id, doc_ids)."""
    row = lambda f, reason: f.select(F.lit(reason).alias("reason"), "query_id")
    ids, truth = queries.select("query_id").distinct(), ground_truth.select("query_id").distinct()
    twice = lambda f: f.groupBy("query_id").count().where("count > 1")
    out = row(twice(queries), "duplicate query_id").unionByName(row(twice(ground_truth), "ground_truth file contains duplicate query_id"))
    out = out.unionByName(row(ids.subtract(truth).union(truth.subtract(ids)), "ground_truth file must align with query ids"))
    total = queries.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
    return out.unionByName(total.select(F.lit("query_count must match query file contents").alias("reason"), F.lit(None).cast("string").alias("query_id")))
