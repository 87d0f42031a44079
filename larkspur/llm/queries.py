"""The registered queries of the corpus operators: thin projections over each operator's own output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, forest, licenses, packing, pieces, secrets, simhash, toolcalls, toxicity, warc
from .common import table


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), rate=0.1, seed=7)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_neighbours(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(table(spark, sf_dir, "embeddings"), "id % 100 = 0", k=10)


def op6_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link_turns(table(spark, sf_dir, "conversations")).withColumn("violations", F.array_join("violations", "; "))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", simhash.spelled(F.col("fp")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pieces, op2_fingerprints, op3_warc, op4_licenses, op5_forest, op6_toolcalls, op7_packing, op8_simhash, op9_toxicity, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.oracle(), "op4_licenses": licenses.oracle(), "op6_toolcalls": toolcalls.oracle()}
