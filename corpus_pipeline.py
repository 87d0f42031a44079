"""The corpus pipeline: its stages in order, each with the operator that it calls.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but
the last return the columns of documents; between stages the table is written to the shared
folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import copies, packing, secrets, toxicity
from larkspur.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go; the others stay as they are."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs.select(*COLUMNS), scorer)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies (five words, similarity 0.8) the document of the smallest id stays."""
    return copies.drop_copies(docs.select(*COLUMNS), similarity=0.8, words=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    redacted = secrets.redact(docs.select(*COLUMNS), secrets.fit(docs))
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows that related documents share."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", reject_toxic), ("near_dedup", drop_near_copies), ("secrets", redact_secrets), ("packing", pack_windows)]

#: Markov scores, fingerprints and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
