"""Structured memory: an append-only fact log and the entities in it.

Frame: facts (record_id, subject, predicate, value, status, source, asserted_at_ms); value is a string (JSON text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KIND, ALIAS = "__entity_kind", "__entity_alias"


def query(facts: DataFrame, subject: str | None = None, predicate: str | None = None) -> DataFrame:
    """Facts by exact subject and predicate, either left open; entity records stay hidden."""
    out = facts.where(~F.col("predicate").isin(KIND, ALIAS))
    if subject is not None:
        out = out.where(F.col("subject") == subject)
    return out if predicate is None else out.where(F.col("predicate") == predicate)


def invalid(new: DataFrame) -> DataFrame:
    """Records that an append refuses, with the reason."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    reason = F.when(blank("subject"), "structured memory record subject cannot be empty").when(blank("predicate"), "structured memory record predicate cannot be empty").when(blank("source"), "structured memory record source cannot be empty").when(F.col("predicate").isin(KIND, ALIAS), "predicate is reserved")
    return new.withColumn("reason", reason).where("reason is not null")


def numbered(facts: DataFrame, new: DataFrame) -> DataFrame:
    """new (with its ordinal `ord`) given the record ids that follow the log's largest. A batch is what one writer appends at once."""
    top = facts.agg(F.coalesce(F.max("record_id"), F.lit(0)).alias("top"))
    return new.crossJoin(F.broadcast(top)).withColumn("record_id", F.col("top") + F.row_number().over(W.orderBy("ord"))).drop("top", "ord")


def entities(facts: DataFrame) -> DataFrame:
    """(subject, kind, source, asserted_at_ms, aliases): the last kind record with its provenance, aliases in order of first sight."""
    last = F.max_by(F.struct("value", "source", "asserted_at_ms"), "record_id")
    kinds = facts.where(F.col("predicate") == KIND).groupBy("subject").agg(last.alias("k"))
    seen = facts.where(F.col("predicate") == ALIAS).groupBy("subject", "value").agg(F.min("record_id").alias("at"))
    aliases = seen.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("aliases"))
    return kinds.join(aliases, "subject", "left").select("subject", F.col("k.value").alias("kind"), F.col("k.source").alias("source"), F.col("k.asserted_at_ms").alias("asserted_at_ms"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def upsert_records(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records to append so that entities are as wanted (subject, kind, aliases, source, asserted_at_ms): changed kinds and unseen aliases only."""
    now = entities(facts).select("subject", F.col("kind").alias("old"))
    changed = wanted.join(now, "subject", "left").where("old is null or old <> kind").select("subject", F.lit(KIND).alias("predicate"), F.col("kind").alias("value"), "source", "asserted_at_ms", F.lit(0).alias("at"))
    asked = wanted.select("subject", F.posexplode("aliases").alias("at", "value"), "source", "asserted_at_ms").groupBy("subject", "value", "source", "asserted_at_ms").agg(F.min("at").alias("at"))
    known = facts.where(F.col("predicate") == ALIAS).select("subject", "value")
    unseen = asked.join(known, ["subject", "value"], "left_anti").select("subject", F.lit(ALIAS).alias("predicate"), "value", "source", "asserted_at_ms", (F.col("at") + 1).alias("at"))
    return changed.unionByName(unseen)
