"""Upserts, id allocation and set checks of the write path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of incoming replace those of equal key in place; new keys follow in incoming order.

    Both frames have the same columns and an ordinal `ord` of their own; the result's ord orders it.
    """
    columns = [c for c in current.columns if c not in (key, "ord")]
    last = current.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    old = current.select(key, F.col("ord").alias("_old"), F.struct(*columns).alias("_a"))
    new = incoming.select(key, F.col("ord").alias("_new"), F.struct(*columns).alias("_b"))
    both = old.join(new, key, "full_outer").crossJoin(F.broadcast(last))  # last is one row
    row = F.coalesce("_b", "_a")
    return both.select(key, *[row[c].alias(c) for c in columns], F.coalesce("_old", F.col("last") + 1 + F.col("_new")).alias("ord"))


def allocate_ids(bindings: DataFrame, documents: DataFrame, rows_a_block: int = 100_000) -> DataFrame:
    """(external, internal): old bindings stay for ever, new ids follow the largest in document order.

    documents: doc_id and ord. Numbers within blocks of ord are added to the counts of the blocks
    before, so new ids are never ordered in one task.
    """
    new = documents.select(F.col("doc_id").alias("external"), "ord").join(bindings, "external", "left_anti").withColumn("block", F.floor(F.col("ord") / rows_a_block))
    counts = new.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    # a row for each block of ids
    starts = counts.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    top = bindings.agg(F.coalesce(F.max("internal"), F.lit(-1)).alias("top"))
    within = F.row_number().over(W.partitionBy("block").orderBy("ord"))
    numbered = new.join(starts, "block").crossJoin(F.broadcast(top)).select("external", (F.col("top") + F.col("start") + within).cast("long").alias("internal"))
    return bindings.select("external", "internal").unionByName(numbered)


def missing(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of left that right lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def require_cover(documents: DataFrame, vectors: DataFrame, shown: int = 5) -> None:
    """Vectors must be there for exactly the documents; the message names a few ids."""
    for rows, what in ((missing(documents, vectors), "documents without vectors"), (missing(vectors, documents), "vectors without documents")):
        n = rows.count()
        if n:
            some = [r[0] for r in rows.orderBy("doc_id").limit(shown).collect()]
            raise ValueError(f"{what}: {', '.join(map(str, some))}" + (f" (+{n - shown} more)" if n > shown else ""))


def hydrate(hits: DataFrame, documents: DataFrame, required: bool = False) -> DataFrame:
    """hits with preview, the document's text; null where there is none, an error if required."""
    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("preview"))
    out = hits.join(texts, "doc_id", "left")
    if required:
        out = out.withColumn("preview", F.coalesce("preview", F.raise_error(F.concat(F.lit("no text for document "), "doc_id")).cast("string")))
    return out
