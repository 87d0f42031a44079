"""Continuous ingest: new files of documents become generations of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store

SCHEMA = "value string"


def ingest(spark: SparkSession, folder: str, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Every micro-batch of lines is one publish. Of lines with one id the last stands; a batch that is played again publishes the same rows."""

    def publish(batch: DataFrame, _: int) -> None:
        rows = batch.where(F.trim("value") != "").select(F.parse_json("value").alias("v"), F.monotonically_increasing_id().alias("ord"))
        rows = rows.select("ord", F.try_variant_get("v", "$.doc_id", "string").alias("doc_id"), F.try_variant_get("v", "$.text", "string").alias("text"), F.try_variant_get("v", "$.timestamp_ms", "bigint").alias("timestamp_ms"), F.to_json("v").alias("payload"))
        rows = rows.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("ord")))).where("n = 1 and doc_id is not null and text is not null").drop("n")
        if not rows.isEmpty():
            store.publish_documents(rows)

    stream = spark.readStream.schema(SCHEMA).text(folder)
    writer = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
