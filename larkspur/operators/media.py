"""Media assets: a catalogue of imported files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sanitized


def extension(file_name: Column) -> Column:
    """The file's suffix with its dot, .bin where there is none."""
    found = F.regexp_extract(file_name, r"[^./\\](\.[A-Za-z0-9]+)$", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", ".bin").otherwise(found)


def stored_name(asset_id: Column, sha256_hex: Column, file_name: Column) -> Column:
    return F.concat(sanitized(asset_id), F.lit("-"), F.substring(sha256_hex, 1, 12), extension(file_name))


def described(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Descriptors of all files under a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    sha = F.sha2("content", 256)
    name = F.element_at(F.split("path", "/"), -1)
    asset = F.regexp_replace(name, r"\.[^.]*$", "")
    return files.select(asset.alias("asset_id"), F.lit(kind).alias("kind"), name.alias("original_file_name"), "length", sha.alias("sha256_hex")).withColumnRenamed("length", "byte_length").withColumn("stored_relative_path", stored_name(F.col("asset_id"), F.col("sha256_hex"), F.col("original_file_name")))


def invalid(new: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(asset_id, reason) of imports that are refused."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    reason = F.when(blank("asset_id"), "multimodal asset id cannot be empty").when(~F.coalesce(F.col("kind").isin("Image", "Video"), F.lit(False)), "multimodal asset kind is unknown")
    if "image_metadata" in new.columns and "video_metadata" in new.columns:
        reason = reason.when((F.col("kind") == "Image") & F.col("video_metadata").isNotNull() | (F.col("kind") == "Video") & F.col("image_metadata").isNotNull(), "multimodal metadata must match the asset kind")
    wrong = new.withColumn("reason", reason).where("reason is not null").select("asset_id", "reason")
    clash = new.join(catalogue.select("asset_id"), "asset_id", "left_semi").select("asset_id", F.concat(F.lit("multimodal asset id already exists: "), "asset_id").alias("reason"))
    return wrong.unionByName(clash)


def photos(assets: DataFrame) -> DataFrame:
    """Images without hash, kind and video fields."""
    return assets.where("kind = 'Image'").drop("kind", "sha256_hex", "video_metadata")


def videos(assets: DataFrame) -> DataFrame:
    return assets.where("kind = 'Video'").drop("kind", "sha256_hex", "image_metadata")


def asset(assets: DataFrame, asset_id: str) -> DataFrame:
    return assets.where(F.col("asset_id") == asset_id).limit(1)
