"""Helpers shared by the corpus operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []

#: Rows of one key that a task of a join may get; keys with more are joined by broadcast (see spread_join).
HOT = 512
#: Hot keys that are broadcast at most; beyond that the join is salted.
MOST_HOT = 1_000_000
_SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where the session names none (tests on one machine) a temporary folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df once into the shared folder; the table read back, whose lineage ends at its files, and its path."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables written so far; results that still read them must be stored first."""
    while _written:
        remove(spark, _written.pop())


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, under fixed names; a null text counts as empty.

    Other columns, whatever their names, are left behind here.
    """
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def in_slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each slice holds about `limit` bytes of text (one row at least)."""
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pa.compute.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def sampled(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows of df whose keys have the `rows` smallest hashes: a sample that neither layout nor order changes.

    Only keys are ordered; what the rows hold besides is read by a join with the chosen keys.
    """
    chosen = df.select(*keys).distinct().withColumn("h", F.xxhash64(*keys)).orderBy("h", *keys).limit(rows).select(*keys)
    return df.join(F.broadcast(chosen), list(keys), "left_semi")


def spread_join(rows: DataFrame, keyed: DataFrame, on: str, weight: str, at_most: int | None = None, how: str = "inner", merge: bool = False) -> DataFrame:
    """rows joined with keyed, whose `on` is unique and whose `weight` is the number of rows of the key.

    Keys with more than HOT rows, of which there are len(rows) / HOT at most, travel by broadcast, so
    their rows stay where they are; only the others are shuffled. at_most: a known bound of the
    number of hot keys, else they are counted. If there are too many to broadcast, all keys are salted.
    merge: the cold keys are joined by shuffle and sort at any size, so a small run shows what a large one costs.
    """
    hot, cold = keyed.where(F.col(weight) > HOT), keyed.where(F.col(weight) <= HOT)
    if (hot.count() if at_most is None else at_most) > MOST_HOT:
        salted = keyed.drop(weight).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        return rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS))).join(salted, [on, "_salt"], how).drop("_salt")
    flagged = rows.join(F.broadcast(hot.drop(weight).withColumn("_hot", F.lit(True))), on, "left")
    cold = cold.drop(weight).hint("merge") if merge else cold.drop(weight)
    rest = flagged.where("_hot is null").select(*rows.columns).join(cold, on, how)
    return flagged.where("_hot").drop("_hot").unionByName(rest)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of about `rows` rows from batches sorted by a long key, cut between keys: a task holds one of them, or its largest group."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            keys = np.asarray(table[key])
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
            else:
                held = table.to_batches()
            size = len(table) - cut
    if held:
        yield pa.Table.from_batches(held)
