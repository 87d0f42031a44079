"""A store of generations: Parquet folders, a manifest each, and a pointer to the current one.

Readers see one generation whole. A publish writes new folders, then a manifest, then moves the
pointer; whatever fails before leaves the current generation as it was. One writer at a time
holds the lock file; a publish that started from another generation than the current is refused.
All files go through Hadoop's file systems, so the root may be any path that Spark reads.
"""

from __future__ import annotations

import json
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexical, merge, profile

POINTER, LOCK = "_CURRENT", "_LOCK"


class StoreError(RuntimeError):
    pass


@dataclass(frozen=True)
class Manifest:
    """families: name -> {path, generation}; doc, bindings, txt, vec."""

    generation: int
    families: dict[str, dict] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _put(self, name: str, text: str) -> None:
        """Replaces a small file in one step."""
        new = f"{name}.new"
        out = self._fs.create(self._path(new), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self._fs.exists(self._path(name)):
            self._fs.delete(self._path(name), False)
        if not self._fs.rename(self._path(new), self._path(name)):
            raise StoreError(f"cannot replace {name}")

    def _get(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(str(self._path(name))).collect())

    def create(self) -> "Store":
        """An empty generation 0; an error if the store is there."""
        if self._fs.exists(self._path(POINTER)):
            raise StoreError("store already exists")
        self._fs.mkdirs(self._path(""))
        self._commit(Manifest(0))
        return self

    def _commit(self, manifest: Manifest) -> None:
        self._put(f"manifest-{manifest.generation:08d}.json", json.dumps({"generation": manifest.generation, "families": manifest.families}, sort_keys=True))
        self._put(POINTER, str(manifest.generation))

    def manifest(self) -> Manifest:
        """The current generation; where its manifest is damaged, the newest sound one before it."""
        try:
            top = int(self._get(POINTER))
        except Exception:  # the pointer is being moved or lost: the manifests tell
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
            found = [int(n[9:17]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
            if not found:
                raise StoreError(f"no store at {self.root}") from None
            top = max(found)
        for generation in range(top, -1, -1):
            try:
                m = json.loads(self._get(f"manifest-{generation:08d}.json"))
                return Manifest(m["generation"], m["families"])
            except Exception:
                continue
        raise StoreError("no sound manifest")

    @contextmanager
    def _writing(self, expected: int | None):
        if not self._fs.createNewFile(self._path(LOCK)):
            raise StoreError("another writer holds the store")
        try:
            now = self.manifest()
            if expected is not None and now.generation != expected:
                raise StoreError(f"store generation changed: expected {expected}, got {now.generation}")
            yield now
        finally:
            self._fs.delete(self._path(LOCK), False)

    def family(self, name: str, manifest: Manifest | None = None) -> DataFrame | None:
        found = (manifest or self.manifest()).families.get(name)
        return self.spark.read.parquet(found["path"]) if found else None

    def _write(self, generation: int, name: str, frame: DataFrame) -> dict:
        path = f"{self.root}/gen={generation:08d}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return {"path": path, "generation": generation}

    def documents(self) -> DataFrame:
        found = self.family("doc")
        return self.spark.createDataFrame([], "doc_id string, text string, payload string, timestamp_ms long, ord long, internal_id long, deleted boolean") if found is None else found

    def postings(self) -> DataFrame:
        """The text lane; an error where it is missing or older than the documents."""
        m = self.manifest()
        if "doc" in m.families and ("txt" not in m.families or m.families["txt"]["generation"] < m.families["doc"]["generation"]):
            raise StoreError("latest text segment is stale; republish documents")
        return self.family("txt", m) if "txt" in m.families else self.spark.createDataFrame([], "token string, doc_id string")

    def vectors(self) -> DataFrame:
        m = self.manifest()
        if "doc" in m.families and "vec" not in m.families:
            raise StoreError("documents were published without vectors")
        if "vec" in m.families and m.families["vec"]["generation"] < m.families["doc"]["generation"]:
            raise StoreError("latest vector segment is stale; republish vectors")
        return self.family("vec", m) if "vec" in m.families else self.spark.createDataFrame([], "doc_id string, embedding array<float>")

    def _publish(self, now: Manifest, documents: DataFrame, vectors: DataFrame | None) -> int:
        """Writes documents with their ids, postings and vectors as one generation. Without vectors the vector family is dropped."""
        generation = now.generation + 1
        bound = self.family("bindings", now)
        bound = self.spark.createDataFrame([], "external string, internal long") if bound is None else bound
        bindings = self._write(generation, "bindings", merge.allocate_ids(bound, documents.select("doc_id", "ord")))
        ids = self.spark.read.parquet(bindings["path"]).select(F.col("external").alias("doc_id"), F.col("internal").alias("internal_id"))
        rows = documents.select("doc_id", "text", "payload", "timestamp_ms", "ord").join(ids, "doc_id").withColumn("deleted", F.lit(False))
        families = {"bindings": bindings, "doc": self._write(generation, "doc", rows)}
        stored = self.spark.read.parquet(families["doc"]["path"])
        # sorted by token within files, so a term's rows sit together and row groups can be skipped
        families["txt"] = self._write(generation, "txt", lexical.postings(stored).repartition("token").sortWithinPartitions("token", "doc_id"))
        if vectors is not None:
            families["vec"] = self._write(generation, "vec", vectors.select("doc_id", "embedding"))
        self._commit(Manifest(generation, families))
        return generation

    def publish_documents(self, documents: DataFrame, expected: int | None = None) -> int:
        """Merges documents (ord, doc_id, text, payload, timestamp_ms) into the current ones."""
        if documents.isEmpty():
            raise StoreError("no documents to publish")
        profile.reject_duplicates(documents, "publish_documents")
        with self._writing(expected) as now:
            current = self.family("doc", now)
            rows = documents.select("doc_id", "text", "payload", "timestamp_ms", "ord")
            merged = rows if current is None else merge.upsert(current.select(*rows.columns), rows)
            return self._publish(now, merged, None)

    def publish_snapshot(self, documents: DataFrame, vectors: DataFrame | None = None, expected: int | None = None) -> int:
        """Replaces the corpus; vectors, if given, must be there for exactly the documents."""
        profile.reject_duplicates(documents, "publish_snapshot")
        if vectors is not None:
            profile.reject_duplicates(vectors, "publish_snapshot vectors")
            merge.require_cover(documents, vectors)
        with self._writing(expected) as now:
            return self._publish(now, documents, vectors)

    def publish_vectors(self, vectors: DataFrame, expected: int | None = None) -> int:
        """Vectors for exactly the current documents, as a new generation that carries the other families on."""
        profile.reject_duplicates(vectors, "publish_vectors")
        sizes = [r[0] for r in vectors.select(F.coalesce(F.size("embedding"), F.lit(-1)).alias("n")).distinct().orderBy("n").limit(2).collect()]
        if len(sizes) > 1 or sizes == [-1]:
            raise ValueError("publish_vectors: vectors must be there and of one length")
        with self._writing(expected) as now:
            merge.require_cover(self.documents(), vectors, shown=1_000)
            generation = now.generation + 1
            families = now.families | {"vec": self._write(generation, "vec", vectors.select("doc_id", "embedding"))}
            self._commit(Manifest(generation, families))
            return generation
