"""Latency workloads: timed Spark actions, samples as a table, run summaries."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import latency, vector
from ..sources.store import Store
from . import engine


def workloads(store: Store, text: str, vector: list[float], k: int = 10) -> dict[str, Callable[[], object]]:
    """The named workloads over a store; warm ones expect their tables to have been read before."""
    request = lambda mode, preview=False: engine.search(store, engine.SearchRequest(mode, text, vector, k, preview)).collect()
    return {
        "container_open": store.manifest,
        "materialize_vector": lambda: store.vectors().count(),
        "ttfq_text": lambda: request("text"),
        "ttfq_vector": lambda: request("vector"),
        "warm_text": lambda: request("text"),
        "warm_vector": lambda: request("vector"),
        "warm_hybrid": lambda: request("hybrid"),
        "warm_hybrid_with_previews": lambda: request("hybrid", True),
    }


def run(spark: SparkSession, jobs: dict[str, Callable[[], object]], samples: int = 5, fresh: bool = False) -> DataFrame:
    """(workload, sample_index, value) in milliseconds; a workload that fails gives null values."""
    rows = []
    for name, job in jobs.items():
        for i in range(samples):
            if fresh:
                spark.catalog.clearCache()
            began = time.perf_counter_ns()
            try:
                job()
                rows.append((name, i, (time.perf_counter_ns() - began) / 1e6))
            except Exception:
                rows.append((name, i, None))
    return spark.createDataFrame(rows, "workload string, sample_index int, value double")


def summary(samples: DataFrame) -> DataFrame:
    return latency.percentiles(samples, "workload")

# --- run bundles: a folder of sample files, a summary and a manifest that guards them -----------


def write_bundle(folder: str, config: dict, samples: DataFrame) -> None:
    """sample-NNN.json for each sample (a few), summary.json and summary.md, run-manifest.json with their SHA-256."""
    out = Path(folder)
    out.mkdir(parents=True)
    rows = sorted((r.asDict() for r in samples.collect()), key=lambda r: (r["workload"], r["sample_index"]))
    files = {f"sample-{n:03d}.json": json.dumps(r, sort_keys=True) for n, r in enumerate(rows)}
    found = sorted((r.asDict() for r in summary(samples).collect()), key=lambda r: r["workload"])
    files |= {"summary.json": json.dumps(found, sort_keys=True), "summary.md": latency.markdown(found)}
    for name, text in files.items():
        (out / name).write_text(text)
    manifest = {"config": config, "files": {n: hashlib.sha256(t.encode()).hexdigest() for n, t in files.items()}}
    (out / "run-manifest.json").write_text(json.dumps(manifest, sort_keys=True))


def read_bundle(folder: str) -> dict:
    """config, samples and summary of a bundle; status names missing files, a changed one is an error."""
    base = Path(folder)
    manifest = json.loads((base / "run-manifest.json").read_text())
    missing = sorted(n for n in manifest["files"] if not (base / n).exists())
    for name, digest in manifest["files"].items():
        if name not in missing and hashlib.sha256((base / name).read_bytes()).hexdigest() != digest:
            raise ValueError(f"checksum mismatch: {name}")
    samples = [json.loads((base / n).read_text()) for n in sorted(manifest["files"]) if n.startswith("sample-") and n not in missing]
    return {"config": manifest["config"], "samples": samples, "status": {"complete": True} if not missing else {"complete": False, "missing": missing}}


def replay_command(config: dict) -> str:
    """The command line that repeats a run."""
    return " ".join(["python", "-m", "larkspur.cli", config["command"], *(str(x) for x in config.get("arguments", []))])


def mode_comparison(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """(workload, candidate_p95, baseline_p95, delta) of two summaries; null where either has none."""
    a = candidate.select("workload", F.col("p95").alias("candidate_p95"))
    b = baseline.select("workload", F.col("p95").alias("baseline_p95"))
    return a.join(b, "workload", "full_outer").withColumn("delta", F.col("candidate_p95") - F.col("baseline_p95"))


def profile_vector_query(queries: DataFrame, vectors: DataFrame, k: int, dimensions: int, mode: str = "auto") -> dict:
    """Milliseconds of the phases of a vector search, and its numbers of candidates and hits."""

    def timed(action):
        began = time.perf_counter_ns()
        return action(), (time.perf_counter_ns() - began) / 1e6

    n, load_ms = timed(vectors.count)
    chosen = vector.runtime_mode(mode, n, True, True)
    candidates = {"exact": n, "preview": vector.preview_limit(k, n), "approximate": vector.approximate_limit(k, n)}[chosen]
    hits, search_ms = timed(vector.search(queries, vectors, k, dimensions, chosen).count)
    return {"mode": chosen, "load_ms": load_ms, "search_ms": search_ms, "candidates": candidates, "hits": hits}
