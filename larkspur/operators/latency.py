"""Latency samples: percentiles, comparison with a baseline, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: percentile -> samples that it needs
NEEDED = {0.5: 1, 0.95: 1, 0.99: 4}
WORKLOADS = ("container_open", "materialize_vector", "ttfq_text", "ttfq_vector", "warm_text", "warm_vector", "warm_hybrid", "warm_hybrid_with_previews")


def percentiles(samples: DataFrame, *by: str) -> DataFrame:
    """p50, p95, p99 by nearest rank of samples (..., value); null values are unavailable samples, too few samples give null."""
    def at(share: float):
        found = F.expr(f"percentile_disc({share}) within group (order by value)")
        return F.when(F.count("value") >= NEEDED[share], found).alias(f"p{round(share * 100)}")

    return samples.groupBy(*by).agg(F.count("value").alias("samples"), *map(at, NEEDED))


def delta(candidate: DataFrame, baseline: DataFrame, *by: str) -> DataFrame:
    """candidate - baseline for each percentile; null where either is missing."""
    a, b = candidate.alias("a"), baseline.alias("b")
    both = a.join(b, list(by), "left")
    return both.select(*by, *[(F.col(f"a.{p}") - F.col(f"b.{p}")).alias(f"{p}_delta") for p in ("p50", "p95", "p99")])


def check_fairness(candidate: str, baseline: str) -> None:
    if candidate != baseline:
        raise ValueError("fairness fingerprints differ; runs can't be compared")


def sample_errors(samples: DataFrame, expected: int) -> list[str]:
    """What is wrong with sample indices 0..expected-1 of a bundle."""
    n, distinct, top = samples.agg(F.count("sample_index"), F.count_distinct("sample_index"), F.max("sample_index")).first()
    out = ["sample_count does not match sample artifacts"] if n != expected else []
    return out + (["sample indices must be contiguous"] if n and (distinct != n or top != n - 1) else [])


def matrix(percentile_rows: DataFrame, metric: str = "p95") -> DataFrame:
    """One row a mode, one column a workload, of rows (mode, workload, ...)."""
    return percentile_rows.groupBy("mode").pivot("workload", list(WORKLOADS)).agg(F.first(metric))


def markdown(rows: list[dict]) -> str:
    """A table of report rows (a few)."""
    if not rows:
        return ""
    names = list(rows[0])
    cell = lambda v: "unavailable" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)])
