import math

import numpy as np
import pytest

from larkspur.llm import forest


def _rows(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, q int, d double")


def _brute(rows, k):
    """Exact neighbours; ties to smaller ids; rows that take no part are left out."""
    length = max((len(v) for _, v in rows if v), key=lambda n: sum(len(v) == n for _, v in rows if v), default=0)
    fine = {i: np.float32(v).astype(float) for i, v in rows if i is not None and v and len(v) == length and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in fine.items():
        if i % 10 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in fine.items() if j != i)[:k]
            out[i] = [(j, d) for d, j in near]
    return out


@pytest.mark.parametrize("n", [0, 1, 4, 60])
def test_small_tables_are_exact(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(n)]
    if n:
        rows += [(100 + i, [1.0, 2.0, 3.0]) for i in range(15)] + [(200, None), (201, []), (202, [0.0, -0.0, 0.0]), (203, [1.0, None, 2.0]), (204, [1.0, float("nan"), 0.0]), (205, [float("inf"), 1.0, 0.0]), (206, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0])]
    got = {}
    for r in sorted(forest.search(_rows(spark, rows), "id % 10 = 0", 5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: x for q, x in _brute(rows, 5).items() if x}


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.2 * rng.standard_normal(16)]) for i in range(3000)]
    want = _brute(rows, 10)
    found: dict = {}
    for r in forest.search(_rows(spark, rows), "id % 10 = 0", 10, block_rows=400).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = [j in found[q] for q, near in want.items() for j, _ in near]
    assert sum(hits) / len(hits) >= 0.9 and all(len(x) == 10 for x in found.values())
    vectors = {i: np.float32(v).astype(float) for i, v in rows}
    assert all(math.isclose(s, np.linalg.norm(vectors[q] - vectors[j]), rel_tol=1e-12) for q, x in found.items() for j, s in x.items())


def test_common_prefix():
    a = np.array([0, 1 << 63, (1 << 64) - 1, 5], np.uint64)
    b = np.array([0, 0, (1 << 64) - 2, 4], np.uint64)
    assert forest.shared_bits(a, b).tolist() == [64, 0, 63, 63]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_tables(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids, points = np.array(list(vectors)), np.stack(list(vectors.values()))
    rows = forest.search(table, "id % 100 = 0", 10).collect()
    pairs, hits = {(r.query_id, r.vec_id) for r in rows}, []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((points - vectors[q]) ** 2).sum(axis=1))
        hits += [(q, j) in pairs for j in [i for i in ids[np.lexsort((ids, d))] if i != q][:10]]
    seen = {r.query_id: r.candidates for r in rows}
    print(sf, "recall", sum(hits) / len(hits), "distances a query and row", sum(seen.values()) / len(seen) / len(ids))
    assert sum(hits) / len(hits) >= 0.9 and max(seen.values()) <= len(ids)


def test_clustered_vectors_need_few_distances(spark):
    rng = np.random.default_rng(5)
    centres = 3 * rng.standard_normal((60, 16))
    rows = [(i, [float(x) for x in centres[i % 60] + 0.3 * rng.standard_normal(16)]) for i in range(6000)]
    want = _brute(rows, 10)
    found = forest.search(_rows(spark, rows), "id % 10 = 0", 10, block_rows=700).collect()
    pairs = {(r.query_id, r.vec_id) for r in found}
    seen = {r.query_id: r.candidates for r in found}
    hits = [(q, j) in pairs for q, near in want.items() for j, _ in near]
    print("recall", sum(hits) / len(hits), "distances a query and row", sum(seen.values()) / len(seen) / 6000)
    assert sum(hits) / len(hits) >= 0.9 and sum(seen.values()) / len(seen) < 0.1 * 6000


def test_descent_counts_prefixes():
    rng = np.random.default_rng(2)
    strings = rng.integers(0, 1 << 63, 500, dtype=np.uint64) >> np.uint64(4)
    own = np.concatenate([strings[:20], rng.integers(0, 1 << 63, 20, dtype=np.uint64) >> np.uint64(4)])
    table = forest.descend(strings, np.arange(40), own, 5)
    got = {(r["q"], r["level"]): r["n"] for r in table.to_pylist()}
    want = {}
    for q in range(40):
        for n in forest.shared_bits(own[q], strings).tolist():
            want[q, n] = want.get((q, n), 0) + 1
    assert got == {k: n for k, n in want.items() if k[1] >= 5}
    assert (forest.exact_levels(own[None, :], strings[None, :])[3] == np.bincount(forest.shared_bits(own[3], strings), minlength=65)).all()
