import math

import pytest
from pyspark.sql import functions as F

from larkspur.operators import embedding, filters, fusion, lexical, merge, vector


def _docs(spark, **texts):
    return spark.createDataFrame([(k.replace("_", "-"), v) for k, v in texts.items()], "doc_id string, text string")


def _ask(spark, *texts, k=10):
    return spark.createDataFrame([(i, t, k) for i, t in enumerate(texts)], "query long, query_text string, top_k int")


def _ids(hits, query=0):
    return [r.doc_id for r in hits.where(F.col("query") == query).orderBy("rank").collect()]


def test_overlap_order_ties_and_multiplicity(spark):
    post = lexical.postings(_docs(spark, doc_1="alpha", doc_2="alpha beta beta", doc_3="gamma", doc_10="alpha"))
    assert _ids(lexical.search(_ask(spark, "alpha beta"), post)) == ["doc-2", "doc-1", "doc-10"]
    scores = {r.doc_id: r.score for r in lexical.search(_ask(spark, "beta beta alpha"), post).collect()}
    assert scores == {"doc-2": 3, "doc-1": 1, "doc-10": 1}
    assert _ids(lexical.search(_ask(spark, "alpha", k=0), post)) == []
    assert lexical.search(_ask(spark, "nothing here"), post).count() == 0


def test_repeated_queries_stay_apart(spark):
    post = lexical.postings(_docs(spark, a="x y", b="y"))
    hits = lexical.search(_ask(spark, "y", "y"), post)
    assert _ids(hits, 0) == _ids(hits, 1) == ["a", "b"]


def test_top_k_is_a_prefix_of_a_larger_one(spark):
    post = lexical.postings(_docs(spark, **{f"d{i}": " ".join("abcdefg"[: i % 7 + 1]) for i in range(30)}))
    assert _ids(lexical.search(_ask(spark, "a b c d e f g"), post, 20))[:7] == _ids(lexical.search(_ask(spark, "a b c d e f g"), post, 7))


def test_embedding_has_unit_length_and_both_forms_agree(spark):
    docs = _docs(spark, a="alpha beta alpha", b="", c="ΑΒΓ x1")
    rows = {r.doc_id: r.embedding for r in embedding.embed(docs, 16).collect()}
    assert math.isclose(sum(x * x for x in rows["a"]), 1, rel_tol=1e-6) and set(rows["b"]) == {0.0} and len(rows["b"]) == 16
    for r in embedding.sparse(docs, 16).collect():
        assert math.isclose(rows[r.doc_id][r.bucket], r.weight, rel_tol=1e-6)
    assert embedding.embed(docs, 0).first().embedding == []


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, embedding array<float>")


def test_exact_ties_and_replacement(spark):
    vectors = _vectors(spark, [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.5, 0.0]), ("z", [2.0, 0.0])])
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query long, vector array<double>")
    assert _ids(vector.search_exact(asked, vectors, 3)) == ["z", "a", "b"]
    assert _ids(vector.search_exact(asked, vectors, 1)) == ["z"]
    assert _ids(vector.search_exact(asked, vectors, 99)) == ["z", "a", "b", "c"]
    assert vector.search_exact(asked, vectors, 0).count() == 0


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = _vectors(spark, [(f"v{i}", [float(x) for x in rng.standard_normal(4)]) for i in range(300)])
    asked = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4)]) for i in range(20)], "query long, vector array<double>")
    want = sorted(map(tuple, vector.search_exact(asked, vectors, 5).collect()))
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 6)
    got = sorted(map(tuple, vector.search_exact(asked, vectors, 5, block_rows=70).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-12) for a, b in zip(got, want))


def test_modes_and_limits():
    assert vector.auto_mode(64, True, True) == "exact" and vector.auto_mode(65, True, True) == "approximate"
    assert vector.auto_mode(65, False, True) == "preview" and vector.auto_mode(65, False, False) == "exact"
    assert vector.runtime_mode("auto", 1000, True, True, cold=True) == "exact"
    assert vector.runtime_mode("preview", 1000) == "exact"
    assert vector.preview_limit(10, 1000) == 160 and vector.preview_limit(1, 50) == 50 and vector.approximate_limit(10, 1000) == 80
    assert fusion.hybrid_text_limit(5, 1000) == 100 and fusion.hybrid_text_limit(0, 10) == 0 and fusion.hybrid_text_limit(50, 120) == 120
    assert fusion.filtered_limit(1, 1000) == 64 and fusion.filtered_limit(100, 9999) == 4096 and fusion.filtered_limit(0, 5) == 0
    with pytest.raises(ValueError, match="expected 3, got 2"):
        vector.check_dimensions(3, 2)


def test_two_stage_first_hit_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = _vectors(spark, [(f"v{i}", [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.standard_normal((200, 8)))])
    asked = vectors.where("doc_id in ('v3', 'v77')").select(F.substring("doc_id", 2, 9).cast("long").alias("query"), F.col("embedding").alias("vector"))
    for found in (vector.search_preview(asked, vectors, 3), vector.search_hashed(asked, vectors, 3, 8)):
        assert _ids(found, 3)[0] == "v3" and _ids(found, 77)[0] == "v77"


def _hits(spark, *ids):
    return spark.createDataFrame([(0, i + 1, d) for i, d in enumerate(ids)], "query long, rank int, doc_id string")


def test_fusion_order_and_symmetry(spark):
    text, near = _hits(spark, "a", "b", "c"), _hits(spark, "c", "b", "d")
    rows = fusion.fuse(text, near, 10).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == ["c", "b", "a", "d"]
    assert rows[3].text_rank is None and rows[3].vector_rank == 3 and math.isclose(rows[1].score, 2 / 62)
    assert [(r.doc_id, r.score) for r in fusion.fuse(near, text, 10).orderBy("rank").collect()] == [(r.doc_id, r.score) for r in rows]


def test_filters(spark):
    assert filters.parse_filter('{"a": "x", "n": 3, "t": ["x"]}') == {"a": "x"} and filters.parse_filter({"n": 1}) == {}
    docs = spark.createDataFrame([("a", '{"w": "t"}'), ("b", '{"w": 1}'), ("c", '{"m": {"w": "t"}, "w": "t"}')], "doc_id string, p string").select("doc_id", F.parse_json("p").alias("payload"))
    hits = _hits(spark, "b", "c", "a")
    assert _ids(filters.filter_hits(hits, docs, {"w": "t"}, 1)) == ["c"]
    assert _ids(filters.filter_hits(hits, docs, {})) == ["b", "c", "a"]
    assert _ids(filters.filter_hits(hits, docs, {"m.w": "t"})) == ["c"]


def test_upsert_is_idempotent_and_keeps_order(spark):
    old = spark.createDataFrame([("a", "1", 0), ("b", "2", 1)], "doc_id string, text string, ord long")
    new = spark.createDataFrame([("c", "3", 0), ("a", "9", 1)], "doc_id string, text string, ord long")
    once = merge.upsert(old, new)
    assert [(r.doc_id, r.text) for r in once.orderBy("ord").collect()] == [("a", "9"), ("b", "2"), ("c", "3")]
    assert [(r.doc_id, r.text) for r in merge.upsert(once, new).orderBy("ord").collect()] == [("a", "9"), ("b", "2"), ("c", "3")]


def test_ids_are_stable(spark):
    docs = lambda *ids: spark.createDataFrame([(d, i) for i, d in enumerate(ids)], "doc_id string, ord long")
    none = spark.createDataFrame([], "external string, internal long")
    first = merge.allocate_ids(none, docs("x", "y"), 1)
    assert {r.external: r.internal for r in first.collect()} == {"x": 0, "y": 1}
    assert {r.external: r.internal for r in merge.allocate_ids(first, docs("y", "z", "x", "w"), 2).collect()} == {"x": 0, "y": 1, "z": 2, "w": 3}


def test_hydrate_null_or_error(spark):
    docs = _docs(spark, a="text")
    assert {r.doc_id: r.preview for r in merge.hydrate(_hits(spark, "a", "q"), docs).collect()} == {"a": "text", "q": None}
    with pytest.raises(Exception, match="no text for document q"):
        merge.hydrate(_hits(spark, "q"), docs, required=True).collect()


def test_hashed_search_takes_bucket_mates_alone(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = rng.standard_normal((300, 8))
    vectors = _vectors(spark, [(f"v{i}", [float(x) for x in v]) for i, v in enumerate(rows)])
    asked = spark.createDataFrame([(i, [float(x) for x in rows[i]]) for i in range(20)], "query long, vector array<double>")
    planes = vector.hash_planes(8, 3)[:, :4]
    rows = rows.astype(np.float32).astype(np.float64)
    of, mine = vector._buckets(rows, planes), vector._buckets(np.array([r.vector for r in asked.orderBy("query").collect()]), planes)
    want = []
    for q in range(20):
        mates = [i for i in range(300) if any(of[t, i] == mine[t, q] for t in range(3))]
        want += [(q, f"v{i}") for i in mates]
    assert len(want) < 20 * 300 and of.max() < 16
    monkeypatch.setattr(vector, "calibrated_bits", lambda *_: 4)
    for most in (4096, 6):
        monkeypatch.setattr(vector, "BLOCK_QUERIES", most)
        got = vector.search_hashed(asked, vectors, 300, 8, tables=3)
        assert sorted((r.query, r.doc_id) for r in got.collect()) == sorted(want)


def test_repeated_and_null_ids_are_one_document(spark):
    docs = spark.createDataFrame([("a", "x y"), ("a", "x z"), (None, "x"), (None, "x"), ("b", "x x y"), ("c", ""), ("d", None)], "doc_id string, text string")
    whole = spark.createDataFrame([("a", "x y x z"), ("n", "x x"), ("b", "x x y")], "doc_id string, text string")
    rows = lambda frame: sorted((r.doc_id or "n", r.bucket, r.weight) for r in frame.collect())
    assert rows(embedding.sparse(docs, 384)) == rows(embedding.sparse(whole, 384))


def test_embedding_hashes_words_without_a_shuffle(spark, monkeypatch):
    from larkspur.functions.hashing import fnv1a_bucket, fnv1a_many

    words = ["a", "", "é", "日本語", "w" * 3000, "beta", "b"]
    frame = spark.createDataFrame([(w,) for w in words], "w string").select("w", fnv1a_bucket(F.col("w"), 384).alias("b"))
    assert {r.w: r.b for r in frame.collect()} == dict(zip(words, (fnv1a_many(words) % 384).tolist()))
    docs = _docs(spark, **{f"d{i}": f"t{i} u{i % 7} u{i % 7} v" for i in range(50)})
    want = sorted(map(tuple, embedding.sparse(docs, 16).collect()))
    plan = embedding.sparse(docs, 16)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and len(want) > 50
    monkeypatch.setattr(embedding, "TILE", 40)
    monkeypatch.setattr(embedding, "MOST_WORDS", 5)
    assert sorted(map(tuple, embedding.sparse(docs, 16).collect())) == want


def test_search_shuffles_no_row_a_pair(spark, monkeypatch):
    docs = _docs(spark, **{f"d{i}": " ".join("abcdefghij"[: i % 10 + 1]) for i in range(60)})
    asked = _ask(spark, "a b c", "b b j", "zz", "a", k=4)
    post = lexical.postings(docs)
    rows = lambda hits: sorted(map(tuple, hits.collect()))
    by_join = lexical.ranked(lexical.overlap_scores(asked, post), None).select("query", "rank", "doc_id", "score")
    every = rows(by_join)
    few = [r for r in every if r[1] <= 4]
    for tile, pairs in ((1 << 22, 1 << 20), (20, 3)):
        monkeypatch.setattr(lexical, "TILE", tile)
        monkeypatch.setattr(lexical, "PAIRS", pairs)
        assert rows(lexical.search_documents(asked, docs)) == rows(lexical.search(asked, post)) == few
        assert rows(lexical.search(asked, post, 4)) == few and rows(lexical.search_all(asked, post)) == every
    monkeypatch.setattr(lexical, "overlap_scores", None)
    assert rows(lexical.search(asked, post)) == few
