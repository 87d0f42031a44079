import math

import pytest
from pyspark.sql import functions as F

from larkspur.operators import facts, latency, media, profile, quality


def test_quality_per_query(spark):
    qrels = spark.createDataFrame([("q1", "a", 3), ("q1", "b", 1), ("q2", "c", 0), ("q3", "d", 2)], "query_id string, doc_id string, relevance int")
    results = spark.createDataFrame([("q1", 1, "x"), ("q1", 2, "a"), ("q2", 1, "c"), ("other", 1, "a")], "query_id string, rank int, doc_id string")
    rows = {r.query_id: r for r in quality.per_query(qrels, results).collect()}
    assert set(rows) == {"q1", "q2", "q3"}
    dcg, ideal = 7 / math.log2(3), 7 + 1 / math.log2(3)
    assert math.isclose(rows["q1"].ndcg_at_10, dcg / ideal) and rows["q1"].recall_at_10 == 0.5 and rows["q1"].precision_at_10 == 0.1
    assert rows["q1"].mrr_at_10 == 0.5 and rows["q1"].success_at_1 == 0 and rows["q1"].success_at_3 == 1 and rows["q1"].unrated_hits == ["x"]
    assert rows["q2"].ndcg_at_10 == 0 and rows["q3"].recall_at_100 == 0
    total = quality.summary(qrels, results).first()
    assert total.query_count == 3 and total.unrated_hit_count == 1 and math.isclose(total.mrr_at_10, 0.5 / 3)


def test_coverage_errors(spark):
    queries = spark.createDataFrame([("q1",), ("q1",), ("q2",)], "query_id string")
    qrels = spark.createDataFrame([("q1", "a", 5)], "query_id string, doc_id string, relevance int")
    results = spark.createDataFrame([("q1", 1, "a"), ("q2", 1, "a")], "query_id string, rank int, doc_id string")
    found = {(r.reason, r.query_id) for r in quality.coverage_errors(queries, qrels, results).collect()}
    assert found == {("duplicate query_id", "q1"), ("qrels file must align with query ids", "q2"), ("qrels file contains invalid relevance", "q1")}


def test_percentiles(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 6)] + [("b", 1.0), ("b", None)], "w string, value double")
    found = {r.w: r for r in latency.percentiles(rows, "w").collect()}
    assert (found["a"].p50, found["a"].p95, found["a"].p99) == (3.0, 5.0, 5.0)
    assert (found["b"].samples, found["b"].p50, found["b"].p99) == (1, 1.0, None)
    less = latency.delta(latency.percentiles(rows, "w"), latency.percentiles(rows.where("w = 'a'"), "w"), "w")
    assert {r.w: r.p50_delta for r in less.collect()} == {"a": 0.0, "b": None}
    with pytest.raises(ValueError):
        latency.check_fairness("x", "y")


def test_sample_bundle_and_reports(spark):
    good = spark.createDataFrame([(0,), (1,)], "sample_index int")
    assert latency.sample_errors(good, 2) == [] and latency.sample_errors(good, 3) == ["sample_count does not match sample artifacts"]
    assert latency.sample_errors(good.where("sample_index = 1"), 1) == ["sample indices must be contiguous"]
    assert latency.markdown([{"a": 1.5, "b": None}]).splitlines()[-1] == "| 1.500 | unavailable |"


def test_profiles(spark):
    docs = spark.createDataFrame([("a", "é" * 40), ("b", "x"), ("c", "y" * 300), ("d", None)], "doc_id string, text string")
    p = profile.corpus_profile(docs).first()
    assert (p.doc_count, p.total_bytes, p.p50_bytes, p.max_bytes) == (4, 381, 1, 300) and (p.short_ratio, p.medium_ratio, p.long_ratio) == (0.5, 0.25, 0.25)
    empty = profile.corpus_profile(docs.where("false")).first()
    assert (empty.doc_count, empty.total_bytes, empty.p95_bytes, empty.short_ratio) == (0, 0, 0, 0.0)
    lines = spark.createDataFrame([(i, f"d{i}", 10 + i) for i in range(9)], "line long, doc_id string, length long")
    assert {r.doc_id: r.offset for r in profile.byte_offsets(lines, 2).collect()} == {f"d{i}": sum(10 + j for j in range(i)) for i in range(9)}
    with pytest.raises(ValueError, match="ingest received duplicate doc_ids: a"):
        profile.reject_duplicates(docs.union(docs.where("doc_id = 'a'")), "ingest")


def _log(spark, *rows):
    return spark.createDataFrame([(i, *r, "src", i) for i, r in enumerate(rows)], "record_id long, subject string, predicate string, value string, source string, asserted_at_ms long")


def test_entities_and_facts(spark):
    log = _log(spark, ("s", facts.KIND, "person"), ("s", facts.ALIAS, "B"), ("s", "likes", "tea"), ("s", facts.ALIAS, "A"), ("s", facts.ALIAS, "B"), ("s", facts.KIND, "robot"), ("t", facts.ALIAS, "x"))
    (e,) = facts.entities(log).collect()
    assert (e.subject, e.kind, e.asserted_at_ms, e.aliases) == ("s", "robot", 5, ["B", "A"])
    assert [r.value for r in facts.query(log, "s").collect()] == ["tea"] and facts.query(log, "s", "hates").count() == 0
    wanted = spark.createDataFrame([("s", "robot", ["A", "C", "C"], "me", 9), ("u", "place", [], "me", 9)], "subject string, kind string, aliases array<string>, source string, asserted_at_ms long")
    assert sorted((r.subject, r.predicate, r.value) for r in facts.upsert_records(log, wanted).collect()) == [("s", facts.ALIAS, "C"), ("u", facts.KIND, "place")]
    new = spark.createDataFrame([(0, "s"), (1, "t")], "ord long, subject string")
    assert sorted(r.record_id for r in facts.numbered(log, new).collect()) == [7, 8]


def test_assets(spark):
    name = spark.createDataFrame([("a b", "f" * 64, "x/pic.JPG"), ("c", "0" * 64, "noext")], "i string, h string, f string").select(media.stored_name(F.col("i"), F.col("h"), F.col("f")))
    assert [r[0] for r in name.collect()] == ["a_b-ffffffffffff.JPG", "c-000000000000.bin"]
    known = spark.createDataFrame([("a", "Image")], "asset_id string, kind string")
    new = spark.createDataFrame([("a", "Image"), ("", "Video"), ("b", "Audio")], "asset_id string, kind string")
    assert {r.reason for r in media.invalid(new, known).collect()} == {"multimodal asset id already exists: a", "multimodal asset id cannot be empty", "multimodal asset kind is unknown"}
