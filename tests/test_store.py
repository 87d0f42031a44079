import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import embedding
from larkspur.plans import engine, harness, service
from larkspur.sources import ndjson, pack
from larkspur.sources.store import Store, StoreError
from larkspur.streaming.ingest import ingest


def _write(path, rows):
    path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    return str(path)


DOCS = [{"doc_id": "doc-1", "text": "cold open", "metadata": {"kind": "a"}, "priority": 3}, {"doc_id": "doc-2", "text": "warm cold start", "timestamp_ms": 5}, {"doc_id": "doc-3", "text": "nothing", "tags": ["x"]}]


def _docs(spark, tmp_path, rows=DOCS, name="docs.ndjson"):
    return ndjson.documents(spark, _write(tmp_path / name, rows))


def test_scan_keeps_everything(spark, tmp_path):
    rows = {r.doc_id: r for r in _docs(spark, tmp_path).collect()}
    assert rows["doc-1"].metadata == '{"kind":"a"}' and rows["doc-3"].metadata == "{}" and rows["doc-2"].timestamp_ms == 5
    assert json.loads(rows["doc-1"].payload) == DOCS[0]
    for bad in ({"doc_id": 3, "text": "x"}, {"doc_id": "", "text": "x"}, {"doc_id": "a"}):
        with pytest.raises(Exception):
            _docs(spark, tmp_path, [bad], "bad.ndjson").collect()
    extra = spark.createDataFrame([("d", "t", '{"k":1}', None, '{"doc_id":"other","p":2}')], "d string, t string, m string, ts long, x string")
    made = extra.select(ndjson.payload(F.col("d"), F.col("t"), F.col("m"), F.col("ts"), F.col("x"))).first()[0]
    assert json.loads(made) == {"doc_id": "d", "text": "t", "metadata": {"k": 1}, "p": 2}


def test_results_as_array_or_lines(spark, tmp_path):
    rows = [{"query_id": "q", "hits": [{"doc_id": "b"}, {"doc_id": "a"}]}]
    (tmp_path / "array.json").write_text(json.dumps(rows))
    for path in (str(tmp_path / "array.json"), _write(tmp_path / "lines.jsonl", rows)):
        assert [(r.rank, r.doc_id) for r in ndjson.ranked_results(spark, path).orderBy("rank").collect()] == [(1, "b"), (2, "a")]
    (tmp_path / "empty.json").write_text("\n")
    with pytest.raises(ValueError):
        ndjson.ranked_results(spark, str(tmp_path / "empty.json"))


def test_raw_vectors(spark, tmp_path):
    import numpy as np

    ids = _write(tmp_path / "ids.ndjson", [{"doc_id": "a"}, {"doc_id": "b"}])
    np.arange(6, dtype="<f4").tofile(tmp_path / "m.f32")
    assert {r.doc_id: r.embedding for r in ndjson.raw_vectors(spark, ids, str(tmp_path / "m.f32"), 3).collect()} == {"a": [0, 1, 2], "b": [3, 4, 5]}
    with pytest.raises(ValueError):
        ndjson.raw_vectors(spark, ids, str(tmp_path / "m.f32"), 4)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store")).create()


def test_generations(spark, tmp_path, store):
    with pytest.raises(StoreError):
        Store(spark, store.root).create()
    docs = _docs(spark, tmp_path)
    assert store.publish_documents(docs, expected=0) == 1
    assert store.publish_documents(_docs(spark, tmp_path, [{"doc_id": "doc-9", "text": "new"}, {"doc_id": "doc-1", "text": "changed"}], "more.ndjson")) == 2
    rows = {r.doc_id: (r.text, r.internal_id) for r in store.documents().collect()}
    assert rows == {"doc-1": ("changed", 0), "doc-2": ("warm cold start", 1), "doc-3": ("nothing", 2), "doc-9": ("new", 3)}
    with pytest.raises(StoreError, match="generation changed"):
        store.publish_documents(docs, expected=0)
    with pytest.raises(ValueError, match="duplicate doc_ids: doc-1"):
        store.publish_documents(docs.union(docs.where("doc_id = 'doc-1'")))
    (tmp_path / "store" / "manifest-00000002.json").write_text("damaged")
    (tmp_path / "store" / ".manifest-00000002.json.crc").unlink(missing_ok=True)
    assert store.manifest().generation == 1


def test_vectors_must_cover_and_are_dropped(spark, tmp_path, store):
    docs = _docs(spark, tmp_path)
    store.publish_snapshot(docs, embedding.embed(docs.select("doc_id", "text"), 8))
    assert store.vectors().count() == 3
    with pytest.raises(ValueError, match="documents without vectors: doc-2, doc-3"):
        store.publish_vectors(store.vectors().where("doc_id = 'doc-1'"))
    store.publish_documents(_docs(spark, tmp_path, [{"doc_id": "doc-4", "text": "cold"}], "d4.ndjson"))
    with pytest.raises(StoreError, match="without vectors"):
        store.vectors()
    assert store.postings().where("token = 'cold'").count() == 3


def test_lock(spark, store, tmp_path):
    store._fs.createNewFile(store._path("_LOCK"))
    with pytest.raises(StoreError, match="another writer"):
        store.publish_documents(_docs(spark, tmp_path))


def test_search(spark, tmp_path, store):
    docs = _docs(spark, tmp_path)
    vectors = embedding.embed(docs.select("doc_id", "text"), 8)
    store.publish_snapshot(docs, vectors)
    ask = lambda **x: [(r.doc_id, r.preview) for r in engine.search(store, engine.SearchRequest(**x)).collect()]
    assert ask(text_query="cold open", top_k=1, include_preview=True) == [("doc-1", "cold open")]
    v = vectors.where("doc_id = 'doc-3'").first().embedding
    assert ask(mode="vector", vector_query=v, top_k=1)[0][0] == "doc-3"
    assert ask(mode="hybrid", text_query="nothing", vector_query=v, top_k=2)[0][0] == "doc-3"
    assert ask(text_query="cold", filter={"metadata.kind": "a"}) == [("doc-1", None)]
    assert ask(text_query="cold", top_k=0) == []
    with pytest.raises(ValueError, match="text_query is required for text search"):
        ask(top_k=0)
    with pytest.raises(ValueError, match="dimensions"):
        ask(mode="vector", vector_query=[1.0])


def test_batch_routes_lanes(spark, tmp_path, store):
    docs = _docs(spark, tmp_path)
    store.publish_documents(docs)
    vectors = embedding.embed(docs.select("doc_id", "text"), 64)
    schema = "query long, query_id string, query_text string, top_k int, clauses map<string,string>, lane_eligibility struct<text:boolean,vector:boolean,hybrid:boolean>"
    queries = spark.createDataFrame([(0, "t", "cold", 5, {}, (True, False, False)), (1, "v", "nothing", 1, {}, (False, True, False)), (2, "h", "warm", 1, {}, (False, False, True)), (3, "n", "cold", 5, {}, (False, False, False)), (4, "f", "cold", 1, {"metadata.kind": "a"}, (True, False, False)), (5, "t", "open", 5, {"priority": "3"}, (True, True, False))], schema)
    rows = engine.search_batch(queries, store.documents(), vectors, 64).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r.query, []).append(r.doc_id)
    assert found == {0: ["doc-1", "doc-2"], 1: ["doc-3"], 2: ["doc-2"], 4: ["doc-1"]}


def test_service(spark, tmp_path, monkeypatch):
    tools = service.Tools(spark, str(tmp_path))
    assert tools.handle({"tool": "open", "root": "/elsewhere"})["code"] == "invalid_request"
    assert tools.handle({"tool": "open", "root": f"{tmp_path}/../x"})["code"] == "invalid_request"
    session = tools.handle({"tool": "create", "root": str(tmp_path / "s")})["result"]
    tools.handle({"tool": "ingest", "session": session, "path": _write(tmp_path / "docs.ndjson", DOCS)})
    assert [h["doc_id"] for h in tools.handle({"tool": "search", "session": session, "text": "cold"})["result"]] == ["doc-1", "doc-2"]
    assert tools.handle({"tool": "search", "session": 99, "text": "x"})["code"] == "session_not_found"
    monkeypatch.setattr(service, "MOST_SESSIONS", 1)
    assert "session limit exceeded" in tools.handle({"tool": "open", "root": str(tmp_path / "s")})["error"]


def test_pack(spark, tmp_path):
    lanes = {"text": True, "vector": False, "hybrid": True}
    query = {"query_id": "q", "query_class": "keyword", "difficulty": "easy", "query_text": "cold", "top_k": 1, "filter_spec": {"kind": "a", "n": 1}, "preview_expected": False, "embedding_available": True, "lane_eligibility": lanes}
    queries = _write(tmp_path / "q.jsonl", [query])
    m = pack.write_pack(spark, _write(tmp_path / "docs.ndjson", DOCS), {"core": queries}, str(tmp_path / "pack"), 16)
    assert m["corpus"]["doc_count"] == 3 and m["query_sets"][0]["classes"] == ["keyword"] and pack.validate_manifest(m) == []
    assert spark.read.parquet(str(tmp_path / "pack/document_vectors")).first().embedding is not None
    clauses = ndjson.query_set(spark, queries).select(ndjson.string_clauses(F.col("filter_spec"))).first()[0]
    assert clauses == {"kind": "a"}
    bad = m | {"dataset_tier": "tiny", "variant_id": "dirty_light", "files": [{"path": "../x", "checksum": "md5:1"}]}
    assert pack.validate_manifest(bad) == ["invalid dataset_tier", "variant_id must match dirty_profile.profile", "file paths must stay within the dataset pack root", "file checksum must use sha256 format"]
    assert pack.spec_dimensions("minilm-384-f32-cosine") == 384 and pack.spec_metric("minilm-384-f32-cosine") == "cosine"


def test_harness(spark):
    samples = harness.run(spark, {"good": lambda: 1, "bad": lambda: 1 / 0}, 4)
    rows = {r.workload: r for r in harness.summary(samples).collect()}
    assert rows["good"].samples == 4 and rows["good"].p99 is not None and rows["bad"].p50 is None


def test_bundles(spark, tmp_path):
    samples = harness.run(spark, {"good": lambda: 1, "bad": lambda: 1 / 0}, 2)
    folder = tmp_path / "run"
    harness.write_bundle(str(folder), {"command": "profile", "arguments": ["x.ndjson"]}, samples)
    got = harness.read_bundle(str(folder))
    assert len(got["samples"]) == 4 and got["status"] == {"complete": True} and harness.replay_command(got["config"]) == "python -m larkspur.cli profile x.ndjson"
    (folder / "sample-000.json").unlink()
    assert harness.read_bundle(str(folder))["status"]["missing"] == ["sample-000.json"]
    (folder / "summary.md").write_text("other")
    with pytest.raises(ValueError, match="checksum mismatch: summary.md"):
        harness.read_bundle(str(folder))
    rows = {r.workload: r.delta for r in harness.mode_comparison(harness.summary(samples), harness.summary(samples)).collect()}
    assert rows == {"good": 0.0, "bad": None}


def test_vector_profile(spark):
    vectors = spark.createDataFrame([(f"v{i}", [float(i % 5), 1.0]) for i in range(70)], "doc_id string, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query long, vector array<double>")
    found = harness.profile_vector_query(asked, vectors, 2, 2, "preview")
    assert (found["mode"], found["candidates"], found["hits"]) == ("preview", 64, 2)


def test_streaming_ingest(spark, tmp_path, store):
    folder = tmp_path / "in"
    folder.mkdir()
    _write(folder / "a.ndjson", DOCS)
    ingest(spark, str(folder), store, str(tmp_path / "ck")).awaitTermination()
    _write(folder / "b.ndjson", [{"doc_id": "doc-1", "text": "later"}])
    ingest(spark, str(folder), store, str(tmp_path / "ck")).awaitTermination()
    assert store.manifest().generation == 2 and {r.doc_id: r.text for r in store.documents().collect()}["doc-1"] == "later"
