import corpus_pipeline
import duckdb

from larkspur.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contract(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "packing":
            assert out.agg({"length": "sum"}).first()[0] == out.select("doc_id", "doc_tokens").distinct().agg({"doc_tokens": "sum"}).first()[0]
        else:
            assert out.columns == columns and 0.5 * before < out.count() <= before
        docs = out


def test_run_gives_the_stages_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    conversations = spark_free("conversations")  # noqa: F841
    assert duckdb.sql(queries.oracle_sql()["op6_toolcalls"]).fetchall()


def spark_free(name):
    return duckdb.sql(f"select * from '{SF}/{name}.parquet'")
