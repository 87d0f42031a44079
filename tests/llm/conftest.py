import pytest

DOCS = "doc_id long, text string, fp string, node string, shard string"


@pytest.fixture
def docs(spark):
    """Documents with extra columns whose names the operators use themselves."""
    return lambda *rows: spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
