import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, repeated and very long texts, and a clashing extra column."""
    texts = [None, "", "  \n", "x", "A b c D e f", "a B c d E F", "word " * 60_000, "é é\n" * 40, "x", "<|endoftext|> tail", "a\u00a0b\u3000c", "0" * 9000]
    return spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)] + [(3, "x", 1.5)], "doc_id long, text string, score double")
