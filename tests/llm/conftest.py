import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A frame of (doc_id, text) rows with the other columns of documents and some that clash with inner names."""

    def make(rows):
        full = [(i, t, None, None, None, "x", 1, "y") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, spans string, h int, key string").repartition(3)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
