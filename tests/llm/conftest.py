import pytest
from pyspark.sql import types as T


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with inner ones."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("id", T.LongType()), T.StructField("key", T.StringType()),
        T.StructField("row", T.LongType()), T.StructField("group", T.StringType())])

    def make(pairs):
        return spark.createDataFrame([(i, t, 7, "k", 1, "g") for i, t in pairs], schema)
    return make


@pytest.fixture(scope="session")
def texts(duck):
    """All documents of the smallest test table."""
    return duck.execute("select doc_id, text from documents").fetchall()
