import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source)."""

    def make(rows, **extra):
        full = [(row[0], row[1], "en", row[2] if len(row) > 2 else "s", len(row[1] or "")) for row in rows]
        frame = spark.createDataFrame(full, DOCUMENTS)
        for name, value in extra.items():
            frame = frame.withColumn(name, value)
        return frame

    return make
