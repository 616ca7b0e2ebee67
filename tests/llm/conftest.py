import pytest
from pyspark.sql import types as T

#: Documents with columns whose names the operators use themselves.
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("hit", T.StringType()),
    T.StructField("id_hit", T.StringType()), T.StructField("digest", T.StringType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents from (id, text) or (id, text, lang, source) tuples."""

    def build(*rows):
        full = []
        for row in rows:
            key, text, lang, source = (*row, *[None, "s"][len(row) - 2:])[:4] if len(row) < 4 else row
            full.append((key, text, lang, source, len(text or ""), "r", "i", "h", "x", "d"))
        return spark.createDataFrame(full, DOCS)

    return build
