import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) rows, with extra columns of clashing names."""

    def make(rows, extra=()):
        schema = T.StructType([*DOCS.fields, *[T.StructField(c, T.StringType()) for c in extra]])
        full = [
            (i, t, "en", "src0", None if t is None else len(t), *[f"x{i}"] * len(extra)) for i, t in rows
        ]
        return spark.createDataFrame(full, schema)

    return make
