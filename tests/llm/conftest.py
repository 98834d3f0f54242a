import pytest
from pyspark.sql import types as T


@pytest.fixture()
def docs_of(spark):
    """Documents from texts (ids follow their order, or pairs of id and text), with clashing extra columns."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()),
                               T.StructField("line", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("n_chars", T.LongType())])
        return spark.createDataFrame([(i, t, "k", 1, None, len(t or "")) for i, t in rows], schema).repartition(3)

    return make
