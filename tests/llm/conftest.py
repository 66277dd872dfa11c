import pytest
from pyspark.sql import types as T

LONG = "word " * 20_000


@pytest.fixture(scope="session")
def docs_schema():
    return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture
def odd_docs(spark, docs_schema):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "plain words here"), (5, "plain words here"), (6, "plain words here"), (None, "no id at all"), (7, "Ünï ÇÖDÉ 漢字 K x"), (8, "a")]
    df = spark.createDataFrame(rows, docs_schema)
    from pyspark.sql import functions as F

    for name in ("score", "shard", "slot", "fp", "h", "copy", "row", "b", "label", "n", "u", "v", "start", "hash"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture
def no_docs(spark, docs_schema):
    return spark.createDataFrame([], docs_schema)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
