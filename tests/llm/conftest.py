import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text[, lang, source]) as a documents table, with extra columns whose
    names the operators use themselves."""
    def make(*rows, **extra):
        full = [(r[0], r[1], *(list(r[2:]) + ["en", "s"][len(r) - 2:]), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        for name, value in extra.items():
            df = df.selectExpr("*", f"'{value}' AS `{name}`")
        return df

    return make
