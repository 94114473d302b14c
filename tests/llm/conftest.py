import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Make a documents table; rows are (doc_id, text) or (doc_id, text, source)."""

    def make(rows, more=None):
        full = [(i, t, "en", s[0] if s else "src0", 0 if t is None else len(t)) for i, t, *s in rows]
        df = spark.createDataFrame(full, DOCS)
        for name, value in (more or {}).items():
            df = df.withColumn(name, F.lit(value))
        return df

    return make
