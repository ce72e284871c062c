import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """rows -> documents with columns whose names the operators use inside."""
    def build(rows):
        docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA)
        names = ("row", "words", "bucket", "core", "role", "id", "label", "cell", "chunk", "part", "features", "size", "component", "mass", "runs", "base")
        return docs.select("*", *[F.lit(n).alias(n) for n in names])

    return build
