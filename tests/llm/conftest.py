import pytest

from pyspark.sql import functions as F

TEXTS = [None, "", " ", "one", "The quick brown fox jumps over the lazy dog. " * 3, "x" * 30_000, "word " * 8_000, "Ünïcödé façade 日本語 😀", "a\x00b\ttab\r\nline", "The quick brown fox jumps over the lazy dog. " * 3]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    rows = [(i, t, None if i % 3 == 0 else "en", "s", 1.0, b"y", i) for i, t in enumerate(TEXTS)] + [(3, "one", "en", "s", 1.0, b"y", 3), (None, "no id", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, ids binary, n long").withColumn("fp", F.lit("clash"))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 1, 0), (4, 1, 1), (6, 0, 1), (7, 1, None), (None, 1, 1), (9, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
