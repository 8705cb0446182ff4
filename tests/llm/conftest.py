import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns whose names the operators use."""
    long_text = " ".join(f"w{i % 977}x{i % 331}" for i in range(60_000))
    rows = [
        (1, "Alpha beta, gamma delta epsilon zeta eta theta.", "en", "a", 5),
        (1, "Alpha beta, gamma delta epsilon zeta eta theta.", "en", "a", 5),
        (2, "Alpha beta,\t\ngamma delta epsilon zeta eta theta.", None, "b", None),
        (3, None, "en", "a", 0),
        (4, "", "en", None, 0),
        (5, " \n\t ", "en", None, 0),
        (None, "Alpha beta, gamma delta epsilon zeta eta theta.", "en", "b", 1),
        (None, None, None, None, None),
        (6, long_text, "en", "b", 1),
        (7, long_text, "en", None, 1),
        (8, "é ß 😀 naïve 😀 password=😀 token: abcd1234efgh", "fr", "c", 1),
        (9, "???", "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for name in ("row", "digest", "size", "n", "toxic_score", "label", "position", "w", "slot", "keep_id", "bytes"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
