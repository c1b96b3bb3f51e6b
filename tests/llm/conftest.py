import pytest


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def odd_rows(spark):
    """Nulls in every column, empty and blank texts, a long one, ties, repeated rows, and columns with clashing names."""
    rows = [(0, "the cat sat on the mat with a hat and the dog " * 40, "en", "a", "x"), (1, None, "en", None, "x"), (2, "", None, "a", None),
            (3, "   \n\t ", "en", "b", "x"), (4, "word " * 20_000, "en", "a", "x"), (5, "the cat sat on the mat", "en", "b", "y"),
            (5, "the cat sat on the mat", "en", "b", "y"), (None, "the cat sat on the mat", None, "b", "y"),
            (6, "12345 !!! ???", "en", "b", "y"), (7, "été à la plage, 日本語テキスト \U0001f642", "fr", "c", "z"),
            (-9, "a\x00b   c\x85d", "fr", "c", "z"), (2**40, "the cat sat on the mat with a hat and the dog " * 40, "en", "c", "z")]
    names = "doc_id long, text string, lang string, source string, kept string"
    df = spark.createDataFrame(rows, names)
    from pyspark.sql import functions as F
    return df.withColumn("node", F.lit(1)).withColumn("score", F.lit("s")).withColumn("block", F.lit("b")).withColumn("ids", F.lit(3))


@pytest.fixture
def no_rows(odd_rows):
    return odd_rows.limit(0)
