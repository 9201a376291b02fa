import pytest


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and blank texts, a long one, ties and repeated rows, and clashing extra columns."""
    rows = [
        (1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, " \t\n ", "en", "s", 4, "x"), (None, "one two three", None, "s", 1, None), (None, "one two three", None, "s", 1, None),
        (4, "word " * 30_000, "en", "s", 1, "x"), (5, "same row", "en", "s", 1, "x"), (5, "same row", "en", "s", 1, "x"), (6, "Ünï ćödé 漢字 😀 text", "de", None, 1, "x"), (7, "Same Row", "en", "s", 1, "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, item_id string"
    df = spark.createDataFrame(rows, schema)
    for c in ("h", "fp", "rid", "start", "spans", "words", "hot", "score", "slot"):
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("clash"))
    return df
