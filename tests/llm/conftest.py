import pytest


def table(spark, rows, extra=False):
    """documents of (doc_id, text); extra: with columns whose names clash with those inside the operators."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        for c in ("key", "doc", "id", "node", "bucket", "name", "sig", "spans", "score", "ids", "kept", "part", "class", "rank", "length", "size"):
            df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture
def docs(spark):
    return lambda rows, extra=False: table(spark, rows, extra)


#: Cases that every operator must take: nulls, empty, repeated rows, very long, blanks, odd characters.
ODD = [(None, "a null id here"), (1, None), (2, ""), (3, " \t\n"), (4, "same row"), (4, "same row"), (5, "wörd " * 30_000), (6, "x" * 200_000), (7, "İſK \x1c\x85 \U0001d518 <|endoftext|>")]
