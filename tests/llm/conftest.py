import pytest

ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma", "en", "a", 90),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma", "en", "a", 90),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "one two three\nLicensed under the Apache License, Version 2.0.\nmail me: jo.doe@mail1.example.com", "en", "b", 80),
    (5, "one two three\nLicensed under the Apache License, Version 2.0.\nmail me: jo.doe@mail1.example.com", "en", "b", 80),
    (None, "some words without an id at all but quite a few of them here", "en", "b", 60),
    (7, "dup line here\ndup line here\n" + "again and again and more " * 30, "en", None, 700),
    (8, " ".join(f"w{i}" for i in range(20000)), "en", "c", 100000),
    (9, "x" * 5000 + " \x0b <|endoftext|> 漢字 <b>&amp;", "en", "c", 5030),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and a column whose name operators use inside."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumn("n", F.lit(7)).withColumn("score", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("names", F.lit("x"))


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
