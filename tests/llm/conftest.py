import pytest

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda.", "en", "a", 60),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda.", "en", "a", 60),
    (3, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda.", "en", "b", 60),
    (4, None, None, None, None),
    (5, "", "en", "a", 0),
    (6, " \n\t ", "en", "a", 4),
    (7, "one", "en", "c", 3),
    (8, "word " * 30_000, "en", "a", 150_000),
    (9, "été ñandú ß 日本語 🙂 <|endoftext|> don't", "fr", "a", 40),
    (7, "one", "en", "c", 3),
    (None, "no id here at all", "en", "a", 17),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """Nulls, an empty and a very long text, ties, a repeated row, and columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumns({"_m": F.lit(1), "fail_mask": F.lit(2), "part": F.lit(3), "ids": F.lit("x"), "score": F.lit(0.5)})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
