import pytest

ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a"),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "  \t\n\r ", "de", "b"),
    (None, "one two three four five", "de", None),
    (5, "Released under the MIT License.\npassword=7602ad27cf5550de1c", "fr", "c"),
    (6, "w " * 30_000, "fr", "c"),
    (7, "é漢😀 <|endoftext|> it's 1²  x\u00a0y", "es", "b"),
    (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa", None, "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and extra columns of operators' own names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    extra = ["_text", "fp0", "node", "key", "size", "n_words", "_words", "found", "_row", "bucket", "id", "n_tokens_", "_host", "c0"]
    return df.selectExpr("*", "cast(length(text) as long) AS n_chars", *[f"'x' AS `{c}`" for c in extra]).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
