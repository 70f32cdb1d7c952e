import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, short, long and repeated texts, ties, and extra columns whose names the operators use inside."""
    long = " ".join(f"word{i % 977} tail{i % 13}" for i in range(20_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1),
        (2, "alpha  beta\ngamma delta epsilon zeta eta theta", "en", "b", 2),
        (3, None, None, None, None),
        (4, "", "en", None, 0),
        (5, " \t\n", "en", "a", 3),
        (6, long, "en", "c", len(long)),
        (7, long + " end", "en", "c", len(long) + 4),
        (8, "x", "en", "b", 1),
        (8, "x", "en", "b", 1),
        (9, "é ß 日本 don't <|endoftext|> ½ \x1c y", "en", "a", 5),
        (None, "no id here at all my friend", "en", "b", 6),
        (10, "mail a@b.co or +1 (212) 555-0100 card 4111 1111 1111 1111 at 10.0.0.1", "en", "d", 7),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS size", "'k' AS _key", "2 AS rep", "'x' AS kept", "3 AS copies")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
