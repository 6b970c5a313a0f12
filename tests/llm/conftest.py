import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, row string, n_words string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and identifiers, columns with clashing names."""
    base = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"v{i % 977}x{i % 13}" for i in range(60_000))
    texts = [
        (1, base), (2, base), (3, f"start {base} end"), (3, f"start {base} end"), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (None, base), (None, None), (8, long), (9, f"{long} x"), (3, "other text altogether"),
        (10, "Mail a.b@c.de or +1 (555) 123-4567, 10.0.0.1, 4111 1111 1111 1111"), (-5, "negative identifiers count, too"), (11, " ".join(f"w{i}" for i in range(12))), (12, " ".join(f"w{i}" for i in range(13))),
    ]
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "s", "r", "n") for i, t in texts], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
