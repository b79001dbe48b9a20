import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and a clashing extra column."""
    base = "the quick brown fox jumps over the lazy dog while nine pale riders watch from a hill near the old town gate and sing "
    rows = [
        (1, base * 4, "en", "a"),
        (2, base * 4, "en", "a"),
        (2, base * 4, "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (None, "mail me at a.b@c.example.com or call +1 (499) 555-6503 now", "en", None),
        (None, base * 4 + "again", None, None),
        (5, "   \n\t ", "en", "a"),
        (6, "x" * 100_000, "en", "a"),
        (7, (base + "ünï €") * 900, "de", "a"),
        (8, "one two three", "en", "c"),
        (9, "One TWO three", "en", "c"),
    ]
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
