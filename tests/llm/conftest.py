import pytest


@pytest.fixture
def documents(spark):
    """Rows that hold the awkward cases, with an extra column of a clashing name."""
    text = "The quick brown fox jumps over the lazy dog and then runs far away home " * 3
    rows = [
        (1, text, "en", "a", len(text), 1.0),
        (2, text, "en", "a", len(text), 1.0),
        (3, None, None, None, None, None),
        (4, "", "en", "a", 0, 1.0),
        (5, "one two", "en", "b", 7, 1.0),
        (6, "  \t\n ", "en", "b", 6, 1.0),
        (7, "x" * 40_000 + " end", "de", "b", 40_004, 1.0),
        (8, text + " tail words here", "en", "a", 300, 1.0),
        (8, text + " tail words here", "en", "a", 300, 1.0),
        (None, text, "en", None, 300, 1.0),
        (9, "123 456 789 000", "en", "c", 15, None),
        (10, "Ünïcödé wörds ▁ und \u0000 mehr 日本語 text", "de", "c", 30, 1.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")


@pytest.fixture
def empty(documents):
    return documents.limit(0)
