"""Fixtures with the edge cases that every training-data operator must take."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 977} filler" for i in range(30_000))
    rows = [
        (0, None, None, None, None),
        (1, "", "en", "a", 0),
        (2, "   \n\t ", None, "a", 6),
        (3, long, "en", "a", len(long)),
        (4, "One two three four five six seven eight nine ten eleven twelve", "en", "b", 60),
        (4, "One two three four five six seven eight nine ten eleven twelve", "en", "b", 60),
        (5, "One two three four five six seven eight nine ten eleven twelve", "en", "c", 60),
        (None, "no id here at all", "en", None, 17),
        (6, "Überraschung \U0001f600 naïve café ñandú 中文字 MIT License", "de", "c", 40),
        (7, "<|endoftext|> it's  100%\r\n½ done x", "en", "c", 30),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
