from __future__ import annotations

import pytest

EDGE = [(1, "alpha beta gamma delta"), (2, None), (3, ""), (None, "alpha beta gamma delta"), (5, "x"), (5, "x"), (7, "été " * 9000), (8, " \n\t "), (9, "A\0b  c")]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    rows = [(i, t, None if k % 2 else "en", "s" if k % 3 else None, len(t or ""), "score", k, [1.0]) for k, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, to string, task int, contamination array<double>")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
