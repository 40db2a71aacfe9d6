"""Small tables with the awkward rows every operator must take."""
from __future__ import annotations

import pytest
from llm_helpers import DOCS, SMALL


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, tiny and very long texts, repeated rows."""
    long_text = "der die und das mit von ist nicht ein eine " * 40_000
    rows = [
        (-1, None, None, None, None),
        (-2, "", "en", "a", 0),
        (-3, "?! ...", None, "a", 6),
        (-4, "123 456", "de", None, 7),
        (-5, "one", "en", "b", 3),
        (-6, long_text, "de", "b", len(long_text)),
        (-7, "the same words in the same order here", "en", "a", 37),
        (-7, "the same words in the same order here", "en", "a", 37),
        (-8, "The same words, in the same order: here!", "en", "a", 40),
        (None, "a row without an id", "en", "c", 19),
    ]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
