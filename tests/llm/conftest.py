from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture
def documents(spark):
    """documents(rows of (doc_id, text[, lang[, source]])), with columns whose names operators use inside."""

    def make(rows):
        full = [(tuple(r) + (None, None))[:4] for r in rows]
        schema = "doc_id long, text string, lang string, source string"
        df = spark.createDataFrame(full, schema)
        return df.selectExpr("*", "length(text) as n_chars", "'x' as `key`", "1 as pos", "2 as node", "3 as row_no", "4 as `odd name`")

    return make


@pytest.fixture
def awkward(documents):
    """Null and empty values, a very long text, ties and repeated rows."""
    return documents(
        [
            (1, None, "en", "a"),
            (2, "", "en", None),
            (3, LONG, "en", "a"),
            (3, LONG, "en", "a"),
            (None, "one two three four five six seven", None, "b"),
            (4, "one two three four five six seven", "fr", "b"),
            (4, "another text under the same id", "fr", "b"),
            (5, " \n\t ", "de", "c"),
            (6, "日本語 ▁   😀", None, None),
            (7, "7 8 9 !!!", "en", "a"),
        ]
    )
