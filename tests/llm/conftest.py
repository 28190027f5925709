import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text, lang, source) rows."""
    def build(rows, extra=""):
        full = [(i, t, g, s, len(t) if t is not None else None, *more) for i, t, g, s, *more in rows]
        return spark.createDataFrame(full, SCHEMA + extra)

    return build


#: Rows that every operator has to get through: nulls in all columns, empty, blank and very long texts, repeated rows and ids.
ODD = [(None, None, None, None), (1, "", "en", "a"), (2, None, "en", None), (3, " \t\n ", "de", "b"), (4, "x", None, "a"), (5, "the same words of a text here", "en", "a"),
       (5, "the same words of a text here", "en", "a"), (5, "other words", "en", "a"), (6, "the same words of a text here", "fr", "b"),
       (None, "the same words of a text here", "fr", "b"), (7, "word " * 60_000, "en", "a"), (8, "é" * 9_000 + "\U0001F600", "fr", "ü"), (9, "1234 5678 !!", "en", "a"), (10, "y" * 70_000, "de", "a")]
