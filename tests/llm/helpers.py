"""Small tables with the cases that every operator must stand."""

import os

import pytest

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")

ODD_TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one two three four five six seven eight nine ten"), (5, "one two three four five six seven eight nine ten"),
    (6, "One two  three four five six seven eight nine TEN"), (7, "\n\n same line \nSAME LINE\nother"), (8, "word " * 30_000), (9, "ünïcödé ￿ \U0001f600 строка İ KK <|endoftext|> don't 12.5"), (9, "the same id again"),
    (None, "no id here, but words there are"), (None, None), (10, "x"), (10, "x"), (11, "12345 !!! ###"),
]


def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns named like those of operators."""
    rows = [(i, t, "en", None if i and i % 3 == 0 else "s", 0, "a", 7, "k", 3) for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, size long, key string, rank int")


def none(spark):
    return odd(spark).limit(0)
