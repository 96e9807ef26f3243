"""Documents with nulls, empty and long texts, ties, repeated rows and columns whose names clash."""

from __future__ import annotations

ODD = [
    (1, "the cat sat on the mat and then the cat sat on the mat", "en", "b", 1),
    (2, "the cat sat on the mat and then the cat sat on the mat", "en", "b", 1),
    (2, "the cat sat on the mat and then the cat sat on the mat", "en", "b", 1),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n ", "en", "a", 4),
    (6, "Word", "en", None, 4),
    (7, "two words", "en", "c", 9),
    (8, "lorem ipsum dolor " * 3000, "la", "a", 54000),
    (9, "x" * 30000, "xx", "a", 30000),
    (10, "naïve café \U0001f600 日本語 a▁b", "fr", "a", 20),
    (11, "line one here\nline one here\nline two\n\n\n   \nend # $ % | <x>", "en", "b", 50),
    (None, "a row without an id", "en", "b", 19),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "'clash' as fp", "0L as n", "'k' as key", "1 as size")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
