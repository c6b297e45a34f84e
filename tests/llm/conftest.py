import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties and repeated rows, and columns of clashing names."""
    rows = [(1, "a b c d e f", "x", 7, 1), (2, "a  b c d e f ", "x", 7, 2), (2, "a  b c d e f ", "x", 7, 2), (3, None, None, 7, 3), (4, "", "y", 7, 4), (5, " \t\n", "y", 7, 5),
            (6, "one", "y", 7, 6), (None, "a b c d e f", "x", 7, 7), (7, "lang wort " * 30_000, "z", None, 8), (8, "lang wort " * 29_999 + "ende", "z", 7, None), (9, "x" * 200_000, None, 7, 9),
            (10, "é é 日本 <|endoftext|> \U0001f600", "z", 7, 10)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row long, number long").withColumnsRenamed({"number": "id"})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
