"""Fixtures of the operators' tests."""

import pytest

SF001 = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row_key long, h string, words int, cls long, "
          "_d int, _k int, _kept int, _n int, _row int, _host int, _doc int")
LONG = " ".join(f"word{i * 7919 % 4001}" for i in range(30000))
TEXT = "The same text is here twice, with mail some.name@example.com and the phone +1 (275) 555-7228. " * 3
#: (doc_id, text) of the edge cases: null, empty, blank, short, very long, copies, a repeated row, a null id.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, LONG), (6, LONG), (7, TEXT), (7, TEXT), (8, TEXT),
         (9, "é ñ Under the MIT License <|endoftext|>\nUnder the MIT License"), (None, "no id " * 40)]


def frame(spark, rows):
    """documents with columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}" if i != 4 else None, len(t or ""), 5, "h", 1, None, *range(7))
                                  for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, EDGES).limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
