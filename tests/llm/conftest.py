import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        T.StructField("size", T.DateType()),
        T.StructField("row", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("copies", T.StringType()),
        T.StructField("words", T.StringType()),
        T.StructField("target", T.StringType()),
    ]
)

PROSE = "the cat sat on the mat and looked at a bird that sang in the old tree near our house".split()


def prose(n: int, seed: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(PROSE[(x >> 8) % len(PROSE)] + "abcdefghij"[(x >> 16) % 10])
    return " ".join(out)


@pytest.fixture(scope="session")
def make(spark):
    """A frame of documents with further columns whose names clash with those of operators."""

    def of(rows):
        full = [
            (*(tuple(r) + (None,) * 5)[:5], datetime.date(2020, 1, 1), "r", "n", "c", "w", "t") for r in rows
        ]
        return spark.createDataFrame([Row(*r) for r in full], SCHEMA)

    return of


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and blank texts, ties, repeated rows and a long text."""
    return make(
        [
            (1, None, "en", "a"),
            (2, "", "en", "a"),
            (3, " \t\n ", None, None),
            (4, prose(120, 1), "en", "a"),
            (4, prose(120, 1), "en", "a"),
            (4, prose(90, 2), "fr", "b"),
            (5, prose(120, 1), None, "b"),
            (None, prose(120, 1), "en", None),
            (None, None, None, None),
            (6, "x" * 5000 + " é ünï 你好 " + prose(3000, 3), "fr", "c"),
            (7, "one", "en", "b"),
            (-8, "   \x85word\x0b\x0cnext", "en", "b"),
        ]
    )


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
