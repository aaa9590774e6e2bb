import random

import pytest

from revlens.llm.common import load

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return load(spark, SF0001, "documents")


@pytest.fixture(scope="session")
def labels(spark):
    return load(spark, SF0001, "labels")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def odd_texts():
    rng = random.Random(5)
    word = ["alpha", "beta", "gamma", "delta", "é", "日本", "x"]
    long = " ".join(rng.choice(word) + str(rng.randrange(40)) for _ in range(60_000))
    return [
        (1, "a b c d e f g"), (2, None), (3, ""), (4, " \t\n "), (5, "a  b\tc d e f\ng"), (6, "one"), (7, long),
        (8, long), (9, "x" * 70_000), (10, "\x00 \x01 ### </turn> <|endoftext|>"), (None, "a b c d e f g"), (None, None),
        (11, "Ünï cödé ÄÖ İ ﬁ"), (12, "　wide space \x85"), (13, "a b c d e f g"), (13, "a b c d e f g"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns
    with the names of operator outputs."""
    rows = [(i, t, "src", 0.5, True, -1, "z") for i, t in odd_texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, kept boolean, n int, label string")


@pytest.fixture(scope="session")
def mixed(spark):
    """Ids that floats can't hold beside nulls, ids that repeat with other texts,
    and giant texts, all in one partition and so in one batch."""
    big = 2**53
    giant = " ".join(f"word{k % 97} and{k}" for k in range(6000))
    rows = [(big + 1, "one two three four five six"), (None, "nobody's text"), (big + 3, "one two three four five six"), (1, giant),
            (None, giant), (3, giant + " end"), (4, "short"), (big + 1, giant), (big + 1, "another text of the same id"), (None, None),
            (-big - 1, "below"), (-big - 3, ""), (4, "short"), (4, "three four five six seven eight")]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
