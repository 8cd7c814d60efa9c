import random

import pytest

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "po", "ra", "se", "ti", "vu") for b in ("bran", "den", "fis", "gor", "lem", "nal", "sto", "tur")]


@pytest.fixture(scope="session")
def prose():
    """Invented prose: prose(seed, words)."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture()
def awkward(spark, prose):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""
    long_ = prose(1, 60_000)
    rows = [
        (1, prose(2, 120), "a"), (2, prose(2, 120), "a"), (3, prose(2, 118) + " other end", "b"),
        (4, None, "a"), (5, "", None), (6, " \n\t", "b"), (7, long_, "a"), (8, long_ + " end", "b"),
        (9, prose(3, 3), "a"), (9, prose(3, 3), "a"), (9, prose(4, 80), "b"),
        (None, prose(5, 80), None), (None, prose(5, 80), None), (12, "x" * 200_000, "c"), (13, prose(6, 90), "c"),
        (14, "naïve Žluťoučký 😀 " * 40, "c"), (15, prose(2, 120).replace(" ", "  "), "c"),
    ]
    data = [(i, t, "en", s, len(t or ""), "x", 1, "y", 2.0, "z") for i, t, s in rows]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, node string, size int, `_node` string, score double, row string"
    )


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (3, 1, 1), (4, None, None), (7, 0, 1), (None, 1, 1), (8, 1, 0), (8, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
