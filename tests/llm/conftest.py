import random

import pytest


@pytest.fixture()
def noise():
    """Words and texts that repeat across calls with one seed."""
    rng = random.Random(7)

    def words(n, alphabet="abcdefghij", longest=6):
        return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n)]

    words.rng = rng
    return words


DOCS = "doc_id long, text string, lang string, n_lines string, fingerprint int, _pos int"


@pytest.fixture()
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    columns that clash with names the operators use."""
    rows = [(1, None, "en", "x", 1, 1), (2, "", None, None, None, None), (None, "a b c\nshared line", "en", "x", 1, 1),
            (None, "a b c\nshared line", "en", "x", 1, 1), (3, " \t\n\x0b \n", "de", "y", 2, 2),
            (4, "word " * 30_000, "en", "z", 3, 3), (5, "Ünï čödé 日本語 🎉\nshared line", "fr", "z", 3, 3)]
    rows += [(10 + i, f"line of {i}\n  SHARED line \nend", "en", "x", i, i) for i in range(12)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
