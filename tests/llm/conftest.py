from __future__ import annotations

import pytest

LONG = ("alpha beta gamma delta " * 3 + "token = abcdef123456 \n") * 20_000


@pytest.fixture(scope="session")
def edge(spark):
    """Null, empty, blank, short, long, tied and repeated texts, and columns with names that operators use themselves."""
    texts = [None, "", " \n\t ", "one", "one", "two words", "two words", LONG, LONG + "x", "é ñ ß — 中文 text", "a\u0085b c", "plain words of no note " * 20]
    rows = [(k, t, "x", k, [k], k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id long, keys array<long>, n long")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df) -> dict:
    rows = df.collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows)
    return found


def twins(size: int) -> tuple[str, str]:
    """A word of a and b of so many letters, and the one with both exchanged; polynomial hashes modulo 2**64 can't tell them apart."""
    word, swap = "a", str.maketrans("ab", "ba")
    while len(word) < size:
        word += word.translate(swap)
    return word, word.translate(swap)
