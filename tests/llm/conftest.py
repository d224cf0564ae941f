"""Fixtures of hard rows: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

import pytest

WORDS = "the of and kayit vergi süre über café naïve data row token line value point".split()


def prose(r: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(r.choice(WORDS) + (str(r.randint(0, 99)) if r.random() < 0.3 else ""))
        if r.random() < 0.08:
            out[-1] += r.choice((".", ".\n", "!\n\n", "?", ";\n"))
    return " ".join(out)


@pytest.fixture(scope="session")
def hard_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, n_words, a.h): the last two columns clash with operators' own names or have a dot in theirs."""
    r = random.Random(11)
    texts: list[str | None] = [None, "", " \n\t ", "a", "A b", "one two three", "  x   y", "x" * 5000, prose(r, 6000)]
    texts += [prose(r, r.randint(5, 160)) for _ in range(40)]
    base = prose(r, 150)
    texts += [base, base, base + " tail", base.replace("the", "teh", 1), base.upper(), "\n".join([prose(r, 12)] * 6), "dup dup dup " * 40]
    rows = [(i, t, r.choice(("en", "de", None)), r.choice(("s1", "s1", "s2", "", None)), len(t or ""), -1, "k") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (12, "another text under a known id", "en", "s1", 3, 7, "z"), (None, "text without an id " * 9, "en", None, 5, 0, None), (None, None, None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, `a.h` string"


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
