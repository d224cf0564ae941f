"""In-force status as native columns (STA-01 to STA-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .text import drop, has, java, start_of


def status(body: Column) -> Column:
    """STA-01: a unit is repealed if it carries a repeal mark that is not about a part of it."""
    return F.when(has(drop(body, X.PARTIAL_REPEAL), X.REPEAL_MARK), X.REPEALED).otherwise(X.IN_FORCE)


def article_status(body: Column) -> Column:
    """STA-02: an article is repealed only if the mark stands in its opening notes."""
    rest = drop(body, X.PARTIAL_REPEAL)
    notes = F.length(F.regexp_extract(rest, java(X.OPENING_NOTES), 0))
    at = start_of(rest, X.REPEAL_MARK)
    return F.when((at >= 0) & (at < F.greatest(notes, F.lit(1))), X.REPEALED).otherwise(X.IN_FORCE)


def rolled_up(paragraphs: Column, body: Column) -> Column:
    """STA-03: repealed iff all numbered paragraphs are; without any, by the opening notes."""
    numbered = F.filter(paragraphs, lambda p: p["no"].isNotNull())
    every = F.forall(numbered, lambda p: p["yurutluk"] == X.REPEALED)
    return F.when(F.size(numbered) > 0, F.when(every, X.REPEALED).otherwise(X.IN_FORCE)).otherwise(article_status(body))


def paragraph_status(text: Column, clauses: Column) -> Column:
    """STA-04: from the clauses if there are any, else from the text."""
    every = F.forall(clauses, lambda c: c["yurutluk"] == X.REPEALED)
    return F.when(F.size(clauses) > 0, F.when(every, X.REPEALED).otherwise(X.IN_FORCE)).otherwise(status(text))
