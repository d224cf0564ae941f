"""What query modules share: inputs, literal tables for both engines, and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lexforge.functions import fixed as X
from lexforge.sources.shared import spread

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    """Queries and their SQL by name."""

    queries: dict[str, Query]
    sql: dict[str, str]

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep


def catalog() -> Catalog:
    return Catalog({}, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of long texts, whose rows cost enough to be worth spreading over all cores."""
    return spread(table(spark, sf_dir, name))


def quoted(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    parts = str(value).replace("'", "''").split("\x1f")
    said = " || chr(31) || ".join(f"'{p}'" for p in parts)
    return f"({said})" if len(parts) > 1 else said


def values(rows: Sequence[Sequence[Any]], columns: str) -> str:
    """``(VALUES ...) t(columns)`` for DuckDB; ``columns`` is a Spark schema, whose types the first row carries."""
    fields = [c.strip().rsplit(" ", 1) for c in columns.split(",")]
    kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    first = ", ".join(f"CAST({quoted(v)} AS {kinds[t]})" for v, (_, t) in zip(rows[0], fields))
    rest = "".join(f", ({', '.join(map(quoted, r))})" for r in rows[1:])
    return f"(VALUES ({first}){rest}) t({', '.join(n for n, _ in fields)})"


def frame(spark: SparkSession, rows: Sequence[Sequence[Any]], columns: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], columns)


def expected(rows: Sequence[Sequence[Any]], columns: str) -> str:
    """SQL of hand-written result rows."""
    return f"SELECT * FROM {values(rows, columns)}"


TR_LOWER = "lower(translate({0}, 'İI', 'iı'))"
WORDS = "regexp_extract_all(" + TR_LOWER + f", '{X.TOKEN}')"
TOKENS = "list_transform(" + WORDS + f", lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN w ELSE left(w, {X.STEM}) END)"
