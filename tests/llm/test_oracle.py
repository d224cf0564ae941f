"""The training-data queries that SQL can express give DuckDB's rows."""

from __future__ import annotations

import duckdb
import pytest

from lexforge.llm import queries


def key(row) -> tuple:
    return tuple("" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    order = [columns.index(c) for c in sorted(columns)]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    want = sorted(key([r[i] for i in order]) for r in got.fetchall())
    assert sorted(key([r[c] for c in sorted(df.columns)]) for r in df.collect()) == want


def test_every_operator_has_its_query():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
