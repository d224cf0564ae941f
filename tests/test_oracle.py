"""Every query with SQL gives DuckDB's rows; the others have the properties that define them."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexforge.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def key(row) -> tuple:
    return tuple("" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    got = con.execute(SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = sorted(key([r[i] for i in order]) for r in got.fetchall())
    assert sorted(key([r[c] for c in sorted(df.columns)]) for r in df.collect()) == want


def test_pages_are_stripped_as_their_sql_says(spark, con, tmp_path):
    """References without semicolon, others than the SQL's, white space of all kinds, tags with letters beyond ASCII, nothing."""
    pages = [
        "<h1>token = &quot</h1>b &quot;c&quot; &amp;quot; &amp d &lt;e&gt; &nbsp; &#39; &copy &copy;", "<p>\ta\t</p>\u00a0b\u3000<br\x0b>c<br\f/>\r\n d \x85", "<lı>a</lı><lİ>b<pé>c<P\nx>d<DIV>e", "", "<p> </p>", None, "a\x1f\x1fb<li",
    ]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    rows.write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = [(r.page_id, r.digest, r.n_blocks) for r in catalog.queries()["html_strip"](spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == c.execute(f"SELECT page_id, digest, n_blocks FROM ({SQL['html_strip']}) ORDER BY page_id").fetchall()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() > 0


def test_names_and_docs():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert all(f.__doc__ for f in catalog.queries().values())


def test_bootstrap_contains_the_difference(spark, sf_dir):
    from lexforge.plans.retrieval_queries import rank_pairs

    gain = lambda r: 1 / r if 1 <= r <= 10 else 0
    pairs = rank_pairs(spark, sf_dir).collect()
    d = [gain(r.a) - gain(r.b) for r in pairs]
    mean = sum(d) / len(d)
    first, again = (catalog.queries()["paired_bootstrap"](spark, sf_dir).first() for _ in range(2))
    assert first == again and first.low <= round(mean, 6) <= first.high
    spread = math.sqrt(sum((x - mean) ** 2 for x in d)) / len(d)
    assert 3 * spread <= first.high - first.low <= 5 * spread


def test_heads_overlap_as_pairwise_comparison_says(spark):
    from lexforge.operators.joins import overlapping_heads

    heads = ["a", "ab", "b" * 45 + "x", "b" * 45 + "y", "c" * 39 + "x", "c" * 39 + "y", "c" * 39, "d", "d", "e" * 40, "e" * 41, "f" * 80, "g"]
    rows = [(i, lang, h) for lang in ("en", "de") for i, h in enumerate(heads)] + [(99, "fr", "a"), (98, "fr", "zz")]
    near = lambda x, y: x.startswith(y) or y.startswith(x) or len(x) >= 40 <= len(y) and x[:40] == y[:40]
    want = {(l1, h1) for i, l1, h1 in rows for j, l2, h2 in rows if i != j and l1 == l2 and near(h1, h2)}
    df = spark.createDataFrame(rows, "doc_id long, lang string, head string")
    assert {tuple(r) for r in overlapping_heads(df, "doc_id", "lang", "head").collect()} == want


def test_cross_validation_covers_every_query_once(spark, sf_dir):
    from lexforge.plans.retrieval_queries import swept_ranks

    rows = catalog.queries()["grouped_cv"](spark, sf_dir).groupBy("repeat").agg(F.sum("n").alias("n")).collect()
    n = swept_ranks(spark, sf_dir).select("query_id").distinct().count()
    assert len(rows) == 20 and all(r.n == n for r in rows)


def test_statistics_run_over_the_full_grid_and_all_rounds(spark, sf_dir, monkeypatch):
    from lexforge.plans import retrieval_queries as Q

    asked = {}
    monkeypatch.setattr(Q.E, "grouped_cv", lambda ranks, *a, **k: asked.update(weights=ranks.select("w_id").distinct().count()))
    monkeypatch.setattr(Q.E, "paired_bootstrap", lambda pairs, a, b, rounds=Q.E.paired_bootstrap.__defaults__[0], **k: asked.update(rounds=rounds))
    Q.grouped_cv(spark, sf_dir)
    Q.paired_bootstrap(spark, sf_dir)
    assert asked == {"weights": 21, "rounds": 5000}


def test_row_check_covers_every_benchmark_text(spark, sf_dir, monkeypatch):
    from lexforge.plans import retrieval_queries as Q

    rows = spark.createDataFrame([(1, 1, 2.0, 1), (7, 1, 0.0, 1)], "query_id long, doc_id long, score double, rank int")
    monkeypatch.setattr(Q, "bm25_leg", lambda *a: rows)
    with pytest.raises(Exception, match="a score is not positive"):
        Q.checked_rows(spark, sf_dir).collect()
    monkeypatch.setattr(Q, "bm25_leg", lambda *a: rows.withColumn("score", F.lit(1.0)))
    assert sorted(tuple(r) for r in Q.checked_rows(spark, sf_dir).collect()) == [(1, 1, 1.0), (7, 1, 1.0)]


def test_strata_keep_their_quotas(spark, sf_dir):
    rows = catalog.queries()["stratified_quota"](spark, sf_dir)
    assert rows.groupBy("source").count().agg(F.max("count")).first()[0] <= 6
    assert rows.groupBy("stratum").count().agg(F.max("count")).first()[0] <= 40
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, catalog.queries()["stratified_quota"](spark, sf_dir).collect()))


def test_rate_limit_never_exceeds_a_batch(spark, sf_dir):
    rows = catalog.queries()["stream_rate_limit"](spark, sf_dir).toPandas()
    assert (rows.runs >= rows.asked).all()
    for _, r in rows.groupby("user_id"):
        runs = sorted(r.runs)
        assert all(runs[i + 9] - runs[i] > 0 for i in range(len(runs) - 9))
        assert all(sum(1 for x in runs if t <= x < t + 31) <= 18 for t in runs[:50])
