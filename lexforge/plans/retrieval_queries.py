"""Ranked retrieval (RET), fusion (FUS) and evaluation (EVA, STT) over documents, benchmark texts and embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import fixed as X
from lexforge.operators import evaluation as E
from lexforge.operators import fusion as U
from lexforge.operators import retrieval as R
from lexforge.operators.windows import first_groups, rank_of
from lexforge.sources.shared import stored

from .base import TOKENS, catalog, expected, frame, table, texts, values

C = catalog()
DIGITS = 6

_TF = f"""WITH t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
 dl AS (SELECT doc_id, len({TOKENS.format('text')}) AS dl FROM documents),
 st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
 raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n),
 idf AS (SELECT term, df, CASE WHEN raw < 0 THEN {X.BM25_EPSILON} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_BM25 = f"""{_TF},
 qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
 sc AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * {X.BM25_K1 + 1} / (tf + {X.BM25_K1} * (1 - {X.BM25_B} + {X.BM25_B} * dl / avgdl))), {DIGITS}) AS score
   FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
 bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 50)"""
#: A second leg that both engines can compute: shared distinct terms over the document's length.
_LEGS = f"""{_BM25},
 ov AS (SELECT query_id, doc_id, round(count(*) / sqrt(max(dl)), {DIGITS}) AS score FROM qt JOIN tf USING (term) JOIN dl USING (doc_id) GROUP BY ALL),
 sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ov QUALIFY rank <= 50)"""


def docs_and_queries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return texts(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_leg(spark, sf_dir, k: int = X.CANDIDATES) -> DataFrame:
    docs, queries = docs_and_queries(spark, sf_dir)
    return R.bm25_topk(docs, queries, k, "doc_id", DIGITS)


def overlap() -> R.Leg:
    """A second leg that both engines can compute: shared distinct terms over the root of the document's length."""
    return R.Leg(lambda docs, vocabulary: (np.ones(len(vocabulary)), lambda tf, dl, _: 1 / np.sqrt(dl)), count_query_terms=False)


def plain(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@C.add(f"{_BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def bm25_top10(spark, sf_dir):
    """RET-06 to RET-09: the ten best documents for every benchmark text."""
    return plain(bm25_leg(spark, sf_dir, X.TOP))


@C.add(f"{_TF} SELECT doc_id, CAST(count(*) AS BIGINT) AS terms, CAST(sum(tf) AS BIGINT) AS tokens, CAST(max(tf) AS BIGINT) AS top FROM tf GROUP BY doc_id")
def bm25_postings(spark, sf_dir):
    """RET-06."""
    p = R.postings(texts(spark, sf_dir), key="doc_id")
    return p.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.max("tf").alias("top"))


@C.add(f"{_TF} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 9) AS idf FROM idf")
def bm25_idf(spark, sf_dir):
    """RET-08."""
    return R.term_weights(texts(spark, sf_dir), "doc_id").select("term", "df", F.round("idf", 9).alias("idf"))


_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
_COS = f"{_DOT.format(a='p.embedding', b='q.embedding')} / sqrt({_DOT.format(a='p.embedding', b='p.embedding')}) / sqrt({_DOT.format(a='q.embedding', b='q.embedding')})"


def _dense_sql(where: str, k: int) -> str:
    place = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"
    scores = f"SELECT q.vec_id AS query_id, p.vec_id, {_COS} AS score FROM embeddings p, embeddings q WHERE q.vec_id % 20 = 0 AND {where}"
    return f"SELECT query_id, vec_id, round(score, {DIGITS}) AS score, {place} AS rank FROM ({scores}) QUALIFY {place} <= {k}"


def vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    points = texts(spark, sf_dir, "embeddings")
    return points, points.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _dense(df: DataFrame) -> DataFrame:
    return df.select("query_id", "vec_id", F.round("score", DIGITS).alias("score"), F.col("rank").cast("long").alias("rank"))


@C.add(_dense_sql("true", 10))
def dense_topk(spark, sf_dir):
    """RET-04: exact cosine top-10 of every twentieth vector."""
    return _dense(R.dense_topk(*vectors(spark, sf_dir), 10))


@C.add(_dense_sql("p.label = 1", 10))
def dense_topk_filtered(spark, sf_dir):
    """RET-04 with the filter below the ranking (COR-09)."""
    return _dense(R.dense_topk(*vectors(spark, sf_dir), 10, where=F.col("label") == 1))


@C.add(
    f"""{_TF}, w AS (SELECT doc_id, term, ln(1 + tf) AS weight FROM tf), qw AS (SELECT item_id AS query_id, term, count(*) AS n FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
        s AS (SELECT query_id, doc_id, round(sum(weight * ln(1 + n)), {DIGITS}) AS score FROM w JOIN qw USING (term) GROUP BY ALL)
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10"""
)
def sparse_topk(spark, sf_dir):
    """RET-02, RET-05: sparse vectors of log counts."""
    docs, queries = docs_and_queries(spark, sf_dir)
    def vectors_of(df: DataFrame, key: str) -> DataFrame:
        rows = R.sparse_weights(R.postings(df, key=key).select(key, F.col("term").alias("token"), F.log1p(F.col("tf").cast("double")).alias("weight")), key)
        return rows.groupBy(key).agg(F.collect_list(F.struct("token", "weight")).alias("v")).select(key, F.col("v.token").alias("tokens"), F.col("v.weight").alias("weights"))

    return plain(R.sparse_topk_vectors(vectors_of(docs, "doc_id"), vectors_of(queries, "query_id"), 10, "doc_id", DIGITS))


@C.add(
    f"""{_TF}, w AS (SELECT doc_id, term, ln(1 + tf) AS weight FROM tf), qw AS (SELECT item_id AS query_id, term, count(*) AS n FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
        s AS (SELECT query_id, doc_id, round(sum(weight * ln(1 + n)), {DIGITS}) AS score FROM w JOIN qw USING (term) GROUP BY ALL)
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10"""
)
def sparse_topk_join(spark, sf_dir):
    """RET-05 for vectors stored as rows."""
    docs, queries = docs_and_queries(spark, sf_dir)
    weigh = lambda df, key: R.sparse_weights(R.postings(df, key=key).select(key, F.col("term").alias("token"), F.log1p(F.col("tf").cast("double")).alias("weight")), key)
    return plain(R.sparse_topk(weigh(docs, "doc_id"), weigh(queries, "query_id"), 10, "doc_id", DIGITS))


@C.add(f"{_BM25.replace('QUALIFY rank <= 50', '')} SELECT query_id, doc_id, score FROM bm WHERE score > 0")
def bm25_scores(spark, sf_dir):
    """RET-07: every positive score."""
    docs, queries = docs_and_queries(spark, sf_dir)
    return R.bm25_positive(docs, queries, "doc_id", DIGITS)


_MM = "(score - min(score) OVER (PARTITION BY query_id)) / coalesce(nullif(max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id), 0), 1)"


@C.add(f"{_BM25} SELECT query_id, doc_id, round({_MM}, {DIGITS}) AS norm FROM bm")
def minmax_norm(spark, sf_dir):
    """FUS-01: over the leg's candidates."""
    norm = U.minmax(F.col("score"), Window.partitionBy("query_id"))
    return bm25_leg(spark, sf_dir).select("query_id", "doc_id", F.round(norm, DIGITS).alias("norm"))


def _fused_sql(score: str) -> str:
    return f"""{_LEGS}, b AS (SELECT *, {_MM} AS norm FROM bm), s AS (SELECT *, {_MM} AS norm FROM sp),
        f AS (SELECT coalesce(b.query_id, s.query_id) AS query_id, coalesce(b.doc_id, s.doc_id) AS doc_id, round({score}, {DIGITS}) AS score,
          CASE WHEN b.rank IS NOT NULL THEN b.rank ELSE 1000 + s.rank END AS first FROM b FULL JOIN s ON b.query_id = s.query_id AND b.doc_id = s.doc_id)
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM f"""


WSUM = "coalesce(b.norm, 0) * 0.65 + coalesce(s.norm, 0) * 0.35"
RRF = f"coalesce(1.0::DOUBLE / ({X.RRF_K} + b.rank), 0) * {{0}} + coalesce(1.0::DOUBLE / ({X.RRF_K} + s.rank), 0) * {{1}}"


def legs(spark, sf_dir, k: int = X.CANDIDATES) -> list[DataFrame]:
    """Both legs from one pass over the documents; their k rows for each query are written once, for all that read them."""
    both = stored(R.keyword_legs(*docs_and_queries(spark, sf_dir), [R.bm25(), overlap()], k, "doc_id", DIGITS))
    return [both.filter(F.col("leg") == i).drop("leg") for i in range(2)]


@C.add(_fused_sql(WSUM))
def wsum_fusion(spark, sf_dir):
    """FUS-02, FUS-05, FUS-06, JON-07, WIN-04."""
    return plain(U.wsum(legs(spark, sf_dir), (0.65, 0.35), "doc_id", DIGITS))


@C.add(_fused_sql(RRF.format("1.0::DOUBLE", "1.0::DOUBLE")))
def rrf_fusion(spark, sf_dir):
    """FUS-03, RET-12."""
    return plain(U.rrf(legs(spark, sf_dir), None, "doc_id", digits=DIGITS))


@C.add(_fused_sql(RRF.format("2.0::DOUBLE", "1.0::DOUBLE")))
def weighted_rrf(spark, sf_dir):
    """FUS-04."""
    return plain(U.rrf(legs(spark, sf_dir), (2.0, 1.0), "doc_id", digits=DIGITS))


SWEEP = [(0, 1.0, 0.0), (1, 0.5, 0.5), (2, 0.85, 0.15), (3, 0.0, 1.0)]
SWEEP_T = "w_id long, w0 double, w1 double"
def _swept_sql(weights) -> str:
    return f"""{_LEGS}, b AS (SELECT *, {_MM} AS norm FROM bm), s AS (SELECT *, {_MM} AS norm FROM sp),
        f AS (SELECT w_id, coalesce(b.query_id, s.query_id) AS query_id, coalesce(b.doc_id, s.doc_id) AS doc_id, round(coalesce(b.norm, 0) * w0 + coalesce(s.norm, 0) * w1, {DIGITS}) AS score,
          CASE WHEN b.rank IS NOT NULL THEN b.rank ELSE 1000 + s.rank END AS first FROM b FULL JOIN s ON b.query_id = s.query_id AND b.doc_id = s.doc_id, {values(weights, SWEEP_T)}),
        r AS (SELECT *, row_number() OVER (PARTITION BY w_id, query_id ORDER BY score DESC, first) AS rank FROM f)"""


_SWEPT = _swept_sql(SWEEP)
#: A document is right for a benchmark text that it holds.
_GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark, documents WHERE contains(documents.text, benchmark.text))"
#: Benchmark texts that may be broadcast to where the documents lie.
GOLD_LIMIT = 10_000
_METRICS = """round(coalesce(avg(CAST(h BETWEEN 1 AND 1 AS INT)), 0), 6) AS r1, round(coalesce(avg(CAST(h BETWEEN 1 AND 5 AS INT)), 0), 6) AS r5, round(coalesce(avg(CAST(h BETWEEN 1 AND 10 AS INT)), 0), 6) AS r10,
        round(coalesce(avg(CASE WHEN h BETWEEN 1 AND 10 THEN 1.0::DOUBLE / h ELSE 0 END), 0), 6) AS mrr10, round(coalesce(avg(CASE WHEN h BETWEEN 1 AND 10 THEN 1 / log2(h + 1.0::DOUBLE) ELSE 0 END), 0), 6) AS ndcg10, CAST(count(h) AS BIGINT) AS n"""


def gold(spark, sf_dir) -> DataFrame:
    """(query_id, doc_id) of documents that hold a whole benchmark text; up to ``GOLD_LIMIT`` texts go to where the documents lie, beyond that the join is Spark's."""
    docs, queries = docs_and_queries(spark, sf_dir)
    whole = queries.select("query_id", F.col("text").alias("whole")).filter("whole IS NOT NULL")
    if queries.count() > GOLD_LIMIT:
        return stored(docs.join(whole, F.contains(docs["text"], F.col("whole"))).select("query_id", "doc_id", F.lit(True).alias("hit")))
    rows = [(r["query_id"], r["whole"]) for r in whole.collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.mapInArrow(R.holders(rows, "doc_id"), f"query_id long, doc_id {kind}").withColumn("hit", F.lit(True)))


@C.add(f"{_SWEPT}, {_GOLD}, h AS (SELECT w_id, query_id, coalesce(min(rank) FILTER (WHERE gold.doc_id IS NOT NULL AND rank <= 10), 0) AS h FROM r LEFT JOIN gold USING (query_id, doc_id) WHERE query_id IN (SELECT query_id FROM gold) GROUP BY ALL) SELECT w_id, {_METRICS} FROM h GROUP BY w_id")
def weight_sweep(spark, sf_dir):
    """EVA-01, EVA-05, STT-02, WIN-06: metrics of every weighting from one normalisation."""
    return swept_ranks(spark, sf_dir).groupBy("w_id").agg(*E.rank_metrics(F.col("hit_rank")))


_RANKS = f"{_BM25}, {_GOLD}, h AS (SELECT query_id, coalesce(min(rank) FILTER (WHERE gold.doc_id IS NOT NULL AND rank <= 50), 0) AS h FROM bm LEFT JOIN gold USING (query_id, doc_id) WHERE query_id IN (SELECT query_id FROM gold) GROUP BY ALL)"


def hit_ranks(spark, sf_dir, k: int = 50) -> DataFrame:
    right = gold(spark, sf_dir)
    judged = bm25_leg(spark, sf_dir).join(right.select("query_id").distinct(), "query_id", "left_semi").join(right, ["query_id", "doc_id"], "left")
    return rank_of(judged, "query_id", "rank", F.coalesce("hit", F.lit(False)), k)


@C.add(f"{_RANKS} SELECT query_id, CAST(h AS INTEGER) AS hit_rank FROM h")
def target_ranks(spark, sf_dir):
    """WIN-06, JON-14: place of the first right document."""
    return hit_ranks(spark, sf_dir)


@C.add(f"{_RANKS} SELECT {_METRICS} FROM h")
def rank_metrics(spark, sf_dir):
    """EVA-01, EVA-11."""
    return hit_ranks(spark, sf_dir).agg(*E.rank_metrics(F.col("hit_rank")))


@C.add(
    f"""{_RANKS}, c AS (SELECT k, avg(CAST(h BETWEEN 1 AND k AS INT)) AS recall, avg(CAST(h = 0 AS INT)) AS never FROM h, (SELECT unnest([1, 5, 10, 20, 50, 75, 100]) AS k) GROUP BY k)
        SELECT CAST(k AS INTEGER) AS k, round(recall, 6) AS recall, round(recall - coalesce(lag(recall) OVER (ORDER BY k), 0), 6) AS gain, round(never, 6) AS never FROM c"""
)
def recall_curve(spark, sf_dir):
    """EVA-03."""
    r = E.recall_curve(hit_ranks(spark, sf_dir))
    return r.select("k", *[F.round(c, 6).alias(c) for c in ("recall", "gain", "never")])


@C.add(f"{_RANKS}, s AS (SELECT 'bm25' AS system, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS style, CASE WHEN query_id < 20 THEN 'low' ELSE 'high' END AS part, h FROM h) SELECT system, style, part, {_METRICS} FROM s GROUP BY GROUPING SETS ((system), (system, style), (system, part))")
def metrics_grouping_sets(spark, sf_dir):
    """EVA-02."""
    ranks = hit_ranks(spark, sf_dir).select(
        F.lit("bm25").alias("system"), F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("style"), F.when(F.col("query_id") < 20, "low").otherwise("high").alias("part"), "hit_rank"
    )
    return E.metrics_by(ranks, "system", ["style", "part"])


@C.add(
    f"""{_BM25}, {_GOLD}, l AS (SELECT DISTINCT query_id, lang FROM gold JOIN documents USING (doc_id)), o AS (SELECT DISTINCT query_id, source FROM gold JOIN documents USING (doc_id)),
        j AS (SELECT bm.query_id, rank, gold.doc_id IS NOT NULL AS strict, l.lang IS NOT NULL AS same_lang, o.source IS NOT NULL AS same_source FROM bm JOIN documents d USING (doc_id)
          LEFT JOIN gold ON gold.query_id = bm.query_id AND gold.doc_id = bm.doc_id LEFT JOIN l ON l.query_id = bm.query_id AND l.lang = d.lang LEFT JOIN o ON o.query_id = bm.query_id AND o.source = d.source)
        SELECT query_id, CAST(coalesce(min(rank) FILTER (WHERE strict), 0) AS INTEGER) AS strict, CAST(coalesce(min(rank) FILTER (WHERE same_lang), 0) AS INTEGER) AS same_lang, CAST(coalesce(min(rank) FILTER (WHERE same_source), 0) AS INTEGER) AS same_source FROM j GROUP BY query_id"""
)
def tolerance_levels(spark, sf_dir):
    """EVA-06, EVA-07: the same document, language or source counts."""
    right, docs = gold(spark, sf_dir), texts(spark, sf_dir).select("doc_id", "lang", "source")
    wide = right.join(docs, "doc_id")
    found = bm25_leg(spark, sf_dir).join(docs, "doc_id").join(right, ["query_id", "doc_id"], "left")
    for c in ("lang", "source"):
        found = found.join(wide.select("query_id", c, F.lit(True).alias(f"by_{c}")).distinct(), ["query_id", c], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return E.tolerance_ranks(found, {"strict": yes("hit"), "same_lang": yes("by_lang"), "same_source": yes("by_source")})


@C.add(
    f"""{_BM25}, s AS (SELECT bm.*, (doc_id * 7919) % 1000 AS rerank_score FROM bm)
        SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 20 THEN 0 ELSE 1 END, CASE WHEN rank <= 20 THEN -rerank_score END, rank) AS BIGINT) AS rank FROM s"""
)
def rerank_head(spark, sf_dir):
    """FUS-07: a stand-in model scores the head; the tail keeps its place."""
    scored = bm25_leg(spark, sf_dir).withColumn("rerank_score", (F.col("doc_id") * 7919) % 1000)
    return U.rerank(scored).select("query_id", "doc_id", F.col("new_rank").cast("long").alias("rank"))


@C.add(
    f"""{_BM25}, s AS (SELECT bm.*, (doc_id * 7919) % 1000 AS rerank_score FROM bm), n AS (SELECT unnest([10, 20, 30, 50]) AS head)
        SELECT CAST(head AS INTEGER) AS head, CAST(count(*) AS BIGINT) AS n, CAST(sum(new_rank * (doc_id % 97)) AS BIGINT) AS checksum FROM (SELECT head, doc_id,
          row_number() OVER (PARTITION BY head, query_id ORDER BY CASE WHEN rank <= head THEN 0 ELSE 1 END, CASE WHEN rank <= head THEN -rerank_score END, rank) AS new_rank FROM s, n) GROUP BY head"""
)
def rerank_sweep(spark, sf_dir):
    """EVA-09."""
    scored = bm25_leg(spark, sf_dir).withColumn("rerank_score", (F.col("doc_id") * 7919) % 1000)
    return E.head_sweep(scored).groupBy("head").agg(F.count("*").alias("n"), F.sum(F.col("new_rank") * (F.col("doc_id") % 97)).alias("checksum"))


@C.add(
    f"""{_BM25}, g AS (SELECT bm.*, source, min(rank) OVER (PARTITION BY query_id, source) AS best FROM bm JOIN documents USING (doc_id)),
        p AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY best) AS place FROM g) SELECT query_id, doc_id, source, rank FROM p WHERE place <= 3"""
)
def two_stage(spark, sf_dir):
    """FUS-10, WIN-05, EVA-08: documents of the first three sources of each ranking."""
    found = bm25_leg(spark, sf_dir).join(texts(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return first_groups(found, "query_id", "source", "rank", 3).select("query_id", "doc_id", "source", F.col("rank").cast("long").alias("rank"))


@C.add("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean_ms, max(value) AS max_ms, CAST(count(value) AS BIGINT) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    """EVA-12."""
    return E.latency(table(spark, sf_dir, "events"), "event_type", "value")


@C.add(
    """SELECT CAST(row_number() OVER (ORDER BY i, j) AS BIGINT) AS w_id, round(i / 20.0::DOUBLE, 6) AS w0, round(j / 20.0::DOUBLE, 6) AS w1, round((20 - i - j) / 20.0::DOUBLE, 6) AS w2 FROM range(21) a(i), range(21) b(j) WHERE i + j <= 20
       UNION ALL SELECT 0, 0.333333, 0.333333, 0.333333"""
)
def simplex_grid(spark, sf_dir):
    """STT-01: 231 triples and the equal one."""
    grid = E.simplex(spark)
    order = Window.orderBy("w_id")
    return grid.select((F.row_number().over(order) - 1).cast("long").alias("w_id"), "w0", "w1", "w2")


_GAIN = "CASE WHEN {0} BETWEEN 1 AND 10 THEN 1.0::DOUBLE / {0} ELSE 0 END"
_SYSTEMS = f"""{_LEGS}, {_GOLD}, u AS (SELECT 'bm25' AS system, query_id, doc_id, rank FROM bm UNION ALL SELECT 'overlap', query_id, doc_id, rank FROM sp),
        h AS (SELECT system, query_id, coalesce(min(rank) FILTER (WHERE gold.doc_id IS NOT NULL AND rank <= 10), 0) AS h FROM u LEFT JOIN gold USING (query_id, doc_id) WHERE query_id IN (SELECT query_id FROM gold) GROUP BY ALL)"""
_PAIRS = f"{_SYSTEMS}, p AS (SELECT query_id, coalesce(max(h) FILTER (WHERE system = 'bm25'), 0) AS a, coalesce(max(h) FILTER (WHERE system = 'overlap'), 0) AS b FROM h GROUP BY query_id)"


def system_ranks(spark, sf_dir) -> DataFrame:
    """(system, query_id, hit_rank) of each leg alone."""
    right = gold(spark, sf_dir)
    words, shared = legs(spark, sf_dir)
    union = words.withColumn("system", F.lit("bm25")).unionByName(shared.withColumn("system", F.lit("overlap")))
    judged = union.join(right.select("query_id").distinct(), "query_id", "left_semi").join(right, ["query_id", "doc_id"], "left")
    return judged.groupBy("system", "query_id").agg(F.coalesce(F.min(F.when(F.col("hit") & (F.col("rank") <= 10), F.col("rank"))), F.lit(0)).alias("hit_rank"))


def rank_pairs(spark, sf_dir) -> DataFrame:
    """JON-15: (query_id, a, b), the hit ranks of the two legs side by side; 0 where a leg has none."""
    of = lambda name: F.coalesce(F.max(F.when(F.col("system") == name, F.col("hit_rank"))), F.lit(0)).cast("long")
    return system_ranks(spark, sf_dir).groupBy("query_id").agg(of("bm25").alias("a"), of("overlap").alias("b"))


@C.add(f"{_PAIRS} SELECT CAST(w AS BIGINT) AS wins, CAST(l AS BIGINT) AS losses, round(coalesce((w - l) / nullif(sqrt(w + l), 0), 0), 6) AS z FROM (SELECT count(*) FILTER (WHERE {_GAIN.format('a')} > {_GAIN.format('b')}) AS w, count(*) FILTER (WHERE {_GAIN.format('a')} < {_GAIN.format('b')}) AS l FROM p)")
def win_loss(spark, sf_dir):
    """STT-06, JON-15: the two legs' hit ranks, query by query."""
    gain = lambda c: F.when(F.col(c).between(1, 10), 1.0 / F.col(c)).otherwise(0.0)
    return E.win_loss(rank_pairs(spark, sf_dir), gain("a") > gain("b"), gain("a") < gain("b"))


_DRAWN = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in E.poisson_cuts())


@C.add(
    f"""{_PAIRS}, d AS (SELECT {_GAIN.format('a')} - {_GAIN.format('b')} AS d, round, CAST('0x' || left(md5(concat_ws(':', query_id, round, {E.SEED})), 7) AS BIGINT) / {1 << 28}.0 AS u FROM p, unnest(range(1, 5001)) r(round)),
        m AS (SELECT round, coalesce(sum(d * c) / nullif(sum(c), 0), 0) AS m FROM (SELECT *, {_DRAWN} AS c FROM d) GROUP BY round)
        SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m"""
)
def paired_bootstrap(spark, sf_dir):
    """STT-05: 5,000 rounds over the two legs' hit ranks, drawn by MD5."""
    gain = lambda c: F.when(F.col(c).between(1, 10), 1.0 / F.col(c)).otherwise(0.0)
    return E.paired_bootstrap(rank_pairs(spark, sf_dir), gain("a"), gain("b"))


#: Every weighting of two legs in steps of a twentieth.
GRID = [(i, i / 20, (20 - i) / 20) for i in range(21)]


def swept_ranks(spark, sf_dir, weights=SWEEP) -> DataFrame:
    swept = U.sweep(legs(spark, sf_dir), frame(spark, weights, SWEEP_T), "doc_id", DIGITS)
    right = gold(spark, sf_dir)
    judged = swept.join(right.select("query_id").distinct(), "query_id", "left_semi").join(right, ["query_id", "doc_id"], "left")
    return judged.groupBy("w_id", "query_id").agg(F.coalesce(F.min(F.when(F.col("hit") & (F.col("rank") <= 10), F.col("rank"))), F.lit(0)).alias("hit_rank"))


@C.add(
    f"""{_swept_sql(GRID)}, {_GOLD}, h AS (SELECT w_id, query_id, coalesce(min(rank) FILTER (WHERE gold.doc_id IS NOT NULL AND rank <= 10), 0) AS h FROM r LEFT JOIN gold USING (query_id, doc_id) WHERE query_id IN (SELECT query_id FROM gold) GROUP BY ALL),
        e AS (SELECT w_id, repeat, CAST('0x' || left(md5(concat_ws(':', query_id, repeat, {E.SEED})), 7) AS BIGINT) % 5 AS fold, h FROM h, unnest(range(20)) x(repeat)),
        g AS (SELECT repeat, w_id, fold, sum({_GAIN.format('h')}) AS g, sum(CASE WHEN h BETWEEN 1 AND 10 THEN 1 ELSE 0 END) AS t, count(*) AS n FROM e GROUP BY ALL),
        k AS (SELECT *, round(coalesce((sum(g) OVER w - g) / nullif(sum(n) OVER w - n, 0), 0), 6) AS k0, round(coalesce((sum(t) OVER w - t) / nullif(sum(n) OVER w - n, 0), 0), 6) AS k1 FROM g WINDOW w AS (PARTITION BY repeat, w_id))
        SELECT CAST(repeat AS BIGINT) AS repeat, CAST(fold AS BIGINT) AS fold, w_id, round(g / n, 6) AS mrr, CAST(n AS BIGINT) AS n FROM k QUALIFY row_number() OVER (PARTITION BY repeat, fold ORDER BY k0 DESC, k1 DESC, w_id) = 1"""
)
def grouped_cv(spark, sf_dir):
    """STT-03: weights of the full grid, 20 times five folds by MD5 of the query."""
    return E.grouped_cv(swept_ranks(spark, sf_dir, GRID), "query_id")


@C.add(
    f"""{_SWEPT}, {_GOLD}, h AS (SELECT w_id, query_id, coalesce(min(rank) FILTER (WHERE gold.doc_id IS NOT NULL AND rank <= 10), 0) AS h FROM r LEFT JOIN gold USING (query_id, doc_id) WHERE query_id IN (SELECT query_id FROM gold) GROUP BY ALL),
        m AS (SELECT w_id, {_METRICS} FROM h GROUP BY w_id) SELECT w_id, mrr10, CAST(row_number() OVER (ORDER BY mrr10 DESC, r10 DESC, w_id) AS BIGINT) AS place FROM m QUALIFY mrr10 >= max(mrr10) OVER () - 0.005"""
)
def weight_plateau(spark, sf_dir):
    """STT-04."""
    scores = swept_ranks(spark, sf_dir).groupBy("w_id").agg(*E.rank_metrics(F.col("hit_rank")))
    return E.plateau(scores).select("w_id", "mrr10", F.col("place").cast("long").alias("place"))


@C.add(f"{_SYSTEMS} SELECT system, {_METRICS} FROM h GROUP BY system")
def ablation(spark, sf_dir):
    """EVA-04: each leg alone."""
    return system_ranks(spark, sf_dir).groupBy("system").agg(*E.rank_metrics(F.col("hit_rank")))


LISTS_T = "query_id long, rank int, pair string, score double"
OLD = [(q, i, f"p{i}", 0.5 if q == 3 else 1.0 - i / 10) for q in range(1, 6) for i in (1, 2)]
NEW = [
    (1, 1, "p1", 0.9, None), (1, 2, "p2", 0.8, None), (2, 1, "p1", 0.9, None), (2, 2, "p1", 0.8, None), (3, 1, "p2", 0.5, None), (3, 2, "p1", 0.5, None), (4, 1, "p9", 0.9, "p1"), (4, 2, "p2", 0.8, None),
    (5, 1, "p9", 0.9, "p9"), (5, 2, "p2", 0.8, None),
]


@C.add(expected([(1, "same"), (2, "collision"), (3, "equal_scores"), (4, "stale"), (5, "different")], "query_id long, kind string"))
def list_equivalence(spark, sf_dir):
    """EVA-10."""
    return E.compare_lists(frame(spark, OLD, LISTS_T), frame(spark, NEW, f"{LISTS_T}, truth string"))


@C.add(f"{_BM25} SELECT query_id, doc_id, score FROM bm WHERE rank <= 10")
def checked_rows(spark, sf_dir):
    """EVA-17: an invariant holds for the ten best of every benchmark text; a row that breaks it fails the query."""
    return E.check(bm25_leg(spark, sf_dir, 10), F.col("score") > 0, "a score is not positive").select("query_id", "doc_id", "score")
