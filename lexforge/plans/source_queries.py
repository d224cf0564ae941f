"""Sources, sinks, limits, settings and models (SRC, SNK, RET-01, RET-02, FUS-08, FUS-11) with stand-ins for external services."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from lexforge.functions import fixed as X
from lexforge.functions import text as T
from lexforge.operators import fusion, resolve, retrieval
from lexforge.sources import lists, paged, sinks
from lexforge.sources.settings import Settings
from lexforge.sources.shared import shared_root

from .base import catalog, expected, frame, table, texts
from .retrieval_queries import _BM25, bm25_leg

C = catalog()


def place(spark, name: str) -> str:
    return f"{shared_root(spark)}/sinks/{name}-{uuid.uuid4().hex}"


@C.add("SELECT doc_id, text, lang FROM documents")
def json_lines_round_trip(spark, sf_dir):
    """SNK-01, SRC-11: what is written is what is read, whole texts with quotes and line ends."""
    path = place(spark, "lines")
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang").write.json(path)
    return spark.read.schema("doc_id LONG, text STRING, lang STRING").option("mode", "FAILFAST").json(path)


@C.add("SELECT vec_id, label FROM embeddings WHERE label = 1")
def partitioned_points(spark, sf_dir):
    """SNK-02, SRC-14: vectors partitioned by the column that queries filter on; the count is checked on writing."""
    path = place(spark, "points")
    sinks.write_points(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("yurutluk")), path)
    return spark.read.parquet(path).filter("yurutluk = 1").select("vec_id", F.col("yurutluk").alias("label"))


@C.add("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_ids FROM documents")
def append_and_resume(spark, sf_dir):
    """SNK-04, SNK-05, STR-02: an interrupted run, then a whole one, then one more."""
    path, docs = place(spark, "resume"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    for part in (docs.filter("doc_id % 3 = 0"), docs, docs):
        sinks.append_new(part, path, "doc_id")
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_ids"))


@C.add("SELECT 'short' AS tip, doc_id, length(text) AS n, NULL AS lang FROM documents WHERE length(text) < 100 UNION ALL SELECT 'french', doc_id, NULL, lang FROM documents WHERE lang = 'fr'")
def suspicious_rows(spark, sf_dir):
    """SNK-06: kinds of rows with different columns in one table."""
    path, docs = place(spark, "suspicious"), table(spark, sf_dir, "documents")
    sinks.write_suspicious(path, short=docs.filter("length(text) < 100").select("doc_id", F.length("text").cast("long").alias("n")), french=docs.filter("lang = 'fr'").select("doc_id", "lang"))
    return spark.read.schema("tip STRING, doc_id LONG, n LONG, lang STRING").json(path)


@C.add("SELECT CAST(contains(text, 'License') AS VARCHAR) AS leaky, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def leaky_split(spark, sf_dir):
    """SNK-07."""
    path = place(spark, "split")
    sinks.write_split(texts(spark, sf_dir).select("doc_id", "text"), F.contains("text", F.lit("License")), path)
    return spark.read.schema("doc_id LONG, text STRING, leaky STRING").json(path).groupBy("leaky").agg(F.count("*").alias("n"))


@C.add(f"{_BM25} SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS docs, CAST(count(*) AS BIGINT) AS n FROM bm WHERE rank <= 5 GROUP BY query_id")
def candidate_lists(spark, sf_dir):
    """SNK-08, D21: candidates as aligned arrays."""
    path = place(spark, "candidates")
    sinks.write_candidates(bm25_leg(spark, sf_dir).withColumnRenamed("doc_id", "doc_ord"), path, 5)
    rows = spark.read.parquet(path)
    return rows.select("query_id", F.array_join(F.transform("adaylar", lambda x: x.cast("string")), ",").alias("docs"), F.size("skorlar").cast("long").alias("n"))


@C.add(f"{_BM25} SELECT query_id, doc_id, sha256(left(text, 1500)) AS digest FROM bm JOIN documents USING (doc_id) WHERE rank <= 3")
def rerank_inputs(spark, sf_dir):
    """SNK-09, TXT-32."""
    path = place(spark, "rerank")
    sinks.rerank_input(bm25_leg(spark, sf_dir).withColumnRenamed("doc_id", "doc_ord"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_ord"), "text"), path, 3)
    return spark.read.schema("query_id LONG, doc_ord LONG, text STRING").json(path).select("query_id", F.col("doc_ord").alias("doc_id"), F.sha2("text", 256).alias("digest"))


@C.add("SELECT 'lang' AS facet, lang AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def viewer_facets(spark, sf_dir):
    """SNK-10, GRP-06."""
    return sinks.viewer_counts(table(spark, sf_dir, "documents"), "lang", "source")


@C.add("SELECT page_id, sha256(html) AS digest FROM pages")
def decoded_pages(spark, sf_dir):
    """SRC-05, SRC-07, TXT-41: base64 contents back to text."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.base64(F.encode("html", "UTF-8")).alias("c"))
    return pages.select("page_id", F.sha2(lists.decoded(F.col("c")), 256).alias("digest"))


@C.add("SELECT CAST(n_nationkey AS VARCHAR) AS mevzuat_id, '2001-02-' || lpad(CAST(n_nationkey % 28 + 1 AS VARCHAR), 2, '0') AS resmi_gazete_tarihi, CAST(1000 + n_nationkey AS VARCHAR) AS resmi_gazete_sayisi FROM nation")
def record_cache(spark, sf_dir):
    """SRC-02, SRC-03, SRC-18: gazette fields from a cache that is one JSON object; a second cache that does not exist adds nothing."""
    path, key = place(spark, "records"), F.col("n_nationkey").cast("string")
    day = F.concat(F.lit("2001-02-"), F.lpad((F.col("n_nationkey") % 28 + 1).cast("string"), 2, "0"))
    record = F.struct(key.alias("mevzuatId"), day.alias("resmiGazeteTarihi"), (1000 + F.col("n_nationkey")).cast("string").alias("resmiGazeteSayisi"))
    table(spark, sf_dir, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, record)))).alias("value")).coalesce(1).write.text(path)
    return lists.law_records(spark, path).unionByName(lists.law_records(spark, place(spark, "absent")))


@C.add("SELECT o_orderkey, o_orderstatus FROM orders")
def checked_responses(spark, sf_dir):
    """SRC-02: rows of responses that all report success; one that does not would fail the query."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.struct(F.lit("SUCCESS").alias("FMTY")).alias("metadata"))
    return lists.checked_response(rows).select("o_orderkey", "o_orderstatus")


@C.add("SELECT 'v' || vec_id AS madde_id, CAST(len(embedding) AS BIGINT) AS n, label FROM embeddings")
def stored_vectors(spark, sf_dir):
    """SRC-14, SRC-15: points with both vectors, written and read back; a point without one would fail the query."""
    path = place(spark, "vectors")
    sparse = F.create_map(F.lit("token"), F.col("label").cast("float"))
    table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("madde_id"), F.col("embedding").alias("dense"), sparse.alias("sparse"), "label").write.parquet(path)
    return lists.vectors(spark, path).select("madde_id", F.size("dense").cast("long").alias("n"), "label")


@C.add("SELECT DISTINCT CAST(o_custkey + 1 AS VARCHAR) AS kanun_no, 'EK' || (o_orderkey % 7) AS madde_no FROM orders")
def cited_keys(spark, sf_dir):
    """SRC-17: distinct article keys from the first of two paths that exists; leading zeros, spaces, dashes and case go."""
    path = place(spark, "cited")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("00"), (F.col("o_custkey") + 1).cast("string")).alias("kanun_no"), F.concat(F.lit("ek - "), (F.col("o_orderkey") % 7).cast("string")).alias("madde_no"))
    blank = table(spark, sf_dir, "nation").select(F.lit("1").alias("kanun_no"), F.lit("").alias("madde_no"))
    # the file is one JSON array, written once by hand in its source
    rows.distinct().unionByName(blank).agg(F.to_json(F.collect_list(F.struct("kanun_no", "madde_no"))).alias("value")).coalesce(1).write.text(path)
    return lists.cited_articles(spark, place(spark, "absent"), path)


@C.add(
    """WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS kanun_no, '0' AS madde_no, max(o_orderkey) AS last FROM orders GROUP BY ALL),
       g AS (SELECT 'q' || c_custkey AS ilgi, CAST(c_custkey AS VARCHAR) AS kanun_no, '0' AS madde_no FROM customer)
       SELECT g.* FROM g JOIN s USING (kanun_no, madde_no) WHERE last % 3 <> 0 ORDER BY md5(concat_ws(':', ilgi, kanun_no, madde_no, 4721)), ilgi LIMIT 50"""
)
def gold_in_force(spark, sf_dir):
    """SRC-16, JON-14: the first fifty gold queries in seeded order whose target's last row is in force."""
    path = place(spark, "gold")
    table(spark, sf_dir, "customer").select(F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("ilgi"), F.col("c_custkey").cast("string").alias("kanun_no"), F.lit("0").alias("madde_no")).write.json(path)
    state = F.when(F.col("o_orderkey") % 3 == 0, F.lit(X.REPEALED)).otherwise(F.lit("in force"))
    rows = table(spark, sf_dir, "orders").select(F.struct(F.col("o_custkey").cast("string").alias("kanun_no"), F.lit("0").alias("madde_no"), state.alias("yurutluk")).alias("metadata"), F.col("o_orderkey").alias("sira"))
    return lists.gold(spark, path, rows, 50).select("ilgi", "kanun_no", "madde_no")


@C.add("SELECT CAST(doc_id AS VARCHAR) AS mevzuat_id, CAST((row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1) % 3 AS INTEGER) AS worker FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 10 <> 0")
def worklist_shares(spark, sf_dir):
    """SRC-19, SRC-21, STR-01: what neither the cache nor the list of failures holds, dealt to three workers."""
    ids = lambda df: df.select(F.col("doc_id").cast("string").alias("mevzuat_id"))
    docs = table(spark, sf_dir, "documents")
    left = lists.missing(ids(docs), ids(table(spark, sf_dir, "labels")), ids(docs.filter("doc_id % 10 = 0")))
    return lists.shares(left, 3, "mevzuat_id").select("mevzuat_id", F.col("worker").cast("int").alias("worker"))


LIMITS = [("bucket", "0,0,0,17,0,0,17"), ("batch", "0,0,0,31,0,0"), ("retry", "3.5,2,17")]


@C.add(expected(LIMITS, "kind string, waits string"))
def rate_limits(spark, sf_dir):
    """SRC-08, SRC-09, SRC-20: waits of the two limiters and of a request that meets 429, 500, 429, 200."""
    bucket, batch, slept = paged.Bucket(3), paged.Batches(4), []
    batch.refused()
    answers = iter([(429, {"Retry-After": "3"}, None), (500, {}, None), (429, {}, None), (200, {}, {})])
    paged.post_with_retry(lambda *_: next(answers), "u", paged.envelope({}, 1, 20), paged.Bucket(), slept.append)
    said = lambda xs: ",".join(f"{x:g}" for x in xs)
    return frame(spark, [("bucket", said([bucket.wait() for _ in range(7)])), ("batch", said([batch.wait() for _ in range(6)])), ("retry", said(slept))], "kind string, waits string")


@C.add(expected([("aday_k", "50"), ("rerank_varsayilan", "True"), ("w_dense", "0.5"), ("w_bm25", "0.15"), ("embed_backend", "onnx-int8")], "name string, value string"))
def settings(spark, sf_dir):
    """SRC-23, RET-13: typed settings from an environment."""
    s = Settings.read({"W_DENSE": "0.5", "RERANK_VARSAYILAN": "evet", "ADAY_K": "", "EMBED_BACKEND": "onnx-int8"})
    return frame(spark, [(n, str(getattr(s, n))) for n in ("aday_k", "rerank_varsayilan", "w_dense", "w_bm25", "embed_backend")], "name string, value string")


@C.add("SELECT doc_id, round(length(text) / sqrt(length(text) * length(text) + 1.0::DOUBLE), 3) AS x FROM documents")
def embedded(spark, sf_dir):
    """RET-01, RET-03, SNK-03: a stand-in encoder; vectors come out normalised."""
    embed = retrieval.embedder(lambda batch: np.array([[len(t), 1.0] for t in batch]))
    return texts(spark, sf_dir).select("doc_id", F.round(embed("text")[0].cast("double"), 3).alias("x"))


@C.add(f"{_BM25} SELECT query_id, doc_id, CAST(length(left(documents.text, 3000)) + length(benchmark.text) AS DOUBLE) AS s FROM bm JOIN documents USING (doc_id) JOIN benchmark ON item_id = query_id WHERE rank <= 5")
def pair_scores(spark, sf_dir):
    """FUS-08, FUS-11, RET-10: a stand-in pair model over pairs of all queries; batches of like length, order restored."""
    score = fusion.reranker(lambda pairs: [float(len(q) + len(t)) for q, t in pairs])
    found = bm25_leg(spark, sf_dir, 5).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rows = found.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), "query_id")
    return rows.select("query_id", "doc_id", score("q", "text").alias("s"))


@C.add("SELECT doc_id, length(left(text, 3000)) AS n, CAST(NULL AS VARCHAR) AS none FROM documents")
def reranker_heads(spark, sf_dir):
    """TXT-32, TXT-12: the reranker's part of a text."""
    return texts(spark, sf_dir).select("doc_id", F.length(T.head(F.col("text"))).cast("long").alias("n"), T.prefix_name(F.lit(None).cast("string")).alias("none"))


@C.add("SELECT true AS same, false AS other")
def corpus_version(spark, sf_dir):
    """STR-04, SRC-13: file versions tell whether a table changed."""
    version = lambda n: resolve.version(table(spark, sf_dir, n))
    equal = lambda a, b: a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count("*") == 0).alias("x"))
    return equal(version("nation"), version("nation")).select(F.col("x").alias("same"), F.lit(1).alias("k")).join(equal(version("nation"), version("region")).select(F.col("x").alias("other"), F.lit(1).alias("k")), "k").drop("k")
