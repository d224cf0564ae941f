"""Sources, sinks, settings, streams, service, fusion properties, and independence from the optional subpackage."""

from __future__ import annotations

import json
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.operators import evaluation, fusion, resolve, retrieval, service
from lexforge.plans.structure_queries import LAW_HTML, LAW_TREE, corpus_of
from lexforge.sources import lists, paged, sinks
from lexforge.sources.settings import Settings
from lexforge.sources.shared import spread
from lexforge.streaming import streams

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_needs_the_optional_subpackage(tmp_path):
    """Without lexforge/llm and corpus_pipeline.py the catalogue still loads, with the other queries."""
    code = f"""
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("lexforge.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing()); sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
names = e.queries(); assert "bm25_top10" in names and not any(n.startswith("op") and n[2].isdigit() for n in names), names
e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
    importers = [p for p in (ROOT / "lexforge").rglob("*.py") if "llm" not in p.parts and "lexforge.llm" in p.read_text()]
    assert importers == []


def test_limiters():
    slept: list[float] = []
    answers = iter([(429, {"Retry-After": "3"}, None), (500, {}, None), (429, {}, None), (200, {}, {"ok": 1})])
    assert paged.post_with_retry(lambda *_: next(answers), "u", {}, paged.Bucket(), slept.append) == {"ok": 1}
    assert slept == [3.5, 2.0, paged.COOL_DOWN]
    with pytest.raises(RuntimeError):
        paged.post_with_retry(lambda *_: (500, {}, None), "u", {}, paged.Bucket(), slept.append, 2)
    bucket = paged.Bucket(2, 9.0)
    assert [bucket.wait() for _ in range(5)] == [0, 0, 9.0, 0, 9.0]
    batches = paged.Batches(4)
    for _ in range(3):
        batches.refused()
    assert batches.size == paged.LEAST_BATCH
    assert paged.envelope({"a": 1}, 2, 20) == {"data": {"a": 1}, "paging": {"pageNumber": 2, "pageSize": 20}}


def test_paged_source(spark, monkeypatch):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            page = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["paging"]["pageNumber"]
            rows = [{"id": 3 * (page - 1) + i} for i in range(3 if page < 3 else 1)] if page <= 3 else []
            body = json.dumps({"items": rows}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(paged.PagedList)
    rows = spark.read.format("paged").option("url", f"http://127.0.0.1:{server.server_port}").option("pagesize", "3").option("workers", "2").load().collect()
    server.shutdown()
    assert sorted(json.loads(r.value)["id"] for r in rows) == list(range(7))


def test_cache_updates_fetch_only_what_is_missing(spark, tmp_path):
    import base64

    from lexforge.sources import fetch

    ids = spark.createDataFrame([("1",), ("2",), ("3",)], "mevzuat_id string")

    def post(_, payload):
        key = payload["data"]["id"]
        return 200, {}, {"data": {"content": None if key == "3" else base64.b64encode(f"<p>ş{key}</p>".encode()).decode()}}

    go = lambda rows: fetch.update_cache(rows, "u", f"{tmp_path}/pages", f"{tmp_path}/none", post, 2)
    assert (go(ids.limit(1)), go(ids), go(ids)) == (1, 1, 0)
    assert sorted(r.content for r in spark.read.parquet(f"{tmp_path}/pages").collect()) == ["<p>ş1</p>", "<p>ş2</p>"]
    assert [r.mevzuat_id for r in spark.read.parquet(f"{tmp_path}/none").collect()] == ["3"]


def test_caches_and_corpus_round_trip(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("1234\t100\tÖrnek Kanunu\n1234\t100\tYinelenen\n77\t200\tEksik\n", encoding="utf-8")
    (tmp_path / "html_100.html").write_text(LAW_HTML, encoding="utf-8")
    (tmp_path / "treejson_100.json").write_text(json.dumps(LAW_TREE), encoding="utf-8")
    (tmp_path / "list.json").write_text(json.dumps({"100": {"resmiGazeteTarihi": "2001-05-06T00:00:00", "resmiGazeteSayisi": 24000}}), encoding="utf-8")
    (tmp_path / "cited.json").write_text(json.dumps([{"kanun_no": "01234", "madde_no": "3"}, {"kanun_no": "5", "madde_no": None}]), encoding="utf-8")
    base = str(tmp_path)
    laws = lists.laws(spark, f"{base}/ids.txt", base)
    assert [(r.mevzuat_id, r.kanun_ad) for r in laws.collect()] == [("100", "Örnek Kanunu")]
    assert lists.law_list(spark, f"{base}/ids.txt").count() == 2
    records = lists.law_records(spark, f"{base}/list.json")
    assert tuple(records.first()) == ("100", "2001-05-06", "24000") and lists.law_records(spark, f"{base}/none.json").count() == 0
    cited = lists.cited_articles(spark, f"{base}/none.json", f"{base}/cited.json")
    assert [tuple(r) for r in cited.collect()] == [("1234", "3")] and lists.cited_articles(spark, f"{base}/none.json").count() == 0
    from lexforge.operators import corpus

    built = corpus.build_corpus(laws, records, cited).cache()
    sinks.write_corpus(built, f"{base}/corpus", f"{base}/corpus.parquet")
    again = lists.corpus(spark, f"{base}/corpus")
    assert sorted(map(str, again.drop("sira").collect())) == sorted(map(str, built.collect()))
    assert spark.read.parquet(f"{base}/corpus.parquet").filter("yurutluk = 'mülga'").count() == 1
    before = resolve.version(spark.read.parquet(f"{base}/corpus.parquet"))
    service.check_unchanged(before, before)
    with pytest.raises(RuntimeError):
        service.check_unchanged(before, before.limit(0))
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    with pytest.raises(Exception):
        lists.law_records(spark, f"{base}/bad.json").collect()


def test_reported_failures(spark):
    ok = spark.createDataFrame([(("SUCCESS",), 1)], "metadata struct<FMTY:string>, x int")
    assert lists.checked_response(ok).count() == 1
    with pytest.raises(Exception, match="source reported"):
        lists.checked_response(ok.withColumn("metadata", F.struct(F.lit("ERROR").alias("FMTY")))).collect()
    row = spark.createDataFrame([("xZ8=",), ("değil!",)], "c string").select(lists.decoded(F.col("c")).alias("d")).collect()
    assert [r.d for r in row] == ["ş"[:0] + "ş" if False else "ş", "değil!"] or row[0].d == "ş"


def test_worklists(spark):
    want = spark.range(9).select(F.col("id").cast("string").alias("mevzuat_id"))
    left = lists.missing(want, want.limit(0).unionByName(spark.createDataFrame([("1",), ("2",)], want.schema)), spark.createDataFrame([("3",)], want.schema))
    assert left.count() == 6
    assert [r["count"] for r in lists.shares(left, 3, "mevzuat_id").groupBy("worker").count().collect()] == [2, 2, 2]


def test_sinks(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "mid long, v string")
    for _ in range(2):
        sinks.append_new(rows, f"{base}/t", "mid")
    assert spark.read.parquet(f"{base}/t").count() == 2
    points = spark.createDataFrame([(1, [0.5], "yürürlükte"), (2, [0.1], "mülga")], "id long, dense array<float>, yurutluk string")
    assert sinks.write_points(points, f"{base}/p") == 2
    assert "PartitionFilters: [isnotnull(yurutluk" in spark.read.parquet(f"{base}/p").filter("yurutluk = 'mülga'")._jdf.queryExecution().toString()
    sinks.write_suspicious(f"{base}/s", bos=rows.select("mid"), kirik=rows.select("v"))
    assert spark.read.json(f"{base}/s").count() == 4
    sinks.write_split(rows, F.col("mid") == 1, f"{base}/g")
    assert spark.read.json(f"{base}/g").filter("leaky = 'true'").count() == 1
    good, bad = sinks.isolated(rows, F.col("mid") == 1)
    assert (good.count(), bad.count()) == (1, 1)
    fused = spark.createDataFrame([(1, 7, 0.9, 1), (1, 8, 0.5, 2)], "query_id long, doc_ord long, score double, rank int")
    sinks.write_candidates(fused, f"{base}/c")
    assert spark.read.parquet(f"{base}/c").first().adaylar == [7, 8]
    sinks.rerank_input(fused, spark.createDataFrame([(7, "x" * 2000), (8, "y")], "doc_ord long, text string"), f"{base}/r")
    assert spark.read.json(f"{base}/r").agg(F.max(F.length("text"))).first()[0] == 1500
    assert sinks.viewer_counts(rows, "mid", "v").count() == 4


def test_settings():
    assert Settings.read({}).weights == (0.65, 0.2, 0.15)
    s = Settings.read({"W_DENSE": "0.5", "RERANK_VARSAYILAN": "evet", "ADAY_K": "", "ORT_THREADS": "2"})
    assert (s.w_dense, s.rerank_varsayilan, s.aday_k, s.ort_threads) == (0.5, True, 50, 2)
    with pytest.raises(ValueError):
        Settings.read({"EMBED_BACKEND": "magic"})


def test_drained_rows_lie_in_files(spark, sf_dir):
    """What a stream wrote is read from the shared folder; a memory sink would hold every row on the driver."""
    from lexforge.plans import catalog

    for name in ("stream_incremental", "stream_windows", "stream_rate_limit"):
        df = catalog.queries()[name](spark, sf_dir)
        assert df.inputFiles() and df.count() > 0


def test_limiter_carries_its_state_over_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, i * 0.7 + rng.random() / 2, rng.random() < 0.05) for i in range(150) for k in (1, 2)]
    parts, schema = [rows[:180], rows[180:]], "k long, at double, refused boolean"
    for part in parts:
        spark.createDataFrame(part, schema).selectExpr("k", "timestamp_micros(cast(round(at * 1e6) as bigint)) AS ts", "refused").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, ts timestamp, refused boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {(r.k, round(r.asked, 6)): (round(r.runs, 6), r.batch) for r in streams.drain(streams.limited(stream, "k", "ts", 9, 31.0), f"{tmp_path}/out").collect()}
    want = {}
    for k in (1, 2):
        opened, used, limit, shift = 0.0, 0, 9, 0.0
        for _, at, refused in (r for r in rows if r[0] == k):
            now = max(round(at, 6), shift)
            used = 0 if used and now - opened >= 31.0 else used
            if used >= limit:
                now, used = opened + 31.0, 0
            opened, used = (now if used == 0 else opened), used + 1
            if refused:
                limit, used = max(paged.LEAST_BATCH, limit - 1), 0
            shift = now
            want[k, round(at, 6)] = (round(now, 6), limit)
    assert got == want


def test_incremental_runs(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    sink = lambda df, _: df.write.mode("append").parquet(out)
    for i in range(2):
        spark.range(i * 10, i * 10 + 10).write.mode("append").parquet(src)
        streams.incremental(spark, src, "id LONG", f"{tmp_path}/ck", sink).awaitTermination()
    assert spark.read.parquet(out).agg(F.count("*"), F.count_distinct("id")).first() == (20, 20)


def test_service(spark):
    s = service.Service(corpus_of(spark), rerank_model=lambda q, t: F.length(t).cast("double"))
    assert s.health()["madde"] == 7
    for bad in ({"queries": ()}, {"queries": (" ",)}, {"queries": ("x" * 2001,)}, {"queries": ("a",), "top_k": 0}, {"queries": ("a",), "top_k": 51}, {"queries": ("a",), "mode": "x"}):
        with pytest.raises(ValueError):
            service.Request(**bad)
    got = s.respond(service.Request(("VUK m. 359", "kira sözleşmesi"), with_text=True))
    assert [(r["madde_id"], r["skor"] == 1.0, "atif" in r) for r in got["sonuclar"]][0] == ("3-359", True, True) and "atif" not in got["sonuclar"][1] and got["sonuclar"][1]["metin"]
    plain = s.respond(service.Request(("kira sözleşmesi",), mode="dogal"))["sonuclar"]
    ranked = s.respond(service.Request(("kira sözleşmesi",), mode="dogal", rerank=True))["sonuclar"]
    assert [r["madde_id"] for r in plain] == ["1-1", "2-1"] and [r["rerank_skor"] for r in ranked] == sorted((r["rerank_skor"] for r in ranked), reverse=True)
    with pytest.raises(ValueError):
        service.Service(corpus_of(spark)).respond(service.Request(("kira",), mode="dogal", rerank=True))


def python_wsum(legs, weights):
    norms = []
    for leg in legs:
        low, high = (min(leg.values()), max(leg.values())) if leg else (0, 0)
        norms.append({k: (v - low) / ((high - low) or 1.0) for k, v in leg.items()})
    keys = dict.fromkeys(k for n in norms for k in n)
    return {k: sum(w * n.get(k, 0.0) for w, n in zip(weights, norms)) for k in keys}


@pytest.mark.parametrize("seed", range(6))
def test_fusion_equals_a_plain_fold(spark, seed):
    r = random.Random(seed)
    queries = {q: [{d: round(r.random(), r.choice((1, 3))) for d in r.sample(range(30), r.randint(0, 12))} for _ in range(3)] for q in range(5)}
    frames = []
    for leg in range(3):
        rows = []
        for q, legs in queries.items():
            for rank, (d, s) in enumerate(sorted(legs[leg].items(), key=lambda x: (-x[1], x[0])), 1):
                rows.append((q, d, float(s), rank))
        frames.append(spark.createDataFrame(rows, "query_id long, doc_ord long, score double, rank int"))
    weights = r.choice([(0.65, 0.2, 0.15), (0.33, 0.33, 0.34), (1.0, 0.0, 0.0), (0.2, 0.3, 0.5)])
    got = {}
    for x in fusion.wsum(frames, weights).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.doc_ord, round(x.score, 9)))
    for q, legs in queries.items():
        ordered = [dict(sorted(leg.items(), key=lambda x: (-x[1], x[0]))) for leg in legs]
        want = sorted(python_wsum(ordered, weights).items(), key=lambda x: -x[1])
        assert [(k, round(v, 9)) for k, v in want] == got.get(q, [])
    with pytest.raises(ValueError):
        fusion.wsum(frames, (1.0,))


def test_dense_slices_agree(spark, monkeypatch):
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "vec_id long, embedding array<double>").repartition(5)
    queries = points.filter("vec_id < 9").select(F.col("vec_id").alias("query_id"), "embedding")
    found = lambda: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in retrieval.dense_topk(points, queries, 5).collect())
    whole = found()
    monkeypatch.setattr(retrieval, "QUERY_CELLS", 16)
    assert found() == whole and len(whole) == 45


def test_dense_ties_are_those_of_sums_in_order(spark, tmp_path):
    """Copies of vectors under other keys tie exactly, as in the query's SQL, whatever the task and the tile."""
    import duckdb

    from lexforge.plans import catalog

    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64)).astype(np.float32)
    rows = [(i + 60 * copy, base[i].tolist(), i % 2) for copy in range(30) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("dense_topk", "dense_topk_filtered"):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in catalog.queries()[name](spark, str(tmp_path)).collect())
        assert got == sorted(c.execute(f"SELECT query_id, rank, vec_id, score FROM ({catalog.oracle_sql()[name]})").fetchall())


def test_dense_tiles_bound_a_workers_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    points, queries = rng.normal(size=(10_000, 8)), rng.normal(size=(3_000, 8))
    batch = pa.RecordBatch.from_pydict({"vec_id": pa.array(np.arange(10_000)), "embedding": pa.array(list(points), pa.list_(pa.float64()))})
    tracemalloc.start()
    found = list(retrieval._nearest(np.arange(3_000), queries, 5, "vec_id")(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == 15_000 and peak < 80e6  # all scores at once are 240 MB
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.sort(np.argsort(-(unit(queries[:50]) @ unit(points).T), axis=1)[:, :5], axis=1)
    assert np.sort(found[0].column("vec_id").to_numpy().reshape(-1, 5)[:50], axis=1).tolist() == want.tolist()


def test_keyword_topk_equals_the_join(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc_ord"), "text")
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(8)
    joined = retrieval.ranked(retrieval.bm25_scores(docs, queries).withColumn("score", F.round("score", 6)).filter("score > 0"), ["query_id"], "score", "doc_ord").filter("rank <= 7")
    want = sorted((r.query_id, r["rank"], r.doc_ord, r.score) for r in joined.collect())
    for cells in (retrieval.QUERY_CELLS, 40):
        monkeypatch.setattr(retrieval, "QUERY_CELLS", cells)
        assert sorted((r.query_id, r["rank"], r.doc_ord, r.score) for r in retrieval.bm25_topk(docs, queries, 7, digits=6).collect()) == want
    assert retrieval.bm25_topk(docs.limit(0), queries, 7).count() == 0 and retrieval.bm25_topk(docs, queries.limit(0), 7).count() == 0


def test_keyword_workers_hold_few_scores():
    """Documents are scored in small parts: neither all scores of a batch nor its texts as Python strings are held."""
    import tracemalloc

    import pyarrow as pa

    words = [f"w{i}" for i in range(50)]
    r = random.Random(1)
    texts = [" ".join(r.choices(words, k=8)) for _ in range(10_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(10_000)), "text": pa.array(texts)})
    matrix = np.array([[float(r.random() < 0.05) for _ in range(2_000)] for _ in words])
    leg = (matrix, np.ones(50), lambda tf, dl, values: values * tf / dl)
    tracemalloc.start()
    found = list(retrieval._score_documents(np.arange(2_000), {w: j for j, w in enumerate(words)}, [leg], 3, "doc_id", 6)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110e6  # all scores at once are 160 MB, their order as much again
    rows = pa.Table.from_batches(found).to_pandas()
    for q in (0, 1_999):
        score = [sum(matrix[int(w[1:]), q] for w in t.split()) / 8 for t in texts]
        want = sorted(range(10_000), key=lambda d: (-score[d], d))[:3]
        assert rows[rows.query_id == q].doc_id.tolist() == want


def test_every_positive_score_equals_the_join(spark):
    docs = [(1, "Vergi 123456 123457 vergiler"), (2, None), (3, ""), (4, "vergi İSTANBUL ışık 12345 12345a"), (5, "çok uzun vergilendirme \u212aira"), (None, "vergi kira"), (6, "başka şeyler")]
    queries = [(1, "vergilendirme 123456"), (2, "12345 kira kira"), (3, ""), (4, None), (5, "Istanbul ışık")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    join = retrieval.bm25_scores(d, q, "doc_id").filter("doc_id IS NOT NULL AND score > 0")
    rounded = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 6)) for r in df.collect())
    assert rounded(retrieval.bm25_positive(d, q, "doc_id")) == rounded(join) != []


def test_rows_of_sparse_vectors_are_scored_without_a_join_on_tokens(spark):
    r = random.Random(2)
    rows = [(d, f"t{t}", r.random()) for d in range(80) for t in r.sample(range(20), 5)]
    asked = [(q, f"t{t}", r.random()) for q in range(4) for t in r.sample(range(25), 6)]
    points, queries = spark.createDataFrame(rows, "doc_ord long, token string, weight double"), spark.createDataFrame(asked, "query_id long, token string, weight double")
    found = retrieval.sparse_topk(points, queries, 7)
    score = {}
    for q, t, w in asked:
        for d, u, v in rows:
            if t == u:
                score[q, d] = score.get((q, d), 0.0) + v * w
    want = {(q, d) for q in range(4) for d in sorted((d for p, d in score if p == q), key=lambda d: -score[q, d])[:7]}
    assert {(x.query_id, x.doc_ord) for x in found.collect()} == want
    assert "Inner" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_fused_queries_read_both_legs_from_one_pass(spark, sf_dir):
    from lexforge.plans import catalog

    for name in ("wsum_fusion", "rrf_fusion", "ablation", "weight_sweep", "target_ranks"):
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "NestedLoop" not in plan and "contains(" not in plan.lower() and plan.count("MapIn") <= (name == "target_ranks")


def test_holders_of_texts_are_those_that_contain_them(spark, tmp_path):
    from lexforge.plans import retrieval_queries as Q

    items = ["a b c", "b", "", "x  y", "one two\nthree four", "ends here", " lead", "aa bb cc dd", None, "a b c"]
    docs = ["a b c", "za b cz", "a  b c", "x  y", "zero one two\nthree four five", "it ends here.", " leading", "xaa bb cc ddx aa bb", None, "", "b" * 20]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((q, d) for q, i in enumerate(items) for d, t in enumerate(docs) if i is not None and t is not None and i in t)
    assert sorted((r.query_id, r.doc_id) for r in Q.gold(spark, str(tmp_path)).collect()) == want


def test_the_one_law_is_one_task(spark):
    """Each task of the corpus build starts a worker for each of its functions, tasks without rows too."""
    from lexforge.plans.structure_queries import build

    assert "Repartition 1, false" in build(spark)._jdf.queryExecution().optimizedPlan().toString()


def test_list_comparison(spark):
    t = "query_id long, rank int, pair string, score double"
    old = spark.createDataFrame([(q, i, f"p{i}", 1.0 - i / 10 if q != 3 else 0.5) for q in range(1, 6) for i in (1, 2)], t)
    new = [(1, 1, "p1", 0.9, None), (1, 2, "p2", 0.8, None), (2, 1, "p1", 0.9, None), (2, 2, "p1", 0.8, None), (3, 1, "p2", 0.5, None), (3, 2, "p1", 0.5, None), (4, 1, "p9", 0.9, "p1"), (4, 2, "p2", 0.8, None), (5, 1, "p9", 0.9, "p9"), (5, 2, "p2", 0.8, None)]
    got = evaluation.compare_lists(old, spark.createDataFrame(new, t + ", truth string"))
    assert {r.query_id: r.kind for r in got.collect()} == {1: "same", 2: "collision", 3: "equal_scores", 4: "stale", 5: "different"}


def test_checks_fail_loudly(spark):
    rows = spark.range(3)
    assert evaluation.check(rows, F.col("id") < 9, "too large").count() == 3
    with pytest.raises(Exception, match="too large"):
        evaluation.check(rows, F.col("id") < 2, "too large").collect()


def test_model_columns(spark):
    rows = spark.createDataFrame([(1, "q", "aaa"), (2, "q", "a"), (3, "q", None)], "id long, q string, t string")
    score = fusion.reranker(lambda pairs: [float(len(t)) for _, t in pairs], batch=2)
    assert [r.s for r in rows.select("id", score("q", "t").alias("s")).orderBy("id").collect()] == [3.0, 1.0, 0.0]
    embed = retrieval.embedder(lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert all(abs(sum(x * x for x in r.e) - 1) < 1e-6 for r in rows.select(embed("t").alias("e")).collect())


def test_plans_push_down_and_prune(spark, sf_dir):
    """Filters and columns reach the scan; the ranking is limited before its shuffle."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = plan(retrieval.lengths(docs.filter("lang = 'en'"), key="doc_id"))
    assert "EqualTo(lang,en)" in p and "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    from lexforge.operators.windows import ranked

    assert "WindowGroupLimit" in plan(ranked(events, ["user_id"], "value", "event_id").filter("rank <= 3"))


def test_spread(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert spread(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = docs.repartition(9)
    assert spread(many) is many
