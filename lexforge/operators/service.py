"""Search facade: validated, batched requests to ranked or cited rows (RET-10 to RET-13, API-01 to API-06, MOD-01)."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import fixed as X
from lexforge.functions.text import head
from lexforge.sources.settings import Settings

from . import fusion, resolve, retrieval


@dataclass(frozen=True)
class Request:
    """API-01: one request or many; what is out of bounds is refused before any work."""

    queries: tuple[str, ...]
    top_k: int = X.TOP
    rerank: bool | None = None
    in_force_only: bool = True
    with_text: bool | None = None
    mode: str = "otomatik"

    def __post_init__(self) -> None:
        if not self.queries or any(not q.strip() or len(q) > X.QUERY_LIMIT for q in self.queries):
            raise ValueError(f"a query has 1 to {X.QUERY_LIMIT} characters and is not blank")
        if not 1 <= self.top_k <= X.TOP_LIMIT:
            raise ValueError(f"top_k is 1 to {X.TOP_LIMIT}")
        if self.mode not in ("otomatik", "atif", "dogal"):
            raise ValueError(f"unknown mode {self.mode!r}")


@dataclass
class Service:
    """API-04: a corpus (sira, id, text, metadata) with its points and models.

    ``points`` has (doc_ord, embedding, yurutluk), ``sparse`` (doc_ord, token, weight, yurutluk); either leg may be missing. ``embed`` and
    ``sparse_embed`` turn queries (query_id, text) into vectors; ``rerank_model`` is a column function of query and text.
    """

    corpus: DataFrame
    settings: Settings = field(default_factory=Settings)
    points: DataFrame | None = None
    sparse: DataFrame | None = None
    embed: Callable[[DataFrame], DataFrame] | None = None
    sparse_embed: Callable[[DataFrame], DataFrame] | None = None
    rerank_model: Callable[[Column, Column], Column] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.corpus.sparkSession

    def candidates(self, queries: DataFrame, in_force_only: bool = True) -> DataFrame:
        """RET-10: fused candidates (query_id, doc_ord, score, rank); the keyword leg is always in force only."""
        s, legs, weights = self.settings, [], []
        keep = (lambda df: df.filter(F.col("yurutluk") == X.IN_FORCE)) if in_force_only else (lambda df: df)
        if self.points is not None and self.embed is not None:
            legs.append(retrieval.dense_topk(keep(self.points), self.embed(queries), s.aday_k, "doc_ord"))
            weights.append(s.w_dense)
        if self.sparse is not None and self.sparse_embed is not None:
            legs.append(retrieval.sparse_topk(keep(self.sparse).select("doc_ord", "token", "weight"), self.sparse_embed(queries), s.aday_k))
            weights.append(s.w_sparse)
        docs = self.corpus.filter(F.col("metadata.yurutluk") == X.IN_FORCE).select(F.col("sira").alias("doc_ord"), "text")
        legs.append(retrieval.bm25_topk(docs, queries, s.aday_k))
        weights.append(s.w_bm25)
        return fusion.wsum(legs, weights)

    def ranked(self, queries: DataFrame, request: Request) -> DataFrame:
        """RET-11: the best ``top_k`` rows of each query, re-ranked if asked for."""
        found = self.candidates(queries, request.in_force_only)
        on = fusion.rerank_on(request.rerank, self.settings.rerank_varsayilan, self.rerank_model)
        found = found.join(self.corpus.withColumnRenamed("sira", "doc_ord"), "doc_ord")
        if on:
            pairs = found.join(queries.select("query_id", F.col("text").alias("q")), "query_id")
            scored = pairs.withColumn("rerank_score", F.when(F.col("rank") <= self.settings.rerank_aday, self.rerank_model(F.col("q"), head(F.col("text"), self.settings.rerank_max_krk))))
            found = fusion.rerank(scored, self.settings.rerank_aday).drop("q", "rank").withColumnRenamed("new_rank", "rank")
        else:
            found = found.withColumn("rerank_score", F.lit(None).cast("double"))
        return found.filter(F.col("rank") <= request.top_k)

    def search(self, request: Request) -> DataFrame:
        """API-01 to API-03, MOD-01: one schema for both paths; ``atif`` is null on the ranked one, ``metin`` unless asked for."""
        queries = self.spark.createDataFrame(list(enumerate(request.queries)), "query_id long, text string")
        idx = resolve.index(self.corpus)
        parsed = resolve.parse_queries(queries, resolve.law_names(idx) if request.mode != "dogal" else None)
        if request.mode == "dogal":
            parsed = parsed.withColumn("parsed", F.struct(F.array().cast(parsed.schema["parsed"].dataType["atiflar"].dataType).alias("atiflar"), F.lit("").alias("tani")))
        matches = resolve.resolve(parsed, idx)
        path = resolve.route(parsed, matches, request.mode)
        cited = resolve.citation_rows(matches.join(path.filter("mod = 'atif'").select("query_id"), "query_id", "left_semi"), request.top_k)
        cited = cited.drop("kanun_no", "madde_no", "mevzuat_id").join(self.corpus.drop("sira"), cited["madde_id"] == self.corpus["id"])
        text = lambda default: F.when(F.lit(default if request.with_text is None else request.with_text), F.col("text"))
        m = lambda c: F.coalesce(F.col(f"metadata.{c}"), F.lit(""))
        common = [F.col("id").alias("madde_id"), m("kanun_no").alias("kanun_no"), m("kanun_ad").alias("kanun_ad"), m("madde_no").alias("madde_no")]
        cite = F.struct((F.col("cite") + 1).alias("atif_sira"), F.col("metadata.mevzuat_id"), F.col("metadata.yurutluk"), F.col("metadata.tasindigi_kanun"), "parca", "uyarilar")
        a = cited.select("query_id", F.col("rank").cast("int").alias("sira"), *common, F.lit(1.0).alias("skor"), F.lit(None).cast("double").alias("rerank_skor"), text(True).alias("metin"), cite.alias("atif"))
        natural = queries.join(path.filter("mod = 'dogal'").select("query_id"), "query_id", "left_semi")
        b = self.ranked(natural, request).select("query_id", F.col("rank").cast("int").alias("sira"), *common, F.col("score").alias("skor"), F.col("rerank_score").alias("rerank_skor"), text(False).alias("metin"))
        return a.unionByName(b, allowMissingColumns=True).join(path, "query_id")

    def respond(self, request: Request) -> dict:
        """API-02, STR-05: the response of a request as plain objects, with the time it took and the settings used."""
        began = time.perf_counter()
        rows = [r.asDict(recursive=True) for r in self.search(request).orderBy("query_id", "sira").collect()]
        for r in rows:
            if r["atif"] is None:
                del r["atif"]
        config = {"embed_backend": self.settings.embed_backend, "rerank_backend": self.settings.rerank_backend, "agirliklar": list(self.settings.weights), "aday_k": self.settings.aday_k}
        return {"sonuclar": rows, "sure_ms": {"toplam": (time.perf_counter() - began) * 1000}, "config": config}

    def health(self) -> dict:
        """API-05."""
        n = self.corpus.agg(F.count("*").alias("n"), F.count_if(F.col("metadata.yurutluk") == X.IN_FORCE).alias("k")).first()
        return {"durum": "ok", "madde": n["n"], "yururlukte": n["k"]}


def check_unchanged(before: DataFrame, after: DataFrame) -> None:
    """STR-04, API-05: an error if the corpus files differ from those an index was built on."""
    if before.exceptAll(after).limit(1).count() or after.exceptAll(before).limit(1).count():
        raise RuntimeError("the corpus changed since the index was built; build it again")


def build(spark: SparkSession, corpus_path: str, **parts) -> Service:
    """RET-13: a service over a corpus table with the settings of the environment."""
    from lexforge.sources.lists import corpus

    return Service(corpus(spark, corpus_path), Settings.read(), **parts)


def main() -> None:
    """API-06: ``spark-submit`` with a corpus path and queries; the score shown is the reranker's if there is one."""
    import sys

    path, *queries = sys.argv[1:]
    service = build(SparkSession.builder.getOrCreate(), path)
    for r in service.respond(Request(tuple(queries)))["sonuclar"]:
        score = r["skor"] if r["rerank_skor"] is None else r["rerank_skor"]
        print(f"{r['query_id']}\t{r['sira']}\t{score:.4f}\t{r['kanun_ad']} m. {r['madde_no']}")


if __name__ == "__main__":
    main()
