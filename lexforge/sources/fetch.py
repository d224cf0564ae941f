"""Fetch job: the list of laws, then the pages and trees that the cache lacks (SRC-04, SRC-05, SRC-10, SRC-19, SRC-21).

``spark-submit lexforge/sources/fetch.py URL CACHE [LIMIT]``. Running it again fetches only what is missing; documents known to have no tree are
remembered and not asked for again.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lists import decoded, exists, first_of_each, missing
from .paged import Batches, PagedList, Post, envelope, http_post, post_with_retry
from .shared import ship


def fetch_list(spark: SparkSession, url: str, path: str, page_size: int = 20) -> DataFrame:
    """The list of laws, cached as Parquet at ``path``."""
    if not exists(spark, path):
        spark.dataSource.register(PagedList)
        rows = spark.read.format("paged").option("url", f"{url}/list").option("pagesize", str(page_size)).load()
        field = lambda c: F.get_json_object("value", f"$.{c}")
        laws = rows.select(field("mevzuatNo").alias("kanun_no"), field("mevzuatId").alias("mevzuat_id"), field("mevzuatAdi").alias("kanun_ad"), F.struct("page", "pos").alias("o"))
        first_of_each(laws, "mevzuat_id", "o").drop("o").write.parquet(path)
    return spark.read.parquet(path)


def fetch_contents(ids: DataFrame, url: str, workers: int = 3, post: Post = http_post, limiter: Callable[[], Batches] = Batches) -> DataFrame:
    """(mevzuat_id, content) for each id; each of ``workers`` partitions is one polite client. An id that fails has a null content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rate = limiter()
        for pdf in batches:
            out = []
            for key in pdf["mevzuat_id"]:
                try:
                    body = post_with_retry(post, url, envelope({"id": key}), rate)
                    out.append((key, (body.get("data") or {}).get("content")))
                except (RuntimeError, OSError, ValueError):
                    out.append((key, None))
            yield pd.DataFrame(out, columns=["mevzuat_id", "content"])

    return ids.select("mevzuat_id").repartition(workers, "mevzuat_id").mapInPandas(run, "mevzuat_id string, content string")


def update_cache(ids: DataFrame, url: str, path: str, empty_path: str | None = None, post: Post = http_post, workers: int = 3, limiter: Callable[[], Batches] = Batches) -> int:
    """Append the contents of ids that the table at ``path`` lacks; ids without content go to ``empty_path``. Returns how many were new."""
    spark = ids.sparkSession
    known = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], "mevzuat_id string, content string")
    none = spark.read.parquet(empty_path) if empty_path and exists(spark, empty_path) else None
    got = fetch_contents(missing(ids, known.select("mevzuat_id"), none), url, workers, post, limiter).withColumn("content", decoded(F.col("content"))).persist()
    new = got.filter("content IS NOT NULL")
    n = new.count()
    new.write.mode("append").parquet(path)
    if empty_path:
        got.filter("content IS NULL").select("mevzuat_id").write.mode("append").parquet(empty_path)
    got.unpersist()
    return n


def main() -> None:
    url, cache, *limit = sys.argv[1:]
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    laws = fetch_list(spark, url, f"{cache}/list")
    laws = laws.limit(int(limit[0])) if limit else laws
    print("trees", update_cache(laws, f"{url}/tree", f"{cache}/trees", f"{cache}/no_trees"))
    print("pages", update_cache(laws, f"{url}/content", f"{cache}/pages"))


if __name__ == "__main__":
    main()
