"""Writers (SNK-01 to SNK-10): every sink is a partitioned, restartable table write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import fixed as X

from .lists import exists


def write_corpus(corpus: DataFrame, path: str, parquet: str | None = None) -> None:
    """SNK-01: JSON lines, and Parquet if asked for; Spark's commit protocol makes each write all or nothing."""
    corpus.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    if parquet:
        corpus.select("*", F.col("metadata.yurutluk").alias("yurutluk")).write.mode("overwrite").partitionBy("yurutluk").parquet(parquet)


def isolated(rows: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """SNK-01: rows that parse, and those that do not, so that one broken law does not stop the others."""
    flag = F.coalesce(bad, F.lit(True))
    return rows.filter(~flag), rows.filter(flag)


def write_points(points: DataFrame, path: str, batch: int = 256) -> int:
    """SNK-02: vectors partitioned by status (the pushed-down filter), rewritten as a whole; the count read back must agree."""
    points.write.mode("overwrite").partitionBy("yurutluk").option("maxRecordsPerFile", batch * 4096).parquet(path)
    n, wanted = points.sparkSession.read.parquet(path).count(), points.count()
    if n != wanted:
        raise RuntimeError(f"{path}: {n} points were written, {wanted} were meant")
    return n


def embed_job(corpus: DataFrame, embed: Callable[[str], Column], path: str, limit: int | None = None) -> None:
    """SNK-03: text to vectors with the payload fields; ``limit`` is a trial mode."""
    rows = corpus if limit is None else corpus.limit(limit)
    rows.select(F.col("id").alias("madde_id"), embed("text").alias("dense"), *[f"metadata.{c}" for c in X.PAYLOAD]).write.mode("overwrite").parquet(path)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """SNK-04, SNK-05, STR-02: append what the table does not hold yet; running it again adds nothing."""
    spark = rows.sparkSession
    new = rows.join(spark.read.parquet(path).select(key), key, "left_anti") if exists(spark, path) else rows
    new.write.mode("append").parquet(path)


def write_suspicious(path: str, **kinds: DataFrame) -> None:
    """SNK-06: several kinds of suspicious rows in one table, each with its name."""
    union = None
    for name, df in kinds.items():
        tagged = df.select(F.lit(name).alias("tip"), "*")
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    union.write.mode("overwrite").json(path)


def write_split(rows: DataFrame, leaky: Column, path: str) -> None:
    """SNK-07: clean and leaky gold rows as partitions."""
    rows.withColumn("leaky", F.coalesce(leaky, F.lit(False))).write.mode("overwrite").partitionBy("leaky").json(path)


def write_candidates(fused: DataFrame, path: str, k: int = 50) -> None:
    """SNK-08: candidates of each query in order, as aligned arrays."""
    top = fused.filter(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_ord", "score"))).alias("c"))
    top.select("query_id", F.transform("c", lambda x: x["doc_ord"]).alias("adaylar"), F.transform("c", lambda x: x["score"]).alias("skorlar")).write.mode("overwrite").parquet(path)


def rerank_input(fused: DataFrame, texts: DataFrame, path: str, k: int = 50, chars: int = 1500) -> None:
    """SNK-09: the top of each list with shortened texts."""
    fused.filter(F.col("rank") <= k).join(texts, "doc_ord").select("query_id", "rank", "doc_ord", F.left("text", F.lit(chars)).alias("text")).write.mode("overwrite").json(path)


def viewer_counts(rows: DataFrame, *facets: str) -> DataFrame:
    """SNK-10, GRP-06: the counters of a facet viewer, one row for each facet value."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]))
    return rows.select(each.alias("x")).select("x.*").groupBy("facet", "value").agg(F.count("*").alias("n"))


