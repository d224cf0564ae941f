"""Score fusion and re-ranking, batched over queries (FUS-01 to FUS-11).

A leg is a table (query_id, key, score, rank). Fusing is one union, one window and one aggregation whatever the number of legs;
ties keep the order of first appearance: by leg, then by rank in the leg.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import fixed as X

from .windows import first_groups


def minmax(score: Column, w) -> Column:
    """FUS-01: to 0..1 over the candidates of the window; equal scores all become 0."""
    low, high = F.min(score).over(w), F.max(score).over(w)
    return (score - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))


def union_legs(legs: Sequence[DataFrame], key: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [leg.select("query_id", key, "score", F.col("rank").cast("int").alias("rank"), F.lit(i).alias("leg")) for i, leg in enumerate(legs)])


def _ordered(df: DataFrame, digits: int | None) -> DataFrame:
    if digits is not None:
        df = df.withColumn("score", F.round("score", digits))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first"))
    return df.withColumn("rank", place).drop("first")


def wsum(legs: Sequence[DataFrame], weights: Sequence[float] = X.WEIGHTS, key: str = "doc_ord", digits: int | None = None) -> DataFrame:
    """FUS-02, FUS-05, FUS-06: weighted sum of min-max scores; legs are added in their order, as written weights."""
    if len(legs) != len(weights):
        raise ValueError("as many weights as legs are needed")
    rows = union_legs(legs, key).withColumn("s", minmax(F.col("score"), Window.partitionBy("query_id", "leg")))
    parts = [F.coalesce(F.max(F.when(F.col("leg") == i, F.col("s"))), F.lit(0.0)) * float(w) for i, w in enumerate(weights)]
    fused = rows.groupBy("query_id", key).agg(reduce(lambda a, b: a + b, parts).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    return _ordered(fused, digits)


def rrf(legs: Sequence[DataFrame], weights: Sequence[float] | None = None, key: str = "doc_ord", k: int = X.RRF_K, digits: int | None = None) -> DataFrame:
    """FUS-03 and FUS-04: (weighted) reciprocal ranks."""
    weights = weights or [1.0] * len(legs)
    parts = [F.coalesce(F.max(F.when(F.col("leg") == i, 1.0 / (k + F.col("rank")))), F.lit(0.0)) * float(w) for i, w in enumerate(weights)]
    fused = union_legs(legs, key).groupBy("query_id", key).agg(reduce(lambda a, b: a + b, parts).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    return _ordered(fused, digits)


def sweep(legs: Sequence[DataFrame], triples: DataFrame, key: str = "doc_ord", digits: int | None = None) -> DataFrame:
    """EVA-05 and STT-02: every weight triple (w_id, w0, w1, ...) at once; normalised scores are computed once and shared."""
    rows = union_legs(legs, key).withColumn("s", minmax(F.col("score"), Window.partitionBy("query_id", "leg")))
    each = [F.coalesce(F.max(F.when(F.col("leg") == i, F.col("s"))), F.lit(0.0)).alias(f"n{i}") for i in range(len(legs))]
    norms = rows.groupBy("query_id", key).agg(*each, F.min(F.struct("leg", "rank")).alias("first"))
    weighted = norms.crossJoin(F.broadcast(triples)).withColumn("score", reduce(lambda a, b: a + b, [F.col(f"n{i}") * F.col(f"w{i}") for i in range(len(legs))]))
    if digits is not None:
        weighted = weighted.withColumn("score", F.round("score", digits))
    place = F.row_number().over(Window.partitionBy("w_id", "query_id").orderBy(F.col("score").desc(), "first"))
    return weighted.select("w_id", "query_id", key, "score", place.alias("rank"))


def rerank(fused: DataFrame, head: int = X.RERANK_HEAD, score: str = "rerank_score") -> DataFrame:
    """FUS-07: the first ``head`` candidates by ``score``, stable; the rest stays in place."""
    inside = F.col("rank") <= head
    order = [(~inside).cast("int"), F.when(inside, -F.col(score)), "rank"]
    return fused.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def two_stage(fused: DataFrame, group: str, n: int) -> DataFrame:
    """FUS-10: candidates of the first ``n`` distinct groups."""
    return first_groups(fused, "query_id", group, "rank", n)


def reranker(model: Callable[[list[tuple[str, str]]], list[float]], batch: int = 16):
    """FUS-08 and FUS-11: a pair-scoring model as a column; pairs of all queries share batches of like length, order is restored."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in batches:
            rows = list(zip(queries.fillna(""), texts.fillna("").str[: X.RERANK_CHARS]))
            order = sorted(range(len(rows)), key=lambda i: len(rows[i][1]))
            out = [0.0] * len(rows)
            for at in range(0, len(order), batch):
                group = order[at : at + batch]
                for i, s in zip(group, model([rows[i] for i in group])):
                    out[i] = float(s)
            yield pd.Series(out)

    return score


def rerank_on(request: bool | None, default: bool, model: object | None) -> bool:
    """FUS-09: the request decides, else the default; without a model it is an error."""
    wanted = default if request is None else request
    if wanted and model is None:
        raise ValueError("re-ranking was asked for but no model is loaded")
    return wanted
