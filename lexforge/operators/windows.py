"""Ordered-state operators as window functions (WIN-01 to WIN-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import slug


def inherit(df: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """WIN-01: the last ``value`` at or before each row; nulls inside a struct are inherited with it."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def assign_ids(df: DataFrame, group: str, order: str, number: str, name: str = "id") -> DataFrame:
    """WIN-02: ``group-slug``, with a running number where a slug repeats."""
    same = Window.partitionBy(group, slug(F.col(number)))
    rank = F.row_number().over(same.orderBy(order))
    base = F.concat(F.col(group).cast("string"), F.lit("-"), slug(F.col(number)))
    return df.withColumn(name, F.when(F.count("*").over(same) > 1, F.concat(base, F.lit("-"), rank.cast("string"))).otherwise(base))


def next_start(df: DataFrame, group: str, start: str, end: Column, name: str = "end") -> DataFrame:
    """WIN-03: each slice ends where the next one starts, the last at ``end``."""
    return df.withColumn(name, F.coalesce(F.lead(start).over(Window.partitionBy(group).orderBy(start)), end))


def ranked(df: DataFrame, groups: list[str], score: str, tie: str, name: str = "rank") -> DataFrame:
    """WIN-04: 1-based rank by descending score, ties by first appearance."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(F.col(score).desc(), tie)))


def first_groups(df: DataFrame, query: str, group: str, rank: str, n: int) -> DataFrame:
    """WIN-05 and FUS-10: rows of the first ``n`` distinct groups of each ranking.

    A group's place is the place of its best row; the running count of first appearances is one more window, no join.
    """
    best = F.min(rank).over(Window.partitionBy(query, group))
    place = F.dense_rank().over(Window.partitionBy(query).orderBy("__best"))
    return df.withColumn("__best", best).withColumn("__place", place).filter(F.col("__place") <= n).drop("__best", "__place")


def rank_of(found: DataFrame, query: str, rank: str, hit: Column, k: int = 10) -> DataFrame:
    """WIN-06: rank of the first hit within ``k``, 0 without one."""
    return found.groupBy(query).agg(F.coalesce(F.min(F.when(hit & (F.col(rank) <= k), F.col(rank))), F.lit(0)).cast("int").alias("hit_rank"))


def counting_run(numbers: Column) -> Column:
    """WIN-07: how far the array counts 1, 2, 3 and so on, passing over others."""
    return F.aggregate(numbers, F.lit(0), lambda a, x: F.when(x == a + 1, x).otherwise(a))


def growing(df: DataFrame, groups: list[str], order: str, value: str) -> DataFrame:
    """WIN-08: rows whose value exceeds all earlier ones of the group."""
    before = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__top", F.max(value).over(before)).filter(F.col("__top").isNull() | (F.col(value) > F.col("__top"))).drop("__top")
