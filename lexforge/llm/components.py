"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_root


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b) but those that are the least of their component.

    Each round hangs a node's larger neighbours on the least one it sees and then does so again from the larger side;
    it ends when the edge set repeats, after a logarithmic number of rounds in practice. Every step is a
    partial aggregation and an equality join, so a star with any number of leaves is spread over tasks. Each round is
    written to the shared folder; only a count and a checksum reach the driver.
    """
    shared_root(edges.sparkSession)
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialize(small.select("e.*").filter("u <> v").distinct())
        before, seen = seen, _mark(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
