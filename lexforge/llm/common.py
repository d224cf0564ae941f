"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.sources.shared import shared_root

#: The six characters that separate words in every contract but the benchmark one.
SPACES = r"[ \x09-\x0D]+"
WORD = r"[^ \x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it.

    Catalyst inlines ordinary aliases into lambdas, where they would be recomputed for every element;
    a lambda variable is bound exactly once.
    """
    return F.transform(F.array(value), body)[0]


#: Folder of the tables of the piece of work in hand; without one they lie under the application's id.
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts lineage, lets several consumers share one pass over the text, and outlives lost executors.
    The tables lie under ``<spark.checkpoint.dir>/tables/<application id>``, until ``sweep`` removes them, or in the folder of a ``scope``, until that ends.
    """
    spark = df.sparkSession
    at = _scope.get() or f"{shared_root(spark)}/tables/{spark.sparkContext.applicationId}"
    path = f"{at}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it exists."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are removed at its end; what is made of them must have been written by then."""
    path = f"{shared_root(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    token = _scope.set(path)
    try:
        yield
    finally:
        _scope.reset(token)
        remove(spark, path)


def sweep(spark: SparkSession) -> None:
    """Remove this application's materialized tables; call it once their readers have finished."""
    remove(spark, f"{shared_root(spark)}/tables/{spark.sparkContext.applicationId}")


def checked_broadcast(df: DataFrame, rows: int, limit: int = 50_000) -> DataFrame:
    """Broadcast ``df`` if it is known to have at most ``limit`` rows; else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def map_rows(df: DataFrame, run: Callable) -> DataFrame:
    """``mapInArrow`` over all columns of ``df`` by place, since it cannot take names with dots."""
    places = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return places.mapInArrow(run, places.schema).toDF(*df.columns)


def row_hash(name: str = "text") -> Column:
    """Tells apart rows that share a doc_id; rows equal in both are one document to the operators."""
    return F.xxhash64(text_or_empty(name))


def native_words(text: Column) -> Column:
    """Array of the words of ``text`` (maximal runs of anything but the six white-space characters)."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")
