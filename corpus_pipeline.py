"""Documents to training mix: five filtering stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm.common import remove, scope
from lexforge.llm.decontaminate import decontaminate
from lexforge.llm.mixing import mix_filter
from lexforge.llm.quality import quality_filter
from lexforge.llm.simhash import simhash_dedup
from lexforge.llm.winnow import dedup_lines
from lexforge.sources.shared import shared_root, shipped, spread

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


@shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's and source's robust scatter.

    Null and empty texts fail the base rules; small groups and groups of null language or source are judged as ``lexforge.llm.quality`` says; repeated rows share a
    verdict; an empty table stays empty; all columns are kept, whatever their names.
    """
    return quality_filter(spread(docs))


@shipped
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of long lines and runs of lines; those of which nothing is left go.

    Null texts have no lines and stay; rows equal in id and text delete nothing in each other; null ids rank first, one id's texts by hash; all columns are kept, and
    ``n_chars`` follows a shortened text; an empty table stays empty.
    """
    return dedup_lines(spread(docs))


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id.

    Null and empty texts share fingerprint zero and so a component; null ids come last; of one id's texts the smallest hash stays, of equal rows one; all columns are
    kept, whatever their names; an empty table stays empty.
    """
    return simhash_dedup(spread(docs))


@shipped
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none and stay; null items are no windows; repeated rows stay or go together; all columns are kept, whatever their names; an empty table
    or benchmark changes nothing.
    """
    return decontaminate(spread(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@shipped
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with ``size``, ``target`` (words of its source), ``taken`` (words) and ``parts`` ((shard, start, end) of its word ranges).

    Null and empty texts have no words and go; null source is a source, last in order; repeated rows have places of their own; columns of those four names are
    replaced, all others kept; an empty table stays empty.
    """
    return mix_filter(spread(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SimHash needs XXH64 of shingles, which DuckDB lacks; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables between stages lie in the folder of ``spark.checkpoint.dir``; each is removed when the next is written, so only the result stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at, before = f"{shared_root(spark)}/pipeline/{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{at}/{i}_{name}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
