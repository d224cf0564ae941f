"""Queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexforge.sources.shared import spread

from .chat import chat_table
from .decontaminate import contamination_table
from .html_crf import extract_table
from .mixing import mix_table
from .oracle import oracle_sql as oracle_sql
from .pii import find_pii
from .quality import quality_table
from .secrets import find_secrets
from .simhash import simhash_table
from .units import unit_table
from .winnow import line_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_table(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_table(_table(spark, sf_dir, "conversations"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_table(_table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_table(_table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(_table(spark, sf_dir, "documents"))


def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_table(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_table(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_table(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_decontaminate, op3_chat_format, op4_mix_sources, op5_html_extract, op6_secrets, op7_quality_rules, op8_unit_dedup, op9_simhash, op10_line_dedup)}
