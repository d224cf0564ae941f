"""End-to-end search, streams and sinks as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexforge.operators.service import Request, Service
from lexforge.sources.shared import shared_root
from lexforge.streaming import streams

from .base import catalog, expected, table
from .structure_queries import corpus_of

C = catalog()

#: query, place, row, path, status.
FOUND = [
    (0, 1, "3-359", "atif", "eslesti"), (1, 1, "1-1", "dogal", None), (1, 2, "2-1", "dogal", None), (2, 1, "1-1", "dogal", "eslesme_yok"), (2, 2, "2-1", "dogal", "eslesme_yok"),
]


@C.add(expected(FOUND, "query_id long, sira int, madde_id string, mod string, durum string"))
def hybrid_search(spark, sf_dir):
    """RET-10, RET-11, MOD-01, API-01 to API-03: a citation, a question, and a citation that matches nothing."""
    service = Service(corpus_of(spark))
    found = service.search(Request(("VUK m. 359", "kira sözleşmesi nedir", "VUK m. 999 kira sözleşmesi"), top_k=2))
    return found.select("query_id", "sira", "madde_id", "mod", "durum")


def stream_of(spark, sf_dir):
    """The events table as a file stream: a directory of part files, or the one file in the scale-factor directory."""
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def scratch(spark) -> str:
    return f"{shared_root(spark)}/streams/{uuid.uuid4().hex}"


@C.add("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events")
def stream_incremental(spark, sf_dir):
    """STR-01, STR-02: a drained file stream holds every row once."""
    rows = streams.drain(stream_of(spark, sf_dir).select("event_id"), scratch(spark))
    return rows.agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@C.add("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Event-time windows; in complete mode no row is late."""
    return streams.drain(streams.event_counts(stream_of(spark, sf_dir)), scratch(spark), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@C.add()
def stream_rate_limit(spark, sf_dir):
    """STR-03: stateful, so checked by its properties: no window of a key runs more than its batch."""
    asked = stream_of(spark, sf_dir).select((F.col("user_id") % 20).alias("user_id"), "ts", (F.col("event_type") == "refund").alias("refused"))
    return streams.drain(streams.limited(asked, "user_id", "ts"), scratch(spark))
