"""Structured Streaming forms of the incremental parts (STR-01 to STR-05)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexforge.sources.lists import exists
from lexforge.sources.paged import BATCH, LEAST_BATCH, WINDOW

#: Rows that the rate limiter hands on at once.
ROWS = 50_000


def incremental(spark: SparkSession, source: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None], files: int = 64, fmt: str = "parquet") -> StreamingQuery:
    """STR-01, STR-02: process the files that are new since the last run, then stop; the checkpoint remembers the rest."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(source)
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limited(requests: DataFrame, key: str, ts: str, size: int = BATCH, pause: float = WINDOW, watermark: str = "10 minutes") -> DataFrame:
    """STR-03: when each request of a key may run, if at most ``size`` run in a window of ``pause`` seconds; refusals shrink the batch.

    ``requests`` (key, ts, refused) is a stream; the state of a key is four numbers. Within a batch of the stream a key's requests are taken in
    event order.
    """

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, used, limit, shift = state.get if state.exists else (0.0, 0, size, 0.0)
        # a key may have most rows of the stream, so rows are kept as numbers in arrays
        asked, refusals = zip(*[(b[ts].to_numpy("datetime64[us]"), b["refused"].to_numpy(bool, na_value=False)) for b in batches])
        asked, refusals = np.concatenate(asked), np.concatenate(refusals)
        order = np.argsort(asked, kind="stable")
        asked, refusals = asked[order].astype("int64") / 1e6, refusals[order]
        for start in range(0, len(asked), ROWS):
            part = slice(start, start + ROWS)
            runs, limits = [], []
            for at, refused in zip(asked[part].tolist(), refusals[part].tolist()):
                now = max(at, shift)
                if used and now - opened >= pause:
                    used = 0
                if used >= limit:
                    now, used = opened + pause, 0
                opened = now if used == 0 else opened
                used += 1
                if refused:
                    limit, used = max(LEAST_BATCH, limit - 1), 0
                shift = now
                runs.append(now)
                limits.append(limit)
            yield pd.DataFrame({key: name[0], "asked": asked[part], "runs": runs, "batch": limits})
        state.update((opened, used, limit, shift))

    kind = requests.schema[key].dataType.simpleString()
    grouped = requests.withWatermark(ts, watermark).groupBy(key)
    return grouped.applyInPandasWithState(run, f"{key} {kind}, asked double, runs double, batch int", "opened double, used int, size int, shift double", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and means by type in event-time windows; rows later than the watermark are left out by the engine."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def drain(df: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote: Parquet in the shared folder ``at``, so no row passes through the driver."""
    spark, rows = df.sparkSession, f"{at}/rows"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(rows)
    else:  # a table that each batch writes anew; files can only be appended to
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(rows)).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(rows) if exists(spark, rows) else spark.createDataFrame([], df.schema)


class Durations(StreamingQueryListener):
    """STR-05: milliseconds of each phase, added up over a query's batches."""

    def __init__(self) -> None:
        self.ms: dict[str, float] = {}

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        for phase, ms in event.progress.durationMs.items():
            self.ms[phase] = self.ms.get(phase, 0.0) + ms

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass
