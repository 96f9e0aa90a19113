"""Headways and late rows over a stream of departures or events, with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder)


def windowed_departures(events: DataFrame, time: str, line: str, window: str = "1 hour", slide: str | None = None, lateness: str = "15 minutes") -> DataFrame:
    """(line, window_start, departures, headway_minutes) per event-time window; rows later than the watermark are dropped."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", lateness)
    frame = F.window("_t", window, slide) if slide else F.window("_t", window)
    counted = timed.groupBy(F.col(line).alias("line"), frame.alias("w")).agg(F.count("*").alias("departures"))
    minutes = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")) / 60.0
    return counted.select("line", F.col("w.start").alias("window_start"), "departures", (minutes / F.col("departures")).alias("headway_minutes"))


def running_headways(events: DataFrame, time: str, line: str, lateness: str = "15 minutes") -> DataFrame:
    """(line, departures, mean_gap_minutes) of each line so far, updated with every batch; the state is one small row a line."""
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last = state.get if state.exists else (0, None, None)
        for batch in batches:
            n += len(batch)
            low, high = batch["_s"].min(), batch["_s"].max()
            first, last = (low if first is None else min(first, low)), (high if last is None else max(last, high))
        state.update((int(n), float(first), float(last)))
        yield pd.DataFrame({"line": [key[0]], "departures": [n], "mean_gap_minutes": [(last - first) / 60 / (n - 1) if n > 1 else None]})

    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", lateness).select(F.col(line).cast("string").alias("line"), F.col("_t").cast("double").alias("_s"))
    return timed.groupBy("line").applyInPandasWithState(update, "line string, departures long, mean_gap_minutes double", "n long, first double, last double", "update", GroupStateTimeout.NoTimeout)
