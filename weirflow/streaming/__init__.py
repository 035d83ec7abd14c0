"""Streams: the same operators on unbounded tables, sources and sinks, windows and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read_files(spark: SparkSession, path: str, schema: str, format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A folder as a stream of its files."""
    reader = spark.readStream.format(format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_rate(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def write(df: DataFrame, checkpoint: str, path: str | None = None, format: str = "parquet", mode: str = "append", each_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts a query that takes what is there and ends: into files, a memory table (format "memory", path its name), or a function of each batch."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each_batch is not None:
        return writer.foreachBatch(each_batch).start()
    return writer.format("memory").queryName(path).start() if format == "memory" else writer.format(format).start(path)


def windowed(df: DataFrame, time: str, width: str, *aggregates: Column, keys: list[str] | None = None, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """A row per window and key; rows later than the watermark are dropped."""
    timed = df.withWatermark(time, late) if df.isStreaming else df
    return timed.groupBy(F.window(time, width, slide or width), *(keys or [])).agg(*aggregates)


def sessions(df: DataFrame, time: str, gap: str, *aggregates: Column, keys: list[str] | None = None, late: str = "0 seconds") -> DataFrame:
    timed = df.withWatermark(time, late) if df.isStreaming else df
    return timed.groupBy(F.session_window(time, gap), *(keys or [])).agg(*aggregates)


def keyed_state(df: DataFrame, key: str, value: str, order: str | None, step: Callable[[int, int], int | None], zero: int = 0) -> DataFrame:
    """A stream of (key, state): new = step(old, value), where None keeps the old state.

    With an order, the rows of one key and micro-batch are held to be sorted (bound them by files_per_trigger); with
    None they are taken as they come, an Arrow batch at a time, whatever their number.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else zero
        for rows in batches if order is None else [pd.concat(list(batches)).sort_values(order)]:
            for v in rows[value].tolist():
                fresh = step(now, v)
                now = now if fresh is None else fresh
        state.update((int(now),))
        yield pd.DataFrame({key: [keys[0]], "state": [int(now)]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, value, *([order] if order else [])).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, state long", "state long", "update", "NoTimeout")
