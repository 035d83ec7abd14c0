"""Sinks that pass their rows through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row

from weirflow.functions.lifecycle import Environment, opened
from weirflow.shared import ship


def foreach(df: DataFrame, consume: Callable[[Row], None], environment: Environment | None = None) -> DataFrame:
    """Calls consume for every row, on the executors, and gives df for further use. A task that is run again calls it again."""
    ship(df.sparkSession)

    def run(rows: Iterator[Row]) -> None:
        with opened(consume, environment) as own:
            for row in rows:
                own(row)

    df.foreachPartition(run)
    return df


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode("overwrite").parquet(path)
    return df
