"""Sorting: a total order, an order within partitions, and the first rows of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.schema import Keys, columns
from weirflow.shared import checkpointed


def _directed(keys: Keys, ascending: bool):
    return [c.asc() if ascending else c.desc() for c in columns(keys)]


def sort(df: DataFrame, keys: Keys, ascending: bool = True) -> DataFrame:
    """All rows in one order; one direction for all keys. Structs compare field by field."""
    return df.orderBy(*_directed(keys, ascending))


def sort_within_partitions(df: DataFrame, keys: Keys, ascending: bool = True) -> DataFrame:
    """Each partition sorted, nothing shuffled."""
    return df.sortWithinPartitions(*_directed(keys, ascending))


def top_k(df: DataFrame, keys: Keys, k: int, ascending: bool = True) -> DataFrame:
    """The first k rows of an order: each partition keeps k at most."""
    return df.orderBy(*_directed(keys, ascending)).limit(k)


def with_positions(df: DataFrame, name: str = "position") -> DataFrame:
    """df with the place of each row in its order, from 0: places within partitions, and the sizes of the partitions before.

    Rows and places are written to the shared folder, now, so that an order that isn't total is read the same twice.
    """
    held = checkpointed(df.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()))
    line = Window.orderBy("_part")  # one row per partition
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = held.join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_place") - F.col("_first")).select(*df.columns, name)
