"""How rows are dealt over partitions. Results never depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.schema import Keys, columns


def hash_partition(df: DataFrame, keys: Keys | None = None, n: int | None = None) -> DataFrame:
    """By hash of the keys, or of whole records."""
    own = columns(keys if keys is not None else [f"`{c}`" for c in df.columns])
    return df.repartition(n, *own) if n else df.repartition(*own)


def round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def range_partition(df: DataFrame, keys: Keys, n: int | None = None) -> DataFrame:
    return df.repartitionByRange(n, *columns(keys)) if n else df.repartitionByRange(*columns(keys))


def narrow(df: DataFrame, n: int) -> DataFrame:
    """To fewer partitions without a shuffle; rows are never repeated."""
    return df.coalesce(n)


def broadcast_if_small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows (they are counted, up to the bound); else df as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
