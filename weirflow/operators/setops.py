"""Bag union, bag difference and distinct, on whole records; nulls are equal to nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


from weirflow.schema import same_columns


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, by position."""
    return a.union(same_columns(a, b))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of a that do not occur in b; repeats of a stay, unlike with EXCEPT or EXCEPT ALL."""
    # Which rows occur is all that counts of b, so its repeats are dropped before they are shuffled to the join.
    right = same_columns(a, b).distinct().toDF(*[f"_r{i}" for i in range(len(a.columns))])
    on = reduce(lambda x, y: x & y, [a[f"`{c}`"].eqNullSafe(right[f"_r{i}"]) for i, c in enumerate(a.columns)])
    return a.join(right, on, "left_anti")


def distinct(df: DataFrame) -> DataFrame:
    """Each different row once."""
    return df.distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Extension: the different rows that occur in both."""
    return a.intersect(same_columns(a, b))


