"""Pairwise equi-joins. Results are pairs of records (_1, _2); schema.flattened() spreads them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.schema import Keys, columns


def _keyed(df: DataFrame, keys: Keys, side: str) -> tuple[DataFrame, list[str]]:
    own = columns(keys)
    names = [f"_k{side}{i}" for i in range(len(own))]
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(f"_{side}"), *[k.alias(n) for k, n in zip(own, names, strict=True)]), names


def hash_join(build: DataFrame, probe: DataFrame, build_keys: Keys, probe_keys: Keys, duplicates: str = "all", order: Keys | None = None, null_equal: bool = False, hint: str | None = None) -> DataFrame:
    """Inner equi-join: (_1: build record, _2: probe record).

    duplicates="all" pairs every build record; "last" keeps, per key, the build record that is last by `order`, as a
    hash table that is overwritten would. Which side is broadcast or shuffled is left to the optimizer, which knows
    sizes; `hint` ("merge", "shuffle_hash", "broadcast") overrides it for the build side.
    """
    left, left_keys = _keyed(build, build_keys, "1")
    right, right_keys = _keyed(probe, probe_keys, "2")
    if len(left_keys) != len(right_keys):
        raise ValueError("build and probe need as many keys")
    if duplicates == "last":
        if order is None:
            raise ValueError("duplicates='last' needs an order, for rows have none of their own")
        by = F.struct(*[F.col(f"_1.{o}") if isinstance(o, str) else o for o in ([order] if isinstance(order, str | Column) else order)])
        left = left.groupBy(*left_keys).agg(F.max_by("_1", by).alias("_1"))
    elif duplicates != "all":
        raise ValueError(f"duplicates={duplicates!r}")
    if hint:
        left = left.hint(hint)
    pairs = zip(left_keys, right_keys, strict=True)
    on = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) if null_equal else F.col(a) == F.col(b) for a, b in pairs])
    return left.join(right, on, "inner").select("_1", "_2")


def merge_join(build: DataFrame, probe: DataFrame, build_keys: Keys, probe_keys: Keys) -> DataFrame:
    """The same join with sorted inputs merged."""
    return hash_join(build, probe, build_keys, probe_keys, hint="merge")
