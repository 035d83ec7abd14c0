"""Records as rows: positional names, dotted paths as keys, schemas from sample objects."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Keys = str | Column | Sequence[str | Column]

#: Python types as Spark types.
_TYPES = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType()}


def columns(keys: Keys) -> list[Column]:
    """Keys as columns; a string is a name or a dotted path such as "_1._2"."""
    if isinstance(keys, str | Column):
        keys = [keys]
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def positional(df: DataFrame) -> DataFrame:
    """df with its columns named _1 to _N."""
    return df.toDF(*[f"_{i}" for i in range(1, len(df.columns) + 1)])


def record(df: DataFrame, alias: str) -> Column:
    """All columns of df as one struct."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(alias)


def flattened(df: DataFrame, *structs: str, separator: str = "_") -> DataFrame:
    """df with the named struct columns (all, by default) spread into columns, struct name first."""
    wanted = structs or tuple(f.name for f in df.schema if isinstance(f.dataType, T.StructType))
    out: list[Column] = []
    for f in df.schema:
        if f.name in wanted and isinstance(f.dataType, T.StructType):
            out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{separator}{g.name}") for g in f.dataType]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def inferred(sample: object) -> T.DataType:
    """The Spark type of a sample: primitives, tuples (fields _1 to _N), dicts, lists, sets and dataclasses, nested."""
    for kind, out in _TYPES.items():
        if type(sample) is kind:
            return out
    if dataclasses.is_dataclass(sample):
        return T.StructType([T.StructField(f.name, inferred(getattr(sample, f.name))) for f in dataclasses.fields(sample)])
    if isinstance(sample, tuple) and hasattr(sample, "_fields"):
        return T.StructType([T.StructField(n, inferred(v)) for n, v in zip(sample._fields, sample, strict=True)])
    if isinstance(sample, tuple):
        return T.StructType([T.StructField(f"_{i}", inferred(v)) for i, v in enumerate(sample, 1)])
    if isinstance(sample, dict) and sample:
        key, value = next(iter(sample.items()))
        return T.MapType(inferred(key), inferred(value))
    if isinstance(sample, list | set | frozenset) and sample:
        return T.ArrayType(inferred(next(iter(sample))))
    raise TypeError(f"no type can be inferred from {sample!r}")


def same_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """b with its columns in a's order and under a's names, by position."""
    if len(a.columns) != len(b.columns):
        raise ValueError(f"{len(a.columns)} columns against {len(b.columns)}")
    return b.toDF(*a.columns)


def listed(keys: Iterable[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)
