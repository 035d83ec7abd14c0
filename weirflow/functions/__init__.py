"""Functions of collections. Positions count from 0; -1 means not there. A null collection gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _v(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def size(collection: Column | str) -> Column:
    return F.when(_c(collection).isNotNull(), F.size(_c(collection)))


def is_empty(collection: Column | str) -> Column:
    return size(collection) == 0


def contains(items: Column | str, value: object) -> Column:
    return F.array_contains(_c(items), _v(value))


def contains_all(items: Column | str, others: Column | str) -> Column:
    return F.size(F.array_except(_c(others), _c(items))) == 0


def get(items: Column | str, index: object) -> Column:
    """The item at a position; null outside."""
    return F.get(_c(items), _v(index))


def index_of(items: Column | str, value: object) -> Column:
    return (F.array_position(_c(items), _v(value)) - 1).cast("int")


def last_index_of(items: Column | str, value: object) -> Column:
    back = F.array_position(F.reverse(_c(items)), _v(value))
    return F.when(back == 0, -1).otherwise(F.size(_c(items)) - back).cast("int")


def as_set(items: Column | str) -> Column:
    return F.array_distinct(_c(items))


def contains_key(entries: Column | str, key: object) -> Column:
    return F.map_contains_key(_c(entries), key)


def contains_value(entries: Column | str, value: object) -> Column:
    return F.array_contains(F.map_values(_c(entries)), _v(value))


def value_of(entries: Column | str, key: object) -> Column:
    return F.try_element_at(_c(entries), _v(key))


def keys(entries: Column | str) -> Column:
    return F.map_keys(_c(entries))


def values(entries: Column | str) -> Column:
    return F.map_values(_c(entries))


def entries(of: Column | str) -> Column:
    return F.map_entries(_c(of))


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    """The squared Euclidean distance of two points."""
    out = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        out = out + (x - y) * (x - y)
    return out
