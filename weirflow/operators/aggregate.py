"""Folds, run grouping and grouped maps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from weirflow.functions.lifecycle import Environment, opened
from weirflow.schema import Keys, columns
from weirflow.shared import checkpointed, ship


def fold(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row with the aggregates of all rows; none if there are no rows."""
    return df.groupBy(F.lit(1).alias("_all")).agg(*aggregates).drop("_all")


def hash_fold(df: DataFrame, keys: Keys | None, *aggregates: Column, emit_keys: bool = True) -> DataFrame:
    """A row per key; partial sums are made before the shuffle. Without keys, fold()."""
    if keys is None:
        return fold(df, *aggregates)
    own = columns(keys)
    out = df.groupBy(*own).agg(*aggregates)
    return out if emit_keys else out.select(*out.columns[len(own) :])


@dataclass(frozen=True)
class Monoid:
    """A fold as three functions of Python values; union must be associative and commutative."""

    empty: Callable[[], object]
    singleton: Callable[[dict], object]
    union: Callable[[object, object], object]


def monoid(df: DataFrame, keys: Keys, fold_of: Monoid, schema: str, finish: Callable[[object], tuple] | None = None) -> DataFrame:
    """Folds by Python functions in two phases: each partition folds its rows by key, then partial values meet by key.

    The value that folds must be picklable; it crosses the shuffle in binary form. A key's rows never meet in one
    place, only its partial values, one from each partition. finish makes the output row (a tuple) of a value.
    """
    import pickle

    ship(df.sparkSession)
    own = [c.alias(f"_k{i}") for i, c in enumerate(columns(keys))]
    names = [f"_k{i}" for i in range(len(own))]
    keyed = df.select(*own, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_record"))
    middle = ", ".join(f"{n} {keyed.schema[n].dataType.simpleString()}" for n in names) + ", _value binary"
    middle_arrow = to_arrow_schema(_parse_datatype_string(middle))
    target = _parse_datatype_string(schema)
    target_arrow = to_arrow_schema(target)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: dict[tuple, object] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**dict(zip(names, k, strict=True)), "_value": pickle.dumps(v)} for k, v in values.items()], schema=middle_arrow)

        for batch in batches:
            for row in batch.to_pylist():
                k = tuple(row[n] for n in names)
                values[k] = fold_of.union(values[k] if k in values else fold_of.empty(), fold_of.singleton(row["_record"]))
            if len(values) > 100_000:  # bounded: partial values may repeat a key
                yield out()
                values.clear()
        yield out()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        value: object = None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                k = tuple(row[n] for n in names)
                if k != now:
                    if now is not None:
                        rows.append((now, value))
                    now, value = k, fold_of.empty()
                value = fold_of.union(value, pickle.loads(row["_value"]))  # noqa: S301  written by partial() above
            yield made(rows)
        if now is not None:
            yield made([(now, value)])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        out = [(*k, *(finish(v) if finish else (v,))) for k, v in rows]
        return pa.RecordBatch.from_pylist([dict(zip(target.names, r, strict=True)) for r in out], schema=target_arrow)

    return keyed.mapInArrow(partial, middle).repartition(*names).sortWithinPartitions(*names).mapInArrow(final, target)


def fold_ordered(df: DataFrame, keys: Keys, order: Keys, zero: object, step: Callable[[object, dict], object], schema: str, finish: Callable[[object], tuple] | None = None) -> DataFrame:
    """An ordered fold per key: value = step(value, row) over the rows (dicts) of a key in order, for folds that no two phases can make.

    One row per key: its key and the value (a tuple, by finish). Rows are streamed, so a key of any size needs the
    memory of one batch; the steps of one key run one after another in one task, which is their nature.
    """
    own = columns(keys)
    names = [f"_f{i}" for i in range(len(own))]

    def folded(rows: Iterable[dict]) -> list[tuple]:
        value, key = zero, ()
        for row in rows:
            key = tuple(row.pop(n) for n in names)
            value = step(value, row)
        return [(*key, *(finish(value) if finish else (value,)))]

    return map_group(df.select("*", *[c.alias(n) for c, n in zip(own, names, strict=True)]), keys, folded, schema, order)


def group_runs(df: DataFrame, order: Keys, keys: Keys, *aggregates: Column, partition_by: Keys | None = None) -> DataFrame:
    """A row per run of equal keys among rows in order: the keys, run (a number within partition_by) and the aggregates.

    Without partition_by the order is global: rows are ranged over all partitions and numbered there, and that is
    written to the shared folder, now, as partitions and numbers must be the same wherever they are read; then one row
    per partition meets in one place and says where its runs begin. Rows that tie in `order` keep one order, whichever.
    """
    own = columns(keys)
    key = F.struct(*own)
    if partition_by is not None:
        parts = columns(partition_by)
        window = Window.partitionBy(*parts).orderBy(*columns(order))
        new = F.when(F.row_number().over(window) == 1, 1).when(F.lag(key).over(window).eqNullSafe(key), 0).otherwise(1)
        marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*parts, *own, "run").agg(*aggregates)
    ranged = df.repartitionByRange(*columns(order)).withColumn("_part", F.spark_partition_id())
    window = Window.partitionBy("_part").orderBy(*columns(order))
    marked = ranged.withColumn("_key", key).withColumn("_at", F.row_number().over(window)).withColumn("_same", (F.col("_at") > 1) & F.lag("_key").over(window).eqNullSafe(F.col("_key")))
    numbered = marked.withColumn("_run", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    held = checkpointed(numbered.drop("_same"))
    # One row per partition: its number of runs, first and last key.
    ends = held.groupBy("_part").agg(F.max("_run").alias("runs"), F.min_by("_key", "_at").alias("first"), F.max_by("_key", "_at").alias("last"))
    line = Window.orderBy("_part")
    joined = (F.row_number().over(line) > 1) & F.lag("last").over(line).eqNullSafe(F.col("first"))
    before = F.coalesce(F.sum("runs").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = ends.withColumn("_joined", F.when(joined, 1).otherwise(0)).withColumn("_base", before - F.sum("_joined").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    placed = held.join(F.broadcast(base.select("_part", "_base")), "_part").withColumn("run", F.col("_run") + F.col("_base"))
    return placed.groupBy(*own, "run").agg(*aggregates)


def map_group(df: DataFrame, keys: Keys, function: Callable[[Iterable[dict]], Iterable[tuple]], schema: str, order: Keys | None = None, environment: Environment | None = None) -> DataFrame:
    """A Python function over the rows of each key (an iterator of dicts, in order), which yields tuples.

    Rows are streamed: a group of any size needs the memory of one batch, unless the function keeps its rows.
    """
    ship(df.sparkSession)
    own = columns(keys)
    names = [f"_g{i}" for i in range(len(own))]
    target = _parse_datatype_string(schema)
    arrow = to_arrow_schema(target)
    dealt = df.select("*", *[c.alias(n) for c, n in zip(own, names, strict=True)]).repartition(*names).sortWithinPartitions(*names, *(columns(order) if order is not None else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = (row for batch in batches for row in batch.to_pylist())
        out: list[dict] = []
        with opened(function, environment) as made_by:
            for _, group in groupby(rows, key=lambda r: tuple(r[n] for n in names)):
                for made in made_by({c: v for c, v in r.items() if c not in names} for r in group):
                    out.append(dict(zip(target.names, made, strict=True)))
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.mapInArrow(run, target)


def min_record_by(df: DataFrame, keys: Keys, value: Column | str, *ties: Column | str) -> DataFrame:
    """The whole record with the least value of each key; ties decide among equals, then the record itself."""
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    by = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in (value, *ties)], record)
    return df.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(columns(keys))]).agg(F.min_by(record, by).alias("_r")).select("_r.*")
