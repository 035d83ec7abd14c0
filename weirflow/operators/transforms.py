"""Map, flat-map, filter and whole partitions. Expressions stay in the JVM; Python functions get Arrow batches.

A Python function may be a lifecycle.Function: it is created once per task with the environment, and released.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from weirflow.functions.lifecycle import Environment, opened
from weirflow.shared import ship

Batch = pa.RecordBatch


def map_rows(df: DataFrame, *exprs: Column | str, function: Callable | None = None, schema: str | None = None, environment: Environment | None = None) -> DataFrame:
    """One row out for each row in: by expressions, or by a Python function of a row (a dict) that returns a tuple."""
    if function is None:
        return df.select(*[F.expr(e) if isinstance(e, str) else e for e in exprs])
    return _python(df, function, schema, environment, one=True)


def flat_map(df: DataFrame, rows: Column | None = None, function: Callable | None = None, schema: str | None = None, environment: Environment | None = None) -> DataFrame:
    """Any number of rows for each row: an array of structs (or of values, as column `value`), or a Python function of a row that yields tuples."""
    if rows is not None:
        made = df.select(rows.alias("_rows"))
        kind = made.schema["_rows"].dataType.elementType
        return made.select(F.inline("_rows")) if kind.typeName() == "struct" else made.select(F.explode("_rows").alias("value"))
    if function is None or schema is None:
        raise ValueError("flat_map needs an array column, or a function and its schema")
    return _python(df, function, schema, environment, one=False)


def _python(df: DataFrame, function: Callable, schema: str, environment: Environment | None, one: bool) -> DataFrame:
    ship(df.sparkSession)
    target = _parse_datatype_string(schema)
    arrow = to_arrow_schema(target)
    names = [f.name for f in target]

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        with opened(function, environment) as own:
            for batch in batches:
                found = [dict(zip(names, out, strict=True)) for row in batch.to_pylist() for out in ((own(row),) if one else own(row))]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return df.mapInArrow(run, target)


def filter_rows(df: DataFrame, condition: Column | str | None = None, function: Callable | None = None, environment: Environment | None = None) -> DataFrame:
    """The rows for which the condition is true; a null is not."""
    if function is None:
        return df.filter(condition)
    ship(df.sparkSession)

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        with opened(function, environment) as own:
            for batch in batches:
                yield batch.filter(pa.array([own(row) is True for row in batch.to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def map_partitions(df: DataFrame, function: Callable[[Iterator[Batch]], Iterator[Batch]], schema: str, environment: Environment | None = None) -> DataFrame:
    """A whole task in Python: the function gets a partition's Arrow batches and yields batches of the schema."""
    ship(df.sparkSession)

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        with opened(function, environment) as own:
            yield from own(batches)

    return df.mapInArrow(run, _parse_datatype_string(schema))


def map_with_broadcast(df: DataFrame, variable: DataFrame, *exprs: Column | str, collection: str | None = None, most_rows: int = 1_000_000) -> DataFrame:
    """Maps with a broadcast variable that the expressions may use.

    By default the variable has one row (nulls where it has none, an error where it has more), and its columns are
    used by name. With `collection`, all its rows, at most `most_rows` (checked), are an array of structs of that name.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in variable.columns])
    if collection is None:
        one = variable.select(record.alias("_v")).limit(2).scalar()  # a second row is an error
        with_variable = df.withColumn("_v", one).select(*[F.col(f"`{c}`") for c in df.columns], "_v.*")
    else:
        rows = variable.limit(most_rows + 1).agg(F.collect_list(record).alias("_v"))
        bound = F.when(F.size("_v") <= most_rows, F.col("_v")).otherwise(F.raise_error(F.lit(f"a collection of more than {most_rows} rows")))
        with_variable = df.withColumn(collection, rows.select(bound).scalar())
    return with_variable.select(*[F.expr(e) if isinstance(e, str) else e for e in exprs])
