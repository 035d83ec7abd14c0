"""Keyed state: upserts, and updates of keys that exist."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from weirflow.schema import Keys, listed
from weirflow.shared import ship


def upsert(state: DataFrame | None, changes: DataFrame, keys: list[str] | str, order: Keys) -> DataFrame:
    """The last record of each key by `order` (a column or columns of changes); records of the state come before all changes."""
    by = listed(order) if not isinstance(order, Column) else [order]
    rank = F.struct(F.lit(1).alias("_new"), *[F.col(o) if isinstance(o, str) else o for o in by])
    record = F.struct(*[F.col(f"`{c}`") for c in changes.columns])
    ranked = changes.select(record.alias("_r"), rank.alias("_o"))
    if state is not None:
        same = state.select(*changes.columns)
        old = F.struct(F.lit(0).alias("_new"), *[F.col(o) if isinstance(o, str) else o for o in by])
        ranked = same.select(F.struct(*[F.col(f"`{c}`") for c in changes.columns]).alias("_r"), old.alias("_o")).unionByName(ranked)
    return ranked.groupBy(*[F.col(f"_r.{k}").alias(f"_k_{k}") for k in listed(keys)]).agg(F.max_by("_r", "_o").alias("_r")).select("_r.*")


def update_existing(state: DataFrame, changes: DataFrame, keys: list[str] | str, value: str, change: str, step: Callable[[object, object], object], order: Keys) -> DataFrame:
    """The state after each key's changes, in order: new = step(old, change), where None keeps the old value. Unknown keys are ignored.

    step is a Python function. State and changes are dealt by key in one shuffle and streamed, the state first, so a
    key with any number of changes needs the memory of one batch. A key with several records has each one updated.
    """
    ship(state.sparkSession)
    own = listed(keys)
    by = [F.col(o) if isinstance(o, str) else o for o in ([order] if isinstance(order, str | Column) else order)]
    names, marks = [f"_k{i}" for i in range(len(own))], [f"_o{i}" for i in range(len(by))]
    kinds = [f.dataType for f in changes.select(*by, F.col(change)).schema]
    record = F.struct(*[F.col(f"`{c}`") for c in state.columns])
    held = state.select(*[F.col(k).alias(n) for k, n in zip(own, names, strict=True)], F.lit(0).alias("_what"), *[F.lit(None).cast(t).alias(n) for t, n in zip(kinds, marks, strict=False)], record.alias("_state"), F.lit(None).cast(kinds[-1]).alias("_change"))
    record_kind = held.schema["_state"].dataType
    new = changes.select(*[F.col(k).alias(n) for k, n in zip(own, names, strict=True)], F.lit(1).alias("_what"), *[c.alias(n) for c, n in zip(by, marks, strict=True)], F.lit(None).cast(record_kind).alias("_state"), F.col(change).alias("_change"))
    dealt = held.unionByName(new).repartition(*names).sortWithinPartitions(*names, "_what", *marks).select(*names, "_what", "_state", "_change")
    arrow = to_arrow_schema(state.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, records, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[n] for n in names)
                if key != now:
                    out += records
                    now, records = key, []
                if row["_what"] == 0:
                    records.append(row["_state"])
                elif None not in key:
                    for r in records:
                        fresh = step(r[value], row["_change"])
                        r[value] = r[value] if fresh is None else fresh
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
            out = []
        yield pa.RecordBatch.from_pylist(records, schema=arrow)

    return dealt.mapInArrow(run, state.schema)
