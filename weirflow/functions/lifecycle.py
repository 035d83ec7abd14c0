"""The life of a Python function in a task: created with an environment, called for each row, released."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from weirflow.shared import ship


class Function:
    """Base of functions that need set-up per task. Subclasses define __call__; one copy lives in each task."""

    def create(self, environment: Environment) -> None:
        """Called once in a task, before the first row."""

    def release(self) -> None:
        """Called once in a task, after the last row or an error."""


@dataclass
class Environment:
    """What functions may read: properties, and named collections that are broadcast to all machines."""

    properties: dict[str, object] = field(default_factory=dict)
    collections: dict[str, object] = field(default_factory=dict)

    def property(self, name: str, default: object = None) -> object:
        return self.properties.get(name, default)

    def collection(self, name: str) -> list[dict]:
        """The rows of a broadcast collection; sort them where order matters."""
        if name not in self.collections:
            raise KeyError(f"no collection {name!r}")
        return self.collections[name].value

    @staticmethod
    def task() -> int:
        """The number of the task's partition."""
        from pyspark import TaskContext

        context = TaskContext.get()
        return context.partitionId() if context else 0


def environment(spark: SparkSession, properties: dict[str, object] | None = None, most_rows: int = 1_000_000, **collections: DataFrame) -> Environment:
    """An environment for functions on the executors; each collection of at most `most_rows` rows (checked) is broadcast whole."""
    ship(spark)
    sent = {}
    for name, df in collections.items():
        rows = [r.asDict(recursive=True) for r in df.limit(most_rows + 1).collect()]
        if len(rows) > most_rows:
            raise ValueError(f"collection {name!r} has more than {most_rows} rows; join it instead")
        sent[name] = spark.sparkContext.broadcast(rows)
    return Environment(dict(properties or {}), sent)


@contextmanager
def opened(function: Callable, given: Environment | None) -> Iterator[Callable]:
    """The function for one task: created, and released whatever happens. Plain functions pass through."""
    if not isinstance(function, Function):
        yield function
        return
    function.create(given or Environment())
    try:
        yield function
    finally:
        function.release()
