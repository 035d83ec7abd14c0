"""Generators as sources: a function that yields rows, run once per replica."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType, _parse_datatype_string


def generate(spark: SparkSession, produce: Callable[[], Iterable[tuple]], schema: str, replicas: int = 1) -> DataFrame:
    """The rows of produce(), which runs once in each of `replicas` tasks: every row comes `replicas` times."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = _parse_datatype_string(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for _ in range(batch.num_rows):
                rows: list[dict] = []
                for row in produce():
                    rows.append(dict(zip(target.names, row, strict=True)))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.range(0, replicas, 1, replicas).mapInArrow(run, target)


class _Part(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, produce: Callable[[], object | None], replicas: int):
        self.produce, self.replicas = produce, replicas

    def partitions(self) -> list[InputPartition]:
        return [_Part(i) for i in range(self.replicas)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        # Until it gives None: the end of the stream.
        source = self.produce()
        while (row := source()) is not None:
            yield row


def register_generator(spark: SparkSession, name: str, schema: str, make: Callable[[], Callable[[], tuple | None]]) -> None:
    """A source spark.read.format(name), option "replicas": each task calls make() once, then the result until it gives None."""
    own, kind = make, schema

    class Generator(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str | StructType:
            return kind

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(own, int(self.options.get("replicas", 1)))

    spark.dataSource.register(Generator)
