"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.shared import fresh_path, shared_dir, ship

__all__ = ["dropped", "fits", "hold", "joined_once", "raw_texts", "shared_dir", "ship", "strings", "text_of", "text_runs", "tidied", "word_runs", "words", "written"]

_SPACE = b" \t\n\x0b\x0c\r"


def words(data: bytes) -> list[bytes]:
    """The words of a UTF-8 text: A-Z lower-cased, split at space and \\x09-\\x0D, which is what bytes know as case and white space."""
    return data.lower().split()


def text_runs(data: bytes, most: int = 4_000_000) -> Iterator[bytes]:
    """A text in turn in pieces of about `most` bytes that end where words do, so that a text of any length needs bounded memory."""
    at = 0
    while len(data) - at > most:
        cut = at + most
        while cut < len(data) and data[cut] not in _SPACE:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_runs(data: bytes, most: int = 4_000_000) -> Iterator[list[bytes]]:
    """The words of a text in turn, in lists of about `most` bytes of text."""
    return map(words, text_runs(data, most))


_HELD: dict[str, object] = {}


def hold(name: str, release=None) -> None:
    """Called where a Python worker starts an operator: what other operators kept in this worker is let go of."""
    for other in [k for k in _HELD if k != name]:
        if free := _HELD.pop(other):
            free()
    _HELD[name] = release


def _trim() -> None:
    """Gives memory that is free back to the machine: idle workers count to an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(name: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], release=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run as a task that starts without what other operators kept in the worker, and ends without spare memory."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(name, release)
        try:
            yield from run(batches)
        finally:
            _trim()

    return tidy


_CLEANING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage is cut, executors can be lost.

    Shuffle files of the write go as it ends; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(_CLEANING, "false")
    spark.conf.set(_CLEANING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANING, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._weirflow_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._weirflow_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fits(df: DataFrame, most: int) -> bool:
    """Whether a written table has at most that many rows."""
    return df.count() <= most


def joined_once(big: DataFrame, small: DataFrame, on: list[str] | str, few: int = 1_000_000, heavy: int = 100_000) -> DataFrame:
    """big joined with small, whose keys are unique, without a hot key in one task. Both are written tables.

    A small side of at most `few` rows (counted) is broadcast. Beyond, the keys that have more than 1/heavy of big's
    rows, of which there are fewer than `heavy`, are broadcast, and all others are shuffled.
    """
    if fits(small, few):
        return big.join(F.broadcast(small), on)
    keys = [on] if isinstance(on, str) else on
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(written(counts.where(F.col("_n") > big.count() / heavy).select(*keys), "hot"))
    return big.join(F.broadcast(small.join(hot, keys, "left_semi")), keys).unionByName(big.join(hot, keys, "left_anti").join(small, keys))


def text_of(column: str = "text"):
    """The text, empty where null."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow column of strings, empty where null."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column, empty where null."""
    return ["" if x is None else x for x in column.to_pylist()]
