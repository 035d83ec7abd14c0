"""A session: named datasets that outlive a query, references, mutable datasets and broadcast collections."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.state import update_existing, upsert

IMMUTABLE, SERIALIZED, REFERENCE, MUTABLE = "immutable", "serialized", "reference", "mutable"


@dataclass
class _Entry:
    kind: str
    frame: DataFrame | None
    reads_left: int | None = None
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()


class Session:
    """Holds what a client keeps between queries. Stored frames are persisted and spill to disk; lost parts are computed again."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._entries: dict[str, _Entry] = {}
        self._broadcasts: dict[str, DataFrame] = {}

    # -- datasets -----------------------------------------------------------
    def store(self, name: str, df: DataFrame, reads: int | None = None, serialized: bool = False) -> DataFrame:
        """Stores rows under a name, now. After `reads` reads the dataset is erased."""
        self.erase(name, missing_ok=True)
        held = df.persist(StorageLevel.DISK_ONLY if serialized else StorageLevel.MEMORY_AND_DISK)
        held.count()
        self._entries[name] = _Entry(SERIALIZED if serialized else IMMUTABLE, held, reads)
        return held

    def read(self, name: str) -> DataFrame:
        """The rows of a dataset; counts as one read."""
        entry = self._entry(name)
        if entry.frame is None:
            raise ValueError(f"nothing is assigned to {name!r}")
        if entry.reads_left is not None:
            if entry.reads_left == 0:
                raise KeyError(f"{name!r} has been read as often as it may")
            entry.reads_left -= 1
        return entry.frame

    def gather(self, name: str) -> list:
        """All rows of a dataset, to the client."""
        if self._entry(name).kind == SERIALIZED:
            raise ValueError("a serialized dataset is read by queries only")
        return self.read(name).collect()

    def reference(self, name: str) -> None:
        """A name to which datasets are assigned."""
        self._entries[name] = _Entry(REFERENCE, None)

    def assign(self, target: str, source: str | DataFrame) -> DataFrame:
        """Binds a reference to what a dataset (or frame) holds now."""
        entry = self._entry(target)
        if entry.kind != REFERENCE:
            raise ValueError(f"{target!r} is not a reference")
        entry.frame = source if isinstance(source, DataFrame) else self._entry(source).frame
        return entry.frame

    def mutable(self, name: str, keys: Iterable[str], order: Iterable[str], df: DataFrame | None = None) -> None:
        """A dataset with one record per key, the last by `order`."""
        self._entries[name] = _Entry(MUTABLE, None, None, tuple(keys), tuple(order))
        if df is not None:
            self.add(name, df)

    def add(self, name: str, changes: DataFrame) -> DataFrame:
        """Puts records into a mutable dataset, over those of the same keys."""
        entry = self._mutable(name)
        return self._replace(entry, upsert(entry.frame, changes, list(entry.keys), list(entry.order)))

    def update(self, name: str, changes: DataFrame, value: str, change: str, step, order: str) -> DataFrame:
        """Updates the records of a mutable dataset whose keys exist, and passes the changes through."""
        entry = self._mutable(name)
        self._replace(entry, update_existing(entry.frame, changes, list(entry.keys), value, change, step, order))
        return changes

    def erase(self, name: str, missing_ok: bool = False) -> None:
        """Frees a dataset."""
        entry = self._entries.pop(name, None)
        if entry is None and not missing_ok:
            raise KeyError(name)
        if entry is not None and entry.frame is not None and entry.kind != REFERENCE:
            entry.frame.unpersist()

    def datasets(self) -> dict[str, str]:
        """Names and kinds."""
        return {n: e.kind for n, e in self._entries.items()}

    def _entry(self, name: str) -> _Entry:
        if name not in self._entries:
            raise KeyError(f"no dataset {name!r}")
        return self._entries[name]

    def _mutable(self, name: str) -> _Entry:
        entry = self._entry(name)
        if entry.kind != MUTABLE:
            raise ValueError(f"{name!r} is not a mutable dataset")
        return entry

    def _replace(self, entry: _Entry, df: DataFrame) -> DataFrame:
        fresh = df.persist(StorageLevel.MEMORY_AND_DISK)
        fresh.count()
        if entry.frame is not None:
            entry.frame.unpersist()
        entry.frame = fresh
        return fresh

    # -- broadcast collections ----------------------------------------------
    def broadcast(self, rows: Iterable, schema: str, name: str | None = None, most_rows: int = 1_000_000) -> str:
        """A client's collection of at most `most_rows` rows, for maps on all machines; gives its name."""
        name = name or str(uuid.uuid4())
        own = list(islice(rows, most_rows + 1))
        if len(own) > most_rows:
            raise ValueError(f"a collection of more than {most_rows} rows; write it as a table")
        self._broadcasts[name] = F.broadcast(self.spark.createDataFrame(own, schema))
        return name

    def broadcasted(self, name: str) -> DataFrame:
        return self._broadcasts[name]

    # -- cluster -------------------------------------------------------------
    def utilization(self) -> dict[str, int]:
        """Slots, and the jobs and stages that run now."""
        sc = self.spark.sparkContext
        tracker = sc.statusTracker()
        return {"slots": sc.defaultParallelism, "active_jobs": len(tracker.getActiveJobsIds()), "active_stages": len(tracker.getActiveStageIds())}

    def close(self) -> None:
        for name in list(self._entries):
            self.erase(name)
        self._broadcasts.clear()
