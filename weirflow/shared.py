"""What a cluster's machines share: the folder for intermediate data, and this package's code."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share.

    Where it is unset, a session in one process gets a temporary folder; a cluster is refused, for its
    machines can't read each other's folders.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="weirflow-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/weirflow-{name}-{uuid.uuid4().hex[:12]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, now, which cuts its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_weirflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = os.path.join(tempfile.mkdtemp(), "weirflow_package.zip")  # the driver's own copy; Spark sends it
    Path(path).write_bytes(buffer.getvalue())
    sc.addPyFile(path)
    sc._weirflow_shipped = True
