"""Sources and sinks: Parquet, delimited text, generators, collections; foreach and dataset sinks."""

from weirflow.sources.delimited import read_csv, write_csv
from weirflow.sources.generator import generate, register_generator
from weirflow.sources.sinks import foreach, write_parquet
from weirflow.sources.tables import read_parquet, table

__all__ = ["foreach", "generate", "read_csv", "read_parquet", "register_generator", "table", "write_csv", "write_parquet"]
