"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """A table of a directory of Parquet tables."""
    return read_parquet(spark, f"{directory}/{name}.parquet", *columns)
