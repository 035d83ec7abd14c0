"""Complete workloads: the least record per key, and k-means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions import squared_distance
from weirflow.operators.aggregate import min_record_by
from weirflow.shared import checkpointed


def least_record_per_key(df: DataFrame, key: str, value: str, *ties: str) -> DataFrame:
    """The record with the least value of each key; the earlier one by `ties` among equals."""
    return min_record_by(df, key, value, *ties)


def nearest(points: DataFrame, centroids: DataFrame, dimensions: list[str], cluster: str = "cluster", most: int = 100_000) -> DataFrame:
    """points with the cluster of the nearest centroid, the smaller id among equals. Centroids become one value, at most `most` (checked)."""
    fields = F.struct(F.col(cluster).alias("id"), *[F.col(d).alias(f"c_{d}") for d in dimensions])
    listed = centroids.limit(most + 1).agg(F.array_sort(F.collect_list(fields)).alias("_centroids"))
    all_centroids = listed.select(F.when(F.size("_centroids") <= most, F.col("_centroids")).otherwise(F.raise_error(F.lit(f"more than {most} centroids"))))

    def distance(c: Column) -> Column:
        return F.struct(squared_distance([F.col(d) for d in dimensions], [c[f"c_{d}"] for d in dimensions]).alias("d"), c["id"].alias("id"))

    best = F.array_min(F.transform("_centroids", distance))
    return points.drop(cluster).withColumn("_centroids", all_centroids.scalar()).withColumn(cluster, best["id"]).drop("_centroids")


def k_means(points: DataFrame, centroids: DataFrame, dimensions: list[str], updates: int = 4, epsilon: float = 1e-4, cluster: str = "cluster") -> tuple[DataFrame, DataFrame]:
    """(points with clusters, centroids) after at most `updates` updates; a cluster without points keeps its centroid.

    Stops when no coordinate moves by more than epsilon. Centroids are few by nature: they are what a client passes in.
    """
    now = checkpointed(centroids.select(cluster, *[F.col(d).cast("double").alias(d) for d in dimensions]))
    for _ in range(updates):
        means = nearest(points, now, dimensions, cluster).groupBy(cluster).agg(*[F.avg(d).alias(f"_m_{d}") for d in dimensions])
        moved = now.join(means, cluster, "left").select(cluster, *[F.coalesce(f"_m_{d}", d).alias(d) for d in dimensions], F.greatest(*[F.abs(F.coalesce(f"_m_{d}", d) - F.col(d)) for d in dimensions], F.lit(0.0)).alias("_change"))
        moved = checkpointed(moved)
        change = moved.agg(F.max("_change")).first()[0] or 0.0
        now = moved.drop("_change")
        if change <= epsilon:
            break
    return nearest(points, now, dimensions, cluster), now


def first_rows(df: DataFrame, order: str, k: int) -> DataFrame:
    """The first k rows with their numbers from 0, in column `cluster`: seeds."""
    return df.orderBy(order).limit(k).withColumn("cluster", F.row_number().over(Window.orderBy(order)) - 1)
