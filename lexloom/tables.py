"""The tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``.

    One that comes in so few pieces that half of all cores would stay idle is spread over them, which moves a small file;
    filters and columns still reach the scan.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if 0 < 2 * rows.rdd.getNumPartitions() <= cores else rows
