"""Parquet tables by name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a folder, as `<name>.parquet` (a file or a directory of parts)."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """The rows of a plain scan over all cores, where the files are too few to keep half of them busy; else the scan itself.

    For work that takes long a row. A large table has more splits than cores, and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Each table as a temporary view of its name."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
