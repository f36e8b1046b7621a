"""The latest of rows that repeat a key, in one scan of the rows and without moving those that don't repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talverk.session import broadcast_if_small


def latest_rows(df: DataFrame, key: str, version: str, spread: DataFrame | None = None) -> DataFrame:
    """df with one row for each key, the one with the latest version; rows with a null key are left out.

    The repeated keys and their latest versions are found from these two columns alone. The other columns are read once:
    rows of an earlier version are dropped by a join with the repeated keys, broadcast as long as they are few (checked),
    by a shuffle beyond that. A null version is earlier than any other. Only of keys whose latest version itself occurs
    more than once are the rows grouped, and the one with the largest values is kept; columns must be orderable then.
    `spread` may hold the same rows over more tasks; they are then taken from it, while keys are counted on df.
    """
    versions = df.select(F.col(key).alias("_key"), F.col(version).alias("_version")).where("_key is not null")
    # max_by would pass over a null version, a struct doesn't
    times = versions.groupBy("_key", "_version").agg(F.count("*").alias("_n"))
    last = times.groupBy("_key").agg(F.sum("_n").alias("_rows"), F.max(F.struct("_version", "_n")).alias("_last"))
    repeated = broadcast_if_small(last.where("_rows > 1").select("_key", F.col("_last._version").alias("_best"), (F.col("_last._n") > 1).alias("_tied")))
    rows = (df if spread is None else spread).where(F.col(key).isNotNull())
    earlier = F.coalesce(F.col(version) < F.col("_best"), F.col("_best").isNotNull())
    if repeated.where("_tied").isEmpty():
        return rows.join(repeated, (rows[key] == F.col("_key")) & earlier, "left_anti")
    once = rows.join(repeated, (rows[key] == F.col("_key")) & (earlier | F.col("_tied")), "left_anti")
    tied = rows.join(repeated.where("_tied"), (rows[key] == F.col("_key")) & ~earlier, "left_semi")
    others = [c for c in df.columns if c not in (key, version)]
    many = tied.groupBy(key).agg(F.max(F.struct(version, *others)).alias("_row"))
    return once.unionByName(many.select(key, "_row.*").select(*df.columns))
