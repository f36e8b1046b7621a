"""Table-level helpers: weights, column types, index-like columns, column order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the integer types and what they hold
INTEGERS = (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31), ("bigint", 2**63))


def trim_low_weights(df: DataFrame, threshold: float | None, column: str = "weight") -> DataFrame:
    """Rows above the threshold; all rows if there is no threshold or no such column."""
    if not threshold or column not in df.columns:
        return df
    return df.where(F.col(column) > threshold)


def smallest_types(df: DataFrame) -> DataFrame:
    """(column, stored, smallest, distinct_share): the smallest type that holds the values of each column, in one pass.

    Integers become the smallest integer type, doubles without fractions an integer type, other doubles float;
    distinct_share tells whether a dictionary would pay. Nothing is changed; see `downcast`.
    """
    plain = [(c, t) for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double", "string")]
    aggs = []
    for c, t in plain:
        x = F.col(f"`{c}`")
        if t == "string":
            aggs += [F.lit(None).cast("double").alias(f"lo_{c}"), F.lit(None).cast("double").alias(f"hi_{c}"), F.lit(False).alias(f"whole_{c}")]
        else:
            aggs += [F.min(x).cast("double").alias(f"lo_{c}"), F.max(x).cast("double").alias(f"hi_{c}"), F.bool_and(x == F.floor(x)).alias(f"whole_{c}")]
        aggs.append((F.count_distinct(x) / F.count("*")).alias(f"share_{c}"))
    stats = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("stored"), F.col(f"`lo_{c}`").alias("lo"), F.col(f"`hi_{c}`").alias("hi"), F.col(f"`whole_{c}`").alias("whole"), F.col(f"`share_{c}`").alias("distinct_share")) for c, t in plain]
    long = stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    best = F.when(F.col("stored") == "string", "string").when(~F.coalesce("whole", F.lit(False)), "float")
    for name, limit in INTEGERS:
        best = best.when((F.col("lo") >= -float(limit)) & (F.col("hi") < float(limit)), name)
    return long.select("column", "stored", best.otherwise("double").alias("smallest"), F.round("distinct_share", 6).alias("distinct_share"))


def downcast(df: DataFrame) -> DataFrame:
    """df with its columns cast to the smallest types, as far as they are numbers."""
    best = {r["column"]: r["smallest"] for r in smallest_types(df).collect()}
    return df.select(*[F.col(f"`{c}`").cast(best.get(c, t)).alias(c) for c, t in df.dtypes])


def index_like_columns(df: DataFrame, row: str) -> DataFrame:
    """(column): integer columns that equal the row number in every row."""
    others = [c for c, t in df.dtypes if c != row and t in ("tinyint", "smallint", "int", "bigint")]
    if not others:
        return df.sparkSession.createDataFrame([], "column string")
    same = df.agg(*[F.coalesce(F.bool_and(F.col(f"`{c}`").eqNullSafe(F.col(row))), F.lit(False)).alias(c) for c in others])
    return same.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("same")) for c in others])).alias("r")).where("r.same").select("r.column")


def move_column(df: DataFrame, name: str, position: int) -> DataFrame:
    names = [c for c in df.columns if c != name]
    names.insert(position, name)
    return df.select(*[f"`{c}`" for c in names])
