"""Joins that keep an eye on keys and row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talverk.session import broadcast_if_small, materialize


def join_on(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None, *, null_matches: bool = False, drop_key: bool = True) -> DataFrame:
    """Left join on one key; a left row that matches several right rows is repeated. Clashing columns of the right get `_r`."""
    right_key = right_key or key
    taken = set(left.columns)
    names = {c: (f"{c}_r" if c in taken and c != right_key else c) for c in right.columns}
    renamed = right.select(*[F.col(c).alias("_key" if c == right_key else n) for c, n in names.items()])
    same = F.col(key).eqNullSafe(F.col("_key")) if null_matches else F.col(key) == F.col("_key")
    out = left.join(renamed, same, "left")
    return out.drop("_key") if drop_key or right_key in taken else out.withColumnRenamed("_key", right_key)


def fan_out(right: DataFrame, key: str) -> DataFrame:
    """(key, rows) of the keys that would repeat rows of a left side."""
    return right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def with_group_values(df: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """df with the other columns of `groups`, which has a row for each key, a null one too.

    Groups that are few (checked) are broadcast, so that no row of df moves and no group is one task's; others are joined by
    a shuffle, in which a key with very many rows is split at run time.
    """
    named = groups.withColumnRenamed(key, "_key")
    return df.join(broadcast_if_small(named), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def group_total(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with the sum of the value over the row's group; null keys are a group."""
    return with_group_values(df, key, df.groupBy(key).agg(F.sum(value).alias(name)))


def backfill(df: DataFrame, key: str, column: str, lookup: DataFrame, lookup_key: str, lookup_value: str, missing: Column) -> DataFrame:
    """df with the column taken from the lookup where it is missing and the lookup has the key (its smallest value counts)."""
    one = lookup.groupBy(F.col(lookup_key).alias("_key")).agg(F.min(lookup_value).alias("_value"))
    out = df.join(one, F.col(key) == F.col("_key"), "left")
    return out.withColumn(column, F.when(missing, F.coalesce("_value", column)).otherwise(F.col(column))).drop("_key", "_value")


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Left join of the k-th row with the k-th row. Rows have no place in Spark, so both orders are given.

    The numbers are made within ranges of a distributed sort, not in one task.
    """
    a, b = numbered(left, left_order), numbered(right, right_order)
    clash = set(left.columns)
    b = b.select("_place", *[F.col(c).alias(f"{c}_r" if c in clash else c) for c in right.columns])
    return a.join(b, "_place", "left").drop("_place")


def numbered(df: DataFrame, order: list[str], name: str = "_place", rows: int = 1_000_000) -> DataFrame:
    """df with the place of each row from 0 in the order, which must be total; a range of the distributed sort for so many rows."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // rows + 1)
    kept = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = places_before(kept.groupBy("_part").agg(F.count("*").alias("_n")), "_part", "_n")
    own = Window.partitionBy("_part").orderBy(*order)
    return kept.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.row_number().over(own) - 1).drop("_part", "_before")


def places_before(sizes: DataFrame, part: str, size: str, keys: list[str] | None = None) -> DataFrame:
    """(keys…, part, _before): the rows in the parts before; there are as many rows as parts, so that one task may sort them."""
    order = Window.partitionBy(*(keys or [])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*(keys or []), part, F.coalesce(F.sum(size).over(order), F.lit(0)).alias("_before"))


def first_containing(df: DataFrame, name: str, paths: DataFrame, path: str) -> DataFrame:
    """df with `found`, the smallest path that contains the name, null if none does or the name is null or empty.

    A path that contains a name contains each run of three characters of it. Names meet the paths that have the run of
    theirs that is in fewest paths (shorter names: the name itself), and only these are compared.
    """

    def runs(text: str, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(n)))

    def grams(text: str, sizes: tuple[int, ...]) -> Column:
        return F.array_distinct(F.concat(*[runs(text, n) for n in sizes]))

    names = df.select(F.col(name).alias("_name")).where("_name is not null and _name <> ''").distinct()
    there = materialize(paths.select(F.col(path).alias("_path")).where("_path is not null").distinct().select("_path", F.explode(grams("_path", (1, 2, 3))).alias("_gram")))
    often = there.groupBy("_gram").agg(F.count("*").alias("_n"))
    asked = names.select("_name", F.explode(F.when(F.length("_name") < 3, F.array("_name")).otherwise(grams("_name", (3,)))).alias("_gram"))
    rarest = asked.join(often, "_gram", "left").groupBy("_name").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram")).alias("_r")).where("_r._n > 0")
    hits = rarest.select("_name", F.col("_r._gram").alias("_gram")).join(there, "_gram").where(F.contains("_path", F.col("_name"))).groupBy("_name").agg(F.min("_path").alias("found"))
    return df.join(hits, F.col(name) == F.col("_name"), "left").drop("_name")


def looked_up(column: Column, table: dict, default: Column | None = None) -> Column:
    """The value of a small dictionary for the column's value; where there is none, the default, or else the value itself."""
    value = None
    for k, v in table.items():
        value = F.when(column == k, F.lit(v)) if value is None else value.when(column == k, F.lit(v))
    rest = column if default is None else default
    return rest if value is None else value.otherwise(rest)


def counts_with_missing(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str, value: str, missing: str = "NaN") -> DataFrame:
    """(value, count) of the looked-up values, keys without one under `missing`."""
    one = lookup.select(F.col(lookup_key).alias("_key"), F.col(value).alias("_value")).dropDuplicates(["_key"])
    return df.join(one, F.col(key) == F.col("_key"), "left").groupBy(F.coalesce(F.col("_value").cast("string"), F.lit(missing)).alias(value)).agg(F.count("*").alias("count"))


def largest_of_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, kinds, most): different inner values of each outer one, and the rows of the most frequent."""
    counts = df.where(F.col(outer).isNotNull() & F.col(inner).isNotNull()).groupBy(outer, inner).agg(F.count("*").alias("n"))
    return counts.groupBy(outer).agg(F.count("*").alias("kinds"), F.max("n").alias("most"))


def found_and_missing(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(value, rows) of each value asked for, 0 if it isn't there."""
    asked = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], "value string")
    there = df.where(F.col(column).isin(values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    return asked.join(there, "value", "left").select("value", F.coalesce("rows", F.lit(0)).alias("rows"))
