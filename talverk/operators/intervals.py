"""Continuous periods and gaps of intervals that overlap, nest or leave gaps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A list of disjoint sorted intervals, as the days lo, hi, lo, hi, …
PERIODS = T.ArrayType(T.IntegerType())


def merge_two(a: list[int], b: list[int]) -> list[int]:
    """Union of two lists of disjoint sorted intervals, by one walk along both."""
    out: list[int] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if j == len(b) or (i < len(a) and a[i] <= b[j]):
            lo, hi, i = a[i], a[i + 1], i + 2
        else:
            lo, hi, j = b[j], b[j + 1], j + 2
        if not out or lo > out[-1] + 1:
            out += (lo, hi)
        elif hi > out[-1]:
            out[-1] = hi
    return out


def merge_all(lists: list[list[int]]) -> list[int]:
    """Union of many such lists, by merging pairs until one is left."""
    while len(lists) > 1:
        lists = [merge_two(*lists[k : k + 2]) if k + 1 < len(lists) else lists[k] for k in range(0, len(lists), 2)]
    return lists[0] if lists else []


@F.arrow_udf(PERIODS)
def merge_lists(lists: pa.Array) -> pa.Array:
    return pa.array([merge_all(parts) for parts in lists.to_pylist()], pa.list_(pa.int32()))


def disjoint_periods(df: DataFrame, entity: str, lo: Column, hi: Column) -> DataFrame:
    """(entity, periods): for each entity the sorted list of its longest runs of covered days.

    Rows with a null entity, lo or hi, or with hi before lo cover nothing. Days that touch belong to one run.
    The list is a mergeable aggregate, built in three steps of a reduction tree: by first day, by year, by entity. The
    first is an ordinary maximum (one row for each first day, whatever the number of rows), so a list never
    exceeds 366 entries a year and half the days of the entity's time, even where one entity holds a third of the rows.
    """
    days = df.select(F.col(entity).alias("entity"), F.unix_date(lo).alias("lo"), F.unix_date(hi).alias("hi"), F.year(lo).alias("part")).where("entity is not null and lo <= hi")
    longest = days.groupBy("entity", "part", "lo").agg(F.max("hi").alias("hi"))
    years = longest.groupBy("entity", "part").agg(F.collect_list(F.array("lo", "hi")).alias("lists")).withColumn("periods", merge_lists("lists"))
    return years.groupBy("entity").agg(F.collect_list("periods").alias("lists")).select(F.col("entity").alias(entity), merge_lists("lists").alias("periods"))


def periods_and_gaps(lists: DataFrame, entity: str) -> DataFrame:
    """(entity, kind, first_day, last_day): a row for each period and for each gap between two periods, days as YYYY-MM-DD."""
    gaps = F.expr("transform(sequence(1, size(periods) div 2 - 1, 1), i -> named_struct('kind', 'gap', 'lo', periods[2 * i - 1] + 1, 'hi', periods[2 * i] - 1))")
    gaps = F.when(F.size("periods") > 2, gaps).otherwise(F.expr("array()").cast("array<struct<kind:string,lo:int,hi:int>>"))
    periods = F.expr("transform(sequence(0, size(periods) div 2 - 1, 1), i -> named_struct('kind', 'period', 'lo', periods[2 * i], 'hi', periods[2 * i + 1]))")
    rows = lists.select(F.col(entity), F.explode(F.concat(periods, gaps)).alias("x"))
    day = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")
    return rows.select(entity, F.col("x.kind").alias("kind"), day(F.col("x.lo")).alias("first_day"), day(F.col("x.hi")).alias("last_day"))
