"""Grouped reports: counts, pivots, shares, quantiles, histograms, rankings.

Rows whose grouping key is null are left out everywhere, and every ranking has a tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talverk.operators.joins import places_before, with_group_values
from talverk.session import broadcast_if_small, materialize


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def multi_aggregate(df: DataFrame, keys: list[str], who: str = "who", tokens: str = "n_tokens") -> DataFrame:
    """speakers (different), speeches, tokens, and tokens a speaker rounded half to even."""
    out = keyed(df, keys).groupBy(*keys).agg(F.count_distinct(who).alias("speakers"), F.count("*").alias("speeches"), F.sum(tokens).alias("tokens"))
    return out.withColumn("tokens_per_speaker", F.bround(F.try_divide(F.col("tokens"), F.col("speakers")), 2))


MEASURES = {"tokens": lambda: F.sum("n_tokens"), "speeches": lambda: F.count(F.lit(1)), "speakers": lambda: F.count_distinct("who")}


def pivot_report(df: DataFrame, mode: str, period: str, key: str, values: list[str], *, filter_value: str | None = None, sub_key: str | None = None, normalize: bool = False) -> DataFrame:
    """One row for each period and one column for each value of the key, absent ones 0; with `normalize` shares of the row.

    With a filter value only its rows count, and the columns are the values of `sub_key`. A row whose sum is 0 has null shares.
    """
    if mode not in MEASURES:
        raise ValueError(f"mode is one of {sorted(MEASURES)}")
    if filter_value is not None:
        if sub_key is None:
            raise ValueError("a filter needs a sub key")
        df, key = df.where(F.col(key) == filter_value), sub_key
    wide = keyed(df, [period, key]).groupBy(period).pivot(key, values).agg(MEASURES[mode]())
    filled = wide.select(period, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(v) for v in values])
    if not normalize:
        return filled
    total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    return filled.select(period, *[F.try_divide(F.col(f"`{v}`"), total).alias(v) for v in values])


def share_of_parent(df: DataFrame, keys: list[str], parent: list[str]) -> DataFrame:
    """count of each group and its share of the count of its parent group."""
    counts = keyed(df, keys).groupBy(*keys).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*parent)))


def quantiles(df: DataFrame, key: str, value: str, lower: float, upper: float) -> DataFrame:
    """Lower and upper quantile (linear interpolation) and median."""
    return keyed(df, [key]).groupBy(key).agg(F.percentile(value, lower).alias("lower"), F.percentile(value, 0.5).alias("median"), F.percentile(value, upper).alias("upper"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys…, one column for each share): quantiles with linear interpolation, exact also for very many different values.

    Values are counted, sorted by a distributed sort and numbered within their group; only those at the places asked for are
    gathered, so no group is held by one task. Rows with a null key or value are left out.
    """
    counts = keyed(df, [*keys, value]).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    kept = materialize(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    before = places_before(kept.groupBy(*keys, "_part").agg(F.sum("_n").alias("_m")), "_part", "_m", keys)
    totals = kept.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    own = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = kept.withColumn("_in", F.sum("_n").over(own)).join(broadcast_if_small(before), [*keys, "_part"]).join(broadcast_if_small(totals), keys)
    last = F.col("_before") + F.col("_in") - 1  # the places of a value among all from 0: first to last
    first = last - F.col("_n") + 1
    parts = []
    for name, q in shares.items():
        place = (F.col("_all") - 1) * F.lit(float(q))
        low, weight = F.floor(place), place - F.floor(place)
        for c, at in ((f"{name}_lo", low), (f"{name}_hi", F.ceil(place))):
            parts.append(F.max(F.when((first <= at) & (at <= last), F.col("_v"))).alias(c))
        parts.append(F.max(weight).alias(f"{name}_w"))
    found = placed.groupBy(*keys).agg(*parts)
    return found.select(*keys, *[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_w")).alias(n) for n in shares])


def mean_std(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return keyed(df, keys).groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def rate(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Percentage of true among the rows where the flag isn't null."""
    return keyed(df, [key]).groupBy(key).agg((F.avg(F.col(flag).cast("double")) * 100).alias("rate"))


def count_not_null(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return keyed(df, [key]).groupBy(key).agg(*[F.count(c).alias(c) for c in columns])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return keyed(df, columns).groupBy(*columns).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *columns)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Count of each bin from 0; values outside the range are left out, the upper end belongs to the last bin."""
    inside = df.where(F.col(value).between(low, high))
    return inside.withColumn("bin", F.least(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)) - 1, F.lit(bins - 1)).cast("int")).groupBy("bin").agg(F.count("*").alias("count"))


def density(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], cells: int, keys: list[str] | None = None) -> DataFrame:
    """Natural logarithm of the count of each square cell, by keys."""
    keys = keys or []
    inside = keyed(df, keys).where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    cell = lambda c, r: F.least(F.floor((F.col(c) - r[0]) * cells / (r[1] - r[0])), F.lit(cells - 1)).cast("int")
    return inside.groupBy(*keys, cell(x, x_range).alias("x_bin"), cell(y, y_range).alias("y_bin")).agg(F.ln(F.count("*")).alias("log_count"))


def top_k(df: DataFrame, keys: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each group; `order` must end in a tie-breaker."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def extremes(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The rows with the largest and the smallest value of each group, ties by the smallest tie-breaker."""
    rows = keyed(df, keys).where(F.col(value).isNotNull())
    pick = lambda order: F.min_by(tie, F.struct(order, F.col(tie)))
    return rows.groupBy(*keys).agg(pick(-F.col(value)).alias("largest"), pick(F.col(value)).alias("smallest"))


def top_and_bottom(df: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The k rows with the largest (`top`) and the k with the smallest values (`bottom`) of each group."""
    rows = materialize(keyed(df, keys).where(F.col(value).isNotNull()))  # figures made once for both rankings
    top = top_k(rows, keys, k, [F.desc(value), F.col(tie)]).withColumn("side", F.lit("top"))
    bottom = top_k(rows, keys, k, [F.col(value), F.col(tie)]).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def cumulative_share(counts: DataFrame, keys: list[str], term: str, count: str) -> DataFrame:
    """Running percentage of the group's total, from the most frequent term on."""
    running = Window.partitionBy(*keys).orderBy(F.desc(count), term).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("cumulative", F.sum(count).over(running) * 100.0 / F.sum(count).over(Window.partitionBy(*keys)))


def unique_list(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sorted different values of each group, null ones left out."""
    return keyed(df, [key]).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def first_by(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The value of the first row of each group."""
    return keyed(df, [key]).groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("first"))


def aligned_share(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """Rows that meet the condition and all rows of each group, and their ratio, in one pass."""
    out = keyed(df, [key]).groupBy(key).agg(F.count_if(condition).alias("part"), F.count("*").alias("total"))
    return out.withColumn("share", F.col("part") / F.col("total"))


def repeats(df: DataFrame, text: str, tie: str, least: int = 10) -> DataFrame:
    """md5 of texts that occur at least `least` times, with the count and the text of the smallest tie-breaker."""
    rows = df.where(F.col(text).isNotNull()).withColumn("hash", F.md5(text))
    return rows.groupBy("hash").agg(F.count("*").alias("count"), F.min_by(text, tie).alias("sample")).where(F.col("count") >= least)


def with_group_count(df: DataFrame, key: str) -> DataFrame:
    """df with `repeats`, the rows of the row's group."""
    return with_group_values(df, key, df.groupBy(key).agg(F.count("*").alias("repeats")))


def distinct_with_null(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values, kinds): the different values of each group without null, and with null as a value."""
    return keyed(df, [key]).groupBy(key).agg(F.count_distinct(value).alias("values"), (F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))).cast("bigint").alias("kinds"))


def nulls_last(column: Column, low: float = -10_000.0) -> Column:
    """A column to sort by, in which null is a given low number."""
    return F.coalesce(column, F.lit(low))


def panels(df: DataFrame, key: str, period: str, values: list[str], measure: Column) -> DataFrame:
    """(period, key, value): the measure of each given value of the key in every period that has rows, null where it has none: a panel for each value."""
    rows = keyed(df, [period, key]).where(F.col(key).isin(values)).groupBy(period, key).agg(measure.alias("value"))
    frame = rows.select(period).distinct().withColumn(key, F.explode(F.array(*[F.lit(v) for v in values])))
    return frame.join(rows, [period, key], "left")


def with_overall(df: DataFrame, key: str, value: str, label: str) -> DataFrame:
    """Mean of each group and a last row with the mean of all groups' means."""
    groups = keyed(df, [key]).groupBy(key).agg(F.avg(value).alias("mean"))
    return groups.unionByName(groups.agg(F.avg("mean").alias("mean")).select(F.lit(label).alias(key), "mean"))
