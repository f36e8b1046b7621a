"""Attributes of an entity as they were known on the day of an event.

A register holds versions of records. A version says which value of one attribute holds from one day to another (valid
time) and was entered at some moment (recorded); it replaces the earlier versions of its record from then on. For an
event on day D only versions recorded on or before D count, and of the held versions whose days cover D the latest
recorded one wins.

Every attribute has a register of its own (`held_values`), which may be another table, change at other times and have
other records than those of the other attributes. Each gets its own change history (entity, attribute, day, value), each
is matched with its last change on or before the day of the event, and the matches are pivoted back. Rows are long, one
attribute each, from the register to the match; no row ever holds two attributes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Years in one slice of an entity's time. A slice bounds what one group holds, also for an entity with most rows.
SLICE_YEARS = 20


def held_values(versions: DataFrame, attribute: str, value: Column, *, record: str, recorded: str, start: Column, end: Column, entity: str) -> DataFrame:
    """(entity, attribute, value, rank_at, rank_tie, lo, hi): the days on which each version of one attribute is both held and valid.

    A null start or end is open. A version is held from the day of its recording to the day before the next version of
    the record was recorded; of several on one day the latest is held. Repeated rows count once. Versions without
    an entity, a record key or a time of recording are of no use and left out. Ties in `recorded` are settled within a
    record by the values, the larger one last, and between records by a hash of the record, alike for all attributes.
    """
    v = versions.select(F.col(record).alias("_record"), F.col(entity).alias("entity"), F.col(recorded).alias("recorded"), start.alias("_start"), end.alias("_end"), value.cast("string").alias("value"))
    v = v.where("entity is not null and _record is not null and recorded is not null").withColumn("_on", F.to_date("recorded"))
    # one version of a record and day, so that a record has at most one row a day however often it was entered
    v = v.groupBy("_record", "_on").agg(F.max(F.struct("recorded", "_start", "_end", "entity", "value")).alias("_v")).select("_record", "_on", "_v.*")
    following = F.lead("_on").over(Window.partitionBy("_record").orderBy("_on"))
    lo = F.greatest(F.col("_on"), F.col("_start"))  # greatest and least pass over nulls
    hi = F.coalesce(F.least(F.date_sub(following, 1), F.col("_end")), F.lit("9999-12-31").cast("date"))
    held = v.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    return held.select("entity", F.lit(attribute).alias("attribute"), "value", F.unix_micros("recorded").alias("rank_at"), F.xxhash64("_record").alias("rank_tie"), "lo", "hi")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows ordered by (entity, attribute, slice, lo) and yields the days on which the winning value changes."""
    names = ("entity", "attribute", "slice", "day", "value")
    out: tuple[list, ...] = ([], [], [], [], [])
    key, heap, last, day = None, [], [], None

    def emit(at: int) -> None:
        value = heap[0][3] if heap else None
        if not last or last[0] != value:
            last[:] = [value]
            for column, x in zip(out, (*key, at, value)):
                column.append(x)

    def expire(before: int | None) -> None:
        """Change at the end of each winning interval that ends before the day."""
        while heap and (before is None or -heap[0][2] < before):
            at = -heap[0][2] + 1
            while heap and -heap[0][2] < at:
                heapq.heappop(heap)
            if before is None or at < before:
                emit(at)

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=names)
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        for entity, attribute, part, lo, hi, at, tie, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (entity, attribute, part) != key:
                if key is not None:
                    emit(day)
                    expire(None)
                key, heap, last, day = (entity, attribute, part), [], [], None
            elif lo != day:
                emit(day)
            if lo != day:
                expire(lo)
            day = lo
            heapq.heappush(heap, (-at, -tie, -hi, value))
            if len(heap) > 64 and len(heap) & (len(heap) - 1) == 0:  # a lower interval that ends no later can never win
                kept, far = [], None
                for x in sorted(heap, key=lambda x: x[:3]):
                    if far is None or -x[2] > far:
                        kept.append(x)
                        far = -x[2]
                heap[:] = kept
        if len(out[0]) > 20_000:
            yield flush()
    if key is not None:
        emit(day)
        expire(None)
    yield flush()


def slice_of(day: Column) -> Column:
    return F.floor(F.year(day) / SLICE_YEARS).cast("int")


def change_histories(held: DataFrame, slices: DataFrame) -> DataFrame:
    """(entity, attribute, slice, day, value): the days on which the value of an attribute changes, day as days since 1970.

    `slices` (entity, slice) are those in which there are events; an interval is clipped to each slice it touches, so
    that an entity with very many versions is spread over its slices and no group exceeds one slice and attribute.
    """
    touched = (
        held.join(slices.withColumnRenamed("entity", "_e"), (F.col("entity") == F.col("_e")) & (F.col("slice") >= slice_of(F.col("lo"))) & (F.col("slice") <= slice_of(F.col("hi"))))
        .withColumn("lo", F.unix_date(F.greatest("lo", F.make_date(F.col("slice") * SLICE_YEARS, F.lit(1), F.lit(1)))))
        .withColumn("hi", F.unix_date("hi"))
    )
    # of intervals of one slice with the same days the latest recorded one is enough
    best = touched.groupBy("entity", "attribute", "slice", "lo", "hi").agg(F.max(F.struct("rank_at", "rank_tie", F.col("value").isNotNull().alias("_there"), "value")).alias("_best"))
    rows = best.select("entity", "attribute", "slice", "lo", "hi", "_best.rank_at", "_best.rank_tie", "_best.value")
    rows = rows.repartition("entity", "attribute", "slice").sortWithinPartitions("entity", "attribute", "slice", "lo")
    return rows.mapInArrow(_sweep, "entity string, attribute string, slice int, day int, value string")


def attributes_at_event_time(events: DataFrame, entity: str, day: str, registers: dict[str, DataFrame]) -> DataFrame:
    """(entity, day, one string column for each attribute): the attributes of each distinct entity and day of the events.

    `registers` has the held values of each attribute (`held_values`). An attribute is null where its register as it
    stood on the day held nothing for the entity. Events with a null entity or day have no row. The events are first
    reduced to distinct pairs, so an entity with a third of all events counts at most once a day. Join the result to the
    events on (entity, day).
    """
    attributes = list(registers)
    asked = events.select(F.col(entity).alias("entity"), F.col(day).alias("_day")).where("entity is not null and _day is not null").distinct()
    asked = asked.select("entity", slice_of(F.col("_day")).alias("slice"), F.unix_date("_day").alias("day"))
    slices = asked.select("entity", "slice").distinct()
    history = change_histories(reduce(DataFrame.unionByName, registers.values()), slices)
    questions = asked.withColumn("attribute", F.explode(F.array(*[F.lit(a) for a in attributes])))
    both = history.select("entity", "attribute", "slice", "day", F.struct("value").alias("change"), F.lit(False).alias("asks")).unionByName(
        questions.select("entity", "attribute", "slice", "day", F.lit(None).cast("struct<value:string>").alias("change"), F.lit(True).alias("asks"))
    )
    latest = F.last("change", ignorenulls=True).over(Window.partitionBy("entity", "attribute", "slice").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0))
    matched = both.withColumn("value", latest["value"]).where("asks")
    if len(attributes) == 1:  # nothing to pivot
        wide = matched.select("entity", "day", F.col("value").alias(attributes[0]))
    else:
        wide = matched.groupBy("entity", "slice", "day").pivot("attribute", attributes).agg(F.first("value"))
    return wide.select(F.col("entity").alias(entity), F.date_from_unix_date("day").alias(day), *attributes)
