"""How often every distinct term occurs, and in how many records, in a vertical layout.

A term has a bitmap of the records in which it occurs, next to a counter of occurrences. Records are numbered densely; a
bitmap is cut into containers of 2^16 numbers, each held as a sorted list of 16-bit numbers or, where that is longer, as
65,536 bits. Every task builds the bitmaps of its own rows, so that what is shuffled is one container and counter for each
term and task and not a row for each posting. Containers of the same term and place are merged by union, counters by sum,
and the number of records of a term is the cardinality of its bitmap. Merging is done by term and container, so a term
that is in every record is spread over as many groups as it has containers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talverk.session import broadcast_if_small

#: Numbers in one container, and the bytes of its bits.
SPAN, BITS = 1 << 16, 1 << 13
#: Postings that a task collects before it hands on the bitmaps built so far; a bound on memory.
POSTINGS = 1_000_000


def plain_term(term: str) -> str | None:
    """Lower case and NFC, without soft hyphens and without white space at either end; null for a blank term."""
    return unicodedata.normalize("NFC", term.replace("\xad", "").lower()).strip() or None


def pack(numbers: np.ndarray) -> bytes:
    """A container of sorted different 16-bit numbers: the numbers, or bits where these are shorter."""
    if 2 * len(numbers) < BITS:
        return numbers.astype("<u2").tobytes()
    bits = np.zeros(SPAN, np.uint8)
    bits[numbers] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    if len(container) < BITS:
        return np.frombuffer(container, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little")).astype("<u2")


def union(containers: list[bytes]) -> bytes:
    """Union of containers: of bits by or, of lists by a merge."""
    if len(containers) == 1:
        return containers[0]
    if any(len(c) == BITS for c in containers):
        bits = np.zeros(SPAN, np.uint8)
        for c in containers:
            if len(c) == BITS:
                bits |= np.unpackbits(np.frombuffer(c, np.uint8), bitorder="little")
            else:
                bits[np.frombuffer(c, "<u2")] = 1
        return np.packbits(bits, bitorder="little").tobytes()
    return pack(np.unique(np.concatenate([np.frombuffer(c, "<u2") for c in containers])))


def cardinality(container: bytes) -> int:
    return len(container) // 2 if len(container) < BITS else int(np.unpackbits(np.frombuffer(container, np.uint8)).sum())


_PARTS = "term string, high bigint, bitmap binary, n bigint"


def _build(normalize):
    """Containers and counters of the terms of a task's rows (raw, seq, n); `high` is null where no row has a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}  # raw form -> place of its term, -1 if it has none
        terms: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def place(raw: str) -> int:
            term = normalize(raw)
            return -1 if term is None else terms.setdefault(term, len(terms))

        def flush() -> pa.RecordBatch:
            names = list(terms)
            at, seq, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            high = np.where(seq < 0, -1, seq >> 16)
            order = np.lexsort((seq, high, at))
            at, seq, n, high = at[order], seq[order], n[order], high[order]
            begins = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (high[1:] != high[:-1]))))
            sums = np.add.reduceat(n, begins)
            new = np.concatenate(([True], (at[1:] != at[:-1]) | (seq[1:] != seq[:-1])))  # a record counts once
            kept = (seq & 0xFFFF).astype(np.uint16)[new]
            bounds = np.append(np.concatenate(([0], np.cumsum(new)))[begins], len(kept))
            where = high[begins]
            maps = [None if h < 0 else pack(kept[a:b]) for h, a, b in zip(where.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())]
            return pa.record_batch([pa.array(names).take(pa.array(at[begins])), pa.array(where, mask=where < 0), pa.array(maps, pa.binary()), pa.array(sums)], names=["term", "high", "bitmap", "n"])

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            own = []
            for raw in coded.dictionary.to_pylist():
                k = places.get(raw)
                if k is None:
                    k = places[raw] = place(raw)
                own.append(k)
            at = np.array(own, np.int64)[coded.indices.to_numpy()] if len(batch) else np.zeros(0, np.int64)
            there = at >= 0
            held.append((at[there], batch.column(1).fill_null(-1).to_numpy()[there], batch.column(2).to_numpy()[there]))
            size += int(there.sum())
            if size >= POSTINGS:
                yield flush()
                places, terms, held, size = {}, {}, [], 0
        if size:
            yield flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (term, high): a row (term, records, n) for each container, the cardinality of its union and its counter."""
    key, maps, total = None, [], 0
    out: tuple[list, list, list] = ([], [], [])

    def emit() -> None:
        for column, value in zip(out, (key[0], cardinality(union(maps)) if maps else 0, total)):
            column.append(value)

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["term", "records", "n"])
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        for term, high, bitmap, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (term, high) != key:
                if key is not None:
                    emit()
                key, maps, total = (term, high), [], 0
            if bitmap is not None:
                maps.append(bitmap)
                if len(maps) >= 64:
                    maps = [union(maps)]
            total += n
        if len(out[0]) > 20_000:
            yield flush()
    if key is not None:
        emit()
    yield flush()


def record_numbers(records: DataFrame, record: str, groups: int) -> DataFrame:
    """(record, seq): numbers of the distinct records, dense within each of `groups` hash groups, which follow one another.

    Dense within a group, so that bitmaps of common terms fill their containers, and without a global sort.
    """
    group = F.pmod(F.xxhash64(record), F.lit(groups)).cast("bigint")
    own = Window.partitionBy("_group").orderBy(record)
    rows = records.select(record).where(F.col(record).isNotNull()).distinct().withColumn("_group", group).withColumn("_n", F.row_number().over(own).cast("bigint") - 1)
    sizes = rows.groupBy("_group").agg(F.count("*").alias("_size"))
    # at most `groups` rows; groups follow one another at whole containers only if they are that large
    step = F.when(F.col("_size") < SPAN, F.col("_size")).otherwise(F.ceil(F.col("_size") / SPAN) * SPAN)
    before = sizes.select("_group", F.coalesce(F.sum(step).over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_group").select(record, (F.col("_before") + F.col("_n")).cast("bigint").alias("seq"))


def term_statistics(df: DataFrame, record: str, term: str, count: str, normalize=plain_term, groups: int | None = None, records: DataFrame | None = None) -> DataFrame:
    """(term, occurrences bigint, records bigint): each distinct term with its total count and number of distinct records.

    Terms are compared as `normalize` makes them; null ones and those it makes null are left out. Rows with a null count count 0
    times but do place the term in the record; rows with a null record add to the count and to no record. A term spread over
    several rows of a record has that record once. An empty input gives no rows. `records` may name a frame with a column
    `record` that holds all records of df (and perhaps more) and is cheaper to read than df.
    """
    groups = groups or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(record).alias("record"), F.col(term).alias("raw"), F.coalesce(F.col(count), F.lit(0)).cast("bigint").alias("n")).where("raw is not null")
    # the numbers of the records are broadcast as long as they are few (checked); beyond that the join is by shuffle
    numbers = broadcast_if_small(record_numbers(records if records is not None else df.select(F.col(record).alias("record")), "record", groups))
    placed = rows.where("record is not null").join(numbers, "record").select("raw", "seq", "n")
    loose = rows.where("record is null").groupBy("raw").agg(F.sum("n").alias("n")).select("raw", F.lit(None).cast("bigint").alias("seq"), "n")
    parts = placed.unionByName(loose).mapInArrow(_build(normalize), _PARTS)
    merged = parts.repartition("term", "high").sortWithinPartitions("term", "high").mapInArrow(_merge, "term string, records bigint, n bigint")
    return merged.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum("records").alias("records"))


def repeated_numbers(df: DataFrame, key: str) -> DataFrame:
    """(key bigint): the integers that occur in more than one row, null ones left out.

    Found by bitmaps too: each task hands on, for each container, the numbers it saw, and of the containers of all tasks
    those that are in more than one, or twice in one, are kept. Two bytes a row or less move where the numbers are dense.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[np.ndarray]) -> pa.RecordBatch:
            numbers, times = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            highs: list[int] = []
            maps: list[bytes] = []
            for part in (numbers, numbers[times > 1]):  # a number seen twice is handed on twice
                high = part >> 16
                begins = np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1]))) if len(part) else np.zeros(0, np.int64)
                for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(part)]):
                    highs.append(int(high[a]))
                    maps.append(pack((part[a:b] & 0xFFFF).astype(np.uint16)))
            return pa.record_batch([pa.array(highs, pa.int64()), pa.array(maps, pa.binary())], names=["high", "bitmap"])

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += len(batch)
            if size >= 4 * POSTINGS:
                yield rows(held)
                held, size = [], 0
        yield rows(held)

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, more = None, np.zeros(0, bool), np.zeros(0, bool)
        for batch in batches:
            out = []
            for high, bitmap in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if high != at:
                    if at is not None:
                        out.append((at << 16) + np.flatnonzero(more))
                    at, once, more = high, np.zeros(SPAN, bool), np.zeros(SPAN, bool)
                numbers = unpack(bitmap)
                more[numbers] |= once[numbers]
                once[numbers] = True
            if out:
                yield pa.record_batch([pa.array(np.concatenate(out), pa.int64())], names=[key])
        if at is not None:
            yield pa.record_batch([pa.array((at << 16) + np.flatnonzero(more), pa.int64())], names=[key])

    numbers = df.select(F.col(key).cast("bigint")).where(F.col(key).isNotNull())
    return numbers.mapInArrow(seen, "high bigint, bitmap binary").repartition("high").sortWithinPartitions("high").mapInArrow(twice, f"`{key}` bigint")


def latest_delivery(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row for each key (an integer), that with the latest `at`; rows with a null key are kept as they are.

    Only rows of repeated keys are grouped; of the others nothing but the key is looked at, and none is moved as long as
    the repeated keys are few (checked). Of rows delivered at the same time the one with the largest values counts.
    """
    rows = df.select(key, F.struct(at, *columns).alias("_row"))
    repeated = broadcast_if_small(repeated_numbers(df, key).select(F.col(key).alias("_key")))
    once = rows.join(repeated, F.col(key) == F.col("_key"), "left_anti")
    many = rows.join(repeated, F.col(key) == F.col("_key"), "left_semi").groupBy(key).agg(F.max("_row").alias("_row"))
    return once.unionByName(many).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def mark_terms(stats: DataFrame, total_records: DataFrame, least: int, share: float) -> DataFrame:
    """stats with `mark`: `rare` below `least` records, `common` above the share of all records, else null.

    `total_records` is a frame of one row and one column. A term that is both counts as `rare`.
    """
    total = total_records.scalar()
    mark: Column = F.when(F.col("records") < least, "rare").when(F.col("records") > share * total, "common")
    return stats.withColumn("mark", mark)
