"""Persons, their parties and the intervals in which they held them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talverk.operators.asof import attributes_at_event_time

# fixed values: what the cascade reports
MESSAGES = {
    "unknown": "Unknown person",
    "none": "No listing",
    "one": "Only one match",
    "perfect": "Perfect match found",
    "party": "Only one unique party possible, no matching date",
    "guess": "More than one possible party found, had to guess",
}


def affiliation_on_date(events: DataFrame, affiliations: DataFrame, *, who: str = "who", date: str = "date", entity: str = "id", start: str = "start", end: str = "end", row: str = "row_idx") -> DataFrame:
    """(who, date, party, uncertain, message) of each distinct who and date of the events.

    In this order: the person `unknown`; no listing; a single listing; a single listing that covers the date (both ends
    included, null covers nothing); a single party; no covering listing: of the nearest start and the nearest end, the
    party of the start if that start lies after that end, else that of the end; else the last covering listing in row order.
    The last two are uncertain. Rows with a null who or date have none; join the result with a default for them.
    """
    asked = events.select(F.col(who).alias("who"), F.col(date).alias("date")).where("who is not null and date is not null").distinct()
    listed = affiliations.select(F.col(entity).alias("_id"), "party", F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(row).cast("bigint").alias("_row")).where("_id is not null")
    persons = listed.groupBy("_id").agg(F.count("*").alias("n"), F.count_distinct("party").alias("parties"), F.min(F.struct("_row", "party")).alias("first"))
    # one row for each person and day on which something begins or ends, and the questions between them; so no listing
    # meets every date of its person, and a person has at most a row a day however often they are listed
    covers = F.col("_s") <= F.col("_e")
    marks = [
        F.struct(F.col("_s").alias("day"), F.struct("_row", "party").alias("s"), F.lit(None).cast("struct<_row:bigint,party:string>").alias("e"), covers.cast("int").alias("delta")),
        F.struct(F.col("_e").alias("day"), F.lit(None).cast("struct<_row:bigint,party:string>").alias("s"), F.struct("_row", "party").alias("e"), F.lit(0).alias("delta")),
        F.struct(F.when(covers, F.date_add("_e", 1)).alias("day"), F.lit(None).cast("struct<_row:bigint,party:string>").alias("s"), F.lit(None).cast("struct<_row:bigint,party:string>").alias("e"), F.lit(-1).alias("delta")),
    ]
    days = listed.select("_id", F.explode(F.array(*marks)).alias("m")).select("_id", "m.*").where("day is not null").groupBy("_id", "day").agg(F.min("s").alias("s"), F.min("e").alias("e"), F.sum("delta").alias("delta"))
    questions = asked.select(F.col("who").alias("_id"), F.col("date").alias("day"), F.lit(True).alias("asks"))
    line = days.withColumn("asks", F.lit(False)).unionByName(questions, allowMissingColumns=True)
    back = Window.partitionBy("_id").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_id").orderBy(F.desc("day"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct("day", f"{c}._row", f"{c}.party"))
    near = {f"{c}_{k}": F.last(at(c), ignorenulls=True).over(w) for c in "se" for k, w in (("back", back), ("ahead", ahead))}
    line = line.withColumns(near | {"covering": F.coalesce(F.sum("delta").over(back), F.lit(0))}).where("asks")
    nearest_of = lambda c: F.least(*[F.when(F.col(f"{c}_{k}").isNotNull(), F.struct(F.abs(F.datediff(f"{c}_{k}.day", "day")).alias("d"), f"{c}_{k}._row", F.col(f"{c}_{k}.day").alias("at"), f"{c}_{k}.party")) for k in ("back", "ahead")])
    line = line.select(F.col("_id").alias("who"), F.col("day").alias("date"), "covering", nearest_of("s").alias("by_start"), nearest_of("e").alias("by_end"))
    # the last of the covering listings in row order, by the sweep that finds what wins on a day
    held = listed.where(covers).select(F.col("_id").alias("entity"), F.lit("last").alias("attribute"), F.col("party").alias("value"), F.col("_row").alias("rank_at"), F.xxhash64("party").alias("rank_tie"), F.col("_s").alias("lo"), F.col("_e").alias("hi"))
    last = attributes_at_event_time(asked, "who", "date", {"last": held})
    found = line.join(last, ["who", "date"]).join(persons, F.col("who") == F.col("_id"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.struct(F.lit(0).alias("d"), F.col("first._row").alias("_row"), F.lit(None).cast("date").alias("at"), F.col("first.party").alias("party"))
    by_start, by_end = F.coalesce("by_start", first), F.coalesce("by_end", first)
    nearest = F.when(by_start["at"] > by_end["at"], by_start["party"]).otherwise(by_end["party"])
    unknown = F.col("who") == "unknown"
    cases: list[tuple[Column, Column, bool, Column]] = [
        (unknown, F.lit("unknown"), False, F.lit(MESSAGES["unknown"])),
        (F.col("n") == 0, F.lit("unknown_missing"), False, F.lit(MESSAGES["none"])),
        (F.col("n") == 1, F.col("first.party"), False, F.lit(MESSAGES["one"])),
        (F.col("covering") == 1, F.col("last"), False, F.lit(MESSAGES["perfect"])),
        (F.col("parties") == 1, F.col("first.party"), False, F.lit(MESSAGES["party"])),
        (F.col("covering") == 0, nearest, True, F.concat(F.lit("Estimated closest match ("), F.col("parties").cast("string"), F.lit(" possible parties)"))),
        (F.lit(True), F.col("last"), True, F.lit(MESSAGES["guess"])),
    ]
    pick = lambda k: _chain([(c[0], c[k] if k != 2 else F.lit(c[2])) for c in cases])
    return found.select("who", "date", pick(1).alias("party"), pick(2).alias("uncertain"), pick(3).alias("message"))


def _chain(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out


def overlap_hulls(affiliations: DataFrame, today: str, *, entity: str = "id", start: str = "start", end: str = "end") -> DataFrame:
    """(id, party_1, party_2, overlap_start, overlap_end): hull of the common time of each pair of parties of a person.

    Intervals are open, so ends that touch don't overlap; a null start is the earliest of all, a null end is `today`.
    """
    spans = affiliations.select(F.col(entity).alias("id"), "party", F.col(start).alias("s"), F.coalesce(end, F.lit(today).cast("date")).alias("e")).where("id is not null and party is not null").distinct()
    earliest = spans.agg(F.min("s")).scalar()
    spans = spans.select("id", "party", F.coalesce(F.col("s"), earliest).alias("s"), "e").where("s < e").distinct()
    # the time of a person with a party as disjoint spans, so that the pairs to look at are about as many as the spans
    longest = spans.groupBy("id", "party", "s").agg(F.max("e").alias("e"))
    own = Window.partitionBy("id", "party").orderBy("s")
    reach = F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1))
    apart = longest.withColumn("_new", F.coalesce(F.col("s") > reach, F.lit(True)).cast("int")).withColumn("_k", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = apart.groupBy("id", "party", "_k").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_k")
    # spans meet only within the decades they touch
    decades = F.sequence(F.floor(F.year("s") / 10), F.floor(F.year("e") / 10))
    cut = merged.withColumn("_decade", F.explode(decades))
    a, b = cut.alias("a"), cut.alias("b")
    pairs = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a._decade") == F.col("b._decade")) & (F.col("a.party") < F.col("b.party")) & (F.col("a.s") < F.col("b.e")) & (F.col("b.s") < F.col("a.e")))
    return pairs.groupBy(F.col("a.id").alias("id"), F.col("a.party").alias("party_1"), F.col("b.party").alias("party_2")).agg(
        F.min(F.greatest("a.s", "b.s")).alias("overlap_start"), F.max(F.least("a.e", "b.e")).alias("overlap_end")
    )


def overlap_flags(affiliations: DataFrame, *, entity: str = "id", start: str = "start", end: str = "end", row: str = "row_idx") -> DataFrame:
    """affiliations with `overlaps`: does the row begin before the end of the row before it of the same person (in row order)?"""
    before = F.lag(end).over(Window.partitionBy(entity).orderBy(row))
    return affiliations.withColumn("overlaps", F.coalesce(before > F.col(start), F.lit(False)))


def undefined_timespans(affiliations: DataFrame, *, entity: str = "id", start: str = "start", end: str = "end") -> DataFrame:
    """(id, affiliations) of persons with at least two affiliations that all have the same start and end; null is a value."""
    one = lambda c: (F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))) == 1
    out = affiliations.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("id")).agg(F.count("*").alias("affiliations"), one(start).alias("_s"), one(end).alias("_e"))
    return out.where("affiliations >= 2 and _s and _e").select("id", "affiliations")


def active_between(spans: DataFrame, first: str, last: str, *, start: str = "start", end: str = "end") -> DataFrame:
    """Rows whose interval touches the days from first to last."""
    return spans.where((F.col(start) <= F.lit(last).cast("date")) & (F.col(end) >= F.lit(first).cast("date")))


def decade_days(decade: int) -> tuple[str, str]:
    return f"{decade}-01-01", f"{decade + 9}-12-31"


def year_days(year: int) -> tuple[str, str]:
    return f"{year}-01-01", f"{year}-12-31"


def covering(spans: DataFrame, day: str, *, start: str = "start", end: str = "end") -> DataFrame:
    """Rows whose interval holds the day, both ends included."""
    return spans.where((F.col(start) <= F.lit(day).cast("date")) & (F.col(end) >= F.lit(day).cast("date")))


def active_members_party(spans: DataFrame, affiliations: DataFrame, first: str, last: str, day: str) -> DataFrame:
    """(party, members): parties of the persons with a span in the days; who has several gets that of the cascade on `day`."""
    members = active_between(spans, first, last).where("id is not null").select("id").distinct()
    own = affiliations.join(members, "id", "left_semi").where("party is not null").groupBy("id").agg(F.count_distinct("party").alias("n"), F.min("party").alias("party"))
    doubtful = own.where("n > 1").select(F.col("id").alias("who"), F.lit(day).cast("date").alias("date"))
    decided = affiliation_on_date(doubtful, affiliations).select(F.col("who").alias("id"), "party")
    return own.where("n = 1").select("id", "party").unionByName(decided).groupBy("party").agg(F.count("*").alias("members"))


def completed(spans: DataFrame, *, entity: str = "id", start: str = "start", end: str = "end") -> DataFrame:
    """Null starts become the person's earliest start, null ends the latest end; null if there is none."""
    own = Window.partitionBy(entity)
    return spans.withColumn(start, F.coalesce(start, F.min(start).over(own))).withColumn(end, F.coalesce(end, F.max(end).over(own)))


def consolidate_names(names: DataFrame, *, entity: str = "id", name: str = "name", primary: str = "primary_name") -> DataFrame:
    """(id, name, alternative_names): the primary name (or else the last by order) and all names, sorted."""
    rows = names.where(F.col(entity).isNotNull()).distinct()
    return rows.groupBy(F.col(entity).alias("id")).agg(F.max(F.struct(primary, name))[name].alias("name"), F.array_sort(F.collect_set(name)).alias("alternative_names"))


def consolidate_persons(persons: DataFrame, *, entity: str = "id", prefer: str = "shortest") -> DataFrame:
    """(id, born, dead, gender, riksdagen_id): one row for each person.

    Of several dates the `shortest` string counts, a null being three characters long, or with prefer=`longest` the
    longest; ties go to the smaller string. gender and riksdagen_id are the smallest that isn't null.
    """
    if prefer not in ("shortest", "longest"):
        raise ValueError("prefer is shortest or longest")
    sign = 1 if prefer == "shortest" else -1
    empty = 3 if prefer == "shortest" else 0

    def choose(c: str) -> Column:
        length = F.coalesce(F.length(c), F.lit(empty)) * sign
        return F.min(F.struct(length.alias("n"), F.coalesce(c, F.lit("")).alias("order"), F.col(c).alias("value")))["value"].alias(c)

    rows = persons.where(F.col(entity).isNotNull())
    return rows.groupBy(F.col(entity).alias("id")).agg(choose("born"), choose("dead"), F.min("gender").alias("gender"), F.min("riksdagen_id").alias("riksdagen_id"))


def id_column(df: DataFrame) -> str:
    """The first of wiki_id, swerik_id, person_id that the frame has."""
    for name in ("wiki_id", "swerik_id", "person_id"):
        if name in df.columns:
            return name
    raise ValueError("no id column")


def rows_with_all_words(df: DataFrame, words: list[str]) -> DataFrame:
    """Rows that contain every word somewhere, whatever its case."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]))
    for w in words:
        df = df.where(F.contains(text, F.lit(w.lower())))
    return df


def words_in_tables(tables: dict[str, DataFrame], words: list[str]) -> dict[str, DataFrame]:
    """The tables that have rows with every word, reduced to those rows."""
    found = {name: rows_with_all_words(df, words) for name, df in tables.items()}
    return {name: df for name, df in found.items() if not df.isEmpty()}
