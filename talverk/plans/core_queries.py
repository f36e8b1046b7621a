"""Queries of the general operators for training data: p1, p4 and p5, with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talverk.functions.dates import first_day, last_day
from talverk.operators import asof, intervals, termstats
from talverk.sources.tables import table


def _known(spark: SparkSession, folder: str, values: dict[str, str]) -> DataFrame:
    """Each speech with a speaker and a date, with the attributes that the register held on that day: a name and the register's column for each."""
    speeches = table(spark, folder, "speech_index").select("u_id", "who", "date", "party_affiliation").where("date is not null and who is not null and who <> 'unknown'").distinct()
    register = table(spark, folder, "party_affiliation")
    registers = {
        name: asof.held_values(register, name, F.col(column), record="aff_id", recorded="recorded", start=first_day(F.col("start")), end=last_day(F.col("end")), entity="wiki_id")
        for name, column in values.items()
    }
    return speeches.join(asof.attributes_at_event_time(speeches, "who", "date", registers), ["who", "date"], "left")


def p1_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Each speech with a speaker and a date, with the party of the register as known on that day and the record that says so."""
    known = _known(spark, folder, {"party": "party", "entry": "aff_id"})
    return known.select("u_id", "who", "date", "party_affiliation", F.coalesce("party", F.lit("unknown")).alias("party"), F.col("entry").cast("bigint").alias("aff_id"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Speeches whose stated party is not that of the register on the day."""
    known = _known(spark, folder, {"party": "party"})
    return known.where(~F.col("party_affiliation").eqNullSafe(F.coalesce("party", F.lit("unknown")))).select("u_id").distinct()


def seats(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "member_of_parliament").select("wiki_id", "start", "end")
    hi = F.when(F.col("end").isNull(), F.lit("2024-12-31").cast("date")).otherwise(last_day(F.col("end")))
    return intervals.disjoint_periods(rows, "wiki_id", first_day(F.col("start")), hi)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous periods of the seats of each person, and the gaps between them."""
    return intervals.periods_and_gaps(seats(spark, folder), "wiki_id")


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct word with its total count, the number of speeches and its mark."""
    counts = table(spark, folder, "word_count")
    rows = termstats.latest_delivery(counts, "tally_id", "counted_at", ["u_id", "word", "cnt"])
    total = counts.where("u_id is not null").agg(F.count_distinct("u_id"))
    return termstats.mark_terms(termstats.term_statistics(rows, "u_id", "word", "cnt", records=counts.select(F.col("u_id").alias("record"))), total, 3, 0.2).withColumnRenamed("term", "word")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The words that are too rare or too common."""
    return p5_terms(spark, folder).where("mark is not null").select("word", "mark")


QUERIES = {f.__name__: f for f in (p1_found, p1_attributes, p4_found, p5_found, p5_terms)}

_P1 = """
with v as (
  select distinct *, cast(recorded as timestamp)::date as on_day from party_affiliation
  where aff_id is not null and wiki_id is not null and recorded is not null),
s as (select distinct u_id, who, "date", party_affiliation from speech_index where "date" is not null and who is not null and who <> 'unknown'),
held as (
  select s.who, s."date", v.* exclude ("date"), row_number() over (partition by s.who, s."date", v.aff_id order by v.recorded desc) as r
  from (select distinct who, "date" from s) s join (select *, null as "date" from v) v on v.wiki_id = s.who and v.on_day <= s."date"),
days as (
  select *, try_cast(case length("start") when 4 then "start" || '-01-01' when 7 then "start" || '-01' else "start" end as date) as lo,
    case length("end") when 4 then try_cast("end" || '-12-31' as date) when 7 then last_day(try_cast("end" || '-01' as date)) else try_cast("end" as date) end as hi
  from held where r = 1),
best as (
  select who, "date", arg_max(party, recorded) as party, arg_max(aff_id, recorded) as aff_id
  from days where (lo is null or lo <= "date") and (hi is null or hi >= "date") group by all),
known as (select s.*, coalesce(b.party, 'unknown') as party, b.aff_id from s left join best b on b.who = s.who and b."date" = s."date")
"""
_P4 = """
with d as (
  select distinct wiki_id,
    try_cast(case when regexp_full_match("start", '[0-9]{4}') then "start" || '-01-01' when regexp_full_match("start", '[0-9]{4}-[0-9]{2}') then "start" || '-01'
      when regexp_full_match("start", '[0-9]{4}-[0-9]{2}-[0-9]{2}') then "start" end as date) as lo,
    case when "end" is null then date '2024-12-31' when regexp_full_match("end", '[0-9]{4}') then try_cast("end" || '-12-31' as date)
      when regexp_full_match("end", '[0-9]{4}-[0-9]{2}') then last_day(try_cast("end" || '-01' as date))
      when regexp_full_match("end", '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast("end" as date) end as hi
  from member_of_parliament where wiki_id is not null),
o as (select wiki_id, lo, hi, max(hi) over (partition by wiki_id order by lo, hi rows between unbounded preceding and 1 preceding) as reach from d where lo <= hi),
g as (select *, sum(case when reach is null or lo > reach + 1 then 1 else 0 end) over (partition by wiki_id order by lo, hi rows unbounded preceding) as grp from o),
p as (select wiki_id, min(lo) as lo, max(hi) as hi from g group by wiki_id, grp),
n as (select *, lead(lo) over (partition by wiki_id order by lo) as next_lo from p)
select wiki_id, 'period' as kind, strftime(lo, '%Y-%m-%d') as first_day, strftime(hi, '%Y-%m-%d') as last_day from n
union all
select wiki_id, 'gap', strftime(cast(hi + 1 as date), '%Y-%m-%d'), strftime(cast(next_lo - 1 as date), '%Y-%m-%d') from n where next_lo is not null
"""
_P5 = """
with r as (select u_id, word, cnt from word_count qualify tally_id is null or row_number() over (partition by tally_id order by counted_at desc, u_id desc, word desc, cnt desc) = 1),
w as (select u_id, cnt, regexp_replace(nfc_normalize(lower(replace(word, chr(173), ''))), '^[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{000B}\\x{0085}\\x{001C}-\\x{001F}]+|[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{000B}\\x{0085}\\x{001C}-\\x{001F}]+$', '', 'g') as word from r),
t as (select count(distinct u_id) as n from word_count),
s as (select word, cast(sum(coalesce(cnt, 0)) as bigint) as occurrences, count(distinct u_id) as records from w where word <> '' group by word),
m as (select s.*, case when records < 3 then 'rare' when records > 0.2 * t.n then 'common' end as mark from s, t)
"""
ORACLE = {
    "p1_found": _P1 + "select distinct u_id from known where party_affiliation is distinct from party",
    "p1_attributes": _P1 + 'select u_id, who, "date", party_affiliation, party, aff_id from known',
    "p4_found": _P4,
    "p5_found": _P5 + "select word, mark from m where mark is not null",
    "p5_terms": _P5 + "select word, occurrences, records, mark from m",
}
