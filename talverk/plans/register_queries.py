"""Queries over the registers of persons, parties and seats, and over the trade tables, with SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talverk.functions import text as X
from talverk.functions.dates import first_day, last_day
from talverk.operators import affiliation as A
from talverk.operators import joins as J
from talverk.operators import reports as R
from talverk.operators import tables as TB
from talverk.operators.latest import latest_rows
from talverk.plans.speech_queries import S, speech
from talverk.session import shared_folder
from talverk.sources import files, tei
from talverk.sources.tables import spread, table

TODAY = "2024-12-31"
QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def affil(spark: SparkSession, folder: str) -> DataFrame:
    """(id, party, start, end, row_idx): the last version of each record of the register."""
    rows = table(spark, folder, "party_affiliation").select("aff_id", "wiki_id", "party", "start", "end", "recorded")
    last = rows.groupBy("aff_id").agg(F.max(F.struct("recorded", "start", "end", "wiki_id", "party")).alias("v"))
    return last.select(F.col("v.wiki_id").alias("id"), F.col("v.party").alias("party"), first_day(F.col("v.start")).alias("start"), last_day(F.col("v.end")).alias("end"), F.col("aff_id").alias("row_idx"))


def seat(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, end): the seats whose days are dates."""
    rows = table(spark, folder, "member_of_parliament").select("wiki_id", "start", "end").where(F.col("wiki_id").isNotNull())
    return rows.select(F.col("wiki_id").alias("id"), first_day(F.col("start")).alias("start"), last_day(F.col("end")).alias("end")).distinct()


_DAY = """case when regexp_full_match({c}, '[0-9]{{4}}') then try_cast({c} || '{y}' as date) when regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}') then {m} when regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast({c} as date) end"""
_FIRST = _DAY.format(c='"start"', y="-01-01", m="""try_cast("start" || '-01' as date)""")
_LAST = _DAY.format(c='"end"', y="-12-31", m="""last_day(try_cast("end" || '-01' as date))""")
AFF = f"""affil as (select wiki_id as id, party, {_FIRST} as s, {_LAST} as e, aff_id as row_idx from (
  select *, row_number() over (partition by aff_id order by recorded desc, "start" desc, "end" desc) as n from party_affiliation) where n = 1)"""
SEAT = f"""seat as (select distinct wiki_id as id, {_FIRST} as s, {_LAST} as e from member_of_parliament where wiki_id is not null)"""
_CASCADE = """
asked as (select distinct who, day as date from speech where who is not null and day is not null),
x as (select a.who, a.date, f.*, coalesce(f.s <= a.date and f.e >= a.date, false) as c, abs(f.s - a.date) as ds, abs(f.e - a.date) as de from asked a left join affil f on f.id = a.who),
y as (select who, date, count(id) as n, count(distinct party) as parties, count(case when c then 1 end) as covering,
  arg_max(party, row_idx) filter (c) as last_party, arg_min(party, row_idx) as first_party,
  arg_min(party, ds * 1000000 + row_idx) filter (ds is not null) as sp, arg_min(s, ds * 1000000 + row_idx) filter (ds is not null) as sa,
  arg_min(party, de * 1000000 + row_idx) filter (de is not null) as ep, arg_min(e, de * 1000000 + row_idx) filter (de is not null) as ea from x group by who, date),
cascade as (select who, date,
  case when who = 'unknown' then 'unknown' when n = 0 then 'unknown_missing' when n = 1 then first_party when covering = 1 then last_party when parties = 1 then first_party
    when covering = 0 then case when sa > ea then coalesce(sp, first_party) else coalesce(ep, first_party) end else last_party end as party,
  not (who = 'unknown' or n <= 1 or covering = 1 or parties = 1) as uncertain,
  case when who = 'unknown' then 'Unknown person' when n = 0 then 'No listing' when n = 1 then 'Only one match' when covering = 1 then 'Perfect match found'
    when parties = 1 then 'Only one unique party possible, no matching date' when covering = 0 then 'Estimated closest match (' || parties || ' possible parties)'
    else 'More than one possible party found, had to guess' end as message from y)"""


@query(S + ", " + AFF + ", " + _CASCADE + " select * from cascade")
def affiliation_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Party of each speaker and date by the cascade of rules."""
    return A.affiliation_on_date(speech(spark, folder, "who", "day").withColumnRenamed("day", "date"), affil(spark, folder))


_HULL = f"""h as (select distinct id, party, coalesce(s, (select min(s) from affil where id is not null and party is not null)) as s, coalesce(e, date '{TODAY}') as e from affil where id is not null and party is not null)"""


@query("with " + AFF + ", " + _HULL + " select a.id, a.party as party_1, b.party as party_2, min(greatest(a.s, b.s)) as overlap_start, max(least(a.e, b.e)) as overlap_end from h a join h b on a.id = b.id and a.party < b.party and a.s < b.e and b.s < a.e where a.s < a.e and b.s < b.e group by all")
def overlap_hull(spark: SparkSession, folder: str) -> DataFrame:
    return A.overlap_hulls(affil(spark, folder), TODAY)


@query("with " + AFF + " select id, row_idx, coalesce(lag(e) over (partition by id order by row_idx) > s, false) as overlaps from affil")
def overlap_lag(spark: SparkSession, folder: str) -> DataFrame:
    return A.overlap_flags(affil(spark, folder)).select("id", "row_idx", "overlaps")


@query("with " + AFF + " select id, count(*) as affiliations from affil where id is not null group by id having count(*) >= 2 and count(distinct s) + max((s is null)::int) = 1 and count(distinct e) + max((e is null)::int) = 1")
def undefined_timespan(spark: SparkSession, folder: str) -> DataFrame:
    return A.undefined_timespans(affil(spark, folder))


@query("with " + SEAT + ' select id, s as start, e as "end" from seat where s <= date \'1979-12-31\' and e >= date \'1970-01-01\'')
def active_in_decade(spark: SparkSession, folder: str) -> DataFrame:
    return A.active_between(seat(spark, folder), *A.decade_days(1970))


@query("with " + SEAT + ' select id, s as start, e as "end" from seat where s <= date \'1985-06-01\' and e >= date \'1985-06-01\'')
def point_in_interval(spark: SparkSession, folder: str) -> DataFrame:
    return A.covering(seat(spark, folder), "1985-06-01")


@query("with " + SEAT + ", speech as (select distinct id as who, date '1975-06-01' as day from seat where s <= date '1979-12-31' and e >= date '1970-01-01'), " + AFF + ", own as (select id, count(distinct party) as n, min(party) as party from affil where id in (select who from speech) and party is not null group by id), " + _CASCADE + " select party, count(*) as members from (select party from own where n = 1 union all select c.party from cascade c join own on own.id = c.who and own.n > 1) group by party")
def active_members_party(spark: SparkSession, folder: str) -> DataFrame:
    return A.active_members_party(seat(spark, folder), affil(spark, folder), "1970-01-01", "1979-12-31", "1975-06-01")


@query("with " + AFF + ' select id, row_idx, coalesce(s, min(s) over (partition by id)) as start, coalesce(e, max(e) over (partition by id)) as "end" from affil')
def interval_completion(spark: SparkSession, folder: str) -> DataFrame:
    return A.completed(affil(spark, folder)).select("id", "row_idx", "start", "end")


@query(f'with d as (select distinct "start", "end" from member_of_parliament) select "start", "end", {_FIRST} as first_day, {_LAST} as last_day from d')
def partial_dates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "member_of_parliament").select("start", "end").distinct()
    return rows.withColumns({"first_day": first_day(F.col("start")), "last_day": last_day(F.col("end"))})


@query("""with p as (select * from person where wiki_id is not null) select wiki_id as id,
  (arg_min(struct_pack(v := born), coalesce(length(born), 3) * 1000000000000 + coalesce(cast(replace(rpad(born, 10, '0'), '-', '') as bigint), 0))).v as born,
  (arg_min(struct_pack(v := dead), coalesce(length(dead), 3) * 1000000000000 + coalesce(cast(replace(rpad(dead, 10, '0'), '-', '') as bigint), 0))).v as dead,
  min(gender) as gender, min(riksdagen_id) as riksdagen_id from p group by wiki_id""")
def person_consolidation(spark: SparkSession, folder: str) -> DataFrame:
    return A.consolidate_persons(table(spark, folder, "person"), entity=A.id_column(table(spark, folder, "person")))


@query("select abbreviation as id, max(party) as name, string_agg(distinct party, ', ' order by party) as alternative_names from party_abbreviation where abbreviation is not null group by abbreviation")
def name_consolidation(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "party_abbreviation").withColumn("primary_name", F.lit(True))
    return A.consolidate_names(rows, entity="abbreviation", name="party").select("id", "name", F.array_join("alternative_names", ", ").alias("alternative_names"))


@query("select wiki_id, party, start, \"end\", role, district from member_of_parliament where contains(lower(concat_ws(' ', wiki_id, \"start\", \"end\", party, role, district)), 'ledamot') and contains(lower(concat_ws(' ', wiki_id, \"start\", \"end\", party, role, district)), 'torn')")
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    return A.rows_with_all_words(table(spark, folder, "member_of_parliament"), ["Ledamot", "TORN"])


@query("select v.value, count(m.role) as rows from (values ('ledamot'), ('ersättare'), ('talman'), ('kung')) v(value) left join member_of_parliament m on m.role = v.value group by v.value")
def found_not_found(spark: SparkSession, folder: str) -> DataFrame:
    return J.found_and_missing(table(spark, folder, "member_of_parliament"), "role", ["ledamot", "ersättare", "talman", "kung"])


@query("with p as (select wiki_id, min(gender) as gender from person where wiki_id is not null group by wiki_id) select role, count(case when gender = 'man' then 1 end) as man, count(case when gender = 'woman' then 1 end) as woman, cast(abs(count(case when gender = 'man' then 1 end) - count(case when gender = 'woman' then 1 end)) as bigint) as difference, count(case when gender = 'man' then 1 end) + count(case when gender = 'woman' then 1 end) as total from minister m join p using (wiki_id) where role is not null group by role")
def minister_gender(spark: SparkSession, folder: str) -> DataFrame:
    """Ministers of each role by gender, their difference and total, ministers and persons being joined by id."""
    persons = A.consolidate_persons(table(spark, folder, "person"), entity="wiki_id").withColumnRenamed("id", "wiki_id")
    both = table(spark, folder, "minister").where("role is not null").join(persons, "wiki_id")
    wide = both.groupBy("role").agg(F.count_if(F.col("gender") == "man").alias("man"), F.count_if(F.col("gender") == "woman").alias("woman"))
    return wide.withColumn("difference", F.abs(F.col("man") - F.col("woman"))).withColumn("total", F.col("man") + F.col("woman")).orderBy(F.desc("total"), "role")


@query(S + ", p as (select wiki_id, min(try_cast(case when length(born) = 4 then born || '-01-01' when length(born) = 7 then born || '-01' else born end as date)) as born from person group by wiki_id) select u_id, round((day - born) / 365.2425, 6) as age from speech join p on who = wiki_id where day is not null and born is not null")
def approx_age(spark: SparkSession, folder: str) -> DataFrame:
    born = table(spark, folder, "person").groupBy("wiki_id").agg(F.min(first_day(F.col("born"))).alias("born")).where("born is not null")
    rows = speech(spark, folder, "who", "day").where("day is not null").join(born, F.col("who") == F.col("wiki_id"))
    return rows.select("u_id", F.round(X.approximate_age(F.col("day"), F.col("born")), 6).alias("age"))


@query(S + ", p as (select wiki_id, min(try_cast(case when length(born) = 4 then born || '-01-01' when length(born) = 7 then born || '-01' else born end as date)) as born from person group by wiki_id) select year, party_abbrev, round(avg((day - born) / 365.2425), 6) as mean_age, count(distinct who) as speakers from speech join p on who = wiki_id where day is not null and born is not null and year is not null and party_abbrev is not null group by year, party_abbrev")
def mean_age_year_party(spark: SparkSession, folder: str) -> DataFrame:
    born = table(spark, folder, "person").groupBy("wiki_id").agg(F.min(first_day(F.col("born"))).alias("born")).where("born is not null")
    rows = speech(spark, folder, "who", "day", "year", "party_abbrev").where("day is not null").join(born, F.col("who") == F.col("wiki_id"))
    rows = R.keyed(rows, ["year", "party_abbrev"]).withColumn("age", X.approximate_age(F.col("day"), F.col("born")))
    return rows.groupBy("year", "party_abbrev").agg(F.round(F.avg("age"), 6).alias("mean_age"), F.count_distinct("who").alias("speakers"))


@query(S + " select protocol, min(who) as who from speech where protocol is not null and who is not null group by protocol having count(distinct who) = 1")
def single_speaker_protocols(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.keyed(speech(spark, folder, "protocol", "who"), ["protocol", "who"])
    return rows.groupBy("protocol").agg(F.min("who").alias("who"), F.count_distinct("who").alias("n")).where("n = 1").drop("n")


@query(S + " select year, gender, party_abbrev, round(avg(n_tokens), 6) as mean_tokens, count(*) as speeches from speech where year is not null and party_abbrev is not null group by all")
def mean_length_year_gender_party(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.keyed(speech(spark, folder, "year", "gender", "party_abbrev", "n_tokens"), ["year", "party_abbrev"])
    return rows.groupBy("year", "gender", "party_abbrev").agg(F.round(F.avg("n_tokens"), 6).alias("mean_tokens"), F.count("*").alias("speeches"))


@query(S + " , d as (select distinct protocol from speech where protocol is not null) select protocol, try_cast(case when regexp_full_match(split_part(protocol, '-', 2)[1:4], '[0-9]{4}') then split_part(protocol, '-', 2)[1:4] end as integer) as year, nullif(split_part(protocol, '--', 2), '') as number from d")
def protocol_parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = speech(spark, folder, "protocol").select("protocol").where("protocol is not null").distinct()
    return rows.withColumns({"year": X.protocol_year(F.col("protocol")), "number": X.protocol_number(F.col("protocol"))})


@query(S + " , c as (select protocol, who, count(*) as n from speech where protocol is not null and who is not null group by all) select protocol, count(*) as kinds, max(n) as most from c group by protocol")
def nested_agg(spark: SparkSession, folder: str) -> DataFrame:
    return J.largest_of_counts(speech(spark, folder, "protocol", "who"), "protocol", "who")


@query(S + ", l as (select wiki_id, min(gender) as g from person where gender is not null group by wiki_id) select u_id, case when gender = 'unknown' then coalesce(g, gender) else gender end as gender from speech left join l on who = wiki_id")
def backfill_join(spark: SparkSession, folder: str) -> DataFrame:
    lookup = table(spark, folder, "person").where("gender is not null")
    return J.backfill(speech(spark, folder, "who", "gender"), "who", "gender", lookup, "wiki_id", "gender", F.col("gender") == "unknown").select("u_id", "gender")


@query(S + " select coalesce(b.party, 'NaN') as party, count(*) as count from speech s left join (select lower(abbreviation) as k, min(party) as party from party_abbreviation group by 1) b on b.k = lower(s.party_abbrev) group by 1")
def missing_key_counts(spark: SparkSession, folder: str) -> DataFrame:
    lookup = table(spark, folder, "party_abbreviation").groupBy(F.lower("abbreviation").alias("key")).agg(F.min("party").alias("party"))
    return J.counts_with_missing(speech(spark, folder, "party_abbrev").withColumn("k", F.lower("party_abbrev")), "k", lookup, "key", "party")


@query("select c_custkey, c_name, n_name from customer left join nation on c_nationkey = n_nationkey")
def left_join_names(spark: SparkSession, folder: str) -> DataFrame:
    return J.join_on(table(spark, folder, "customer"), table(spark, folder, "nation"), "c_nationkey", "n_nationkey").select("c_custkey", "c_name", "n_name")


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def inner_join(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").join(table(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def anti_join(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").join(table(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey), 4) as total from orders")
def group_total_join(spark: SparkSession, folder: str) -> DataFrame:
    return J.group_total(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice", "total").select("o_orderkey", F.round("total", 4).alias("total"))


@query("with a as (select s_suppkey, row_number() over (order by s_suppkey) as n from supplier), b as (select n_name, row_number() over (order by n_nationkey) as n from nation) select s_suppkey, n_name from a left join b using (n)")
def positional_join(spark: SparkSession, folder: str) -> DataFrame:
    left, right = table(spark, folder, "supplier").select("s_suppkey"), table(spark, folder, "nation").select("n_nationkey", "n_name")
    return J.positional_join(left, right, ["s_suppkey"], ["n_nationkey"]).select("s_suppkey", "n_name")


@query("with p as (select distinct protocol from speech_index where protocol is not null), f as (select distinct file_name from speech_index where file_name is not null) select protocol, (select min(file_name) from f where contains(file_name, protocol)) as found from p")
def contains_join(spark: SparkSession, folder: str) -> DataFrame:
    """For each protocol the first file whose name contains its own."""
    rows = table(spark, folder, "speech_index")
    return J.first_containing(rows.select("protocol").where("protocol is not null").distinct(), "protocol", rows, "file_name")


@query("select file_name, string_split(file_name, '-')[1] as kind, string_split(file_name, '_')[1] as stem from (select distinct file_name from speech_index where file_name is not null)")
def file_stems(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "speech_index").select("file_name").where("file_name is not null").distinct()
    return rows.select("file_name", F.split("file_name", "-")[0].alias("kind"), X.file_stem(F.col("file_name")).alias("stem"))


@query("with " + SEAT + ' select id, s as start, e as "end" from seat where s <= date \'1985-12-31\' and e >= date \'1985-01-01\'')
def active_in_year(spark: SparkSession, folder: str) -> DataFrame:
    return A.active_between(seat(spark, folder), *A.year_days(1985))


@query("select 'minister' as name, count(*) as rows from minister where contains(lower(concat_ws(' ', wiki_id, role)), 'minister') having count(*) > 0 union all select 'party_abbreviation', count(*) from party_abbreviation where contains(lower(concat_ws(' ', party, abbreviation)), 'minister') having count(*) > 0 union all select 'person', count(*) from person where contains(lower(concat_ws(' ', wiki_id, born, dead, gender, riksdagen_id)), 'minister') having count(*) > 0")
def search_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The tables with rows that hold a word, and how many rows do."""
    found = A.words_in_tables({n: table(spark, folder, n) for n in ("minister", "party_abbreviation", "person")}, ["Minister"])
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in found.items()]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "name string, rows bigint")


@query("with p as (select wiki_id, min(gender) as gender from person where wiki_id is not null group by wiki_id), c as (select role, sum(case when gender = 'man' then 1 end) as man, sum(case when gender = 'woman' then 1 end) as woman from minister m join p using (wiki_id) where role is not null group by role) select role, cast(man as bigint) as man, cast(woman as bigint) as woman, cast(coalesce(abs(man - woman), -10000) as double) as difference, row_number() over (order by coalesce(abs(man - woman), -10000) desc, role) as rank from c")
def minister_gender_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """Ministers of each role by gender, sorted by the difference of the two; a role with only one gender has no difference and is last."""
    persons = A.consolidate_persons(table(spark, folder, "person"), entity="wiki_id").withColumnRenamed("id", "wiki_id")
    both = table(spark, folder, "minister").where("role is not null").join(persons, "wiki_id")
    wide = both.groupBy("role").pivot("gender", ["man", "woman"]).agg(F.count(F.lit(1)))
    wide = wide.withColumn("difference", R.nulls_last(F.abs(F.col("man") - F.col("woman")).cast("double"))).withColumn("_order", -F.col("difference"))
    return J.numbered(wide, ["_order", "role"], "rank").withColumn("rank", (F.col("rank") + 1).cast("bigint")).drop("_order")


@query("select coalesce(a.k, b.k) as nation, customers, suppliers from (select c_nationkey as k, count(*) as customers from customer group by 1) a full join (select s_nationkey as k, count(*) as suppliers from supplier group by 1) b on a.k = b.k")
def aligned_counts(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full")


@query("select p_partkey, p_retailprice from part where p_retailprice > 1500")
def weight_trim(spark: SparkSession, folder: str) -> DataFrame:
    return TB.trim_low_weights(table(spark, folder, "part"), 1500.0, "p_retailprice").select("p_partkey", "p_retailprice")


@query("select column_name as column, stored, smallest, round(share, 6) as distinct_share from (select 's_suppkey' as column_name, 'bigint' as stored, case when max(s_suppkey) < 128 and min(s_suppkey) >= -128 then 'tinyint' when max(s_suppkey) < 32768 then 'smallint' when max(s_suppkey) < 2147483648 then 'int' else 'bigint' end as smallest, count(distinct s_suppkey) / cast(count(*) as double) as share from supplier union all select 's_name', 'string', 'string', count(distinct s_name) / cast(count(*) as double) from supplier union all select 's_nationkey', 'int', 'tinyint', count(distinct s_nationkey) / cast(count(*) as double) from supplier union all select 's_acctbal', 'double', 'float', count(distinct s_acctbal) / cast(count(*) as double) from supplier)")
def downcast_probe(spark: SparkSession, folder: str) -> DataFrame:
    return TB.smallest_types(table(spark, folder, "supplier"))


@query("select 'n_nationkey' as column from nation having bool_and(n_nationkey = rn) union all select 'n_regionkey' from nation having bool_and(n_regionkey = rn)".replace("from nation", "from (select *, row_number() over (order by n_nationkey) - 1 as rn from nation)"))
def index_like_columns(spark: SparkSession, folder: str) -> DataFrame:
    return TB.index_like_columns(J.numbered(table(spark, folder, "nation"), ["n_nationkey"], "row"), "row")


@query("select event_id, cast(json_extract(props, '$.k') as integer) as k from events")
def json_field(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("select u_id, cast(len(u_ids) as integer) as ids from speech_index where u_ids is not null")
def json_lists(spark: SparkSession, folder: str) -> DataFrame:
    rows = files.json_lists(files.with_json_lists(table(spark, folder, "speech_index").select("u_id", "u_ids")))
    return rows.where("u_ids is not null").select("u_id", F.size("u_ids").alias("ids"))


@query("with e as (select *, (event_type = 'signup')::int as opens from events), i as (select user_id, ts, event_id, sum(opens) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from e) select user_id, cast(island as bigint) as island, count(*) as events from i group by user_id, island")
def speech_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of events, each begun by an opening event, as notes begin speeches."""
    running = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, folder, "events").withColumn("island", F.sum((F.col("event_type") == "signup").cast("int")).over(running))
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("events"))


_WORDS = "with w as (select distinct lower(word) as word, protocol is null as later from word_count where regexp_matches(word, '[^\\s\\p{Z}]'))"


def _words(spark: SparkSession, folder: str) -> DataFrame:
    """(word, protocol): all words in lower case, without null and blank ones."""
    return table(spark, folder, "word_count").where(F.col("word").rlike(r"[^\s\p{Z}]")).select(F.lower("word").alias("word"), "protocol")


@query(_WORDS + " select word, row_number() over (order by word) - 1 as id from (select distinct word from w)")
def word_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all different words in lower case, whatever their characters; null and blank ones have none."""
    return files.word_ids(_words(spark, folder), "word")


@query(_WORDS + " select word, row_number() over (order by bool_and(later), word) - 1 as id from w group by word")
def word_ids_lasting(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all words from a store that first gets those of known protocols and then all: the first keep theirs."""
    store = files.WordStore(spark, shared_folder(spark))
    store.add(_words(spark, folder).where("protocol is not null"), "word")
    return store.add(_words(spark, folder), "word")


def _escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")  # no XML may hold these


def _protocols(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, xml): a TEI document for each speech, by its id; those without a date lack their last closing tag."""
    rows = table(spark, folder, "speech_index").select("u_id", "loaded_at", "who", "who_intro", "protocol", "date", "text")
    rows = latest_rows(rows, "u_id", "loaded_at", spread(rows))
    parts = F.transform(F.coalesce("text", F.array().cast("array<string>")), lambda t, k: F.concat(F.lit('<u xml:id="'), F.col("u_id"), F.lit("-"), k.cast("string"), F.lit('"'), F.coalesce(F.concat(F.lit(' who="'), _escaped(F.col("who")), F.lit('"')), F.lit("")), F.lit("><seg>"), _escaped(F.coalesce(t, F.lit(""))), F.lit("</seg></u>")))
    head = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><front><div type="preface"><head>'), _escaped(F.coalesce("protocol", F.lit(""))), F.lit("</head></div><docDate>"), F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")), F.lit('</docDate></front><body><note type="speaker">'), _escaped(F.coalesce("who_intro", F.lit(""))), F.lit("</note>"))
    return rows.select(F.col("u_id").alias("file_name"), F.concat(head, F.array_join(parts, "\n"), F.lit("</body></text>"), F.when(F.col("date").isNotNull(), "</TEI>").otherwise("")).alias("xml"))


_LATEST = "with s as (select * from (select *, row_number() over (partition by u_id order by loaded_at desc) as n from speech_index where u_id is not null) where n = 1)"


@query(_LATEST + r""" select u_id as file_name, case when len(coalesce(text, [])) = 0 then 'unknown' else who end as who, protocol, "date", len(coalesce(text, [])) as utterances, coalesce(cast(length(regexp_replace(array_to_string(text, ''), '[^\p{L}\p{N}]', '', 'g')) as bigint), 0) as letters from s where "date" is not null""")
def tei_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The speeches read from a TEI document for each, with the letters and digits of their text."""
    found = tei.extract_speeches(_protocols(spark, folder)).where("date is not null")
    letters = F.length(F.regexp_replace(F.array_join("text", ""), r"[^\p{L}\p{N}]", "")).cast("bigint")
    return found.select("file_name", "who", F.when(F.col("protocol") != "", F.col("protocol")).alias("protocol"), "date", F.size("u_ids").cast("bigint").alias("utterances"), letters.alias("letters"))


@query(_LATEST + """ select u_id as file_name, true as malformed from s where "date" is null""")
def tei_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are no XML."""
    errors = tei.errors_of(tei.extract_speeches(_protocols(spark, folder)))
    return errors.select("file_name", F.startswith("error", F.lit("not well-formed")).alias("malformed"))


@query(_LATEST + """ select u_id as file_name, protocol, len(coalesce(text, [])) as utterances from s where "date" is not null""")
def tei_single_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of single documents by their paths."""
    rows = _protocols(spark, folder).where(F.endswith("xml", F.lit("</TEI>")))
    one = tei.single_document(rows, "//head/text()").withColumnRenamed("values", "head")
    many = tei.single_document(rows, "//u/seg").withColumnRenamed("values", "segs")
    return one.join(many, "file_name").select("file_name", F.when(F.get("head", F.lit(0)) != "", F.get("head", F.lit(0))).alias("protocol"), F.size("segs").cast("bigint").alias("utterances"))


# written and read again

_PLAIN = ["u_id", "who", "protocol", "year", "gender", "n_tokens"]
_PLAIN_SQL = _LATEST + " select u_id, who, protocol, year, gender, n_tokens from s"


def _plain(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "speech_index").select("loaded_at", *_PLAIN)
    return latest_rows(rows, "u_id", "loaded_at").select(*_PLAIN)


@query(_PLAIN_SQL)
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Speeches through a CSV file with its own separator and a byte order mark."""
    to = shared_folder(spark)
    files.write_csv(_plain(spark, folder), f"{to}/speeches.csv", "~", mark=True)
    return files.csv_folder(spark, to, {"speeches": "u_id string, who string, protocol string, year int, gender string, n_tokens int"}, "~")["speeches"]


@query(_PLAIN_SQL)
def groups_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Speeches through a folder for each gender."""
    to = shared_folder(spark)
    rows = _plain(spark, folder)
    files.write_groups(rows, to, ["gender"])
    return spark.read.schema(rows.schema).parquet(to).select(*_PLAIN)


@query(_PLAIN_SQL)
def cached_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Speeches through a cache that is built once."""
    path = shared_folder(spark) + "/cache"
    files.cached(spark, path, lambda: _plain(spark, folder))
    return files.cached(spark, path, lambda: spark.createDataFrame([], "x int"))


@query(_LATEST + " select u_id, text from s")
def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts through a table that holds lists as JSON."""
    rows = table(spark, folder, "speech_index").select("u_id", "loaded_at", "text")
    to = shared_folder(spark)
    files.with_json_lists(latest_rows(rows, "u_id", "loaded_at").select("u_id", "text")).write.parquet(to)
    return files.json_lists(spark.read.parquet(to))


@query(_LATEST + """ select coalesce(gender, 'unknown') as gender, count(*) as texts from s where "date" between date '1950-01-01' and date '1999-12-31' and text is not null group by 1""")
def texts_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of a time as files by gender, a line each, counted when read again."""
    rows = table(spark, folder, "speech_index").select("u_id", "loaded_at", "date", F.coalesce("gender", F.lit("unknown")).alias("gender"), "text")
    rows = latest_rows(rows, "u_id", "loaded_at").withColumn("text", X.squeeze(F.regexp_replace(F.array_join("text", " "), r"[\n\r]", " ")))
    to = shared_folder(spark)
    files.write_texts(rows, to, "text", "date", "gender", "1950-01-01", "1999-12-31")
    return spark.read.schema("value string, gender string").text(to).groupBy("gender").agg(F.count("*").alias("texts"))


@query(_LATEST + """ select u_id as file_name from s where "date" is null""")
def errors_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The errors of documents through a sidecar file."""
    to = shared_folder(spark)
    files.write_errors(tei.errors_of(tei.extract_speeches(_protocols(spark, folder))), to)
    return spark.read.schema("file_name string, u_id string, error string").json(to).select("file_name")


@query("with w as (select abbreviation from party_abbreviation where abbreviation is not null and trim(abbreviation) <> '') select trim(abbreviation) as word, count(*) > 0 as there from w group by 1")
def word_list_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Abbreviations through a list of words in a text file; each word is read once."""
    to = shared_folder(spark)
    table(spark, folder, "party_abbreviation").select(F.col("abbreviation").alias("value")).where("value is not null").write.text(to)
    return spark.createDataFrame([(w, True) for w in files.word_list(spark, to)], "word string, there boolean")


@query(_LATEST + " select u_id, protocol, who, year from s where n_tokens > 0")
def column_order(spark: SparkSession, folder: str) -> DataFrame:
    """Speeches with words, with a column moved to another place."""
    return TB.move_column(tei.with_words(_plain(spark, folder)).select("protocol", "u_id", "who", "year"), "u_id", 0)


@query(_LATEST + """ select u_id, trim(regexp_replace(lower(who_intro), '[\\s]+', ' ', 'g')) as intro from s where "date" between date '1980-01-01' and date '1989-12-31' and who_intro is not null""")
def squeezed_intros(spark: SparkSession, folder: str) -> DataFrame:
    """Introductions of a decade in small letters with single spaces."""
    rows = table(spark, folder, "speech_index").select("u_id", "loaded_at", "date", "who_intro")
    rows = latest_rows(rows, "u_id", "loaded_at").where(F.col("date").between(*[F.lit(d).cast("date") for d in A.decade_days(1980)]) & F.col("who_intro").isNotNull())
    return rows.select("u_id", X.squeeze(F.lower("who_intro")).alias("intro"))
