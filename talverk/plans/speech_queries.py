"""Queries over the speech table: counts, pivots, shares, word and n-gram statistics, with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talverk.functions import text as X
from talverk.operators import joins as J
from talverk.operators import ngrams as N
from talverk.operators import reports as R
from talverk.operators.latest import latest_rows
from talverk.session import materialize
from talverk.sources.tables import spread, table

GENDERS = ["man", "woman", "unknown"]
#: Stop words of the n-gram queries: frequent words of this corpus, and one of either wildcard form.
STOP_WORDS = ["och", "att", "det", "som", "en", "under", "har*", "*utskottet"]
#: Short n-grams with a low threshold suit the test data; the operators take any.
GRAM, LEAST = 3, 10


def speech(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """One row for each speech, with the columns asked for."""
    columns = {
        "who": F.col("who"), "day": F.col("date"), "protocol": F.col("protocol"), "n_tokens": F.col("n_tokens"), "party_abbrev": F.col("party_abbrev"),
        "gender": F.coalesce("gender", F.lit("unknown")), "year": F.col("year"), "decade": X.decade(F.col("year")), "uncertain": F.col("party_affiliation_uncertain"),
        "text": X.merged_text(F.col("text")), "who_intro": F.col("who_intro"),
    }
    rows = table(spark, folder, "speech_index").select("u_id", "loaded_at", *[columns[n].alias(n) for n in names])
    return latest_rows(rows, "u_id", "loaded_at", spread(rows) if "text" in names else None).drop("loaded_at")


S = """with speech as (
  select u_id, who, "date" as day, protocol, n_tokens, party_abbrev, coalesce(gender, 'unknown') as gender, year, year - year % 10 as decade,
    party_affiliation_uncertain as uncertain, lower(array_to_string(text, ' ')) as text, who_intro
  from speech_index where u_id is not null qualify row_number() over (partition by u_id order by loaded_at desc) = 1)"""
QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(S + " select party_abbrev, decade, cast(sum(n_tokens) as bigint) as tokens from speech where party_abbrev is not null and decade is not null group by all")
def tokens_per_group_decade(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.keyed(speech(spark, folder, "party_abbrev", "decade", "n_tokens"), ["party_abbrev", "decade"])
    return rows.groupBy("party_abbrev", "decade").agg(F.sum("n_tokens").alias("tokens"))


_MULTI = "count(distinct who) as speakers, count(*) as speeches, cast(sum(n_tokens) as bigint) as tokens, case when count(distinct who) > 0 then round_even(cast(sum(n_tokens) as double) / count(distinct who), 2) end as tokens_per_speaker"


@query(S + f" select year, gender, {_MULTI} from speech where year is not null group by year, gender")
def multi_agg_year_gender(spark: SparkSession, folder: str) -> DataFrame:
    return R.multi_aggregate(speech(spark, folder, "year", "gender", "who", "n_tokens"), ["year", "gender"])


@query(S + f" select year, gender, party_abbrev, {_MULTI} from speech where year is not null and party_abbrev is not null group by year, gender, party_abbrev")
def multi_agg_year_gender_party(spark: SparkSession, folder: str) -> DataFrame:
    return R.multi_aggregate(speech(spark, folder, "year", "gender", "party_abbrev", "who", "n_tokens"), ["year", "gender", "party_abbrev"])


def _pivot_sql(measure: str, period: str = "decade", where: str = "true") -> str:
    return S + f" select {period}, " + ", ".join(f"cast(coalesce({measure % f"gender = '{g}'"}, 0) as bigint) as {g}" for g in GENDERS) + f" from speech where {period} is not null and {where} group by {period}"


@query(_pivot_sql("sum(case when %s then n_tokens end)"))
def pivot_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return R.pivot_report(speech(spark, folder, "decade", "gender", "n_tokens"), "tokens", "decade", "gender", GENDERS)


@query(_pivot_sql("count(case when %s then 1 end)"))
def pivot_speeches(spark: SparkSession, folder: str) -> DataFrame:
    return R.pivot_report(speech(spark, folder, "decade", "gender"), "speeches", "decade", "gender", GENDERS)


@query(_pivot_sql("count(distinct case when %s then who end)"))
def pivot_speakers(spark: SparkSession, folder: str) -> DataFrame:
    return R.pivot_report(speech(spark, folder, "decade", "gender", "who"), "speakers", "decade", "gender", GENDERS)


@query(f"select decade, man / nullif(cast(man + woman + unknown as double), 0) as man, woman / nullif(cast(man + woman + unknown as double), 0) as woman, unknown / nullif(cast(man + woman + unknown as double), 0) as unknown from ({_pivot_sql('sum(case when %s then n_tokens end)')})")
def pivot_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return R.pivot_report(speech(spark, folder, "decade", "gender", "n_tokens"), "tokens", "decade", "gender", GENDERS, normalize=True)


@query(_pivot_sql("count(case when %s then 1 end)", "year", "party_abbrev = 'Nf'"))
def pivot_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return R.pivot_report(speech(spark, folder, "year", "party_abbrev", "gender"), "speeches", "year", "party_abbrev", GENDERS, filter_value="Nf", sub_key="gender")


@query(S + " select decade, count(case when who = 'unknown' then 1 end) as part, count(*) as total, count(case when who = 'unknown' then 1 end) / cast(count(*) as double) as share from speech where decade is not null group by decade")
def unknown_share(spark: SparkSession, folder: str) -> DataFrame:
    return R.aligned_share(speech(spark, folder, "decade", "who"), "decade", F.col("who") == "unknown")


@query(S + " select year, quantile_cont(n_tokens, 0.1) as lower, quantile_cont(n_tokens, 0.5) as median, quantile_cont(n_tokens, 0.9) as upper from speech where year is not null group by year")
def quantiles_year(spark: SparkSession, folder: str) -> DataFrame:
    return R.quantiles(speech(spark, folder, "year", "n_tokens"), "year", "n_tokens", 0.1, 0.9)


@query(S + " select year, round(avg(n_tokens), 6) as mean, round(stddev_samp(n_tokens), 6) as std from speech where year is not null group by year")
def mean_std_year(spark: SparkSession, folder: str) -> DataFrame:
    return R.mean_std(speech(spark, folder, "year", "n_tokens"), ["year"], "n_tokens").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(S + " select decade, round(avg(cast(uncertain as double)) * 100, 6) as rate from speech where decade is not null group by decade")
def mean_flag_rate(spark: SparkSession, folder: str) -> DataFrame:
    return R.rate(speech(spark, folder, "decade", "uncertain"), "decade", "uncertain").withColumn("rate", F.round("rate", 6))


@query(S + " select party_abbrev, count(who) as who, count(day) as day, count(protocol) as protocol, count(text) as text from speech where party_abbrev is not null group by party_abbrev")
def nonnull_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.count_not_null(speech(spark, folder, "party_abbrev", "who", "day", "protocol", "text"), "party_abbrev", ["who", "day", "protocol", "text"])


_RANGE = "case when n_tokens between 20 and 200 then '20-200' when n_tokens between 201 and 500 then '201-500' when n_tokens between 501 and 1000 then '501-1000' when n_tokens >= 1001 then '1001-inf' else 'None' end"


def _ranged(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    return speech(spark, folder, "n_tokens", *names).withColumn("token_range", X.token_range(F.col("n_tokens")))


@query(S + f" select {_RANGE} as token_range, count(*) as count, try_cast(case when {_RANGE} <> 'None' then split_part({_RANGE}, '-', 1) end as integer) as sort_key from speech group by all")
def token_range_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _ranged(spark, folder).groupBy("token_range").agg(F.count("*").alias("count")).withColumn("sort_key", X.range_start(F.col("token_range")))


def _share_sql(keys: str, parent: str) -> str:
    where = " and ".join(f"{k} is not null" for k in keys.split(", ") if k != "token_range")
    return S + f", r as (select *, {_RANGE} as token_range from speech), c as (select {keys}, count(*) as count from r where {where} group by all) select *, count / cast(sum(count) over (partition by {parent}) as double) as share from c"


@query(_share_sql("year, token_range", "year"))
def token_range_share(spark: SparkSession, folder: str) -> DataFrame:
    return R.share_of_parent(_ranged(spark, folder, "year"), ["year", "token_range"], ["year"])


@query(_share_sql("year, party_abbrev, token_range", "year, party_abbrev"))
def share_party(spark: SparkSession, folder: str) -> DataFrame:
    return R.share_of_parent(_ranged(spark, folder, "year", "party_abbrev"), ["year", "party_abbrev", "token_range"], ["year", "party_abbrev"])


@query(_share_sql("year, gender, party_abbrev, token_range", "year, gender, party_abbrev"))
def share_party_gender(spark: SparkSession, folder: str) -> DataFrame:
    return R.share_of_parent(_ranged(spark, folder, "year", "gender", "party_abbrev"), ["year", "gender", "party_abbrev", "token_range"], ["year", "gender", "party_abbrev"])


@query(S + " select cast(least(floor(n_tokens / 50.0), 19) as integer) as bin, count(*) as count from speech where n_tokens between 0 and 1000 group by all")
def histogram_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return R.histogram(speech(spark, folder, "n_tokens"), "n_tokens", 0, 1000, 20)


@query(S + " select decade, cast(least(floor((year - 1900) * 40 / 130.0), 39) as integer) as x_bin, cast(least(floor(n_tokens * 40 / 2000.0), 39) as integer) as y_bin, ln(count(*)) as log_count from speech where decade is not null and year between 1900 and 2030 and n_tokens between 0 and 2000 group by all")
def density_2d(spark: SparkSession, folder: str) -> DataFrame:
    return R.density(speech(spark, folder, "decade", "year", "n_tokens"), "year", "n_tokens", (1900.0, 2030.0), (0.0, 2000.0), 40, ["decade"])


@query(S + " select party_abbrev, count(*) as count from speech where party_abbrev is not null group by all")
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.value_counts(speech(spark, folder, "party_abbrev"), ["party_abbrev"])


@query(S + " select party_abbrev, " + ", ".join(f"count(case when gender = '{g}' then 1 end) as {g}" for g in GENDERS) + " from speech where party_abbrev is not null group by all")
def value_counts_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return R.pivot_report(speech(spark, folder, "party_abbrev", "gender"), "speeches", "party_abbrev", "gender", GENDERS)


@query(S + " select who, coalesce(string_agg(distinct party_abbrev, ',' order by party_abbrev), '') as parties from speech where who is not null group by who")
def unique_list_per_group(spark: SparkSession, folder: str) -> DataFrame:
    return R.unique_list(speech(spark, folder, "who", "party_abbrev"), "who", "party_abbrev").select("who", F.array_join("values", ",").alias("parties"))


@query(S + " , f as (select protocol, arg_min(day, u_id) filter (day is not null) as first from speech where protocol is not null group by protocol) select first, count(*) as protocols from f where first is not null group by first")
def first_value_per_group(spark: SparkSession, folder: str) -> DataFrame:
    first = R.first_by(speech(spark, folder, "protocol", "day").where("day is not null"), "protocol", "day", ["u_id"])
    return first.groupBy("first").agg(F.count("*").alias("protocols"))


@query(S + " select day, count(distinct protocol) as protocols from speech where day is not null group by day having count(distinct protocol) > 1")
def multi_protocol_dates(spark: SparkSession, folder: str) -> DataFrame:
    return speech(spark, folder, "day", "protocol").where("day is not null").groupBy("day").agg(F.count_distinct("protocol").alias("protocols")).where("protocols > 1").orderBy("day")


@query(S + " select who, case when min(year) = max(year) then cast(min(year) as varchar) else concat_ws('-', min(year), max(year)) end as years, max(year) - min(year) as span from speech where who is not null and year is not null group by who")
def year_range_string(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.keyed(speech(spark, folder, "who", "year"), ["who", "year"])
    return rows.groupBy("who").agg(F.min("year").alias("lo"), F.max("year").alias("hi")).select("who", X.year_range(F.col("lo"), F.col("hi")).alias("years"), (F.col("hi") - F.col("lo")).alias("span"))


@query(S + " select who, avg(decade) as mean_decade from speech where who is not null and decade is not null group by who")
def mean_decade_order(spark: SparkSession, folder: str) -> DataFrame:
    return R.keyed(speech(spark, folder, "who", "decade"), ["who", "decade"]).groupBy("who").agg(F.avg("decade").alias("mean_decade")).orderBy("mean_decade", "who")


def _firsts(spark: SparkSession, folder: str) -> DataFrame:
    """(u_id, first): the first segment of each speech that has one."""
    rows = table(spark, folder, "speech_index").select("u_id", "loaded_at", F.get("text", F.lit(0)).alias("first"))
    return latest_rows(rows, "u_id", "loaded_at", spread(rows)).select("u_id", "first").where("first is not null")


_F = "with r as (select u_id, text[1] as first from (select *, row_number() over (partition by u_id order by loaded_at desc) as n from speech_index where u_id is not null) where n = 1 and text[1] is not null)"


@query(_F + " select md5(first) as hash, count(*) as count, arg_min(first, u_id) as sample from r group by 1 having count(*) >= 2")
def duplicate_hash(spark: SparkSession, folder: str) -> DataFrame:
    return R.repeats(_firsts(spark, folder), "first", "u_id", 2)


@query(_F + " select u_id, count(*) over (partition by md5(first)) as repeats from r")
def repeats_transform(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(_firsts(spark, folder).select("u_id", F.md5("first").alias("hash")))  # for the count and the rows
    return R.with_group_count(rows, "hash").drop("hash")


# words

_W = S + r", w as (select *, regexp_extract_all(text, '[\p{L}\p{N}_]{2,}') as words, regexp_extract_all(text, '[\p{L}\p{N}_]+') as words1 from speech), t as (select *, case when len(words) > 0 then 100.0 * len(list_distinct(words)) / len(words) end as ttr, case when len(words1) > 0 then len(words1) / cast(greatest(1, len(regexp_extract_all(text, '[.!?]+(\s|\z)'))) as double) + 100.0 * len(list_filter(words1, lambda x: length(x) > 6)) / len(words1) end as lix from w)"


def _measured(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    rows = speech(spark, folder, "text", *names).withColumn("words", X.tokens(F.col("text")))
    return rows.withColumn("ttr", X.ttr(F.col("words"))).withColumn("lix", X.lix(F.col("text"))).drop("words", "text")


@query(_W + " select u_id, round(ttr, 6) as ttr from t")
def ttr_speech(spark: SparkSession, folder: str) -> DataFrame:
    return _measured(spark, folder).select("u_id", F.round("ttr", 6).alias("ttr"))


@query(_W + " select party_abbrev, round(avg(ttr), 6) as mean, round(stddev_samp(ttr), 6) as std from t where party_abbrev is not null group by party_abbrev")
def ttr_stats_group(spark: SparkSession, folder: str) -> DataFrame:
    return R.mean_std(_measured(spark, folder, "party_abbrev"), ["party_abbrev"], "ttr").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(_W + " select year, " + ", ".join(f"round(avg(case when gender = '{g}' then ttr end), 6) as {g}" for g in GENDERS) + " from t where year is not null group by year")
def ttr_pivot_year(spark: SparkSession, folder: str) -> DataFrame:
    wide = _measured(spark, folder, "year", "gender").where("year is not null").groupBy("year").pivot("gender", GENDERS).agg(F.avg("ttr"))
    return wide.select("year", *[F.round(g, 6).alias(g) for g in GENDERS])


@query(_W + f" select decade, party_abbrev, {_RANGE} as token_range, round(avg(ttr), 6) as mean, count(ttr) as speeches from t where decade is not null and party_abbrev is not null group by all")
def ttr_range_decade_party(spark: SparkSession, folder: str) -> DataFrame:
    rows = _measured(spark, folder, "decade", "party_abbrev", "n_tokens").withColumn("token_range", X.token_range(F.col("n_tokens")))
    return R.keyed(rows, ["decade", "party_abbrev"]).groupBy("decade", "party_abbrev", "token_range").agg(F.round(F.avg("ttr"), 6).alias("mean"), F.count("ttr").alias("speeches"))


@query(_W + ", q as (select decade, gender, ttr from t where decade is not null and ttr is not null) select decade, gender, " + ", ".join(f"round(quantile_cont(ttr, {q}), 6) as q{k}" for k, q in enumerate((0, 0.25, 0.5, 0.75, 1))) + " from q group by decade, gender")
def ttr_distribution(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.keyed(_measured(spark, folder, "decade", "gender"), ["decade", "ttr"])
    found = R.exact_quantiles(rows, ["decade", "gender"], "ttr", {f"q{k}": k / 4 for k in range(5)})
    return found.select("decade", "gender", *[F.round(f"q{k}", 6).alias(f"q{k}") for k in range(5)])


@query(_W + ", r as (select decade, u_id, round(ttr, 6) as ttr from t where decade is not null and ttr is not null), a as (select *, row_number() over (partition by decade order by ttr desc, u_id) as rank, 'top' as side from r), b as (select *, row_number() over (partition by decade order by ttr, u_id) as rank, 'bottom' as side from r) select * from (select * from a union all select * from b) where rank <= 50")
def ttr_top_bottom(spark: SparkSession, folder: str) -> DataFrame:
    rows = _measured(spark, folder, "decade").select("decade", "u_id", F.round("ttr", 6).alias("ttr"))
    return R.top_and_bottom(rows, ["decade"], "ttr", "u_id", 50).withColumn("rank", F.col("rank").cast("bigint"))


@query(_W + f", r as (select year, {_RANGE} as token_range, u_id, round(ttr, 6) as ttr from t where year is not null and ttr is not null) select year, token_range, max(case when a = 1 then u_id end) as largest, max(case when b = 1 then u_id end) as smallest from (select *, row_number() over (partition by year, token_range order by ttr desc, u_id) as a, row_number() over (partition by year, token_range order by ttr, u_id) as b from r) group by year, token_range")
def ttr_extremes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _measured(spark, folder, "year", "n_tokens").withColumn("token_range", X.token_range(F.col("n_tokens"))).withColumn("ttr", F.round("ttr", 6))
    return R.extremes(rows, ["year", "token_range"], "ttr", "u_id")


@query(_W + ", r as (select text, count(*) as count from t where ttr > 95 and n_tokens >= 20 group by text) select md5(text) as hash, count from r order by count desc, hash limit 22")
def ttr_repeated_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = speech(spark, folder, "text", "n_tokens").withColumn("ttr", X.ttr(X.tokens(F.col("text")))).where("ttr > 95 and n_tokens >= 20")
    return rows.groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "hash").limit(22)


@query(_W + " select u_id, round(lix, 6) as lix from t")
def lix_speech(spark: SparkSession, folder: str) -> DataFrame:
    return _measured(spark, folder).select("u_id", F.round("lix", 6).alias("lix"))


@query(_W + " select party_abbrev, round(avg(lix), 6) as mean, round(stddev_samp(lix), 6) as std from t where party_abbrev is not null group by party_abbrev")
def lix_group(spark: SparkSession, folder: str) -> DataFrame:
    return R.mean_std(_measured(spark, folder, "party_abbrev"), ["party_abbrev"], "lix").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(_W + ", g as (select party_abbrev, avg(lix) as mean from t where party_abbrev is not null group by party_abbrev) select party_abbrev, round(mean, 6) as mean from g union all select 'Mean of all', round(avg(mean), 6) from g")
def lix_with_overall(spark: SparkSession, folder: str) -> DataFrame:
    return R.with_overall(_measured(spark, folder, "party_abbrev"), "party_abbrev", "lix", "Mean of all").withColumn("mean", F.round("mean", 6))


@query(S + r" select year, cast(sum(length(text) - length(replace(text, ',', ''))) as bigint) as commas, cast(sum((length(text) - length(replace(text, ' - ', ''))) // 3) as bigint) as dashes, cast(sum(length(text) - length(replace(text, ';', ''))) as bigint) as semicolons from speech where year is not null group by year")
def punctuation_year(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return speech(spark, folder, "year", "text").where("year is not null").groupBy("year").agg(F.sum(X.occurrences(t, ",")).alias("commas"), F.sum(X.occurrences(t, " - ")).alias("dashes"), F.sum(X.occurrences(t, ";")).alias("semicolons"))


_ENDS = r"len(list_filter(range(2, length(t) + 1), lambda i: t[i - 1] in ('.', '?') and regexp_matches(t[i], '[\s\x0B\x1c-\x1f\x{85}\p{Z}]') and not coalesce(regexp_full_match(t[i - 4:i - 1], '[\p{L}\p{N}_]\.[\p{L}\p{N}_].'), false) and not regexp_full_match(t[i - 3:i - 1], '[A-Z][a-z]\.')))"
_MARKS = ("sentence", "comma", "dash", "semicolon", "divider")


@query(f"""with p as (select year, n_tokens, array_to_string(text, ' ') as t from (select *, row_number() over (partition by u_id order by loaded_at desc) as n from speech_index where u_id is not null) where n = 1 and year is not null and text is not null),
  c as (select year, n_tokens, 1 + {_ENDS} as sentence, length(t) - length(replace(t, ',', '')) as comma, (length(t) - length(replace(t, ' - ', ''))) // 3 as dash, length(t) - length(replace(t, ';', '')) as semicolon from p),
  y as (select year, cast(sum(n_tokens) as bigint) as tokens, cast(sum(sentence) as bigint) as sentence, cast(sum(comma) as bigint) as comma, cast(sum(dash) as bigint) as dash, cast(sum(semicolon) as bigint) as semicolon, cast(sum(comma + dash + semicolon) as bigint) as divider from c group by year)
  select year, tokens, {', '.join(f'{m} as {m}s, round(tokens / cast(nullif({m}, 0) as double), 6) as tokens_per_{m}' for m in _MARKS)} from y""")
def sentence_punct_year(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences and dividers by year, and tokens for each of them; sentences are split by look-behind."""
    rows = table(spark, folder, "speech_index").select("u_id", "loaded_at", "year", "n_tokens", F.array_join("text", " ").alias("text"))
    rows = latest_rows(rows, "u_id", "loaded_at", spread(rows)).where("year is not null and text is not null")
    t = F.col("text")
    marks = {"sentence": F.size(X.split_sentences(t)), "comma": X.occurrences(t, ","), "dash": X.occurrences(t, " - "), "semicolon": X.occurrences(t, ";")}
    sums = rows.groupBy("year").agg(F.sum("n_tokens").alias("tokens"), *[F.sum(x).alias(m) for m, x in marks.items()]).withColumn("divider", F.col("comma") + F.col("dash") + F.col("semicolon"))
    return sums.select("year", "tokens", *[F.col(m).alias(m + "s") for m in _MARKS], *[F.round(F.try_divide("tokens", m), 6).alias(f"tokens_per_{m}") for m in _MARKS])


def _ttr_ranges(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """Mean TTR of the speeches of each token range, by the keys."""
    rows = R.keyed(_measured(spark, folder, "n_tokens", *keys), list(keys)).withColumn("token_range", X.token_range(F.col("n_tokens"))).where("token_range <> 'None'")
    return rows.groupBy(*keys, "token_range").agg(F.round(F.avg("ttr"), 6).alias("mean"), F.count("ttr").alias("speeches"))


def _ttr_ranges_sql(*keys: str) -> str:
    return _W + f", r as (select *, {_RANGE} as token_range from t) select {', '.join(keys)}, token_range, round(avg(ttr), 6) as mean, count(ttr) as speeches from r where token_range <> 'None' and {' and '.join(f'{k} is not null' for k in keys)} group by all"


@query(_ttr_ranges_sql("year", "gender"))
def ttr_range_year_gender(spark: SparkSession, folder: str) -> DataFrame:
    return _ttr_ranges(spark, folder, "year", "gender")


@query(_ttr_ranges_sql("year", "party_abbrev"))
def ttr_range_year_party(spark: SparkSession, folder: str) -> DataFrame:
    return _ttr_ranges(spark, folder, "year", "party_abbrev")


@query(_ttr_ranges_sql("year"))
def ttr_range_year(spark: SparkSession, folder: str) -> DataFrame:
    return _ttr_ranges(spark, folder, "year")


@query(_W + f", r as (select decade, {_RANGE} as token_range, u_id, round(ttr, 6) as ttr from t where decade is not null and ttr is not null), a as (select *, row_number() over (partition by decade, token_range order by ttr desc, u_id) as rank, 'top' as side from r), b as (select *, row_number() over (partition by decade, token_range order by ttr, u_id) as rank, 'bottom' as side from r) select * from (select * from a union all select * from b) where rank <= 50 and token_range <> 'None'")
def ttr_top_bottom_range(spark: SparkSession, folder: str) -> DataFrame:
    """The speeches with the highest and the lowest TTR of each decade and token range."""
    rows = _measured(spark, folder, "decade", "n_tokens").select("decade", X.token_range(F.col("n_tokens")).alias("token_range"), "u_id", F.round("ttr", 6).alias("ttr")).where("token_range <> 'None'")
    return R.top_and_bottom(rows, ["decade", "token_range"], "ttr", "u_id", 50).withColumn("rank", F.col("rank").cast("bigint"))


@query(_W + " select u_id, round(ttr / 100.0, 8) as ratio from t")
def ttr_ratio_speech(spark: SparkSession, folder: str) -> DataFrame:
    return speech(spark, folder, "text").select("u_id", F.round(X.ttr_ratio(X.tokens(F.col("text"))), 8).alias("ratio"))


@query(S + " select decade, count(distinct who) as values, count(distinct who) + max((who is null)::int) as kinds from speech where decade is not null group by decade")
def distinct_null_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.distinct_with_null(speech(spark, folder, "decade", "who"), "decade", "who")


@query(S + " select u_id, case gender when 'man' then 'M' when 'woman' then 'K' else '?' end as code, cast(decade as varchar) || 's' as decade_label from speech")
def dictionary_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows = speech(spark, folder, "gender", "year")
    return rows.select("u_id", J.looked_up(F.col("gender"), {"man": "M", "woman": "K"}, F.lit("?")).alias("code"), X.decade_label(F.col("year")).alias("decade_label"))


@query(S + ", g as (select year, party_abbrev, round(avg(n_tokens), 6) as value from speech where year is not null and party_abbrev in ('S', 'M', 'Nf') group by all) select y.year, p.party_abbrev, g.value from (select distinct year from g) y cross join (values ('S'), ('M'), ('Nf')) p(party_abbrev) left join g on g.year = y.year and g.party_abbrev = p.party_abbrev")
def party_panels(spark: SparkSession, folder: str) -> DataFrame:
    """Mean length of the speeches of three parties by year, with a row for each party and year of any."""
    return R.panels(speech(spark, folder, "year", "party_abbrev", "n_tokens"), "party_abbrev", "year", ["S", "M", "Nf"], F.round(F.avg("n_tokens"), 6))


_C = _W + ", c as (select party_abbrev, word, count(*) as count from (select party_abbrev, unnest(words) as word from w where party_abbrev is not null) group by all)"


def _counts(spark: SparkSession, folder: str, group: str = "party_abbrev") -> DataFrame:
    return N.word_counts(speech(spark, folder, "text", group), "text", [group])


@query(_C + " select * from c")
def word_counts_group(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder)


@query(_C + " select *, cast(sum(count) over (partition by party_abbrev) as bigint) as total from c qualify row_number() over (partition by party_abbrev order by count desc, word) <= 100")
def top_words(spark: SparkSession, folder: str) -> DataFrame:
    from talverk.operators.joins import group_total

    return R.top_k(group_total(_counts(spark, folder), "party_abbrev", "count", "total"), ["party_abbrev"], 100, [F.desc("count"), F.col("word")]).drop("rank")


@query(_C + " select *, round(sum(count) over (partition by party_abbrev order by count desc, word rows unbounded preceding) * 100.0 / sum(count) over (partition by party_abbrev), 6) as cumulative from c")
def cumulative_words(spark: SparkSession, folder: str) -> DataFrame:
    return R.cumulative_share(_counts(spark, folder), ["party_abbrev"], "word", "count").withColumn("cumulative", F.round("cumulative", 6))


@query(_W + ", c as (select decade, word, count(*) as count from (select decade, unnest(words) as word from w where decade is not null) where length(word) >= 16 group by all) select * from c qualify row_number() over (partition by decade order by count desc, word) <= 1000")
def long_words_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = _counts(spark, folder, "decade").where(F.length("word") >= 16)
    return R.top_k(rows, ["decade"], 1000, [F.desc("count"), F.col("word")]).drop("rank")


@query(_C + " select party_abbrev, count(*) as vocabulary, count(case when count > 1 then 1 end) as repeated from c group by party_abbrev")
def unique_words_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder).groupBy("party_abbrev").agg(F.count("*").alias("vocabulary"), F.count_if(F.col("count") > 1).alias("repeated"))


@query(_C + ", h as (select party_abbrev, cast(length(word) as integer) as length, cast(sum(count) as bigint) as count from c group by all) select *, round(count * 100.0 / sum(count) over (partition by party_abbrev), 6) as percentage from h")
def word_length_hist(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    counts = _counts(spark, folder).groupBy("party_abbrev", F.length("word").alias("length")).agg(F.sum("count").alias("count"))
    return counts.withColumn("percentage", F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy("party_abbrev")), 6))


# n-grams

_G = _W + f", g as (select u_id, party_abbrev, decade, unnest(list_transform(range(1, len(words) - {GRAM} + 2), lambda i: array_to_string(words[i:i + {GRAM - 1}], ' '))) as ngram from w where len(words) >= {GRAM})"
_A = _G + f", allowed as (select ngram, count(*) as corpus_count from g group by ngram having count(*) >= {LEAST}), d as (select u_id, ngram, count(*) as cnt from g semi join allowed using (ngram) group by all)"


def _runs(spark: SparkSession, folder: str, *names: str, stop: list[str] | None = None) -> DataFrame:
    return N.document_ngrams(speech(spark, folder, "text", *names), "text", GRAM, ["u_id", *names], stop)


@query(_A + " select * from allowed")
def ngram_allowed(spark: SparkSession, folder: str) -> DataFrame:
    return N.allowed(_runs(spark, folder), LEAST)


@query(_G + " select count(*) as runs, count(distinct ngram) as kinds, count(distinct u_id) as speeches from g")
def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).agg(F.count("*").alias("runs"), F.count_distinct("ngram").alias("kinds"), F.count_distinct("u_id").alias("speeches"))


@query(_A + " select * from d")
def ngram_doc_counts(spark: SparkSession, folder: str) -> DataFrame:
    return N.document_counts(_runs(spark, folder), "u_id", LEAST)


@query(_A + " select ngram, count(*) as df, 1.0 / count(*) as inverse, cast(sum(cnt) as bigint) as total from d group by ngram")
def ngram_df(spark: SparkSession, folder: str) -> DataFrame:
    return N.document_frequencies(N.document_counts(_runs(spark, folder), "u_id", LEAST)).withColumn("inverse", F.col("inverse"))


@query(_A + " select d.u_id, d.ngram, d.cnt, s.who, s.year from d join speech s using (u_id) where ngram = 'trots att varken'")
def ngram_usage(spark: SparkSession, folder: str) -> DataFrame:
    return N.usage(N.document_counts(_runs(spark, folder), "u_id", LEAST), speech(spark, folder, "who", "year"), "u_id", "trots att varken").select("u_id", "ngram", "cnt", "who", "year")


@query(_W + f", g as (select unnest(list_transform(range(1, len(words1) - 1), lambda i: array_to_string(words1[i:i + 2], ' '))) as ngram from w where len(words1) >= 3) select ngram, count(*) as corpus_count from g group by ngram having count(*) >= {LEAST}")
def trigrams_short_words(spark: SparkSession, folder: str) -> DataFrame:
    """Trigrams of words of any length."""
    return N.allowed(N.document_ngrams(speech(spark, folder, "text"), "text", 3, ["u_id"], pattern=X.WORD1), LEAST)


@query(_A + " select * from allowed where contains(ngram, 'skatt')")
def ngram_contains(spark: SparkSession, folder: str) -> DataFrame:
    return N.containing(N.allowed(_runs(spark, folder), LEAST), "skatt")


_PLAIN = ", ".join(f"'{w}'" for w in STOP_WORDS if "*" not in w)


@query(_G + f" select ngram, count(*) as corpus_count from g where not list_bool_or(list_transform(string_split(ngram, ' '), lambda x: x in ({_PLAIN}))) group by ngram having count(*) >= {LEAST}")
def ngram_stopwords(spark: SparkSession, folder: str) -> DataFrame:
    return N.allowed(_runs(spark, folder, stop=[w for w in STOP_WORDS if "*" not in w]), LEAST)


@query(_G + f" select ngram, count(*) as corpus_count from g where not list_bool_or(list_transform(string_split(ngram, ' '), lambda x: x in ({_PLAIN}) or starts_with(x, 'har') or ends_with(x, 'utskottet'))) group by ngram having count(*) >= {LEAST}")
def ngram_wildcard_stop(spark: SparkSession, folder: str) -> DataFrame:
    return N.allowed(_runs(spark, folder, stop=STOP_WORDS), LEAST)


def _tfidf_sql(order: str, idf: str = "ln((n + 1) / (df + 1.0))") -> str:
    return (
        _G
        + f""", z as (select party_abbrev, cast(floor(sum(coalesce(len(words), 0)) / {GRAM}.0) as bigint) as total_ngrams from w where party_abbrev is not null group by party_abbrev),
        r as (select party_abbrev, ngram, count(*) as raw_count from g where party_abbrev is not null group by all),
        k as (select *, cast(sum(raw_count) over (partition by ngram) as bigint) as corpus_count, count(*) over (partition by ngram) as df from r qualify sum(raw_count) over (partition by ngram) >= {LEAST}),
        i as (select k.*, z.total_ngrams, {idf} as idf, raw_count / nullif(cast(total_ngrams as double), 0) as tf from k join z using (party_abbrev), (select count(*) as n from z)),
        f as (select *, tf * idf as tfidf, raw_count * idf as count_idf from i)
        select party_abbrev, ngram, raw_count, corpus_count, df, total_ngrams, round(tfidf, 9) as tfidf, round(count_idf, 6) as count_idf, row_number() over (partition by party_abbrev order by round({order}, 12) desc, ngram) as rank from f
        qualify row_number() over (partition by party_abbrev order by round({order}, 12) desc, ngram) <= 20"""
    )


def _tfidf(spark: SparkSession, folder: str, sort_by: str, prefix: str | None = None) -> DataFrame:
    scored = N.group_tfidf(speech(spark, folder, "text", "party_abbrev"), "text", ["party_abbrev"], GRAM, LEAST, prefix=prefix)
    best = N.top_ngrams(scored, ["party_abbrev"], 20, sort_by)
    return best.select("party_abbrev", "ngram", "raw_count", "corpus_count", "df", "total_ngrams", F.round("tfidf", 9).alias("tfidf"), F.round("count_idf", 6).alias("count_idf"), F.col("rank").cast("bigint").alias("rank"))


@query(_tfidf_sql("tfidf"))
def tfidf_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _tfidf(spark, folder, "tfidf")


@query(_tfidf_sql("raw_count"))
def tfidf_by_count(spark: SparkSession, folder: str) -> DataFrame:
    return _tfidf(spark, folder, "raw_count")


@query(_tfidf_sql("count_idf"))
def tfidf_by_countidf(spark: SparkSession, folder: str) -> DataFrame:
    return _tfidf(spark, folder, "count_idf")


@query(_tfidf_sql("tfidf", "case when starts_with(ngram, 'att ') then ln((n + 1) / (df + 1.0)) else 0.0 end"))
def tfidf_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return _tfidf(spark, folder, "tfidf", "att")


@query(_A + ", b as (select ngram, count(*) as df, cast(sum(cnt) as bigint) as total from d group by ngram), z as (select party_abbrev, sum(coalesce(len(words), 0)) as size from w where party_abbrev is not null group by all), f as (select party_abbrev, ngram, cast(sum(cnt) as bigint) as tf from d join speech using (u_id) where party_abbrev is not null group by all) select party_abbrev, ngram, tf, df, total, round(tf / cast(df as double), 6) as tfidf, round(tf / cast(df as double) / size, 12) as corrected from f join b using (ngram) join z using (party_abbrev)")
def tfidf_legacy(spark: SparkSession, folder: str) -> DataFrame:
    rows = speech(spark, folder, "text", "party_abbrev")
    counts = N.document_counts(N.document_ngrams(rows, "text", GRAM, ["u_id"]), "u_id", LEAST)
    return N.legacy_tfidf(counts, rows, "u_id", "text", "party_abbrev").withColumns({"tfidf": F.round("tfidf", 6), "corrected": F.round("corrected", 12)})


_U = _A + ", u as (select distinct ngram, decade, party_abbrev as p from d join speech using (u_id) where decade is not null and party_abbrev is not null), x as (select ngram, decade, string_agg(p, ', ' order by p) as ps from u group by all)"


@query(_U + " select ngram, string_agg(decade || ': ' || ps, ' ' order by decade) as used_by from x group by ngram")
def ngram_used_by(spark: SparkSession, folder: str) -> DataFrame:
    return _used(spark, folder).select("ngram", "used_by")


@query(_U + ", y as (select ngram, p, min(decade) as first from u group by all), a as (select ngram, string_agg(p, ', ' order by first, p) as by_appearance from y group by ngram) select ngram, string_agg(decade || ' - (' || ps || ')', ', ' order by decade) as used_by_old, any_value(by_appearance) as by_appearance from x join a using (ngram) group by ngram")
def ngram_used_by_legacy(spark: SparkSession, folder: str) -> DataFrame:
    return _used(spark, folder).select("ngram", "used_by_old", "by_appearance")


def _used(spark: SparkSession, folder: str) -> DataFrame:
    return N.used_by(_runs(spark, folder, "decade", "party_abbrev"), "decade", "party_abbrev", LEAST)


@query(_A + " select ngram, corpus_count as in_corpus, cast(0 as bigint) as in_documents from allowed where false")
def ngram_totals_differ(spark: SparkSession, folder: str) -> DataFrame:
    """An assertion: no rows."""
    runs = _runs(spark, folder)
    return N.totals_differ(runs, N.document_counts(runs, "u_id", LEAST))


@query(_G + f", r as (select gender, ngram, count(*) as uses from g join (select u_id, gender from speech) s using (u_id) group by all) select gender, ngram, uses, round(uses / cast(sum(uses) over (partition by ngram) as double), 9) as share from r qualify sum(uses) over (partition by ngram) >= {LEAST}")
def ngram_group_usages(spark: SparkSession, folder: str) -> DataFrame:
    return N.group_usages(_runs(spark, folder, "gender"), "gender", LEAST).withColumn("share", F.round("share", 9))


@query(S + r" select year, cast(sum(n_tokens) as bigint) as tokens, round(sum(n_tokens) / cast(nullif(sum(length(text) - length(replace(text, ',', ''))), 0) as double), 6) as tokens_per_comma, round(sum(n_tokens) / cast(nullif(sum(length(text) - length(replace(text, ';', ''))), 0) as double), 6) as tokens_per_semicolon from speech where year is not null group by year")
def tokens_per_mark_year(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    out = speech(spark, folder, "year", "text", "n_tokens").where("year is not null").groupBy("year").agg(F.sum("n_tokens").alias("tokens"), F.sum(X.occurrences(t, ",")).alias("c"), F.sum(X.occurrences(t, ";")).alias("s"))
    return out.select("year", "tokens", F.round(F.try_divide("tokens", "c"), 6).alias("tokens_per_comma"), F.round(F.try_divide("tokens", "s"), 6).alias("tokens_per_semicolon"))


@query(S + r" select u_id, cast(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) as integer) as tokens from speech")
def token_count_speech(spark: SparkSession, folder: str) -> DataFrame:
    return speech(spark, folder, "text").select("u_id", X.token_count(F.col("text")).alias("tokens"))


# filters on the introduction

@query(S + " select u_id, who_intro from speech where contains(lower(who_intro), 'herr') is false and len(regexp_split_to_array(who_intro, '\\s+')) < 3")
def intro_filter(spark: SparkSession, folder: str) -> DataFrame:
    return speech(spark, folder, "who_intro").where(~F.contains(F.lower("who_intro"), F.lit("herr")) & (F.size(F.split("who_intro", r"\s+")) < 3))


@query(S + " select u_id, cast(length(who_intro) as integer) as length from speech where length(who_intro) > 20")
def intro_length(spark: SparkSession, folder: str) -> DataFrame:
    return speech(spark, folder, "who_intro").where(F.length("who_intro") > 20).select("u_id", F.length("who_intro").alias("length"))


@query(S + " select u_id, upper(who_intro[1]) || lower(who_intro[2:]) as title from speech where who_intro is not null")
def capitalize(spark: SparkSession, folder: str) -> DataFrame:
    return speech(spark, folder, "who_intro").where("who_intro is not null").select("u_id", X.capitalize(F.col("who_intro")).alias("title"))
