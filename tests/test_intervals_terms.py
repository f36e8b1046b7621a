import datetime
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from talverk.functions.dates import first_day, last_day
from talverk.operators import intervals, termstats
from talverk.operators.latest import latest_rows

D = datetime.date


def test_partial_dates(spark):
    texts = ["2020", "2020-02", "2019-02", "2020-01-05", "2020-13", "2020-02-30", "1/4 1985", "", " 2020", "2020\n", None, "19??"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: (r[1], r[2]) for r in df.select("t", first_day(F.col("t")), last_day(F.col("t"))).collect()}
    assert got["2020"] == (D(2020, 1, 1), D(2020, 12, 31))
    assert got["2020-02"] == (D(2020, 2, 1), D(2020, 2, 29)) and got["2019-02"][1] == D(2019, 2, 28)
    assert got["2020-01-05"] == (D(2020, 1, 5), D(2020, 1, 5))
    assert all(got[t] == (None, None) for t in texts[4:])


def periods(spark, rows):
    df = spark.createDataFrame(rows, "who string, lo date, hi date, entity string, part int")
    return sorted(tuple(r) for r in intervals.periods_and_gaps(intervals.disjoint_periods(df, "who", F.col("lo"), F.col("hi")), "who").collect())


def test_periods_against_days(spark):
    rng, base, rows = random.Random(7), D(1999, 11, 1), []
    for _ in range(300):
        lo = rng.randrange(1500)
        rows.append((f"w{rng.randrange(5)}", base + datetime.timedelta(lo), base + datetime.timedelta(lo + rng.randrange(-3, 25)), "x", 1))
    expected = []
    for who in {r[0] for r in rows}:
        days = sorted({r[1] + datetime.timedelta(k) for r in rows if r[0] == who for k in range((r[2] - r[1]).days + 1)})
        runs = []
        for d in days:
            if runs and d == runs[-1][1] + datetime.timedelta(1):
                runs[-1][1] = d
            else:
                runs.append([d, d])
        expected += [(who, "period", str(a), str(b)) for a, b in runs]
        expected += [(who, "gap", str(x[1] + datetime.timedelta(1)), str(y[0] - datetime.timedelta(1))) for x, y in zip(runs, runs[1:])]
    assert periods(spark, rows + rows[:50]) == sorted(expected)


def test_period_edges(spark):
    assert periods(spark, []) == []
    rows = [(None, D(2000, 1, 1), D(2000, 1, 2), "", 1), ("a", None, D(2000, 1, 2), "", 1), ("a", D(2000, 1, 1), None, "", 1), ("a", D(2000, 1, 2), D(2000, 1, 1), "", 1)]
    assert periods(spark, rows) == []
    rows = [("a", D(2000, 12, 31), D(2000, 12, 31), "", 1), ("a", D(2001, 1, 1), D(2001, 1, 1), "", 1), ("a", D(2001, 1, 3), D(2001, 1, 3), "", 1)]
    assert periods(spark, rows) == [("a", "gap", "2001-01-02", "2001-01-02"), ("a", "period", "2000-12-31", "2001-01-01"), ("a", "period", "2001-01-03", "2001-01-03")]


def test_terms(spark):
    rows = [
        (1, "u1", "Och", 2, "2024-01-01"), (2, "u2", "och ", 1, "2024-01-01"), (2, "u2", "och", 5, "2024-01-02"), (3, "u3", "o­ch", None, "2024-01-01"),
        (4, "u1", "å", 1, "2024-01-01"), (5, "u1", "å", 4, "2024-01-01"), (6, "u1", None, 1, "2024-01-01"), (7, "u1", " \t", 1, "2024-01-01"),
        (8, None, "och", 10, "2024-01-01"), (None, "u4", "x" * 100_000, 1, "2024-01-01"), (None, "u4", "x" * 100_000, 1, "2024-01-01"),
    ]
    df = spark.createDataFrame(rows, "id long, u string, w string, n int, at string").withColumn("record", F.lit("clash"))
    kept = termstats.latest_delivery(df, "id", "at", ["u", "w", "n"])
    got = {r["term"]: (r["occurrences"], r["records"]) for r in termstats.term_statistics(kept, "u", "w", "n").collect()}
    assert got == {"och": (17, 3), "å": (5, 1), "x" * 100_000: (2, 1)}
    total = df.agg(F.count_distinct("u"))
    marks = {r["term"][:3]: r["mark"] for r in termstats.mark_terms(termstats.term_statistics(kept, "u", "w", "n"), total, 2, 0.5).collect()}
    assert marks == {"och": "common", "å": "rare", "xxx": "rare"}
    assert termstats.term_statistics(kept.limit(0), "u", "w", "n").count() == 0


def test_terms_many_records(spark):
    df = spark.range(5000).select((F.col("id") % 700).cast("string").alias("u"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("w"), F.lit(1).alias("n"))
    got = {r["term"]: (r["occurrences"], r["records"]) for r in termstats.term_statistics(df, "u", "w", "n", groups=3).collect()}
    pairs = {(k % 700, "a" if k % 3 == 0 else "b") for k in range(5000)}
    assert got == {w: (sum(1 for k in range(5000) if ("a" if k % 3 == 0 else "b") == w), sum(1 for p in pairs if p[1] == w)) for w in "ab"}


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, None), (None, 9, "n"), ("c", None, "q")], "k string, v int, count string")
    assert sorted(map(tuple, latest_rows(df, "k", "v").collect())) == [("a", 2, "z"), ("b", 1, None), ("c", None, "q")]
    assert latest_rows(df.limit(0), "k", "v").count() == 0
    df = df.withColumn("_n", F.lit(1))
    assert latest_rows(df, "k", "v").count() == 3
    rows = spark.range(1000).select((F.col("id") % 400).alias("k"), F.col("id").alias("v"), F.lit("x").alias("t"))
    assert {r["k"]: r["v"] for r in latest_rows(rows, "k", "v").collect()} == {k: max(v for v in range(k, 1000, 400)) for k in range(400)}


def test_bitmaps():
    rng = random.Random(3)
    for size in (0, 1, 50, 4095, 4096, 5000, 65_536):
        a, b = (np.array(sorted(rng.sample(range(65_536), size)), np.uint16) for _ in range(2))
        assert (termstats.unpack(termstats.pack(a)) == a).all() and termstats.cardinality(termstats.pack(a)) == size
        both = termstats.union([termstats.pack(a), termstats.pack(b), termstats.pack(a[:3])])
        assert set(termstats.unpack(both).tolist()) == set(a.tolist()) | set(b.tolist()) and termstats.cardinality(both) == len(set(a.tolist()) | set(b.tolist()))


def test_repeated_numbers(spark):
    rng = random.Random(5)
    numbers = [rng.choice([rng.randrange(3000), rng.randrange(-(2**62), 2**62), -1]) for _ in range(4000)]
    df = spark.createDataFrame([(n,) for n in numbers] + [(None,), (None,)], "high long").repartition(5)
    assert sorted(r[0] for r in termstats.repeated_numbers(df, "high").collect()) == sorted(n for n, k in Counter(numbers).items() if k > 1)
    assert termstats.repeated_numbers(df.limit(0), "high").count() == 0


def test_hot_term_and_record(spark, monkeypatch):
    monkeypatch.setattr(termstats, "POSTINGS", 5000)
    df = spark.range(200_000).select(F.concat(F.lit("u"), F.col("id") % 90_000).alias("u"), F.when(F.col("id") % 3 == 0, "Och").when(F.col("id") % 3 == 1, "och").otherwise(F.concat(F.lit("w"), F.col("id") % 11)).alias("w"), F.lit(2).alias("n"))
    hot = df.limit(70_000).withColumn("u", F.lit("one"))
    rows = df.unionByName(hot)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in termstats.term_statistics(rows, "u", "w", "n").collect()}
    want = rows.groupBy(F.lower("w").alias("w")).agg(F.sum("n"), F.count_distinct("u")).collect()
    assert got == {r[0]: (r[1], r[2]) for r in want}
