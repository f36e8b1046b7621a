import datetime
import random

from pyspark.sql import functions as F

from talverk.functions.dates import first_day, last_day
from talverk.operators import asof

D, T = datetime.date, datetime.datetime
VERSIONS = "aff_id long, who string, party string, start string, end string, recorded timestamp, entity string, day int"


def brute(versions, who, day):
    held = {}
    for r in versions:
        if r["recorded"].date() <= day and (r["aff_id"] not in held or held[r["aff_id"]]["recorded"] < r["recorded"]):
            held[r["aff_id"]] = r
    good = [r for r in held.values() if r["who"] == who and (not r["start"] or r["start"] <= str(day)) and (not r["end"] or r["end"] >= str(day))]
    return max(good, key=lambda r: r["recorded"])["party"] if good else None


def answer(spark, versions, events):
    v = spark.createDataFrame(versions, VERSIONS)
    e = spark.createDataFrame(events, "who string, date date, entity string")
    return {(r["who"], r["date"]): r["party"] for r in asof.attributes_at_event_time(e, "who", "date", {"party": held(v, "party", "party")}).collect()}


def held(versions, attribute, column):
    return asof.held_values(versions, attribute, F.col(column), record="aff_id", recorded="recorded", start=first_day(F.col("start")), end=last_day(F.col("end")), entity="who")


def test_against_brute_force(spark):
    rng = random.Random(4)
    day = lambda: D(1930, 1, 1) + datetime.timedelta(rng.randrange(20_000))
    versions = []
    for k in range(400):
        at = T.combine(day(), datetime.time()) + datetime.timedelta(seconds=rng.randrange(86_400) + k / 1e3)
        a, b = sorted((day(), day()))
        versions.append({"aff_id": rng.randrange(150), "who": f"w{rng.randrange(12)}", "party": rng.choice("abcd"), "start": rng.choice([None, str(a)]), "end": rng.choice([None, str(b)]), "recorded": at, "entity": "x", "day": 1})
    events = [(f"w{rng.randrange(14)}", day(), "e") for _ in range(600)]
    got = answer(spark, versions, events)
    assert len(got) == len(set(events))
    for who, d, _ in events:
        assert got[who, d] == brute(versions, who, d), (who, d)


def test_edges(spark):
    at = T(1990, 1, 1, 12)
    versions = [
        {"aff_id": 1, "who": "a", "party": "x", "start": "1990", "end": None, "recorded": at, "entity": None, "day": None},
        {"aff_id": 1, "who": "a", "party": "x", "start": "1990", "end": None, "recorded": at, "entity": None, "day": None},
        {"aff_id": 1, "who": "a", "party": "y", "start": "1990", "end": "1990-06", "recorded": T(1991, 1, 1), "entity": None, "day": None},
        {"aff_id": None, "who": "a", "party": "z", "start": None, "end": None, "recorded": at, "entity": None, "day": None},
        {"aff_id": 2, "who": None, "party": "z", "start": None, "end": None, "recorded": at, "entity": None, "day": None},
        {"aff_id": 3, "who": "b", "party": None, "start": None, "end": None, "recorded": at, "entity": None, "day": None},
        {"aff_id": 4, "who": "c", "party": "late", "start": "1980", "end": "1985", "recorded": T(1995, 5, 5), "entity": None, "day": None},
    ]
    events = [("a", D(1989, 12, 31), ""), ("a", D(1990, 1, 1), ""), ("a", D(1990, 12, 31), ""), ("a", D(1991, 1, 1), ""), ("b", D(1999, 1, 1), ""), ("c", D(1982, 1, 1), ""), (None, D(1999, 1, 1), ""), ("a", None, "")]
    got = answer(spark, versions, events)
    assert got == {("a", D(1989, 12, 31)): None, ("a", D(1990, 1, 1)): "x", ("a", D(1990, 12, 31)): "x", ("a", D(1991, 1, 1)): None, ("b", D(1999, 1, 1)): None, ("c", D(1982, 1, 1)): None}
    assert answer(spark, [], events[:2]) == {("a", D(1989, 12, 31)): None, ("a", D(1990, 1, 1)): None}
    assert answer(spark, versions, []) == {}


def test_registers_that_change_at_other_times(spark):
    row = lambda k, value, start, recorded: {"aff_id": k, "who": "a", "party": value, "start": start, "end": None, "recorded": recorded, "entity": None, "day": None}
    parties = [row(1, "x", "1990", T(1990, 5, 1)), row(1, "y", "1990", T(1994, 1, 1)), row(2, "z", "1996", T(1996, 3, 1))]
    roles = [row(1, "member", "1985", T(1992, 1, 1)), row(2, "chair", "1993", T(1995, 7, 1))]  # chair since 1993, known since 1995
    registers = {"party": held(spark.createDataFrame(parties, VERSIONS), "party", "party"), "role": held(spark.createDataFrame(roles, VERSIONS), "role", "party")}
    days = [D(1990, 4, 30), D(1990, 5, 1), D(1992, 1, 1), D(1994, 1, 1), D(1995, 6, 30), D(1995, 7, 1), D(1996, 3, 1)]
    events = spark.createDataFrame([("a", d) for d in days] + [("nobody", days[0])], "who string, date date")
    got = {(r["who"], r["date"]): (r["party"], r["role"]) for r in asof.attributes_at_event_time(events, "who", "date", registers).collect()}
    assert [got["a", d] for d in days] == [(None, None), ("x", None), ("x", "member"), ("y", "member"), ("y", "member"), ("y", "chair"), ("z", "chair")]
    assert got["nobody", days[0]] == (None, None)
    # each attribute has what it has alone, whatever the other register does
    for name, register in registers.items():
        alone = {(r["who"], r["date"]): r[name] for r in asof.attributes_at_event_time(events, "who", "date", {name: register}).collect()}
        assert alone == {k: v[name == "role"] for k, v in got.items()}
