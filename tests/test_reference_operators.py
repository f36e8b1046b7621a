import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from talverk.functions import text as X
from talverk.operators import affiliation as A
from talverk.operators import joins as J
from talverk.operators import ngrams as N
from talverk.operators import reports as R
from talverk.operators import tables as TB
from talverk.sources import files, tei
from talverk.streaming import speeches as ST

D = datetime.date


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression).first()[0]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, "åäö _a1 x på ét", X.tokens(t)) == ["åäö", "_a1", "på"]
    assert one(spark, "", X.ttr(X.tokens(t))) is None and one(spark, "", X.ttr(X.tokens(t), -1.0)) == -1.0
    assert one(spark, "aa bb aa cc", X.ttr(X.tokens(t))) == 75.0
    assert one(spark, "one two threefour. five! six", X.lix(t)) == pytest.approx(5 / 2 + 20)
    assert one(spark, "aa bb cc", X.ngrams(X.tokens(t), 2)) == ["aa bb", "bb cc"]
    assert one(spark, "aa", X.ngrams(X.tokens(t), 2)) == [] and one(spark, "aa bb", X.ngrams(X.tokens(t), 2)) == ["aa bb"]
    assert one(spark, "a - b - c", X.occurrences(t, " - ")) == 2
    assert one(spark, "Ab. cd? Ef", F.size(X.split_sentences(t))) == 2
    assert one(spark, "eLLER annat", X.capitalize(t)) == "Eller annat"
    assert one(spark, " a \n b\t", X.squeeze(t)) == "a b"
    assert one(spark, "prot-1933--031", X.protocol_year(t)) == 1933 and one(spark, "x", X.protocol_year(t)) is None
    assert one(spark, "150", X.token_range(t.cast("int"), numbered=True)) == "1: 20-200" and one(spark, "5", X.token_range(t.cast("int"))) == "None"


AFF = "id string, party string, start date, end date, row_idx int"


def test_cascade_branches(spark):
    aff = [
        ("one", "a", None, None, 1), ("perfect", "a", D(2000, 1, 1), D(2001, 1, 1), 2), ("perfect", "b", D(2002, 1, 1), D(2003, 1, 1), 3),
        ("party", "a", D(1990, 1, 1), D(1991, 1, 1), 4), ("party", "a", D(1992, 1, 1), None, 5), ("guess", "a", D(1990, 1, 1), D(2010, 1, 1), 6),
        ("guess", "b", D(1990, 1, 1), D(2010, 1, 1), 7), ("start", "a", D(1990, 1, 1), D(1991, 1, 1), 8), ("start", "b", D(2000, 9, 1), None, 9),
        ("end", "a", D(1980, 1, 1), D(1999, 1, 1), 10), ("end", "b", D(1981, 1, 1), D(1990, 1, 1), 11), ("null", "a", None, None, 12), ("null", "b", None, None, 13),
    ]
    day = D(2000, 6, 1)
    asked = spark.createDataFrame([(w, day) for w in ("unknown", "nobody", "one", "perfect", "party", "guess", "start", "end", "null")] + [(None, day), ("one", None)], "who string, date date")
    got = {r["who"]: (r["party"], r["uncertain"]) for r in A.affiliation_on_date(asked, spark.createDataFrame(aff, AFF)).collect()}
    assert got == {"unknown": ("unknown", False), "nobody": ("unknown_missing", False), "one": ("a", False), "perfect": ("a", False), "party": ("a", False), "guess": ("b", True), "start": ("b", True), "end": ("a", True), "null": ("a", True)}


def test_overlaps(spark):
    rows = [("p", "a", D(2000, 1, 1), D(2001, 1, 1), 1), ("p", "b", D(2001, 1, 1), None, 2), ("p", "c", None, D(2000, 6, 1), 3), ("q", "a", D(2000, 1, 1), D(2002, 1, 1), 4), ("q", "a", D(2000, 1, 1), D(2002, 1, 1), 5)]
    df = spark.createDataFrame(rows, AFF)
    assert [tuple(r) for r in A.overlap_hulls(df, "2024-12-31").collect()] == [("p", "a", "c", D(2000, 1, 1), D(2000, 6, 1))]
    assert {r["row_idx"]: r["overlaps"] for r in A.overlap_flags(df).collect()} == {1: False, 2: False, 3: False, 4: False, 5: True}
    assert [tuple(r) for r in A.undefined_timespans(df).collect()] == [("q", 2)]


def test_persons(spark):
    rows = [("a", None, "x", None, "2"), ("a", "1950", None, "man", "1"), ("b", "1950", None, None, None), ("b", "1950-01-01", None, None, None), (None, "1", None, None, None)]
    df = spark.createDataFrame(rows, "id string, born string, dead string, gender string, riksdagen_id string")
    assert sorted(map(tuple, A.consolidate_persons(df).collect())) == [("a", None, "x", "man", "1"), ("b", "1950", None, None, None)]
    assert {r["id"]: r["born"] for r in A.consolidate_persons(df, prefer="longest").collect()} == {"a": "1950", "b": "1950-01-01"}


def test_tfidf(spark):
    df = spark.createDataFrame([("g", "aa bb cc aa bb"), ("h", "aa bb"), ("i", ""), (None, "aa bb")], "party string, text string")
    got = {(r["party"], r["ngram"]): r for r in N.group_tfidf(df, "text", ["party"], 2, 1).collect()}
    assert got["g", "aa bb"]["raw_count"] == 2 and got["g", "aa bb"]["corpus_count"] == 3 and got["g", "aa bb"]["total_ngrams"] == 2
    assert got["g", "bb cc"]["tfidf"] == pytest.approx(0.5 * 0.6931471805599453) and ("i", "aa bb") not in got
    with pytest.raises(ValueError):
        N.top_ngrams(df, ["party"], 1, "x")
    stopped = N.document_ngrams(df, "text", 2, ["party"], ["c*", "*zz"])
    assert {r["ngram"] for r in stopped.collect()} == {"aa bb"}


def test_reports(spark):
    df = spark.createDataFrame([(1990, "man", "a", 10), (1990, "woman", "a", 20), (1990, None, "b", 5), (None, "man", "c", 1), (1991, "man", None, 0)], "year int, gender string, who string, n_tokens int")
    wide = {r["year"]: r for r in R.pivot_report(df, "tokens", "year", "gender", ["man", "woman"], normalize=True).collect()}
    assert wide[1990]["man"] == pytest.approx(1 / 3) and wide[1991]["man"] is None and None not in wide
    assert R.multi_aggregate(df, ["year"]).count() == 2
    assert {r["bin"]: r["count"] for r in R.histogram(df, "n_tokens", 0, 20, 4).collect()} == {0: 2, 1: 1, 2: 1, 3: 1}
    counts = spark.createDataFrame([("g", "b", 1), ("g", "a", 1), ("g", "c", 2)], "g string, w string, n int")
    assert [r["cumulative"] for r in R.cumulative_share(counts, ["g"], "w", "n").orderBy("cumulative").collect()] == [50.0, 75.0, 100.0]
    assert R.repeats(df.limit(0).withColumn("t", F.lit("x")), "t", "who", 1).count() == 0


def test_joins(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([("x", 3), ("x", 4), (None, 5)], "k string, v int")
    assert J.join_on(a, b, "k").count() == 3 and J.join_on(a, b, "k", null_matches=True).where("v_r = 5").count() == 1
    assert [tuple(r) for r in J.fan_out(b, "k").collect()] == [("x", 2)]
    placed = J.positional_join(b, a, ["v"], ["v"])
    assert sorted((r["v"], r["v_r"]) for r in placed.collect()) == [(3, 1), (4, 2), (5, None)] or placed.where("v_r is null").count() == 1
    assert {r["value"]: r["rows"] for r in J.found_and_missing(b, "k", ["x", "y"]).collect()} == {"x": 2, "y": 0}


def test_types(spark):
    df = spark.createDataFrame([(0, 300, 1.0, "a"), (1, 2, 2.5, None)], "row long, n long, f double, s string")
    assert {r["column"]: r["smallest"] for r in TB.smallest_types(df).collect()} == {"row": "tinyint", "n": "smallint", "f": "float", "s": "string"}
    assert dict(TB.downcast(df).dtypes) == {"row": "tinyint", "n": "smallint", "f": "float", "s": "string"}
    assert TB.trim_low_weights(df, None).count() == 2 and TB.trim_low_weights(df, 5, "n").count() == 1
    assert TB.move_column(df, "s", 0).columns == ["s", "row", "n", "f"]


TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><docDate>1990-01-10</docDate><div type="preface"><head>p--1</head></div><u who="a" xml:id="u0">x  y</u><note type="speaker" xml:id="n1">A:</note><u who="a" xml:id="u1"><seg>One,\n two</seg></u><note type="speaker">B</note><note type="speaker">C</note><u who="b" xml:id="u2"/><u who="c" xml:id="u3">z</u></TEI>'


def test_tei(spark, tmp_path):
    got = tei.speeches_of(TEI, "f")
    assert [(s["who"], s["who_intro"], s["u_id"], s["text"], s["n_tokens"]) for s in got] == [("a", "", "u0", ["x y"], 2), ("a", "A:", "u1", ["One, two"], 3), ("unknown", "B", "", [], 0), ("unknown", "C", "u2", ["", "z"], 1)]
    assert got[0]["date"] == D(1990, 1, 10) and got[0]["protocol"] == "p--1" and len(got[3]["errors"]) == 1
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.xml").write_text(TEI)
    (tmp_path / "in" / "b.xml").write_text("<u>")
    speeches = tei.extract_speeches(tei.read_files(spark, str(tmp_path / "in")))
    assert speeches.count() == 5 and tei.with_words(speeches).count() == 3 and tei.errors_of(speeches).count() == 2
    stream = ST.protocol_stream(spark, str(tmp_path / "in"))
    query = stream.writeStream.format("memory").queryName("protocols").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("protocols").count() == 5


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", D(2000, 1, 1), "x;y", ["p", "q"]), ("b", D(2010, 1, 1), None, [])], "g string, d date, t string, l array<string>")
    again = files.json_lists(files.with_json_lists(df))
    assert sorted(map(tuple, again.select("g", "l").collect())) == [("a", ["p", "q"]), ("b", [])]
    files.write_csv(df.drop("l"), str(tmp_path / "c" / "t.csv"), "~")
    files.write_groups(df, str(tmp_path / "groups"), ["g"])
    assert spark.read.parquet(str(tmp_path / "groups")).count() == 2
    files.write_texts(df, str(tmp_path / "texts"), "t", "d", "g", "1999-01-01", "2005-01-01")
    files.zip_folder(str(tmp_path / "texts"), str(tmp_path / "t.zip"))
    assert (tmp_path / "t.zip").stat().st_size > 0
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "person.csv").write_text("wiki_id,born\nQ1,1950\n")
    assert files.csv_folder(spark, str(tmp_path / "csv"))["person"].first()["born"] == "1950"
    made = []
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "cache"), lambda: (made.append(1), df)[1]).count() == 2
    assert made == [1]


def test_stream_windows(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 1), 2.0), (1, datetime.datetime(2024, 1, 1, 1), 2.0), (2, datetime.datetime(2024, 1, 2, 1), 3.0)], "id long, ts timestamp, value double")
    rows.write.parquet(str(tmp_path / "s"))
    stream = ST.parquet_stream(spark, str(tmp_path / "s"), rows.schema)
    query = ST.tokens_a_window(stream, "ts", "value").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["total"] for r in spark.table("windows").collect()) == [3.0, 4.0]


def test_word_ids_of_all_words(spark, tmp_path):
    words = ["väg", "Väg", "ÅR", "bro", "1994", "skatt2", "報告", "ภาษี", "à", "à", "a", "b-c", "", " ", " ", None, "bro"]
    spark.createDataFrame([(w, "p") for w in words], "word string, protocol string").write.parquet(str(tmp_path / "word_count.parquet"))
    got = {r["word"]: r["id"] for r in entry.queries()["word_ids"](spark, str(tmp_path)).collect()}
    different = sorted({w.lower() for w in words if w and w.strip()}, key=str.encode)
    assert got == {w: k for k, w in enumerate(different)}


def test_word_store(spark, tmp_path):
    store = files.WordStore(spark, str(tmp_path / "store"))
    assert store.ids().count() == 0
    frame = lambda *words: spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["word"]: r["id"] for r in store.add(frame("b", "d", "b", None), "w").collect()} == {"b": 0, "d": 1}
    assert {r["word"]: r["id"] for r in store.add(frame("a", "d", "c"), "w").collect()} == {"b": 0, "d": 1, "a": 2, "c": 3}
    assert store.add(frame(), "w").count() == 4


def test_sources(spark, tmp_path):
    (tmp_path / "words.txt").write_text("och\natt\n\n och \n")
    assert files.word_list(spark, str(tmp_path / "words.txt")) == ["och", "att"]
    with pytest.raises((RuntimeError, FileNotFoundError)):
        files.word_list(spark, str(tmp_path / "words.xlsx"))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "member.csv").write_text("id,born\nQ1,1950\n")
    (tmp_path / "deep" / "note.txt").write_text("x")
    frames = files.csv_folder(spark, str(tmp_path), {"member": "id string, born int"})
    assert list(frames) == ["member"] and frames["member"].first()["born"] == 1950
    assert files.remote_csv(spark, (tmp_path / "deep" / "member.csv").as_uri()).first()["born"] == "1950"
    files.write_csv(spark.createDataFrame([("a", 1)], "k string, n int"), str(tmp_path / "t.csv"), ";", mark=True)
    parts = [p.read_bytes() for p in (tmp_path / "t.csv").glob("part-*") if p.stat().st_size]
    assert all(p.startswith(b"\xef\xbb\xbfk;n") for p in parts)


def test_tables_of_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "K string, N int")
    try:
        df.write.format("jdbc").options(url=url, dbtable="T1", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    except Exception as e:
        if "ClassNotFound" in str(e) or "DRIVER" in str(e).upper():
            pytest.skip("no database driver on the class path")
        raise
    found = files.jdbc_tables(spark, url, options={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    assert "T1" in found and sorted(map(tuple, found["T1"].collect())) == [("a", 1), ("b", 2)]


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, n int")
    try:
        import openpyxl
    except ImportError:
        with pytest.raises(RuntimeError):
            files.write_workbook(df, str(tmp_path / "t.xlsx"))
        return
    files.write_workbook(df, str(tmp_path / "t.xlsx"), "one")
    files.write_workbook(df, str(tmp_path / "t.xlsx"), "two")
    assert openpyxl.load_workbook(tmp_path / "t.xlsx").sheetnames == ["one", "two"]
    files.write_workbooks(df, str(tmp_path), ["g"])
    assert (tmp_path / "a.xlsx").exists() and (tmp_path / "b.xlsx").exists()


def hot(spark):
    """Rows of which a key has half, and a null key some."""
    return spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("k"), F.col("id") % 97)).alias("k"), F.col("id").alias("v"))


def test_hot_keys(spark, tmp_path):
    df = hot(spark)
    rows = [(r["k"], r["v"]) for r in df.collect()]
    sums, counts = {}, {}
    for k, v in rows:
        sums[k], counts[k] = sums.get(k, 0) + v, counts.get(k, 0) + 1
    assert all(r["total"] == sums[r["k"]] for r in J.group_total(df, "k", "v", "total").collect())
    got = R.with_group_count(df, "k").collect()
    assert len(got) == len(rows) and all(r["repeats"] == counts[r["k"]] for r in got)
    assert [r["_place"] for r in J.numbered(df, ["v"], rows=3000).orderBy("v").collect()] == list(range(20_000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as these are far too small to be apart
    try:
        files.write_groups(df, str(tmp_path / "g"), ["k"], rows=2000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "g")).count() == 20_000 and len(list((tmp_path / "g" / "k=hot").glob("*.parquet"))) > 1
    best = R.top_and_bottom(df, ["k"], "v", "v", 3).where("k = 'hot'").collect()
    assert sorted(r["v"] for r in best) == [0, 2, 4, 19_994, 19_996, 19_998]
    quantiles = {r["k"]: (r["lo"], r["mid"]) for r in R.exact_quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5}).collect()}
    want = df.where("k is not null").groupBy("k").agg(F.percentile("v", 0.1), F.percentile("v", 0.5)).collect()
    assert all(quantiles[k] == pytest.approx((a, b)) for k, a, b in want) and len(quantiles) == len(want)


def test_hot_person(spark):
    """One person with most listings: the cascade and the hulls against all pairs."""
    import random

    rng = random.Random(3)
    day = lambda: D(1950, 1, 1) + datetime.timedelta(rng.randrange(20_000))
    rows = []
    for k in range(300):
        a, b = sorted((day(), day()))
        rows.append((rng.choice("ppppq"), rng.choice("abc"), rng.choice([None, a, a, a]), rng.choice([None, b, b, b]), k))
    rows += [("p", "a", D(2000, 1, 2), D(2000, 1, 1), 300), ("r", "a", D(2000, 1, 1), D(2001, 1, 1), 301), (None, "a", D(2000, 1, 1), None, 302)]
    asked = list({(who, day()) for who in "pqrx" for _ in range(60)})
    got = {(r["who"], r["date"]): (r["party"], r["uncertain"], r["message"]) for r in A.affiliation_on_date(spark.createDataFrame(asked, "who string, date date"), spark.createDataFrame(rows, AFF)).collect()}
    assert len(got) == len(asked)
    for who, d in asked:
        own = [r for r in rows if r[0] == who]
        cover = [r for r in own if r[2] and r[3] and r[2] <= d <= r[3]]
        near = lambda c: min(((abs((r[c] - d).days), r[4], r[c], r[1]) for r in own if r[c]), default=None)
        if not own:
            want = "unknown_missing"
        elif len(own) == 1 or len({r[1] for r in own}) == 1:
            want = own[0][1]
        elif cover:
            want = max(cover, key=lambda r: r[4])[1]
        else:
            s, e = near(2), near(3)
            want = s[3] if s[2] > e[2] else e[3]
        assert got[who, d][0] == want, (who, d)
    spans = [(i, p, s or min(r[2] for r in rows if r[2]), e or D(2024, 12, 31)) for i, p, s, e, _ in rows if i]
    spans = [x for x in spans if x[2] < x[3]]
    hulls = {}
    for i, p, s, e in spans:
        for j, q, t, f in spans:
            if i == j and p < q and s < f and t < e:
                a, b = hulls.get((i, p, q), (D.max, D.min))
                hulls[i, p, q] = min(a, max(s, t)), max(b, min(e, f))
    assert {(r["id"], r["party_1"], r["party_2"]): (r["overlap_start"], r["overlap_end"]) for r in A.overlap_hulls(spark.createDataFrame(rows, AFF), "2024-12-31").collect()} == hulls


def test_names_in_paths(spark):
    paths = spark.createDataFrame([(p,) for p in ("in/prot-1.xml", "in/prot-12.xml", "aa", "ab", None, "")], "path string")
    names = spark.createDataFrame([(n,) for n in ("prot-1", "prot-12", "a", "ab", "xyz", "", None, "b", "b")], "found_name string")
    got = sorted(((r["found_name"] or "", r["found"]) for r in J.first_containing(names, "found_name", paths, "path").collect()), key=str)
    assert got == sorted([("prot-1", "in/prot-1.xml"), ("prot-12", "in/prot-12.xml"), ("a", "aa"), ("ab", "ab"), ("xyz", None), ("", None), ("", None), ("b", "ab"), ("b", "ab")], key=str)


def test_first_deliveries(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 1)), (1, datetime.datetime(2024, 1, 1, 2)), (2, datetime.datetime(2024, 1, 2, 1))], "id long, ts timestamp")
    rows.write.parquet(str(tmp_path / "s"))
    stream = ST.first_deliveries(ST.parquet_stream(spark, str(tmp_path / "s"), rows.schema), "id", "ts")
    stream.writeStream.format("memory").queryName("first").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r["id"] for r in spark.table("first").collect()) == [1, 2]


def test_dictionary(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert [r[0] for r in df.select(J.looked_up(F.col("k"), {"a": "x"})).collect()] == ["x", "b", None]
    assert [r[0] for r in df.select(J.looked_up(F.col("k"), {"a": "x"}, F.lit("?"))).collect()] == ["x", "?", "?"]
    assert [r[0] for r in df.select(J.looked_up(F.col("k"), {})).collect()] == ["a", "b", None]
