import random

from pyspark.sql import functions as F

from talverk.llm import readability as R
from talverk.llm import sentences as Z

COMMON = ["vi", "ser", "en", "bro", "och", "tar", "hus", "med", "väg", "som"]


def speech(rng, level):
    out = []
    for _ in range(rng.randint(3, 6)):
        words = [f"sällan{rng.randrange(10_000)}ord" if rng.random() < 0.06 * level else rng.choice(COMMON) for _ in range(rng.randint(4, 6) * level)]
        out.append("Vi " + " ".join(words) + ".")
    return [" ".join(out)]


def levels(texts, labels, what="level"):
    texts = texts if "lang" in texts.columns else texts.withColumn("lang", F.lit("sv"))
    familiar = R.familiar_words(Z.study(texts, "u_id", "text", "lang", words=True).frequencies())
    rows = R.reading_levels(texts, "u_id", "text", "lang", labels, "level", Z.train([]), familiar).collect()
    return {r["u_id"]: r[what] if isinstance(what, str) else tuple(r[x] for x in what) for r in rows}


def test_levels_follow_the_raters(spark):
    rng = random.Random(1)
    truth = {f"u{k}": 1 + k % 5 for k in range(300)}
    texts = spark.createDataFrame([(u, speech(rng, level)) for u, level in truth.items()], "u_id string, text array<string>")
    labels = spark.createDataFrame([(u, truth[u]) for u in list(truth)[:150]] + [("u0", None), (None, 3), ("nobody", 5)], "u_id string, level int")
    got = levels(texts, labels)
    assert sum(got[u] == level for u, level in list(truth.items())[150:]) > 120
    assert all(abs(got[u] - level) <= 1 for u, level in truth.items())


def test_edges(spark):
    rows = [("a", None), ("b", []), ("c", ["", None]), ("d", ["Anna Bo Ek."]), ("e", ["vi ser en bro " * 20_000])]
    texts = spark.createDataFrame(rows, "u_id string, text array<string>").withColumn("length", F.lit("clash"))
    labels = spark.createDataFrame([], "u_id string, level int")
    got = levels(texts, labels, ("words", "level"))
    assert got == {"a": (0, 1), "b": (0, 1), "c": (0, 1), "d": (3, 1), "e": (80_000, 1)}
    assert levels(texts.limit(0), labels) == {}
    frequencies = Z.study(texts.withColumn("lang", F.lit(None).cast("string")), "u_id", "text", "lang", words=True).frequencies()
    assert R.familiar_words(frequencies, 0.5) == {"": ["bro", "en", "ser", "vi"]}


def test_languages_without_labels_are_set_on_the_same_scale(spark):
    rng = random.Random(2)
    truth = {f"u{k}": 1 + k % 5 for k in range(400)}
    rows = []
    for k, (u, level) in enumerate(truth.items()):
        if k < 200:
            rows.append((u, "sv", speech(rng, level)))
        else:  # another language, whose sentences are twice as long at every level
            words = [" ".join(f"{w}x {w}y" for w in s.removeprefix("Vi ").rstrip(".").split()) for s in speech(rng, level)[0].split(". ")]
            rows.append((u, "fi", [". ".join("Me " + w for w in words) + "."]))
    texts = spark.createDataFrame(rows, "u_id string, lang string, text array<string>")
    labels = spark.createDataFrame([(u, truth[u]) for u in list(truth)[:200]], "u_id string, level int")
    got = levels(texts, labels)
    assert sum(abs(got[u] - level) <= 1 for u, level in list(truth.items())[200:]) > 180
    assert len({got[u] for u in list(truth)[200:]}) == 5


def test_plain_words():
    assert Z.plain_words("Vi ser 3 hus i Ölby, år 2019 och ǅ") == ["ser", "hus", "i", "år", "och"]
    assert Z.plain_words("報告書を見る ABC abc") == [*"報告書を見る", "abc"]
