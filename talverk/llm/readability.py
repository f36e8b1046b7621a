"""Reading level of texts by a familiar-word formula.

Two figures describe a text: the share of its words that are not familiar, and the average length of its sentences.
Familiar are the words that occur in a given share of all texts of their group (language), so their list follows the
corpus and is bounded: at most (average number of different words of a text) / share for each group. Levels are set by labels: for
each pair of neighbouring levels a logistic function of the two figures is fitted to what raters say. Groups without
labels are set by where a text lies among the texts of its own group: their figures are moved and scaled to the mean and
deviation of those of the group with most labels, as neither words nor sentences are of one length in all languages.

Only words that begin with no capital are weighed, in both figures: names and rosters of names make a text no harder. In
scripts without spaces each character is a word. Sentences of fewer than three such words (forms of address,
interjections) aren't averaged.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talverk.llm.sentences import Model, plain_words
from talverk.session import materialize

#: A word is familiar if it occurs in this share of the texts.
FAMILIAR = 0.08
#: Most labelled texts that a fit takes.
LABELLED = 20_000
#: A group of fewer texts has the familiar words of all such groups together; with fewer labels it is none with labels.
LEAST = 30
_RUN = re.compile(r"[^\W_]+")


def familiar_words(frequencies: DataFrame, share: float = FAMILIAR) -> dict[str, list[str]]:
    """For each group the words with a document frequency of at least `share` of its texts that aren't blank.

    `frequencies` are those of `Study.frequencies`. Groups of fewer than LEAST texts are taken together as the group "".
    """
    kept = materialize(frequencies)
    totals = kept.where("word = ''").select("group", F.col("texts").alias("_total"))
    pooled = kept.join(F.broadcast(totals), "group").withColumn("group", F.when(F.col("_total") >= LEAST, F.col("group")).otherwise("")).groupBy("group", "word").agg(F.sum("texts").alias("texts"))
    totals = pooled.where("word = '' and texts > 0").select("group", F.col("texts").alias("_total"))
    out: dict[str, list[str]] = {}
    for r in pooled.join(F.broadcast(totals), "group").where(F.col("texts") >= share * F.col("_total")).select("group", "word").collect():
        own = out.setdefault(r["group"], [])
        if r["word"]:
            own.append(r["word"])
    return {g: sorted(words) for g, words in out.items()}


def measures_udf(familiar: dict[str, list[str]], model: Model):
    weights, short = model.weights, model.short
    made: list[Model] = []
    known = {g: frozenset(words) for g, words in familiar.items()}

    @F.arrow_udf("struct<words:int,unfamiliar:double,length:double>")
    def measures(texts: pa.Array, groups: pa.Array) -> pa.Array:
        if not made:
            made.append(Model(weights, short))
        rows = []
        for segments, group in zip(texts.to_pylist(), groups.to_pylist()):
            words = small = strange = sentences = 0
            own_known = known.get(group, known.get("", frozenset()))
            for text in segments or ():
                begin, spaced = 0, max(text or "", default="") < "\u0900"
                for end in made[0].ends(text):
                    found = _RUN.findall(text, begin, end)
                    words += len(found)
                    own = [w for w in found if w[0].islower()] if spaced else plain_words(text[begin:end])
                    begin = end
                    if len(own) >= 3:
                        sentences += 1
                        small += len(own)
                        strange += sum(w not in own_known for w in own)
            rows.append({"words": words, "unfamiliar": strange / small if small else None, "length": small / sentences if sentences else None})
        return pa.array(rows, pa.struct([("words", pa.int32()), ("unfamiliar", pa.float64()), ("length", pa.float64())]))

    return measures


def measures(texts: DataFrame, key: str, segments: str, group: str, familiar: dict[str, list[str]], model: Model) -> DataFrame:
    """(key, group, words, unfamiliar, length) of each text; a text without a sentence of three plain words has null figures."""
    name = F.coalesce(F.col(group), F.lit(""))
    return texts.select(F.col(key), name.alias("group"), measures_udf(familiar, model)(F.col(segments), name).alias("_m")).select(key, "group", "_m.*")


def fit_levels(measured: DataFrame, labels: DataFrame, key: str, level: str, levels: int = 5) -> list[tuple[float, float, float] | None]:
    """For each level from 2 up the weights (constant, unfamiliar, log of length) by which a text is at least that level.

    The level of a text is the mean of its raters; at most LABELLED texts are taken, by a hash of the key. A level
    of which the labels have nothing below or nothing above has no weights.
    """
    mean = labels.where(F.col(level).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(level).alias("_level"))
    rows = measured.where("length is not null").join(mean, key).select(key, "unfamiliar", "length", "_level").orderBy(F.xxhash64(key), key).limit(LABELLED).collect()
    x = np.array([[1.0, r["unfamiliar"], math.log(r["length"])] for r in rows]).reshape(-1, 3)
    y = np.array([r["_level"] for r in rows])
    out: list[tuple[float, float, float] | None] = []
    for k in range(2, levels + 1):
        t = (y >= k - 0.5).astype(float)
        if not len(t) or t.min() == t.max():
            out.append(None)
            continue
        w = np.zeros(3)
        for _ in range(60):  # Newton's method on the penalized likelihood
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - t) + 0.02 * w
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(3)
            step = np.linalg.solve(h, g)
            w -= step * min(1.0, 3 / max(np.abs(step).max(), 1e-9))
        out.append(tuple(float(v) for v in w))
    return out


def scales(measured: DataFrame, labels: DataFrame, key: str, level: str) -> DataFrame:
    """(group, a, b, c, d): by a + b * unfamiliar and c + d * ln(length) the figures of a group are set on the scale of the labelled ones.

    Groups with LEAST labels or more stand as they are, others get the mean and deviation of the group with most labels;
    so do all where no group has labels, and groups whose figures don't differ.
    """
    named = labels.where(F.col(level).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct().withColumn("_labelled", F.lit(1))
    rows = measured.where("length is not null").join(named, F.col(key) == F.col("_key"), "left")
    figures = [f(x).alias(f"{n}_{k}") for k, x in (("u", F.col("unfamiliar")), ("l", F.ln("length"))) for n, f in (("mean", F.avg), ("dev", F.stddev_pop))]
    groups = rows.groupBy("group").agg(F.count("_labelled").alias("_labels"), *figures).collect()
    most = max(groups, key=lambda r: (r["_labels"], r["group"]), default=None)
    out = []
    for r in groups:
        a = c = 0.0
        b = d = 1.0
        if r["_labels"] < LEAST and most["_labels"] and r["group"] != most["group"] and r["dev_u"] and r["dev_l"]:
            b, d = most["dev_u"] / r["dev_u"], most["dev_l"] / r["dev_l"]
            a, c = most["mean_u"] - b * r["mean_u"], most["mean_l"] - d * r["mean_l"]
        out.append((r["group"], a, b, c, d))
    return measured.sparkSession.createDataFrame(out, "group string, a double, b double, c double, d double")


def level_of(weights: list[tuple[float, float, float] | None], unfamiliar: Column, length: Column) -> Column:
    """Level from 1 up; a text without figures has the first. `length` is the logarithm of the average length."""
    level = F.lit(1)
    for w in weights:
        if w:
            level += F.coalesce((F.lit(w[0]) + w[1] * unfamiliar + w[2] * length > 0).cast("int"), F.lit(0))
    return level


def reading_levels(texts: DataFrame, key: str, segments: str, group: str, labels: DataFrame, level: str, model: Model, familiar: dict[str, list[str]]) -> DataFrame:
    """(key, group, words, unfamiliar, length, level) of each text (an array of segments).

    Null and empty texts have no words and the first level. Without labels every text has the first level. A null group
    is the group "".
    """
    measured = materialize(measures(texts, key, segments, group, familiar, model))
    weights = fit_levels(measured, labels, key, level)
    scaled = measured.join(F.broadcast(scales(measured, labels, key, level)), "group", "left")
    out = scaled.withColumn("level", level_of(weights, F.col("a") + F.col("b") * F.col("unfamiliar"), F.col("c") + F.col("d") * F.ln("length")))
    return out.select(key, "group", "words", "unfamiliar", "length", "level")
