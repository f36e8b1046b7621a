"""N-grams of words, their counts in documents and groups, and TF-IDF between groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talverk.functions.text import ngrams, tokens


def stop_condition(word: Column, stop_words: list[str]) -> Column:
    """Is the word a stop word? `foo*` stands for words that begin so, `*foo` for words that end so."""
    plain = [w for w in stop_words if "*" not in w]
    found = word.isin(plain) if plain else F.lit(False)
    for w in stop_words:
        if w.endswith("*"):
            found |= F.startswith(word, F.lit(w[:-1]))
        elif w.startswith("*"):
            found |= F.endswith(word, F.lit(w[1:]))
    return found


def document_ngrams(df: DataFrame, text: str, n: int, carry: list[str], stop_words: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """(carry…, ngram): every run of n words of each text; runs with a stop word are left out. No run crosses texts. `pattern` is that of a word."""
    words = tokens(F.col(text), pattern) if pattern else tokens(F.col(text))
    runs = df.select(*carry, F.explode(ngrams(words, n)).alias("ngram"))
    if stop_words:
        runs = runs.where(~F.exists(F.split("ngram", " "), lambda w: stop_condition(w, stop_words)))
    return runs


def allowed(runs: DataFrame, least: int) -> DataFrame:
    """(ngram, corpus_count) of the n-grams that occur at least `least` times."""
    return runs.groupBy("ngram").agg(F.count("*").alias("corpus_count")).where(F.col("corpus_count") >= least)


def document_counts(runs: DataFrame, key: str, least: int) -> DataFrame:
    """(key, ngram, cnt) of the allowed n-grams: the sparse document matrix in long form."""
    counts = runs.groupBy(key, "ngram").agg(F.count("*").alias("cnt"))
    frequent = counts.groupBy("ngram").agg(F.sum("cnt").alias("_all")).where(F.col("_all") >= least)  # on the same exchange
    return counts.join(frequent, "ngram", "left_semi").select(key, "ngram", "cnt")


def totals_differ(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(ngram, in_corpus, in_documents) of the n-grams whose counts in documents don't add up to that in the corpus: none, if all is well."""
    corpus = runs.groupBy("ngram").agg(F.count("*").alias("in_corpus"))
    documents = counts.groupBy("ngram").agg(F.sum("cnt").alias("in_documents"))
    return documents.join(corpus, "ngram", "left").where(~F.col("in_corpus").eqNullSafe(F.col("in_documents")))


def group_usages(runs: DataFrame, group: str, least: int) -> DataFrame:
    """(group, ngram, uses, share): how often each group uses each allowed n-gram, and its share of all uses."""
    raw = runs.where(F.col(group).isNotNull()).groupBy(group, "ngram").agg(F.count("*").alias("uses"))
    total = F.sum("uses").over(Window.partitionBy("ngram"))
    return raw.withColumn("_all", total).where(F.col("_all") >= least).withColumn("share", F.col("uses") / F.col("_all")).drop("_all")


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(ngram, df, inverse, total): documents that hold it, 1 / df, occurrences."""
    return counts.groupBy("ngram").agg(F.count("*").alias("df"), (F.lit(1.0) / F.count("*")).alias("inverse"), F.sum("cnt").alias("total"))


def group_tfidf(df: DataFrame, text: str, groups: list[str], n: int, least: int, *, prefix: str | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """(groups…, ngram, raw_count, corpus_count, df, total_ngrams, tf, idf, tfidf, count_idf) of the allowed n-grams of each group.

    The groups are the documents: df counts groups, total_ngrams is floor(words of the group / n), tf = raw / total,
    idf = ln((G + 1) / (df + 1)) with G groups. With a prefix, n-grams that don't begin with that word have idf 0.
    Texts with a null group take part in nothing.
    """
    rows = df
    for g in groups:
        rows = rows.where(F.col(g).isNotNull())
    sizes = rows.groupBy(*groups).agg(F.floor(F.sum(F.coalesce(F.size(tokens(F.col(text))), F.lit(0))) / n).cast("bigint").alias("total_ngrams"))
    raw = document_ngrams(rows, text, n, groups, stop_words).groupBy(*groups, "ngram").agg(F.count("*").alias("raw_count"))
    same = Window.partitionBy("ngram")
    known = raw.withColumn("corpus_count", F.sum("raw_count").over(same)).withColumn("df", F.count("*").over(same)).where(F.col("corpus_count") >= least)
    number = sizes.agg(F.count("*").alias("_groups")).scalar()
    idf = F.ln((number + 1) / (F.col("df") + 1))
    if prefix is not None:
        idf = F.when(F.startswith("ngram", F.lit(prefix + " ")), idf).otherwise(0.0)
    out = known.join(sizes, groups).withColumn("tf", F.try_divide(F.col("raw_count").cast("double"), F.col("total_ngrams"))).withColumn("idf", idf)
    return out.withColumn("tfidf", F.col("tf") * F.col("idf")).withColumn("count_idf", F.col("raw_count") * F.col("idf"))


SORTS = ("tfidf", "raw_count", "count_idf")


def top_ngrams(scored: DataFrame, groups: list[str], k: int = 1000, sort_by: str = "tfidf") -> DataFrame:
    """The k best n-grams of each group by tfidf, raw_count or count_idf, ties in order of the n-gram."""
    if sort_by not in SORTS:
        raise ValueError(f"sort_by is one of {SORTS}")
    best = Window.partitionBy(*groups).orderBy(F.desc(F.round(sort_by, 12)), "ngram")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def legacy_tfidf(counts: DataFrame, documents: DataFrame, key: str, text: str, group: str) -> DataFrame:
    """(group, ngram, tf, df, total, tfidf, corrected): count / document frequency, and that by the words of the group."""
    groups = documents.where(F.col(group).isNotNull()).select(key, group, F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).alias("_words"))
    sizes = groups.groupBy(group).agg(F.sum("_words").alias("_size"))
    tf = counts.join(groups.select(key, group), key).groupBy(group, "ngram").agg(F.sum("cnt").alias("tf"))
    out = tf.join(document_frequencies(counts), "ngram").join(sizes, group)
    out = out.withColumn("tfidf", F.col("tf") * F.col("inverse"))
    return out.select(group, "ngram", "tf", "df", "total", "tfidf", F.try_divide(F.col("tfidf"), F.col("_size")).alias("corrected"))


def used_by(runs: DataFrame, decade: str, party: str, least: int) -> DataFrame:
    """(ngram, used_by, used_by_old, by_appearance) of the n-grams that occur at least `least` times.

    `1990: M, S 2000: S`, its older form `1990 - (M, S), 2000 - (S)`, and the parties by their first decade. The runs
    are counted by n-gram, decade and party, and all three come from one aggregation of these; runs without a decade
    or party count, but aren't used by anyone. N-grams that only such runs have are left out.
    """
    counts = runs.groupBy("ngram", decade, party).agg(F.count("*").alias("_n"))
    use = F.when(F.col(decade).isNotNull() & F.col(party).isNotNull(), F.struct(F.col(decade).alias("d"), F.col(party).alias("p")))
    all_ = counts.groupBy("ngram").agg(F.sum("_n").alias("_all"), F.array_sort(F.collect_set(use)).alias("_uses")).where((F.col("_all") >= least) & (F.size("_uses") > 0))
    parties = lambda d: F.array_join(F.transform(F.filter("_uses", lambda u: u["d"] == d), lambda u: u["p"]), ", ")
    by_decade = F.transform(F.array_distinct(F.transform("_uses", lambda u: u["d"])), lambda d: F.struct(d.cast("string").alias("d"), parties(d).alias("p")))
    first = F.transform(F.array_distinct(F.transform("_uses", lambda u: u["p"])), lambda p: F.struct(F.array_min(F.transform(F.filter("_uses", lambda u: u["p"] == p), lambda u: u["d"])).alias("d"), p.alias("p")))
    made = all_.select("ngram", by_decade.alias("_by"), F.array_sort(first).alias("_first"))
    return made.select(
        "ngram",
        F.array_join(F.transform("_by", lambda x: F.concat(x["d"], F.lit(": "), x["p"])), " ").alias("used_by"),
        F.array_join(F.transform("_by", lambda x: F.concat(x["d"], F.lit(" - ("), x["p"], F.lit(")"))), ", ").alias("used_by_old"),
        F.array_join(F.transform("_first", lambda x: x["p"]), ", ").alias("by_appearance"),
    )


def containing(counts: DataFrame, part: str) -> DataFrame:
    """The rows whose n-gram contains the string."""
    return counts.where(F.contains("ngram", F.lit(part)))


def usage(counts: DataFrame, documents: DataFrame, key: str, ngram: str) -> DataFrame:
    """The documents that hold the n-gram, with its count."""
    return counts.where(F.col("ngram") == ngram).join(documents, key)


def word_counts(df: DataFrame, text: str, groups: list[str], pattern: str | None = None) -> DataFrame:
    """(groups…, word, count) of the words of each group."""
    rows = df
    for g in groups:
        rows = rows.where(F.col(g).isNotNull())
    words = tokens(F.col(text), pattern) if pattern else tokens(F.col(text))
    return rows.select(*groups, F.explode(words).alias("word")).groupBy(*groups, "word").agg(F.count("*").alias("count"))
