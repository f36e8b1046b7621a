"""Queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talverk.llm import contamination, readability, scans, sentences, splitting, tokenizer
from talverk.operators.latest import latest_rows
from talverk.sources.tables import spread, table


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def digital(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The deliveries of digital speeches."""
    return table(spark, folder, "speech_index").where("capture = 'digital'").select("u_id", "lang", "loaded_at", "text", *columns)


def latest(rows: DataFrame) -> DataFrame:
    return latest_rows(rows, "u_id", "loaded_at", spread(rows))


def study(spark: SparkSession, folder: str, words: bool = False) -> sentences.Study:
    """What one pass over all digital speeches tells of words and sentences."""
    rows = digital(spark, folder)
    return sentences.study(rows, "u_id", "text", "lang", words=words, wide=spread(rows))


def _levels(spark: SparkSession, folder: str, speeches: DataFrame) -> DataFrame:
    known = study(spark, folder, words=True)
    labels = table(spark, folder, "reading_label").select("u_id", "level")
    return readability.reading_levels(speeches, "u_id", "text", "lang", labels, "level", known.model(), readability.familiar_words(known.frequencies()))


def p2_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Reading level of every speech, scanned ones by their repaired text, with its number of words and the figures behind the level."""
    scanned = _repaired(spark, folder, "lang").select("u_id", "lang", F.transform("parts", lambda p: p["text"]).alias("text"))
    return _levels(spark, folder, latest(digital(spark, folder)).select("u_id", "lang", "text").unionByName(scanned))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The most demanding digital Swedish speeches of at least 40 words."""
    return _levels(spark, folder, latest(digital(spark, folder).where("lang = 'sv'"))).where("words >= 40 and level = 5").select("u_id")


def p3_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of every segment: of digital speeches as they are, of scanned ones in their repaired text."""
    model = study(spark, folder).model()
    scanned = _repaired(spark, folder).select("u_id", F.lit("scan").alias("capture"), F.transform("parts", lambda p: p["text"]).alias("text"))
    both = latest(digital(spark, folder)).select("u_id", F.lit("digital").alias("capture"), "text").unionByName(scanned)
    return sentences.sentences(both.select(F.struct("u_id", "capture").alias("_speech"), "text"), "_speech", "text", model).select("_speech.*", "seg", "n", "char_end", "sentence")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of the segments of digital speeches, by its end."""
    model = study(spark, folder).model()
    return sentences.sentence_ends(latest(digital(spark, folder)), "u_id", "text", model)


def _repaired(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """(u_id, parts, columns…) of each scanned speech."""
    speeches = table(spark, folder, "speech_index").select("u_id", "loaded_at", "text", "capture", *columns)
    rows = speeches.where("capture = 'scan'").select("u_id", "loaded_at", "text", *columns)
    corpus = spread(speeches.where("capture in ('scan', 'digital') and text is not null").select((F.col("capture") == "scan").alias("scanned"), "text"))
    return scans.read_scans(latest(rows), "u_id", "text", corpus, table(spark, folder, "scan_sample"), "raw", "repaired", columns)


def p6_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of scanned speeches as continuous text, with what was wrong with their lines."""
    return _repaired(spark, folder).select("u_id", F.posexplode("parts").alias("seg", "_p")).select("u_id", "seg", "_p.text", "_p.kinds")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of scanned speeches that are furniture, end in a broken word or hold a misread word."""
    return p6_repaired(spark, folder).select("u_id", "seg", F.explode("kinds").alias("k")).select("u_id", "seg", "k.line_no", "k.kind")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.token_ids(documents(spark, folder), "doc_id", "text")


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item with at least 13 words in a row in common, and how much of the item it holds."""
    return contamination.leaked_items(documents(spark, folder), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text", 13)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that hold a passage of a benchmark item, with the items."""
    return p8_leaks(spark, folder).select("doc_id", "item_id")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of each document above 1,024 tokens, with sentences learned from the documents that may be so long."""
    long = table(spark, folder, "documents").select("doc_id", "lang", F.array("text").alias("text")).where(F.octet_length(F.col("text")[0]) > 1024)
    model = sentences.study(long, "doc_id", "text", "lang", wide=spread(long)).model()
    return splitting.split_oversized(documents(spark, folder), "doc_id", "text", 1024, 64, model=model)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents above 1,024 tokens: those that come out in pieces."""
    return p9_pieces(spark, folder).where("piece = 0").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_levels, p3_found, p3_sentences, p6_found, p6_repaired, p7_ids, p8_found, p8_leaks, p9_found, p9_pieces)}
ORACLE: dict[str, str] = {}
