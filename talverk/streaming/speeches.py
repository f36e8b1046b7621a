"""Speeches as a stream: new protocol files, and counts by year that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talverk.sources.tei import extract_speeches


def protocol_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Speeches of the XML files that arrive below a folder."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return extract_speeches(files.select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("file_name"), F.col("value").alias("xml")))


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def tokens_a_window(stream: DataFrame, at: str, value: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, rows, total) of tumbling windows; rows later than `late` are dropped by the watermark."""
    windows = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("rows"), F.sum(value).alias("total"))
    return windows.select(F.col("w.start").alias("start"), "rows", "total")


def first_deliveries(stream: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """The stream without repeats of a key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
