"""Other sources, and the sinks."""

from __future__ import annotations

import os
import urllib.request
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talverk.operators.joins import numbered
from talverk.session import broadcast_if_small, shared_folder


def files_below(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """Paths of the files below a folder, whatever file system it is on, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, out = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        path = found.next().getPath().toString()
        if path.lower().endswith(ending):
            out.append(path)
    return sorted(out)


def csv_folder(spark: SparkSession, folder: str, schemas: dict[str, T.StructType | str] | None = None, separator: str = ",") -> dict[str, DataFrame]:
    """Every CSV file below a folder as a frame by its stem, with the given schema or all strings; each is also a view.

    A file written in parts, a folder of its own, is one frame by the folder's stem. A byte order mark is no part of a name.
    """
    by_stem: dict[str, list[str]] = {}
    for path in files_below(spark, folder, ".csv"):
        base, name = os.path.split(path)
        stem = os.path.splitext(os.path.basename(base) if name.startswith("part-") else name)[0]
        by_stem.setdefault(stem, []).append(path)
    out = {}
    for stem, paths in by_stem.items():
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", separator)
        if schemas and stem in schemas:
            reader = reader.schema(schemas[stem])
        frame = reader.csv(paths)
        out[stem] = frame.toDF(*[c.removeprefix("\ufeff") for c in frame.columns])
        out[stem].createOrReplaceTempView(stem)
    return out


def remote_csv(spark: SparkSession, url: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file at an address, fetched by the driver as a stream into the shared folder and read from there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark) + "/remote.csv")
    out = folder.getFileSystem(spark._jsc.hadoopConfiguration()).create(folder)
    try:
        with urllib.request.urlopen(url) as source:
            while block := source.read(1 << 20):
                out.write(bytearray(block))
    finally:
        out.close()
    return csv_folder(spark, folder.getParent().toString(), {"remote": schema} if schema else None)["remote"]


def json_lists(df: DataFrame) -> DataFrame:
    """Columns named `x_json`, texts of string lists, as array columns `x`."""
    for c in df.columns:
        if c.endswith("_json"):
            df = df.withColumn(c.removesuffix("_json"), F.from_json(c, "array<string>")).drop(c)
    return df


def with_json_lists(df: DataFrame) -> DataFrame:
    """Array columns as texts `x_json`."""
    for c, t in df.dtypes:
        if t == "array<string>":
            df = df.withColumn(f"{c}_json", F.to_json(c)).drop(c)
    return df


def word_list(spark: SparkSession, path: str) -> list[str]:
    """A small list of different words in order, one a line, from a text or CSV file without a header; an Excel file where openpyxl is installed."""
    if path.endswith((".xlsx", ".xls")):
        try:
            import openpyxl
        except ImportError as e:
            raise RuntimeError("reading Excel files needs openpyxl") from e
        sheet = openpyxl.load_workbook(path, read_only=True).active
        return list(dict.fromkeys(str(row[0]) for row in sheet.iter_rows(values_only=True) if row and row[0] is not None))
    return list(dict.fromkeys(r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()))


# fixed values: where databases list their tables
CATALOGS = {
    "sqlite": "select name from sqlite_master where type = 'table'",
    "derby": "select tablename as name from sys.systables where tabletype = 'T'",
    "": "select table_name as name from information_schema.tables where table_type = 'BASE TABLE' and table_schema not in ('information_schema', 'pg_catalog')",
}


def jdbc_tables(spark: SparkSession, url: str, names: list[str] | None = None, options: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables of a database by name, all that its catalog lists if none are named; its driver must be on the class path."""
    if names is None:
        catalog = CATALOGS.get(url.split(":")[1], CATALOGS[""])
        names = [r[0] for r in spark.read.format("jdbc").options(url=url, query=catalog, **(options or {})).load().collect()]
    return {n: spark.read.format("jdbc").options(url=url, dbtable=n, **(options or {})).load() for n in names}


def cached(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """The Parquet table at the path, built and written first if it is missing or forced."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if force or not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def word_ids(words: DataFrame, word: str) -> DataFrame:
    """(word, id): different words with ids from 0 in their order; the ids hold for this set of words only, see `WordStore`."""
    return numbered(words.select(F.col(word).alias("word")).where("word is not null").distinct(), ["word"], "id")


class WordStore:
    """A table of words with ids that last: words that it has keep theirs, new ones get the next in their order."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def ids(self) -> DataFrame:
        """(word, id) of all words so far."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], "word string, id bigint")
        return self.spark.read.schema("word string, id bigint").parquet(self.path)

    def add(self, words: DataFrame, word: str) -> DataFrame:
        """Add the words that are not there yet, null left out, and return (word, id) of all. One writer at a time."""
        there = self.ids()
        new = words.select(F.col(word).alias("word")).where("word is not null").distinct().join(there, "word", "left_anti")
        first = there.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
        numbered(new, ["word"], "id").select("word", (F.col("id") + first).cast("bigint").alias("id")).write.mode("append").parquet(self.path)
        return self.ids()


def write_csv(df: DataFrame, path: str, separator: str = ",", mark: bool = False) -> None:
    """A CSV file in parts; with `mark` each begins with a byte order mark, which spreadsheets ask for."""
    named = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if mark else df
    named.write.mode("overwrite").option("header", True).option("sep", separator).option("escape", '"').csv(path)


def write_groups(df: DataFrame, path: str, keys: list[str], form: str = "parquet", rows: int = 1_000_000) -> None:
    """A folder for each group. A group has a task and file for each so many of its rows, so that none is one task's however large."""
    parts = df.groupBy(*keys).agg((F.floor(F.count("*") / rows) + 1).alias("_parts"))
    named = parts.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], "_parts")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)])
    salted = df.join(broadcast_if_small(named), same).withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.col("_parts")))
    writer = salted.repartition(*[F.col(k) for k in keys], "_part").select(*df.columns).write.mode("overwrite").partitionBy(*keys)
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def write_workbook(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """A report as a sheet of a local Excel file: a new file, or a sheet added to one or replaced in it. Needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("writing Excel files needs openpyxl") from e
    import pandas as pd

    there = {"mode": "a", "if_sheet_exists": "replace"} if os.path.exists(path) else {"mode": "w"}
    with pd.ExcelWriter(path, engine="openpyxl", **there) as writer:
        df.toPandas().to_excel(writer, sheet_name=sheet[:31], index=False)


def write_workbooks(df: DataFrame, folder: str, keys: list[str]) -> None:
    """An Excel file for each group, named by its keys; a group has the rows of a report, and no more than a sheet holds. Needs openpyxl."""
    for row in df.select(*keys).distinct().collect():
        own = df.where(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(row[k])) for k in keys])).drop(*keys)
        write_workbook(own, os.path.join(folder, "_".join(map(str, row)) + ".xlsx"))


def write_texts(df: DataFrame, path: str, text: str, date: str, group: str, first: str, last: str) -> None:
    """Texts dated from first to last, a folder of text files for each group."""
    chosen = df.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col(text).isNotNull())
    chosen.select(group, F.col(text).alias("value")).write.mode("overwrite").partitionBy(group).text(path)


def zip_folder(path: str, archive: str) -> None:
    """A local folder as a zip file, on the driver."""
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for base, _, names in os.walk(path):
            for name in sorted(names):
                out.write(os.path.join(base, name), os.path.relpath(os.path.join(base, name), path))


def write_errors(errors: DataFrame, path: str) -> None:
    errors.write.mode("overwrite").json(path)
