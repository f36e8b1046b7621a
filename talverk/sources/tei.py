"""Speeches of TEI protocols: an ordered walk over the speaker notes and utterances of each file.

Spark's XML source groups children by name and so loses the order of notes and utterances; therefore whole files are
read as text and walked in one Python table function, file by file, without a shuffle.
"""

from __future__ import annotations

import datetime
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPEECH = T.StructType([
    T.StructField("who", T.StringType()), T.StructField("who_intro_id", T.StringType()), T.StructField("who_intro", T.StringType()),
    T.StructField("date", T.DateType()), T.StructField("protocol", T.StringType()), T.StructField("n_tokens", T.IntegerType()),
    T.StructField("u_id", T.StringType()), T.StructField("u_ids", T.ArrayType(T.StringType())), T.StructField("text", T.ArrayType(T.StringType())),
    T.StructField("file_name", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType())),
])
_ID = "{http://www.w3.org/XML/1998/namespace}id"
_TOKEN = re.compile(r"\w+|[^\w\s]")


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _text(element: ET.Element) -> str:
    return " ".join("".join(element.itertext()).split())


def _date(text: str) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat(text.strip()[:10])
    except ValueError:
        return None


def speeches_of(xml: str, file_name: str) -> list[dict[str, Any]]:
    """The speeches of one file in order.

    A speaker note ends the open speech and begins one that holds it; utterances before any note make a speech of their
    own. One distinct @who is the speaker (also an absent one, which is null), none or several are `unknown`; several are
    an error of the speech too. A note without utterances is a speech without words. A file that is no XML gives one row
    with nothing but an error.
    """
    empty = {"who": None, "who_intro_id": "", "who_intro": "", "date": None, "protocol": None, "n_tokens": 0, "u_id": "", "u_ids": [], "text": [], "file_name": file_name, "errors": []}
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        return [empty | {"errors": [f"not well-formed: {e}"]}]
    day = protocol = None
    speeches: list[dict[str, Any]] = []
    speakers: list[set[str | None]] = []
    for element in root.iter():
        tag = _name(element)
        if tag == "docDate" and day is None:
            day = _date(_text(element))
        elif tag == "div" and element.get("type") == "preface" and protocol is None:
            head = next((e for e in element.iter() if _name(e) == "head"), None)
            protocol = _text(head) if head is not None else None
        elif tag == "note" and element.get("type") == "speaker":
            speeches.append(empty | {"who_intro_id": element.get(_ID, ""), "who_intro": _text(element), "u_ids": [], "text": [], "errors": []})
            speakers.append(set())
        elif tag == "u":
            if not speeches:
                speeches.append(empty | {"u_ids": [], "text": [], "errors": []})
                speakers.append(set())
            words = _text(element)
            speeches[-1]["u_ids"].append(element.get(_ID, ""))
            speeches[-1]["text"].append(words)
            speeches[-1]["n_tokens"] += len(_TOKEN.findall(words))
            speakers[-1].add(element.get("who"))
    for speech, who in zip(speeches, speakers):
        speech["who"] = next(iter(who)) if len(who) == 1 else "unknown"
        if len(who) > 1:
            speech["errors"] = ["several speakers: " + ", ".join(sorted(map(str, who)))]
        speech["u_id"] = speech["u_ids"][0] if speech["u_ids"] else ""
        speech["date"], speech["protocol"] = day, protocol
    return speeches


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, xml): every XML file below the folder, whole."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").text(folder, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("file_name"), F.col("value").alias("xml"))


def extract_speeches(files: DataFrame) -> DataFrame:
    """The speeches of (file_name, xml), with errors. Null files have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = SPEECH.fieldNames()
        for batch in batches:
            rows = [speech for name, xml in zip(batch["file_name"], batch["xml"]) if xml is not None for speech in speeches_of(xml, name)]
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, SPEECH)


def errors_of(speeches: DataFrame) -> DataFrame:
    """(file_name, u_id, error): a row for each error, as for a sidecar file."""
    return speeches.select("file_name", "u_id", F.explode("errors").alias("error"))


def with_words(speeches: DataFrame) -> DataFrame:
    return speeches.where("n_tokens > 0")


def without_words(speeches: DataFrame) -> DataFrame:
    return speeches.where("n_tokens = 0")


def single_document(files: DataFrame, path: str) -> DataFrame:
    """(file_name, values): the texts at an XPath of each file, in document order."""
    return files.select("file_name", F.expr(f"xpath(xml, '{path}')").alias("values"))
