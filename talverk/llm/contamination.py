"""Passages of held-out test items inside the documents of a corpus.

A document contains a passage of an item if a run of RUN words of the item occurs in it word for word. The search is a
MinHash containment search with the items partitioned by size, as items are short and documents long, so that the Jaccard
similarity of the two is no guide and the share of the item that is contained is:

* A text is a set of shingles of five words. Its sketch under one hash function is the set of the minima of all windows
  of RUN words (RUN - 4 shingles); its signature is the sketches under FUNCTIONS functions. Texts with a run in common
  share at least one minimum under every function, whatever their lengths.
* Items are partitioned by size: class k holds those of RUN * 2^k words up to twice that. A class has a threshold of its
  own, the smallest containment that one run of an item of the class can make: one minimum of the largest sketch in it.
* The containment of an item in a document is estimated under each function as the share of the item's sketch that is in
  that of the document; a candidate has at least the threshold of its class under every function.
* Candidates are verified by exact containment, word for word, at the places where their minima matched.

All this happens in one pass over the documents: items are few next to documents, so they go to every worker, in blocks of
bounded size, each with a pass of its own. No text and no sketch of a document is ever moved.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talverk.session import written

#: Words of a run that counts as a leak, and words of a shingle.
RUN, SHINGLE = 13, 5
#: Hash functions of a signature.
FUNCTIONS = 4
#: Characters of the items of one block, at most about 25 times as many bytes in a worker's memory.
BLOCK = 8_000_000
_WORD = re.compile(r"[^\W_]+")
#: Characters of text that are hashed together; a bound on memory.
CHUNK = 1_000_000
# odd multipliers of the places in a shingle, and of the functions
_PLACES = [np.uint64(xxhash.xxh3_64_intdigest(bytes([k])) | 1) for k in range(SHINGLE)]
_MIXES = [np.uint64(xxhash.xxh3_64_intdigest(bytes([99, k])) | 1) for k in range(FUNCTIONS)]


def words(text: str | None) -> list[str]:
    """The unbroken runs of letters and digits, in NFKC and without case."""
    if not text:
        return []
    return _WORD.findall(text.lower() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()))


class _Hashes(dict):
    """Hash of each word, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hash of the five words from each place, mixed."""
    with np.errstate(over="ignore"):
        x = sum(hashes[k : len(hashes) - SHINGLE + 1 + k] * _PLACES[k] for k in range(SHINGLE))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def window_minima(shingles: np.ndarray, run: int, function: int) -> np.ndarray:
    """The minimum of each window of `run` words under one of the functions."""
    with np.errstate(over="ignore"):
        x = shingles if function == 0 else (shingles ^ (shingles >> np.uint64(31))) * _MIXES[function]
    n = len(x) - (run - SHINGLE)
    low = x[: max(n, 0)].copy()
    for k in range(1, run - SHINGLE + 1):
        np.minimum(low, x[k : n + k], out=low)
    return low


def size_class(count: int, run: int) -> int:
    """Class of an item of so many words: 0 from `run` words, 1 from twice as many, and so on."""
    return (count // run).bit_length() - 1


class Items:
    """The sketches of the items of a block, their classes with the thresholds, and their words."""

    def __init__(self, items: list[tuple[int, str]], run: int):
        """items: (number, text) of each; those below `run` words hold no run and are left out."""
        self.run, known = run, _Hashes()
        self.words = {k: w for k, text in items if len(w := words(text)) >= run}
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        largest: dict[tuple[int, int], int] = {}
        self.sketches: list[dict[int, set[int]]] = [{} for _ in range(FUNCTIONS)]
        for k, w in self.words.items():
            shingles = shingle_hashes(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
            for f in range(FUNCTIONS):
                minima = window_minima(shingles, run, f)
                if f == 0:
                    pairs.append((minima, np.full(len(minima), k), np.arange(len(minima))))
                own = set(minima.tolist())
                self.sketches[f][k] = own
                c = (size_class(len(w), run), f)
                largest[c] = max(largest.get(c, 0), len(own))
        self.thresholds = {c: 1 / n for c, n in largest.items()}
        low, item, place = (np.concatenate([p[x] for p in pairs]) if pairs else np.zeros(0, t) for x, t in enumerate((np.uint64, np.int64, np.int64)))
        order = np.argsort(low, kind="stable")
        self.low, self.item, self.place = low[order], item[order], place[order]
        self.runs: dict[int, dict[str, int]] = {}

    def runs_of(self, k: int) -> dict[str, int]:
        """The different runs of an item, numbered."""
        own = self.runs.get(k)
        if own is None:
            w = self.words[k]
            own = self.runs[k] = {x: n for n, x in enumerate(dict.fromkeys(" ".join(w[i : i + self.run]) for i in range(len(w) - self.run + 1)))}
        return own

    def search(self, w: list[str], shingles: np.ndarray, minima: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(item, shared, containment, estimate) of the items of which the text has a run; `at` are the windows whose minimum is that of an item."""
        of_item: dict[int, list[int]] = {}
        for p, a, b in zip(at.tolist(), np.searchsorted(self.low, minima[at], "left").tolist(), np.searchsorted(self.low, minima[at], "right").tolist()):
            for k in set(self.item[a:b].tolist()):
                of_item.setdefault(k, []).append(p)
        out = []
        others: dict[int, set[int]] = {0: set(minima[at].tolist())}
        for k, places in of_item.items():
            size, estimates = size_class(len(self.words[k]), self.run), []
            for f in range(FUNCTIONS):
                if f not in others:
                    others[f] = set(window_minima(shingles, self.run, f).tolist())
                own = self.sketches[f][k]
                estimates.append(len(own & others[f]) / len(own))
                if estimates[-1] < self.thresholds[size, f]:
                    break
            else:
                runs = self.runs_of(k)
                shared = {x for p in places if (x := " ".join(w[p : p + self.run])) in runs}
                if shared:
                    out.append((k, len(shared), len(shared) / len(runs), sum(estimates) / FUNCTIONS))
        return out


def search_udf(block: list[tuple[int, str]], run: int, spark):
    shared = spark.sparkContext.broadcast(block)
    made: list[Items] = []
    known = _Hashes()
    kind = pa.list_(pa.struct([("n", pa.int64()), ("shared", pa.int32()), ("containment", pa.float64()), ("estimate", pa.float64())]))

    @F.arrow_udf("array<struct<n:bigint,shared:int,containment:double,estimate:double>>")
    def search(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Items(shared.value, run))
        items, rows = made[0], []

        def flush(part: list[list[str]]) -> None:
            sizes = [len(w) for w in part]
            hashes = np.concatenate([np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in part]) if part else np.zeros(0, np.uint64)
            if len(hashes) < run or not len(items.low):
                rows.extend([] for _ in part)
                return
            shingles = shingle_hashes(hashes)
            minima = window_minima(shingles, run, 0)
            hits = np.flatnonzero(items.low[np.minimum(np.searchsorted(items.low, minima), len(items.low) - 1)] == minima)
            begin = 0
            for w, size in zip(part, sizes):
                n = size - run + 1  # windows within the text
                a, b = np.searchsorted(hits, (begin, begin + max(n, 0)))
                own = shingles[begin : begin + max(size - SHINGLE + 1, 0)]
                rows.append([dict(zip(("n", "shared", "containment", "estimate"), x)) for x in items.search(w, own, minima[begin : begin + n], hits[a:b] - begin)] if b > a else [])
                begin += size

        part, chars = [], 0
        for text in texts.to_pylist():
            part.append(words(text))
            chars += len(text or "")
            if chars > CHUNK:
                flush(part)
                part, chars = [], 0
        flush(part)
        return pa.array(rows, kind)

    return search.asNondeterministic()  # else a filter that Spark infers from an explosion would run it a second time


def item_blocks(items: DataFrame, text: str, size: int) -> Iterator[list[tuple[int, str]]]:
    """The different texts of the items, (n, text), in blocks of about `size` characters; only one block is held at a time."""
    block, chars = [], 0
    for r in items.select("_n", text).toLocalIterator():
        block.append((r[0], r[1]))
        chars += len(r[1])
        if chars > size:
            yield block
            block, chars = [], 0
    if block:
        yield block


def leaked_items(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """(key, item, shared, containment, estimate): each document and test item with a run of `run` words in common.

    shared is the number of different runs of the item in the document, containment its share of all runs of the item,
    estimate the containment as the signatures have it. Rows with a null key, item, or text have no part; texts below
    `run` words match nothing. Rows that repeat a key are one document, of which the largest containment counts, and
    items with the same text are searched once. Documents are read once for each block of items.
    """
    if run < SHINGLE:
        raise ValueError(f"a run has at least {SHINGLE} words")
    spark = documents.sparkSession
    named = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).alias("_item"), F.col(item_text).alias("_text"))
    texts = written(named.groupBy("_text").agg(F.collect_set("_item").alias("_items")).withColumn("_n", F.monotonically_increasing_id()))
    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    parts = [rows.select(F.col(key).alias("_key"), search_udf(b, run, spark)(F.col(text)).alias("_all")).select("_key", F.explode("_all").alias("_s")).select("_key", "_s.*") for b in item_blocks(texts, "_text", block)]
    if not parts:
        parts = [rows.limit(0).select(F.col(key).alias("_key"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("shared"), F.lit(0.0).alias("containment"), F.lit(0.0).alias("estimate"))]
    found = reduce(DataFrame.union, parts).join(texts.select("_n", F.explode("_items").alias("_item")), F.col("n") == F.col("_n"))
    most = found.groupBy("_key", "_item").agg(F.max(F.struct("containment", "shared", "estimate")).alias("_s"))
    return most.select(F.col("_key").alias(key), F.col("_item").alias(item), "_s.shared", "_s.containment", "_s.estimate")
