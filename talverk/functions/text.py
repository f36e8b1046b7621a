"""Column functions on text, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what counts as a word, and where sentences end, in these statistics
WORD2 = r"[\p{L}\p{N}_]{2,}"
WORD1 = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
SENTENCE_END = r"[.!?]+(\s|\z)"
SENTENCE_SPLIT = r"(?<![\p{L}\p{N}_]\.[\p{L}\p{N}_].)(?<![A-Z][a-z]\.)(?<=\.|\?)[\s\x1c-\x1f\x85\p{Z}]"

Range = tuple[int, int | None]
RANGES: list[Range] = [(20, 200), (201, 500), (501, 1000), (1001, None)]


def merged_text(segments: Column) -> Column:
    """Segments as one text in small letters; null for null."""
    return F.lower(F.array_join(segments, " "))


def decade(year: Column) -> Column:
    return year - year % 10


def decade_label(year: Column) -> Column:
    return F.concat(decade(year).cast("string"), F.lit("s"))


def tokens(text: Column, pattern: str = WORD2) -> Column:
    """Words of the text in order; null for null, empty for an empty text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def token_count(text: Column) -> Column:
    """Words and single marks, an approximation of a treebank tokenizer."""
    return F.regexp_count(text, F.lit(TOKEN))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by spaces, in order, repeated ones repeated; empty for fewer words."""

    def runs(w: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, all_).otherwise(F.array().cast("array<string>"))

    # the words are a variable of the outer function, else they would be made anew for each run
    return F.flatten(F.transform(F.array(words), runs))


def ttr(words: Column, sentinel: float | None = None) -> Column:
    """Different words in a hundred words; null (or the sentinel) without words."""
    return F.when(F.size(words) > 0, F.lit(100.0) * F.size(F.array_distinct(words)) / F.size(words)).otherwise(F.lit(sentinel).cast("double"))


def ttr_ratio(words: Column) -> Column:
    """Different words by words, from 0 to 1; null without words."""
    return ttr(words) / 100.0


def sentence_count(text: Column) -> Column:
    """Ends of sentences, at least one for a text that isn't blank."""
    return F.when(text.rlike(r"\S"), F.greatest(F.lit(1), F.regexp_count(text, F.lit(SENTENCE_END))))


def lix(text: Column, sentinel: float | None = None) -> Column:
    """Words a sentence plus the percentage of words of more than six characters; null (or the sentinel) without words."""
    words = tokens(text, WORD1)
    long_words = F.size(F.filter(words, lambda w: F.length(w) > 6))
    value = F.size(words) / sentence_count(text) + F.lit(100.0) * long_words / F.size(words)
    return F.when(F.size(words) > 0, value).otherwise(F.lit(sentinel).cast("double"))


def occurrences(text: Column, part: str) -> Column:
    """How often a string occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def split_sentences(text: Column) -> Column:
    """Parts between white space that follows a full stop or question mark and no abbreviation of two letters."""
    return F.split(text, SENTENCE_SPLIT, -1)


def token_range(count: Column, ranges: list[Range] | None = None, numbered: bool = False) -> Column:
    """Label of the first range that holds the count, `None` if none does."""
    label = None
    for k, (low, high) in enumerate(ranges or RANGES, 1):
        name = ("%d: " % k if numbered else "") + f"{low}-{'inf' if high is None else high}"
        holds = (count >= low) & (F.lit(True) if high is None else count <= high)
        label = F.when(holds, name) if label is None else label.when(holds, name)
    return label.otherwise("None")


def range_start(label: Column) -> Column:
    """Lower end of a range label, to sort by; null for `None`."""
    return F.when(label != "None", F.split(F.regexp_replace(label, r"^\d+: ", ""), "-")[0].cast("int"))


def capitalize(text: Column) -> Column:
    """First letter large, the rest small."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1_000_000_000)))


def squeeze(text: Column) -> Column:
    """Single spaces only, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def protocol_year(protocol: Column) -> Column:
    """Year in an id like prot-1933--031; null if there is none."""
    part = F.substring(F.get(F.split(protocol, "-"), F.lit(1)), 1, 4)
    return F.when(part.rlike("^[0-9]{4}$"), part.cast("int"))


def protocol_number(protocol: Column) -> Column:
    return F.get(F.split(protocol, "--"), F.lit(1))


def file_stem(name: Column) -> Column:
    return F.split(name, "_")[0]


def approximate_age(day: Column, born: Column) -> Column:
    return F.datediff(day, born) / F.lit(365.2425)


def year_range(low: Column, high: Column) -> Column:
    """`1990-1994`, or `1990` if both are the same."""
    return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))
