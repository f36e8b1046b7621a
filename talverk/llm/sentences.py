"""Sentences of texts in many languages and scripts.

Candidate boundaries are generated (terminators with what closes after them, spaces in Thai), and each is classified by a
maximum-entropy model over its neighbouring tokens, their case, length, digits and script, and over what it is nested in.
The model is trained without labels given: boundaries and non-boundaries that are beyond doubt in a bounded sample
serve as examples (see `_label`), and the model decides the doubtful ones, mostly abbreviations before a capital letter.
What is known of words (how they are written, which are abbreviations) is counted over all texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talverk.session import broadcast_if_small, materialize, written

#: Texts of each language in the sample from which a model is trained, texts in all, and characters in all. A bound on the work of the driver.
SAMPLE, TOTAL, CHARACTERS = 1500, 18_000, 3_000_000
#: Scores remembered by a worker for each kind of part; a bound on memory.
REMEMBER = 200_000
#: Least share of the full stops that an abbreviation has before it, and least number. A bound on what the driver gets.
SHARE, LEAST = 2e-6, 3
#: Characters whose words are counted together; a bound on memory.
CHUNK = 1_000_000
#: Longest word that is counted or remembered, and longest token that is looked at as a whole.
LONGEST, WHOLE = 40, 2000
#: A quotation or bracket beyond this many characters or terminators may as well be two stray marks.
NESTED, MARKS = 600, 12

_TERM = re.compile("[.!?…。！？।॥؟۔]+")
_CLOSERS = frozenset("\"'»«”“’)]」』）】›")
_OPENERS = "\"'»«”„“‘’([「『（【‹–—-•*"
_CASELESS_END = frozenset("。！？।॥؟۔")
_QUOTING = re.compile("[\"'»«”„“(\\[「『（]")
_SPAN = re.compile(
    r"\([^()]*\)|\[[^\[\]]*\]|（[^（）]*）|「[^「」]*」|『[^『』]*』|„[^„“”]*[“”]|“[^“”]*”|(?<!\w)”(?=\S)[^”]*”|(?<!\w)\"(?=\S)[^\"]*\"|»(?=\S)[^»«]*[»«]|«(?=\S)[^«»]*»|(?<!\w)'(?=\S)[^']*(?:(?<=\w)'(?=\w)[^']*)*'(?!\w)"
)
_THAI = re.compile(r"(?<=[฀-๿])\s+(?=\S)|(?<=\S)\s+(?=[฀-๿])")
_IN_THAI = re.compile("[฀-๿]")
_NUMBER = re.compile(r"\d[\d.,:/]*\Z")
_WORDISH = re.compile(r"[^\W\d_]+\Z")


class Candidate(NamedTuple):
    end: int  # characters up to and including the sentence's last
    prev: str  # token before the terminator
    term: str  # the terminator, `th` for a space in Thai
    closed: str  # "", or "c" after a quotation or bracket, "C" if that began the sentence
    gap: str  # "" no space, " " space, "\n" newline or more
    next: str  # token that follows, without dashes and opening marks
    opens: bool  # such marks stand before it
    item: bool  # the sentence so far is a number or a single short token
    nested: int = 0  # 1 within a quotation or bracket, 2 within one so long that it may be none


def _token_before(text: str, p: int) -> str:
    size = LONGEST
    while True:
        part = text[max(0, p - size) : p]
        if not part or part[-1].isspace():
            return ""
        token = part.rsplit(None, 1)[-1]
        if len(token) < len(part) or size >= min(p, WHOLE):
            return token.lstrip(_OPENERS)
        size *= 4


def _token_after(text: str, k: int) -> tuple[str, bool]:
    """The token from k on without opening marks, and whether there were some; tokens of nothing else are passed over, two at most."""
    size = LONGEST
    while True:
        part = text[k : k + size]
        tokens = part.split(None, 3)
        if len(tokens) > 3 or size >= min(len(text) - k, WHOLE):
            break
        after = next((n for n, t in enumerate(tokens[:3]) if t.lstrip(_OPENERS)), 2)
        if len(tokens) > after + 1 or (len(tokens) == after + 1 and part[-1].isspace()):
            break
        size *= 4
    opens, after = False, ""
    for token in tokens[:3]:
        after = token.lstrip(_OPENERS)
        opens |= after != token
        if after:
            break
    return after, opens


def candidates(text: str, decide) -> Iterator[tuple[Candidate, bool]]:
    """Each candidate in order with its decision; `decide` is asked at once, as a boundary changes what follows."""
    size, stop = len(text), len(text.rstrip())
    spans = [m.span() for m in _SPAN.finditer(text)] if _QUOTING.search(text) else []
    marks = [(m.start(), m.end()) for m in _TERM.finditer(text)]
    thai = [m.span() for m in _THAI.finditer(text)] if _IN_THAI.search(text) else []
    places = [p for p, _ in marks] if spans else []
    deep = (-1, 0)
    begin = at = 0
    for p, e, space in sorted([(p, e, False) for p, e in marks] + [(p, e, True) for p, e in thai]) if thai else [(p, e, False) for p, e in marks]:
        while at < len(spans) and spans[at][1] <= p:
            at += 1
        j = p if space else e
        if not space:
            while j < size and text[j] in _CLOSERS and not (j + 1 < size and text[j] in "\"'”»" and text[j + 1].isalnum() and not any(s < j < t for s, t in spans[at : at + 1])):
                j += 1
        closed = "c" if j > e and not space else ""
        nested = 0
        if at < len(spans) and spans[at][0] < p:
            if j < spans[at][1]:
                a, b = spans[at]
                if at != deep[0]:
                    deep = at, 2 if b - a > NESTED or bisect_left(places, b) - bisect_left(places, a) > MARKS else 1
                nested = deep[1]
            else:
                closed = "C" if not text[max(begin, spans[at][0] - LONGEST) : spans[at][0]].strip(" \n\t\r–—-") else "c"
        if j >= stop:
            continue  # the end of the text ends the last sentence
        if space:
            gap, k = "\n" if e - p > 1 or text[p] == "\n" else " ", e
        else:
            k = j
            while k < size and text[k].isspace():
                k += 1
            gap = "" if k == j else " " if k == j + 1 and text[j] != "\n" else "\n"
            if not gap:
                c = text[j]
                if text[p] not in _CASELESS_END and (not (c.isalpha() or c in _OPENERS) or c.islower() or (c in _OPENERS and text[p] == ".")):
                    continue
        after, opens = _token_after(text, k)
        so_far = text[begin:p].strip(_OPENERS + " \n\t\r") if p - begin < 12 else "-"
        item = so_far.isdigit() or (len(so_far) <= 4 and so_far.isalpha() and so_far.isascii())
        found = Candidate(j, _token_before(text, p), "th" if space else text[p:e], closed, gap, after, opens, item, nested)
        yes = decide(found)
        if yes:
            begin = k
        yield found, yes


def _kind_before(prev: str, short: frozenset[str] | set[str] = frozenset()) -> str:
    """`short` are the abbreviations."""
    if not prev:
        return "none"
    if prev.lower() in short:
        return "abbreviation"
    if _NUMBER.match(prev):
        return "number"
    if len(prev) == 1:
        return "initial" if prev.isupper() else "letter"
    if "." in prev[1:]:
        return "dotted"
    return "short" if len(prev) <= 4 else "long"


def _kind_after(after: str) -> str:
    if not after:
        return "none"
    c = after[0]
    if c.isdigit():
        return "item" if re.match(r"\d+\.(?:\s|\Z)", after) else "digit"
    if c.isupper() or c.istitle():
        return "initial" if len(after) >= 2 and after[1] == "." else "upper"
    if c.islower():
        return "lower"
    return "caseless" if c.isalpha() else "mark"


def _before(prev: str, kind: str) -> list[str]:
    low = prev.lower()
    out = ["p=" + low, "pk=" + kind]
    if low.isalpha():
        out += ["pl=%d" % min(len(low), 9), "pe=" + low[-3:]]
    if prev[:1].isupper():
        out.append("pU")
    return out


def _after(after: str) -> list[str]:
    word = after.rstrip(".,;:!?…)»”\"'")
    kind = _kind_after(after)
    return ["n=" + word, "nk=" + kind, "ne=%s%s" % (kind[0], word[-4:]), "nl=%d" % min(len(word), 8)]


def _middle(c: Candidate, before: str, after: str) -> list[str]:
    term = "." if c.term == "." else "th" if c.term == "th" else "dots" if set(c.term) <= {".", "…"} else "full" if c.term[0] in _CASELESS_END else "mark"
    near = "th%d%d" % (c.prev[-1:].isdigit(), c.next[:1].isdigit()) if c.term == "th" else ""
    nest = [f"in={c.nested}", f"in={c.nested}{term}{after}", f"in={c.nested}{c.gap}"] if c.nested else []
    return [*nest, f"t={term}{near}", f"t={term}{c.closed}", f"tn={term}{after}", f"tpn={term}{before}{after}", f"cn={c.closed}{after}", f"g={term}{c.gap}{before}{after}", f"o={c.opens}", f"i={c.item and term == '.'}{before}"]


class Model:
    """Weights of the features and the abbreviations; a positive sum of weights is a boundary.

    The parts before, between and after the candidate add up, so each is remembered by itself.
    """

    def __init__(self, weights: dict[str, float], short: frozenset[str] = frozenset()):
        self.weights, self.short = weights, short
        self.known: tuple[dict, dict, dict] = ({}, {}, {})

    def _sum(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def __call__(self, c: Candidate) -> bool:
        first, last, middle = self.known
        a = first.get(c.prev)
        if a is None:
            if len(first) > REMEMBER:
                first.clear()
            kind = _kind_before(c.prev, self.short)
            a = self._sum(_before(c.prev, kind)), kind
            if len(c.prev) <= LONGEST:
                first[c.prev] = a
        b = last.get(c.next)
        if b is None:
            if len(last) > REMEMBER:
                last.clear()
            b = self._sum(_after(c.next)), _kind_after(c.next)
            if len(c.next) <= LONGEST:
                last[c.next] = b
        key = (c.term, c.closed, c.gap, c.opens, c.item, c.nested, a[1], b[1], c.term == "th" and (c.prev[-1:].isdigit(), c.next[:1].isdigit()))
        m = middle.get(key)
        if m is None:
            if len(middle) > REMEMBER:
                middle.clear()
            m = middle[key] = self._sum(_middle(c, a[1], b[1]))
        return a[0] + b[0] + m > 0

    def ends(self, text: str | None) -> list[int]:
        """Characters up to and including the last of each sentence; none for a null, empty or blank text."""
        if not text:
            return []
        size = len(text.rstrip())
        out = [c.end for c, yes in candidates(text, self) if yes and c.end < size]
        return [*out, size] if size else out


#: What a token is like: its word has a full stop, begins small or with a digit, or large; it ends with a call, or with a letter, digit or comma.
_DOTTED, _ON, _UPPER, _CALL, _WITHIN = (1 << k for k in range(5))


class _Looks(dict):
    """The word of each token, without marks at either end, and the bits of the token; remembered."""

    def __init__(self):
        super().__init__()
        self.bits: dict[str, int] = {}

    def __missing__(self, token: str) -> str:
        core = token.strip(_OPENERS + ",;:!?…)»”\"'“\0")
        word = self[token] = core.rstrip(".")
        bits = 0
        if word:
            bits = _DOTTED * core.endswith(".") | _ON * (word[0].islower() or word[0].isdigit()) | _UPPER * word[0].isupper()
        if token != "\0":
            bits |= _CALL * (token[-1] in "!?") | _WITHIN * (token[-1].isalnum() or token[-1] == ",")
        self.bits[token] = bits
        return word


class _Counts:
    """How the words of the texts are written: what tells abbreviations, names and openers of sentences apart."""

    KINDS = ("dotted", "goes_on", "plain", "inner", "opening", "ended")

    def __init__(self, texts: list[str] = ()):
        self.dotted, self.goes_on, self.plain, self.inner, self.opening, self.ended = (Counter() for _ in self.KINDS)
        self.least = LEAST
        self.looks = _Looks()
        self.add(texts)

    def add(self, texts: list[str]) -> None:
        """Count the words of the texts; `ended` are those with a full stop, as they are written."""
        tokens: list[str] = []
        for text in texts:
            tokens += text.split()
            tokens.append("\0")  # nothing reaches over the end of a text
        look, known = self.looks, self.looks.bits
        for token, n in Counter(tokens).items():
            word = look[token]
            if not word:
                continue
            low = word.lower()
            if known[token] & _DOTTED:
                self.dotted[low] += n
                self.ended[word] += n
            else:
                self.plain[word if word[0].isupper() else low] += n
        bits = np.frombuffer(bytes(map(known.__getitem__, tokens)), np.uint8)
        before = np.concatenate(([0], bits[:-1])) if len(bits) else bits
        for counter, at, back in (
            (self.goes_on, (before & _DOTTED > 0) & (bits & _ON > 0), 1),
            (self.opening, (before & _CALL > 0) & (bits & _UPPER > 0), 0),
            (self.inner, (before & _WITHIN > 0) & (bits & _UPPER > 0), 0),
        ):
            for k in np.flatnonzero(at).tolist():
                word = look[tokens[k - back]]
                counter[word.lower() if back else word] += 1
        if len(known) > REMEMBER:
            self.looks.clear()
            known.clear()

    def ordinary(self, prev: str) -> bool:
        """A word that is no abbreviation: it is long or often stands without a full stop, and after its full stop no sentence goes on."""
        low = prev.lower()
        if not _WORDISH.match(low):
            return False
        if self.dotted[low] >= 4 and self.goes_on[low] > 0.25 * self.dotted[low]:
            return False
        return len(low) >= 8 or self.plain[low] + (self.plain[prev] if prev != low else 0) >= max(2, 0.25 * self.dotted[low])

    def name(self, word: str) -> bool:
        return self.inner[word] > 0 and self.plain[word.lower()] <= 0.01 * self.inner[word] and self.inner[word] >= self.opening[word]

    def opener(self, word: str) -> bool:
        if self.opening[word] == 0 and len(word) <= 2 and word != word.upper():
            return False
        if self.dotted[word.lower()] > self.plain[word] + self.plain[word.lower()]:
            return False
        return self.opening[word] >= 2 and self.opening[word] > self.inner[word] or (self.plain[word.lower()] >= 3 and self.plain[word.lower()] > self.inner[word])

    def abbreviations(self) -> frozenset[str]:
        found = Counter()
        for prev, n in self.ended.items():
            if not self.ordinary(prev):
                found[prev.lower()] += n
        return frozenset(w for w, n in found.items() if n >= self.least and not w[-1:].isdigit() and w[-1:] not in _CLOSERS and any(map(str.isalpha, w)) and len(w) <= 12)


def _label(c: Candidate, counts: _Counts, final: set[str]) -> bool | None:
    """Is it beyond doubt a boundary or none? `final` are abbreviations that mostly stand before an opener."""
    before, after, word = _kind_before(c.prev), _kind_after(c.next), c.next.rstrip(".,;:!?…)»”\"'")
    if c.nested == 1:
        return False
    if c.term == "th":
        return not (c.prev[-1:].isdigit() or c.next[:1].isdigit())
    if c.closed and (after == "lower" or (after == "caseless" and not c.gap)):
        return False
    if c.closed == "C" and after in ("upper", "item"):
        return True
    if c.term[0] in _CASELESS_END or "!" in c.term or "?" in c.term:
        return True
    if set(c.term) <= {".", "…"} and c.term != ".":
        return True if after == "upper" and counts.opener(word) else False if after == "lower" and not c.prev else None
    if c.item and (before == "number" or (after == "upper" and counts.name(word))):
        return False
    if before == "initial":
        return False
    if after == "caseless":
        return not (before == "letter" or (before == "short" and len(c.prev) <= 3 and not counts.ordinary(c.prev)))
    if before == "number":
        return False if after == "lower" or counts.name(word) else True if counts.opener(word) else None
    if counts.ordinary(c.prev) and before in ("short", "long"):
        return None if not c.gap and after != "upper" else True
    if after == "lower":
        return None if c.prev.lower() in final else False
    if after == "upper":
        return False if counts.name(word) else True if counts.opener(word) else None
    return False if after in ("digit", "item", "initial") and c.prev.lower() not in final else None


def train(texts: list[str], rounds: int = 150, counts: _Counts | None = None) -> Model:
    """A model from the candidates of the texts that are beyond doubt. Without any, one that takes every candidate.

    `counts` are those of the corpus from which the texts come; without them the texts are the corpus.
    """
    texts = [t for t in texts if t and t.strip()]
    own = _Counts(texts)
    counts = counts or own
    seen: list[Candidate] = []
    for text in texts:
        for c, _ in candidates(text, lambda c: c.nested != 1 and (c.term[0] in "!?" or c.term[0] in _CASELESS_END or (c.term == "." and counts.ordinary(c.prev)))):
            seen.append(c)
    low, all_, up = Counter(), Counter(), Counter()
    for c in seen:
        if c.term == "." and c.nested != 1 and not counts.ordinary(c.prev):
            after, word = _kind_after(c.next), c.next.rstrip(".,;:!?…)»”\"'")
            all_[c.prev.lower()] += 1
            low[c.prev.lower()] += after in ("lower", "digit")
            up[c.prev.lower()] += after == "upper" and counts.opener(word) and not counts.name(word)
    short = counts.abbreviations()
    final = {w for w, n in all_.items() if n >= 5 and up[w] > 0.6 * n and low[w] < 0.15 * n}
    rows: list[tuple[list[str], bool]] = []
    for c in seen:
        label = _label(c, counts, final)
        if label is not None:
            before, after = _kind_before(c.prev, short), _kind_after(c.next)
            rows.append((_before(c.prev, before) + _after(c.next) + _middle(c, before, after), label))
    # what may open a sentence and what stands capitalized within one, as if after an abbreviation
    doubtful = Candidate(0, "x.x", ".", "", " ", "X", False, False)
    for words, label in ((own.opening, True), (own.inner, False)):
        for word, n in words.items():
            if counts.name(word) is not label:
                rows += [(_after(word) + _middle(doubtful, "abbreviation", _kind_after(word)), label)] * min(n, 20)
    if not rows:
        return Model({"t=.": 1.0, "t=dots": 1.0, "t=full": 1.0, "t=mark": 1.0})
    names = {f: k for k, f in enumerate(sorted({f for features, _ in rows for f in features}))}
    grouped = Counter((tuple(sorted(names[f] for f in set(features))), label) for features, label in rows)
    index = np.concatenate([np.array(k, np.int64) for k, _ in grouped])
    row = np.repeat(np.arange(len(grouped)), [len(k) for k, _ in grouped])
    target = np.array([y for _, y in grouped], float)
    weight = np.sqrt(np.array(list(grouped.values()), float))
    w, m, v = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    for step in range(1, rounds + 1):  # Adam on the penalized likelihood
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[index], len(target)), -30, 30)))
        g = np.bincount(index, ((p - target) * weight)[row], len(names)) / weight.sum() + 2e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model({f: round(float(w[k]), 4) for f, k in names.items() if abs(w[k]) > 1e-3}, short)


_STUDY = "kind string, word string, low string, " + ", ".join(f"{kind} bigint" for kind in _Counts.KINDS) + ", texts bigint, place bigint"


def _studied(whole_words: bool):
    """Of rows (group, place, chosen, segments): counts of words (kind w), the texts of words by group (d, if asked for) and the segments of chosen texts (s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            counters = [getattr(counts, kind) for kind in _Counts.KINDS]
            words = [w for w in set().union(*counters) if len(w) <= LONGEST]
            words = [w for w in words if w.isascii() or not any("\ud800" <= x <= "\udfff" for x in w)]
            pairs = [((g, w), n) for g, own in texts.items() for w, n in own.items()]
            n, m, k = len(words), len(pairs), len(sample)
            columns = [
                pa.array(["w"] * n + ["d"] * m + ["s"] * k, pa.string()),
                pa.array(words + [w for (_, w), _ in pairs] + [t for _, _, t in sample], pa.string()),
                pa.array([w.lower() for w in words] + [g for (g, _), _ in pairs] + [g for g, _, _ in sample], pa.string()),
                *(pa.array([c[w] for w in words] + [0] * (m + k), pa.int64()) for c in counters),
                pa.array([0] * n + [x for _, x in pairs] + [0] * k, pa.int64()),
                pa.array([0] * (n + m) + [p for _, p, _ in sample], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["kind", "word", "low", *_Counts.KINDS, "texts", "place"])

        counts, texts, sample, part, size = _Counts(), {}, [], [], 0
        for batch in batches:
            for group, place, chosen, segments in zip(*(c.to_pylist() for c in batch.columns)):
                segments = [t for t in segments or () if t]
                part += segments
                size += sum(map(len, segments))
                if size > CHUNK:
                    counts.add(part)
                    part, size = [], 0
                if whole_words:
                    own = texts.setdefault(group, Counter())
                    own.update(plain_words(" ".join(segments), once=True))
                    own[""] += any(map(str.strip, segments))
                if chosen:
                    sample += [(group, place, t) for t in segments]
            counts.add(part)
            part, size = [], 0
            if len(counts.plain) + len(counts.dotted) + sum(map(len, texts.values())) > REMEMBER:
                yield rows()
                looks, counts, texts, sample = counts.looks, _Counts(), {}, []
                counts.looks = looks
        yield rows()

    return run


#: Words, and single characters of scripts that are written without spaces.
_WORD = re.compile("[฀-๿぀-ヿ㐀-鿿豈-﫿]|[^\\W_฀-๿぀-ヿ㐀-鿿豈-﫿]+")


def plain_words(text: str, once: bool = False) -> list[str]:
    """The words that begin with a letter that is no capital; each `once`, or as often as it occurs."""
    found = _WORD.findall(text)
    return [w for w in (set(found) if once else found) if w[0].islower() or (w[0].isalpha() and not w[0].isupper() and not w[0].istitle())]


class Study(NamedTuple):
    """What one pass over the texts of a corpus tells: counts of words, texts of words by group, and a sample of segments."""

    table: DataFrame

    def sample(self) -> list[str]:
        """At most TOTAL segments of at most CHARACTERS, of each group the first SAMPLE texts by a hash of their keys."""
        rows = self.table.where("kind = 's'").select(F.col("low").alias("_group"), F.col("place").alias("_place"), F.col("word").alias("_text"))
        order = Window.partitionBy("_group").orderBy("_place", "_text")
        ranked = rows.withColumn("_n", F.dense_rank().over(Window.partitionBy("_group").orderBy("_place"))).where(F.col("_n") <= SAMPLE)
        ranked = ranked.withColumn("_k", F.row_number().over(order)).orderBy("_k", "_group").limit(TOTAL)
        out, size = [], 0
        for row in ranked.select("_text").toLocalIterator():
            size += len(row[0])
            if size > CHARACTERS:
                break
            out.append(row[0])
        return out

    def counts(self, sample: list[str], share: float = SHARE) -> _Counts:
        """The counts over all texts, of the words of the sample and of those that have at least `share` of the full stops."""
        words = self.table.where("kind = 'w'").groupBy("word", "low").agg(*[F.sum(kind).alias(kind) for kind in _Counts.KINDS])
        words = materialize(words)
        counts = _Counts()
        counts.least = max(LEAST, share * (words.agg(F.sum("ended")).first()[0] or 0))
        own = _Counts(sample)
        for t in sample:
            own.ended.update(p for c, _ in candidates(t, lambda c: False) for p in (c.prev, c.next.rstrip(".,;:!?…)»”\"'")))
        lows = sorted({w.lower() for kind in _Counts.KINDS for w in getattr(own, kind) if len(w) <= LONGEST})
        frequent = words.groupBy("low").agg(F.sum("ended").alias("_n")).where(F.col("_n") >= counts.least).select("low")
        wanted = frequent.union(self.table.sparkSession.createDataFrame(pa.table({"low": pa.array(lows, pa.string())})))
        found = words.join(wanted, "low", "left_semi").select("word", *_Counts.KINDS).toArrow()
        names = found.column("word").to_pylist()
        for kind in _Counts.KINDS:
            getattr(counts, kind).update({w: n for w, n in zip(names, found.column(kind).to_pylist()) if n})
        return counts

    def model(self) -> Model:
        """Weights from the sample, what is known of words from all texts."""
        sample = self.sample()
        return train(sample, counts=self.counts(sample))

    def frequencies(self) -> DataFrame:
        """(group, word, texts): in how many texts of its group each plain word occurs, and under the empty word the texts that aren't blank."""
        return self.table.where("kind = 'd'").groupBy(F.col("low").alias("group"), "word").agg(F.sum("texts").alias("texts"))


def study(df: DataFrame, key: str, segments: str, group: str, *, words: bool = False, wide: DataFrame | None = None) -> Study:
    """One pass over all texts (arrays of segments); with `words` also the texts of each plain word by group.

    Null and empty segments have no words; repeated rows count again. The texts of the sample are chosen in the same
    pass, by a hash of the key and the number of rows of the group, which is counted on the group alone. `wide` may hold
    the same rows over more tasks.
    """
    name = F.coalesce(F.col(group), F.lit("")).alias("_group")
    sizes = broadcast_if_small(df.select(name).groupBy("_group").agg(F.count("*").alias("_size")))
    rows = (df if wide is None else wide).select(name, F.xxhash64(key).alias("_place"), F.col(segments).alias("_segments")).join(sizes, "_group")
    # so many texts of a group that hardly ever fewer than SAMPLE are chosen
    chosen = (F.col("_place").bitwiseAND(0xFFFFFFF) / 0x10000000) * F.col("_size") < 1.2 * SAMPLE + 50
    return Study(written(rows.select("_group", "_place", chosen.alias("_chosen"), "_segments").mapInArrow(_studied(words), _STUDY)))


def ends_udf(model: Model):
    weights, short = model.weights, model.short
    made: list[Model] = []

    @F.arrow_udf("array<array<int>>")
    def ends(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Model(weights, short))
        return pa.array([[made[0].ends(t) for t in segments or ()] for segments in texts.to_pylist()], pa.list_(pa.list_(pa.int32())))

    return ends.asNondeterministic()  # else a filter that Spark infers from an explosion would run it a second time


def sentence_ends(df: DataFrame, key: str, segments: str, model: Model) -> DataFrame:
    """(key, seg, char_end): a row for each sentence of each segment of the texts (arrays of strings).

    seg counts from 0, also over null and empty segments, which have no rows, as null and empty arrays have none. What
    follows the last terminator of a segment is a sentence too. Rows with the same key have rows of their own.
    """
    found = df.select(key, ends_udf(model)(F.col(segments)).alias("_ends"))
    rows = found.select(key, F.posexplode("_ends").alias("seg", "_e"))
    return rows.select(key, "seg", F.explode("_e").alias("char_end"))


def sentences(df: DataFrame, key: str, segments: str, model: Model) -> DataFrame:
    """(key, seg, n, char_end, sentence): the sentences themselves, numbered from 0 within their segment, without white space at either end."""
    kind = pa.list_(pa.list_(pa.struct([("char_end", pa.int32()), ("sentence", pa.string())])))
    weights, short = model.weights, model.short
    made: list[Model] = []

    @F.arrow_udf("array<array<struct<char_end:int,sentence:string>>>")
    def cut(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Model(weights, short))
        rows = []
        for segments in texts.to_pylist():
            rows.append([])
            for t in segments or ():
                ends = made[0].ends(t)
                rows[-1].append([{"char_end": e, "sentence": t[b:e].strip()} for b, e in zip([0, *ends], ends)])
        return pa.array(rows, kind)

    found = df.select(key, cut.asNondeterministic()(F.col(segments)).alias("_cut"))
    rows = found.select(key, F.posexplode("_cut").alias("seg", "_s"))
    return rows.select(key, "seg", F.posexplode("_s").alias("n", "_x")).select(key, "seg", "n", "_x.char_end", "_x.sentence")
