"""Text of scanned pages as continuous text: furniture out, broken words whole, misread words mended.

A lexicon of frequent words is counted in a reference (text that was not scanned), and skip-gram vectors are trained on
the reference and the scans together. Words of a scan that are neither in the lexicon nor made of parts of its words are
rare. Each rare word is linked to the words a plausible glyph edit away, by three things: how near the vector of the
frequent word is to that of the rare one, how likely the edit is, and how frequent the word is. The vector of a
rare word is the sum of those of the words around all its occurrences, which is what skip-gram makes a word predict; so
also words that occur once have one, and their number has no bound. Links are made once for each different word, by a
distributed aggregation. Where a word has several, the one that fits its neighbours in the text is taken.

Lines that are furniture (running heads, page numbers) are told from lines of the speech by a logistic classifier trained
on repaired samples, with the frequency of a line's pattern over all scans as one of its features; every line is
classified. How likely an edit is comes from these samples too, on top of a list of glyphs of like shape.

What is handed to the executors is bounded by shares, whatever the size of the corpus: at most 1 / WORD_SHARE words with
their vectors, at most (lines of a segment) / LINE_SHARE patterns; links go there if they are few (checked), and by a
join if not.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talverk.session import BROADCAST_BYTES, BROADCAST_ROWS, materialize, scratch

#: A word or odd token of the lexicon makes up at least this share of the tokens of the reference.
WORD_SHARE = 5e-6
#: A known pattern of lines occurs in at least this share of the scanned segments.
LINE_SHARE = 2e-3
#: Most repaired samples from which the classifier of lines is trained and edits are weighed.
SAMPLES = 500
#: Parts of compounds begin or end at least this many words of the lexicon.
PART = 4
#: Size of the vectors, words on either side, and the share of the tokens beyond which words are thinned out for training.
SIZE, WINDOW, THIN = 16, 2, 1e-5
#: Characters whose lines are looked at together; a bound on memory.
CHUNK = 1_000_000
#: Tokens for one partition of the training.
TRAIN = 2_000_000
#: Links kept for a rare word, and rare words whose vectors a task collects before it hands them on.
LINKS, REMEMBER = 4, 50_000

# fixed values: what is read, and what may stand in print
GLYPHS = (
    ("c", "e"), ("e", "c"), ("u", "n"), ("n", "u"), ("f", "t"), ("t", "f"), ("rn", "m"), ("m", "rn"), ("a", "ä"), ("a", "å"), ("ä", "å"),
    ("å", "ä"), ("á", "å"), ("à", "å"), ("â", "å"), ("é", "e"), ("q", "g"), ("g", "q"), ("o", "ö"), ("ö", "o"), ("0", "o"), ("6", "ö"),
    ("lc", "k"), ("ſ", "s"), ("5", "s"), ("ii", "ä"), ("ii", "å"), ("ii", "ü"), ("|", "i"), ("|", "l"), ("1", "l"), ("1", "i"), ("!", "l"),
    ("!", "i"), ("l", "i"), ("i", "l"), ("b", "h"), ("h", "b"), ("y", "v"), ("v", "y"), ("&", "å"), ("&", "ä"), ("8", "å"), ("3", "å"),
    ("cl", "d"), ("li", "h"), ("vv", "w"),
)
#: Marks at the end of a line that break a word, and of these the ones that may be a hyphen of the word itself.
BREAKS, HYPHENS = "-‐¬=\xad", "-‐"
# fixed values: words before which a hyphen stands for the rest of a compound
COORDINATING = frozenset(("och", "eller", "samt", "respektive", "and", "or", "und", "oder", "ja", "tai"))
_EDGES = ".,;:!?»«\"'()”“„…–—[]‘’·"
_INTRUDERS = re.compile(r"[.,;'’:`·]+")
_ODD = re.compile(r"(?<=[^\W\d_])[.,;'’:`·|&\d!ſ]+(?=[^\W\d_])|ſ|\A[|&\d](?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[|&\d]\Z")
_ABBREVIATION = re.compile(r"(?:[^\W\d_]{1,4}[.:])+[^\W\d_]{0,4}\Z")
_NUMBER = re.compile(r"[\d.,:/*§–%-]+\Z")


Link = tuple[str, int, float]  # the right form, the place of the edit, and how good it is


def line_patterns(lines: pa.Array) -> np.ndarray:
    """Hashes of lines (without white space at either end) with their numbers (also misread ones) as 9 and single spaces."""
    texts = lines.to_numpy(zero_copy_only=False)
    numbers = pc.match_substring_regex(lines, "[0-9]").to_numpy(zero_copy_only=False)
    wide = pc.match_substring_regex(lines, r"\s\s|[\t\r\f\v]").to_numpy(zero_copy_only=False)
    if (numbers | wide).any():
        masked = pc.replace_substring_regex(lines.filter(pa.array(numbers | wide)), r"\b[0-9IlOoЗSB|]*[0-9][0-9IlOoЗSB|]*\b", "9")
        texts = texts.copy()
        texts[numbers | wide] = pc.replace_substring_regex(masked, r"\s+", " ").to_numpy(zero_copy_only=False)
    return pd.util.hash_array(texts, categorize=False).view(np.int64)


#: What a character is: bits for digit, letter, capital, small letter, white space, mark around a number, opening and closing bracket, end of a sentence, mark, break.
DIGIT, LETTER, CAPITAL, SMALL, SPACE, AROUND, OPENS, CLOSES, ENDS, MARK, BREAK = (1 << k for k in range(11))


def _classes() -> np.ndarray:
    """The bits of the characters up to U+2FFF, and last those that stand for the rest."""
    out = np.zeros(0x3001, np.int16)
    for k in range(0x3000):
        c = chr(k)
        out[k] = DIGIT * c.isdigit() | LETTER * c.isalpha() | CAPITAL * c.isupper() | SMALL * c.islower() | SPACE * c.isspace() | AROUND * (c in "[]—–-.,()")
        out[k] |= OPENS * (c == "(") | CLOSES * (c == ")") | ENDS * (c in ".!?") | MARK * (c in ".!?,;:") | BREAK * (c in BREAKS)
    out[0x3000] = LETTER
    return out


_CLASSES: list[np.ndarray] = []


class Lexicon:
    """Frequent words with counts and vectors, odd tokens, and the parts of compounds derived from the words."""

    def __init__(self, words: dict[str, int], odd: frozenset[str], vectors: dict[str, np.ndarray], edits: dict[tuple[str, str], float] | None = None):
        self.words, self.odd, self.vectors = words, odd, vectors
        self.edits = edits if edits is not None else weigh_edits([])
        begins, ends = Counter(), Counter()
        for w in words:
            for k in range(3, len(w) - 2):
                begins[w[:k]] += 1
                ends[w[k:]] += 1
        self.begins = frozenset(p for p, n in begins.items() if n >= PART)
        self.ends = frozenset(p for p, n in ends.items() if n >= PART)
        self.longest = max(map(len, words), default=0)
        self.known: dict[str, bool] = {}

    def _reached(self, w: str) -> tuple[int, bool]:
        """How far the word can be covered by parts that begin words, and whether the rest is a part that ends words."""
        reached, last = [0], 0
        for k in range(3, len(w) - 2):
            if k - last > self.longest:
                break  # no part is that long
            if any(3 <= k - j <= self.longest and w[j:k] in self.begins for j in reached[-self.longest :]):
                if len(w) - k <= self.longest and w[k:] in self.ends:
                    return k, True
                reached.append(k)
                last = k
        return last, False

    def valid(self, w: str) -> bool:
        if w in self.words:
            return True
        found = self.known.get(w)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self._reached(w)[1]
            if len(w) <= 3 * self.longest:
                self.known[w] = found
        return found

    def near(self, words: list[str]) -> np.ndarray | None:
        """Sum of the vectors of the words, of length 1."""
        vectors = [self.vectors[n] for n in words if n in self.vectors]
        if not vectors:
            return None
        total = np.sum(vectors, axis=0)
        return total / (float(np.linalg.norm(total)) or 1.0)

    def fit(self, w: str, vector: np.ndarray | None) -> float:
        return 3 * float(vector @ self.vectors[w]) if vector is not None and w in self.vectors else 0.0

    def edited(self, w: str, vector: np.ndarray | None) -> list[Link]:
        """Links of a word to the valid words a glyph edit away."""
        found: dict[str, Link] = {}
        limit = self._reached(w)[0] + self.longest  # before an edit the word is as it was, so parts must cover it up to there
        for (read, printed), weight in self.edits.items():
            k = w.find(read)
            while 0 <= k <= limit:
                v = w[:k] + printed + w[k + len(read) :]
                if v.isalpha() and self.valid(v):
                    score = weight + math.log1p(self.words.get(v, 0)) + self.fit(v, vector)
                    if v not in found or found[v][2] < score:
                        found[v] = (v, k, score)
                k = w.find(read, k + 1)
        return sorted(found.values(), key=lambda x: (-x[2], x[0]))[:LINKS]

    def right(self, core: str) -> bool:
        """A word in small letters that needs no mending, or none that can be mended."""
        return len(core) < 2 or core in self.words or core in self.odd or bool(_NUMBER.match(core))

    def links(self, core: str, vector: np.ndarray | None = None) -> list[Link]:
        """What a word in small letters may have been, best first; none if it is right or beyond mending. `vector` is that of the word."""
        if self.right(core):
            return []
        if core.replace("-", "").replace("‐", "").isalpha() and "ſ" not in core:
            begin = 0
            for part in re.split("[-‐]", core):
                if len(part) > 1 and not self.valid(part):
                    found = self.edited(part, vector)
                    if found:
                        return [(core[:begin] + v + core[begin + len(part) :], begin + k, score) for v, k, score in found]
                begin += len(part) + 1
            return []
        odd, plain = _ODD.search(core), _INTRUDERS.sub("", core)
        if not odd or (_ABBREVIATION.match(core) and (len(plain) < 5 or plain not in self.words)):
            return []
        sides = _INTRUDERS.split(core, maxsplit=2)
        if plain != core and len(sides) == 2 and all(self.valid(s) and len(s) > 2 for s in sides) and core[odd.start()] in ".,;:":
            return []  # two words without a space between
        if plain.isalpha() and "ſ" not in plain and self.valid(plain):
            return [(plain, odd.start(), 0.0)]
        found = self.edited(core, vector) or (self.edited(plain, vector) if plain != core else [])
        if found:
            return found
        twice = core  # several misread glyphs of one kind
        for read, printed in GLYPHS:
            if read in "0156|&ſ!83" and read in twice:
                twice = twice.replace(read, printed)
        return [(twice, odd.start(), 0.0)] if twice != core and twice.isalpha() and self.valid(twice) else []


def weigh_edits(samples: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Logarithms of how likely glyphs are read so: each pair of like shape counts once, and as often as in the samples."""
    counts = Counter(dict.fromkeys(GLYPHS, 1))
    for raw, repaired in samples:
        a, b = raw.split(), repaired.split()
        for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if kind == "replace" and j - i == m - k:
                for x, y in zip(a[i:j], b[k:m]):
                    for same, p, q, r, s in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                        if same == "replace" and max(q - p, s - r) <= 2:
                            counts[x[p:q].lower(), y[r:s].lower()] += 1
    total = sum(counts.values())
    return {pair: math.log(n / total) for pair, n in counts.items()}


def line_features(texts: list[str], lexicon: Lexicon, patterns: dict[int, float]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """The lines of each text, and of each line that isn't blank the number of its text, its own and its features; all texts at once."""
    if not _CLASSES:
        _CLASSES.append(_classes())
    lines = [t.split("\n") for t in texts]
    text = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    number = np.concatenate([np.arange(len(x)) for x in lines]) if lines else np.zeros(0, np.int64)
    all_lines = [line for x in lines for line in x]
    bare = [line.strip() for line in all_lines]
    kept = np.array([bool(x) for x in bare], bool)
    text, number, own = text[kept], number[kept], [x for x in bare if x]
    n = len(own)
    if not n:
        return lines, text, number, np.zeros((0, 23))
    code = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = _CLASSES[0][np.minimum(code, 0x3000)]
    length = np.array([len(x) for x in own])
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    first, last = bits[begin], bits[begin + length - 1]
    before_last = np.where(length > 1, bits[begin + np.maximum(length - 2, 0)], 0)
    count = lambda bit: np.add.reduceat((bits & bit) > 0, begin, dtype=np.int64)
    is_ = lambda x, bit: ((x & bit) > 0).astype(float)
    digits, letters, solid = count(DIGIT), count(LETTER), length - count(SPACE)
    line = pa.array(own, pa.string())
    words = pc.utf8_split_whitespace(line)
    of, word = pc.list_parent_indices(words).to_numpy(), words.flatten()
    number_of = lambda mask: np.bincount(of[mask], minlength=n).astype(float)
    coded = word.dictionary_encode()
    cores = [w.strip(_EDGES + BREAKS).lower() for w in coded.dictionary.to_pylist()]
    at = coded.indices.to_numpy()
    alphabetic = np.array([len(w) > 1 and w.isalpha() for w in cores], bool)[at]
    good = np.array([len(w) > 1 and w.isalpha() and lexicon.valid(w) for w in cores], bool)[at]
    single = np.array([len(w) == 1 for w in coded.dictionary.to_pylist()], bool)[at]
    all_words, alpha = number_of(slice(None)), number_of(alphabetic)
    ends, small, marked, digit_first = is_(last, ENDS), is_(first, SMALL), is_(last, MARK), is_(first, DIGIT)
    same = np.concatenate((text[1:] == text[:-1], [False]))  # does a line of the same text follow?
    open_before = np.concatenate(([False], same[:-1] & (ends[:-1] == 0)))
    small_after = same & (np.roll(small, -1) > 0)
    share = np.log1p(1e4 * np.array([patterns.get(h, 0.0) for h in line_patterns(line).tolist()]))
    closing = code[begin + length - 1] == ord("]")
    columns = [
        np.ones(n), share * (1 - small), share * small, ((digits > 0) & (digits == solid - count(AROUND))) * (1 - ends), digits / solid, np.maximum(is_(last, DIGIT), closing), (letters > 6) * (count(CAPITAL) == letters),
        (all_words >= 5) * (number_of(single) > 0.7 * all_words), small, digit_first * (all_words > 1), np.where(alpha > 0, number_of(good) / np.maximum(alpha, 1), 0.5),
        np.array(["   " in x for x in own]), np.array(["\f" in x for x, k in zip(all_lines, kept) if k]), is_(last, CLOSES) * is_(before_last, ENDS), ends, ends * (digits > 0.4 * solid), np.minimum(length, 60) / 60,
        is_(last, BREAK) * is_(before_last, LETTER), open_before & small_after, small * (digits == 0), small * marked, digit_first * marked, count(CLOSES) > count(OPENS),
    ]
    return lines, text, number, np.column_stack(columns).astype(float)


def sample_lines(raw: str, repaired: str) -> tuple[list[str], list[bool | None]]:
    """The lines of a sample, and of each whether it is furniture (None for a blank one): most of it isn't in the repaired text."""
    lines = raw.split("\n")
    solid = ["".join(line.split()) for line in lines]
    of_line = np.repeat(np.arange(len(lines)), [len(x) for x in solid])
    same = np.zeros(len(lines))
    for a, _, size in SequenceMatcher(None, "".join(solid), "".join(repaired.split()), autojunk=False).get_matching_blocks():
        same += np.bincount(of_line[a : a + size], minlength=len(lines))
    return lines, [bool(n < 0.6 * len(x)) if x else None for n, x in zip(same, solid)]


def train_lines(samples: list[tuple[str, str]], lexicon: Lexicon, patterns: dict[int, float]) -> np.ndarray:
    """Weights of line_features for furniture. Without samples of both kinds nothing is taken for furniture."""
    kinds = [sample_lines(raw, repaired)[1] for raw, repaired in samples]
    _, text, line, x = line_features([raw for raw, _ in samples], lexicon, patterns)
    y = np.array([float(kinds[t][k]) if kinds[t][k] is not None else np.nan for t, k in zip(text.tolist(), line.tolist())])
    x, y = x[~np.isnan(y)], y[~np.isnan(y)]
    if len(set(y.tolist())) < 2:
        return np.array([-1.0])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + 0.05 * w)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return w


class Page:
    """The words of a segment with the furniture out and broken words whole."""

    def __init__(self, lines: list[str], out: set[int]):
        self.kinds: set[tuple[int, str]] = {(k, "furniture") for k in out}
        speech = [k for k, line in enumerate(lines) if k not in out and line.strip()]
        # words with their line; a broken word has the line of each of its parts, with where they end
        self.tokens: list[str] = []
        self.places: list[int | list[tuple[int, int]]] = []
        held, parts = "", []
        for n, k in enumerate(speech):
            words = lines[k].split()
            following = lines[speech[n + 1]].split(None, 1)[0] if n + 1 < len(speech) else ""
            last = words[-1]
            broken = bool(following) and len(last) > 1 and last[-1] in BREAKS and (last[-2].isalpha() or last[-2] in "|&ſ016")
            name = False  # two names with a hyphen of their own, which stays
            if broken:
                own = last[-1] in HYPHENS and (following.lower() in COORDINATING or following[0].isupper())
                name = own and last[0].isupper() and following[0].isupper()
                broken = not own and (following[0].isalpha() or following[0] in "|&ſ0156")
            if held:
                words[0] = held + words[0]
            for word in words[:-1] if broken or name else words:
                self.tokens.append(word)
                if held:
                    self.places.append([*parts, (k, len(word))])
                    held, parts = "", []
                else:
                    self.places.append(k)
            if broken or name:
                held = words[-1] if name else words[-1][:-1]
                if broken:
                    self.kinds.add((k, "split"))
                parts = [*parts, (k, len(held))] if len(words) == 1 else [(k, len(held))]
        self.cores = [w.strip(_EDGES).lower() for w in self.tokens]

    def line_at(self, token: int, at: int) -> int:
        place = self.places[token]
        return place if isinstance(place, int) else next((line for line, end in place if at < end), place[-1][0])

    def groups(self) -> Iterator[tuple[int, int, str]]:
        """(begin, end, core) of each word; letters that stand apart, three or more, are one."""
        k, n = 0, len(self.tokens)
        while k < n:
            j = k
            while j < n and len(self.cores[j]) == 1 and self.cores[j].isalpha():
                j += 1
            if j - k >= 3:
                yield k, j, "".join(self.tokens[k:j]).strip(_EDGES).lower()
                k = j
            else:
                yield k, k + 1, self.cores[k]
                k += 1

    def around(self, k: int, j: int) -> list[str]:
        return self.cores[max(0, k - WINDOW) : k] + self.cores[j : j + WINDOW]


class Reader:
    """read(segments) gives the kinds of the lines and the text of each; `links` has those of the rare words, without it they are made at once."""

    def __init__(self, lexicon: Lexicon, patterns: dict[int, float], weights: np.ndarray, links: dict[str, list[Link]] | None = None):
        self.lexicon, self.patterns, self.weights, self.links = lexicon, patterns, weights, links

    def pages(self, texts: list[str | None]) -> Iterator[Page | None]:
        """The pages of texts, None for a null or blank one; the lines of about CHUNK characters are classified at once."""
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size > CHUNK:
                yield from self._pages(part)
                part, size = [], 0
        yield from self._pages(part)

    def _pages(self, texts: list[str | None]) -> list[Page | None]:
        there = [k for k, t in enumerate(texts) if t and t.strip()]
        out: list[Page | None] = [None] * len(texts)
        own = [texts[k] for k in there]
        furniture: dict[int, set[int]] = {}
        if len(self.weights) == 1:
            lines = [t.split("\n") for t in own]
        else:
            lines, text, line, x = line_features(own, self.lexicon, self.patterns)
            hits = np.flatnonzero(x @ self.weights > 0)
            for t, k in zip(text[hits].tolist(), line[hits].tolist()):
                furniture.setdefault(t, set()).add(k)
        for t, k in enumerate(there):
            out[k] = Page(lines[t], furniture.get(t, set()))
        return out

    def misread(self, core: str, near: list[str], links: dict[str, list[Link]] | None = None) -> tuple[str, int] | None:
        """The right form of a word in small letters and the place where it was misread; None if it is right or beyond mending."""
        if self.lexicon.right(core):
            return None
        own = links if links is not None else self.links
        found = self.lexicon.links(core, self.lexicon.near(near)) if own is None else own.get(core)
        if not found:
            return None
        if len(found) > 1 and own is not None:  # which fits here?
            vector = self.lexicon.near(near)
            return max(found, key=lambda x: (x[2] + self.lexicon.fit(x[0], vector), x[0]))[:2]
        return found[0][:2]

    def mend(self, page: Page, links: dict[str, list[Link]] | None = None) -> tuple[list[tuple[int, str]], str]:
        kinds, known, out = set(page.kinds), self.lexicon.words, []
        for k, j, core in page.groups():
            if j - k == 1 and core in known:
                out.append(page.tokens[k])
                continue
            word = "".join(page.tokens[k:j])
            found = self.misread(core, page.around(k, j), links)
            if j - k > 1:
                kinds.update((page.line_at(t, 0), "misread") for t in range(k, j))
            elif found:
                kinds.add((page.line_at(k, word.lower().find(core) + found[1]), "misread"))
            out.append(self.mended(word, core, found))
        return sorted(kinds), " ".join(out)

    def read(self, texts: list[str | None], links: dict[str, list[Link]] | None = None) -> list[tuple[list[tuple[int, str]], str]]:
        return [self.mend(page, links) if page else ([], "") for page in self.pages(texts)]

    @staticmethod
    def mended(word: str, core: str, found: tuple[str, int] | None) -> str:
        """The word with the right form in place of its core, large letters as they were."""
        if not found:
            return word
        begin = word.lower().find(core)
        inner, better = word[begin : begin + len(core)], found[0]
        better = better.upper() if inner.isupper() and len(inner) > 1 else better[:1].upper() + better[1:] if inner[:1].isupper() else better
        return word[:begin] + better + word[begin + len(core) :]


def token_lists(texts: pa.Array) -> pa.ListArray:
    """The tokens of each text, in small letters and without marks at either end; empty ones stay, as nothing."""
    lists = pc.utf8_split_whitespace(texts)
    tokens = pc.utf8_lower(pc.utf8_trim(lists.flatten(), _EDGES))
    return pa.ListArray.from_arrays(lists.offsets, tokens) if not lists.null_count else pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))), pa.int32()), tokens)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (scanned, segments): tokens of the reference (kind w), patterns of lines (p) and number of segments of the scans (n), with counts."""
    for batch in batches:
        scanned, segments = batch.column(0), batch.column(1)
        tokens = token_lists(segments.filter(pc.invert(scanned)).flatten().drop_null()).flatten()
        words = tokens.filter(pc.greater(pc.binary_length(tokens), 0)).value_counts()
        pages = segments.filter(scanned).flatten()
        lines = pc.split_pattern(pages.drop_null(), "\n").flatten()
        lines = lines.filter(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(lines)), 0))
        patterns, times = np.unique(line_patterns(lines), return_counts=True) if len(lines) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        k, m = len(words), len(patterns)
        yield pa.record_batch(
            [
                pa.array(["w"] * k + ["p"] * m + ["n"]), pa.concat_arrays([words.field(0).cast(pa.string()), pa.nulls(m + 1, pa.string())]),
                pa.array(np.concatenate((np.zeros(k, np.int64), patterns, [0])), pa.int64()), pa.array(np.concatenate((words.field(1).to_numpy(), times, [len(pages)])), pa.int64()),
            ], names=["kind", "word", "pattern", "n"],
        )


class Corpus:
    """What one pass over the reference and the scans tells, (scanned boolean, segments array<string>): the lexicon without vectors, and patterns of lines."""

    def __init__(self, rows: DataFrame, share: float = WORD_SHARE, line_share: float = LINE_SHARE):
        counted = materialize(rows.mapInArrow(_counted, "kind string, word string, pattern bigint, n bigint").groupBy("kind", "word", "pattern").agg(F.sum("n").alias("n")))
        totals = {r[0]: r[1] for r in counted.groupBy("kind").agg(F.sum("n")).collect()}
        self.tokens = totals.get("w", 0)
        self.least = max(1, math.ceil(share * self.tokens))
        frequent = [(r[0], r[1]) for r in counted.where((F.col("kind") == "w") & (F.col("n") >= self.least)).select("word", "n").collect()]
        self.words = {t: n for t, n in frequent if t.isalpha()}
        self.odd = frozenset(t for t, n in frequent if not t.isalpha() and n >= max(2, self.least))
        segments = totals.get("n", 0)
        often = counted.where((F.col("kind") == "p") & (F.col("n") >= max(2, line_share * segments))).select("pattern", "n").collect()
        self.patterns = {r[0]: r[1] / segments for r in often}

    def thinned(self, lists: pa.ListArray, seed: int) -> pa.ListArray:
        """The lists with frequent words left out at random, as is usual before skip-gram training, and without empty tokens."""
        tokens = lists.flatten()
        names, counts = pa.array(list(self.words), pa.string()), np.fromiter(self.words.values(), float)
        at = pc.index_in(tokens, value_set=names).fill_null(-1).to_numpy()
        keep = np.append(np.sqrt(THIN * max(self.tokens, 1) / np.maximum(counts, 1)), 2.0)[at]
        kept = (np.random.default_rng(seed).random(len(tokens)) < keep) & (pc.binary_length(tokens).to_numpy() > 0)
        before = np.concatenate(([0], np.cumsum(kept)))
        return pa.ListArray.from_arrays(pa.array(before[lists.offsets.to_numpy()], pa.int32()), tokens.filter(pa.array(kept)))

    def training(self, rows: DataFrame, reader: Reader) -> DataFrame:
        """(scanned, tokens): the thinned tokens of each text; those of scans with furniture out and broken words whole."""
        words, tokens, state = self.words, self.tokens, (reader.lexicon.words, reader.lexicon.odd, reader.patterns, reader.weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Corpus.__new__(Corpus)
            own.words, own.tokens = words, tokens
            known = Reader(Lexicon(state[0], state[1], {}), state[2], state[3])
            for batch in batches:
                for flag in (False, True):
                    texts = batch.column(1).filter(pc.equal(batch.column(0), flag)).flatten().drop_null()
                    if flag:
                        lists = pa.array([[core for _, _, core in page.groups()] for page in known.pages(texts.to_pylist()) if page], pa.list_(pa.string()))
                    else:
                        lists = token_lists(texts)
                    if len(lists):
                        thin = own.thinned(lists, zlib.crc32(texts[0].as_py().encode("utf-8", "replace")))
                        thin = thin.filter(pc.greater(pc.list_value_length(thin), 0))
                        yield pa.record_batch([pa.array(np.full(len(thin), flag)), thin], names=["scanned", "tokens"])

        return rows.mapInArrow(run, "scanned boolean, tokens array<string>")

    def vectors(self, training: DataFrame) -> dict[str, np.ndarray]:
        """Skip-gram vectors of length 1 of the words that are frequent enough, of the reference and the scans."""
        from pyspark.ml.feature import Word2Vec  # for the driver only

        size, cores = training.agg(F.sum(F.size("tokens"))).first()[0] or 0, training.sparkSession.sparkContext.defaultParallelism
        least = max(self.least, 2)
        if not size or training.select(F.explode("tokens").alias("t")).groupBy("t").count().where(F.col("count") >= least).limit(2).count() < 2:
            return {}
        model = Word2Vec(vectorSize=SIZE, windowSize=WINDOW, minCount=least, numPartitions=max(cores, math.ceil(size / TRAIN)), maxIter=1, seed=7, inputCol="tokens", outputCol="v", maxSentenceLength=1000)
        out = {}
        for r in model.fit(training).getVectors().collect():
            v = np.array(r["vector"], np.float32)
            out[r["word"]] = v / (float(np.linalg.norm(v)) or 1.0)
        return out


def link_words(training: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(word, links array<struct<word, place, score>>) of the rare words of the scans that have any.

    The vector of a rare word is the sum over all its occurrences of the vectors of the words around; it is summed by
    word in a distributed aggregation. Links are made once for each different word.
    """
    shared = training.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.odd, lexicon.vectors, lexicon.edits))
    made: list[Lexicon] = []

    def own() -> Lexicon:
        if not made:
            made.append(Lexicon(*shared.value))
        return made[0]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, sums = own(), {}

        def rows() -> pa.RecordBatch:
            values = np.array(list(sums.values()), float).reshape(-1, SIZE)
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array(values[:, k]) for k in range(SIZE))], ["word", *(f"v{k}" for k in range(SIZE))])

        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                for k, t in enumerate(tokens):
                    if lexicon.right(t) or (t.isalpha() and lexicon.valid(t)):
                        continue
                    total = sums.setdefault(t, np.zeros(SIZE))
                    for n in tokens[max(0, k - WINDOW) : k] + tokens[k + 1 : k + 1 + WINDOW]:
                        v = lexicon.vectors.get(n)
                        if v is not None:
                            total += v
            if len(sums) > REMEMBER:
                yield rows()
                sums = {}
        yield rows()

    kind = pa.list_(pa.struct([("word", pa.string()), ("place", pa.int32()), ("score", pa.float64())]))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = own()
        for batch in batches:
            words = batch.column(0).to_pylist()
            vectors = np.column_stack([batch.column(k + 1).to_numpy() for k in range(SIZE)]) if words else np.zeros((0, SIZE))
            norms = np.linalg.norm(vectors, axis=1)
            found = [lexicon.links(w, v / n if n else None) for w, v, n in zip(words, vectors, norms)]
            kept = [(w, f) for w, f in zip(words, found) if f]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([[dict(zip(("word", "place", "score"), x)) for x in f] for _, f in kept], kind)], ["word", "links"])

    summed = training.where("scanned").select("tokens").mapInArrow(contexts, "word string, " + ", ".join(f"v{k} double" for k in range(SIZE)))
    summed = summed.groupBy("word").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(SIZE)])
    return summed.mapInArrow(links, "word string, links array<struct<word:string,place:int,score:double>>")


_KIND = pa.struct([("kinds", pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))), ("text", pa.string())])
_LINKS = "array<struct<word:string,links:array<struct<word:string,place:int,score:double>>>>"


def _table(links: list[dict] | None) -> dict[str, list[Link]]:
    return {x["word"]: [(o["word"], o["place"], o["score"]) for o in x["links"]] for x in links or ()}


def _reader_udfs(spark: Any, reader: Reader):
    """read(segments, links) and rare(segments), the words of a row that may have links; the reader's own links serve where it has some."""
    x = reader.lexicon
    shared = spark.sparkContext.broadcast((x.words, x.odd, x.vectors, x.edits, reader.patterns, reader.weights, reader.links))
    made: list[Reader] = []

    def own() -> Reader:
        if not made:
            *of_lexicon, patterns, weights, links = shared.value
            made.append(Reader(Lexicon(*of_lexicon), patterns, weights, links))
        return made[0]

    def by_row(texts: pa.Array, f) -> list[list]:
        segments = texts.to_pylist()
        pages = own().pages([t for row in segments for t in row or ()])
        return [[f(k, next(pages)) for _ in row or ()] for k, row in enumerate(segments)]

    @F.arrow_udf("array<struct<kinds:array<struct<line_no:int,kind:string>>,text:string>>")
    def read(texts: pa.Array, links: pa.Array) -> pa.Array:
        tables = None if own().links is not None else [_table(row) for row in links.to_pylist()]

        def one(k: int, page: Page | None) -> dict:
            kinds, text = own().mend(page, tables and tables[k]) if page else ([], "")
            return {"kinds": [{"line_no": n, "kind": kind} for n, kind in kinds], "text": text}

        return pa.array(by_row(texts, one), pa.list_(_KIND))

    # else a filter that Spark infers from an explosion would run it a second time
    read = read.asNondeterministic()

    @F.arrow_udf("array<string>")
    def rare(texts: pa.Array) -> pa.Array:
        rows = by_row(texts, lambda _, page: {core for *_, core in page.groups() if not own().lexicon.right(core)} if page else set())
        return pa.array([sorted(set().union(*row)) for row in rows], pa.list_(pa.string()))

    return read, rare


def read_scans(scans: DataFrame, key: str, segments: str, corpus: DataFrame, samples: DataFrame, raw: str, repaired: str, columns: tuple[str, ...] = (), links_shared: int = BROADCAST_ROWS) -> DataFrame:
    """(key, parts, columns…) of each row of the scans: for each segment its continuous text and what was wrong with its lines.

    parts is an array of (kinds, text), kinds one of (line_no, kind) with kind `furniture`, `split` or `misread`. Null and
    empty segments have an empty text and no kinds, null and empty arrays no parts. `corpus` holds (scanned, segments):
    the reference and the scans, from which words, vectors and patterns are learned. Without reference text no word is
    taken for misread but those with letters apart; without samples no line is taken for furniture. `samples` are bounded by SAMPLES.
    """
    spark = scans.sparkSession
    known = Corpus(corpus)
    pairs = samples.where(F.col(raw).isNotNull() & F.col(repaired).isNotNull()).select(raw, repaired).orderBy(F.xxhash64(raw), raw).limit(SAMPLES).collect()
    pairs = [tuple(p) for p in pairs]
    lexicon = Lexicon(known.words, known.odd, {}, weigh_edits(pairs))
    reader = Reader(lexicon, known.patterns, train_lines(pairs, lexicon, known.patterns))
    with scratch(known.training(corpus, reader)) as training:
        lexicon.vectors = known.vectors(training)
        links = materialize(link_words(training, lexicon))
    # links go to every worker while they are few (checked); else each row of the scans gets those of its words by a join
    few = links.limit(links_shared + 1).count() <= links_shared and (links.agg(F.sum(F.octet_length("word") * 8)).first()[0] or 0) <= BROADCAST_BYTES
    if few:
        reader.links = _table([r.asDict(True) for r in links.toLocalIterator()])
        read, _ = _reader_udfs(spark, reader)
        return scans.select(key, read(F.col(segments), F.lit(None).cast(_LINKS)).alias("parts"), *columns)
    read, rare = _reader_udfs(spark, reader)
    words = scans.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.explode(rare(F.col(segments))).alias("word")).distinct()
    of_row = words.join(links, "word").groupBy("_key").agg(F.collect_list(F.struct("word", "links")).alias("_links"))
    return scans.join(of_row, F.col(key) == F.col("_key"), "left").select(key, read(F.col(segments), F.col("_links")).alias("parts"), *columns)
