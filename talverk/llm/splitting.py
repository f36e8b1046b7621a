"""Oversized texts as ordered pieces of a bounded number of tokens, cut at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talverk.llm.sentences import Model
from talverk.llm.tokenizer import BYTE_BPE_50K, TOKENIZERS, encoder

#: The separators of each level, coarse to fine. A cut lies at the end of the group that matched, before white space.
LEVELS = ("section", "paragraph", "sentence", "word", "character")
_ENDS = (
    re.compile(r"()\s*\f|()[^\S\n]*\n[^\S\n]*\n[^\S\n]*\n|()\n[^\S\n]*(?=#{1,6} |§ ?\d)"),
    re.compile(r"()[^\S\n]*\n[^\S\n]*\n"),
    re.compile(r"([.!?…؟۔।॥]+[)\]}»«”“’\"']*)(?=\s)|([。！？]+[）」』】”’]*)|()[^\S\n]*\n|(?<=[฀-๿])() "),
    re.compile(r"()\s+|([、，；：])"),
)
_LINE_END = re.compile(r"[^\S\n]*\n\s*")
_SPLITS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("char_begin", pa.int32()), ("char_end", pa.int32()), ("cut", pa.string()), ("text", pa.string())]))


class Splitter:
    """Sentences end where the model says so, and at the ends of lines that don't go on with a small letter; without a model where a pattern does."""

    def __init__(self, folder: str, file: str, model: Model | None = None):
        self.own, self.model = encoder(folder, file), model
        self.widths = np.zeros(max(self.own.ranks.values()) + 1, np.int64)
        for token, rank in self.own.ranks.items():
            self.widths[rank] = len(token)

    def ends(self, text: str, lo: int, hi: int, level: int) -> np.ndarray:
        """Places within text[lo:hi] at which a group of this level ends."""
        if level != LEVELS.index("sentence") or self.model is None:
            return np.array([m.end(m.lastindex) for m in _ENDS[level].finditer(text, lo, hi)], np.int64)
        part = text[lo:hi]
        lines = [m.start() for m in _LINE_END.finditer(part) if m.end() < len(part) and not part[m.end()].islower()]
        return np.unique(np.array([*self.model.ends(part), *lines], np.int64)) + lo

    def split(self, text: str | None, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
        """(begin, end, char_begin, char_end, cut) of each piece, as places in the ids and in the text; none for a text of at most `limit` tokens."""
        if not text or (len(text) <= limit and len(text.encode("utf-8", "replace")) <= limit):  # a token has at least one byte
            return []
        ids = np.frombuffer(self.own.packed(text), np.int32)
        if len(ids) <= limit:
            return []
        raw = np.frombuffer(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode(), np.uint8)
        after = np.concatenate(([0], np.cumsum(self.widths[ids])))  # bytes before each token
        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters begun before each byte
        starts = np.append((raw & 0xC0) != 0x80, True)
        clean = starts[after]  # does a character begin at this token?
        at_char = chars[after]  # its place in the text, where clean

        def cuts(begin: int, end: int, level: int) -> list[int]:
            """Tokens within (begin, end) before which one may cut at this level."""
            if level == len(LEVELS) - 1:
                return (np.flatnonzero(clean[begin + 1 : end]) + begin + 1).tolist()
            lo, hi = int(at_char[begin]), int(at_char[end])
            where = self.ends(text, lo, hi, level)
            k = np.searchsorted(at_char, where, "right") - 1  # boundaries within the character before count the same, the clean one is last
            k = k[(k > begin) & (k < end)]
            return np.unique(k[np.isin(at_char[k], where) & clean[k]]).tolist()

        room = limit - overlap
        atoms: list[tuple[int, int]] = []  # end of each unit, and the level at which it was cut

        def units(begin: int, end: int, level: int, ended: int) -> None:
            if end - begin <= room:
                atoms.append((end, ended))
                return
            for stop in cuts(begin, end, level):
                units(begin, stop, level + 1, level)
                begin = stop
            if level + 1 < len(LEVELS):
                units(begin, end, level + 1, ended)
            else:
                atoms.append((end, ended))

        units(0, len(ids), 0, 0)
        out, done, k, begin = [], 0, 0, 0
        ends = [a for a, _ in atoms]
        while done < len(ids):
            k = max(bisect_right(ends, begin + limit) - 1, k)
            end, level = atoms[k]
            first = begin
            while not clean[first]:  # the shared tokens may begin within a character; the text of a piece begins after it
                first += 1
            out.append((begin, end, int(at_char[first]), int(at_char[end]), "end" if end == len(ids) else LEVELS[level]))
            done, begin, k = end, end - overlap, k + 1
        return out


def pieces_udf(limit: int, overlap: int, folder: str, file: str, model: Model | None):
    state = None if model is None else (model.weights, model.short)
    made: list[Splitter] = []
    names = ("begin", "end", "char_begin", "char_end", "cut", "text")

    @F.arrow_udf("array<struct<begin:int,end:int,char_begin:int,char_end:int,cut:string,text:string>>")
    def pieces(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Splitter(folder, file, state and Model(*state)))
        return pa.array([[dict(zip(names, (*p, t[p[2] : p[3]]))) for p in made[0].split(t, limit, overlap)] for t in texts.to_pylist()], _SPLITS)

    return pieces.asNondeterministic()  # else a filter that Spark infers from an explosion would run it a second time


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 1024, overlap: int = 64, folder: str = TOKENIZERS, file: str = BYTE_BPE_50K, model: Model | None = None) -> DataFrame:
    """(key, piece, begin, end, char_begin, char_end, cut, text) of the pieces of each text of more than `limit` tokens.

    A text is divided at sections; a section that is too long at paragraphs, these at sentences, at words, at characters.
    Sentences are those of `model`, a model of sentence boundaries, or of a plain pattern where none is given.
    The units are packed in order: a piece takes as many whole units as fit, and begins with the last `overlap` tokens of
    the piece before. begin and end are places in the ids of the text, cut is the level at which the piece ends. Pieces
    without their overlap make up the text exactly. Texts within the limit, null and empty ones have no pieces.
    A row with the key of another has pieces of its own. Nothing is shuffled, and only the pieces leave the worker.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    found = df.select(F.col(key), pieces_udf(limit, overlap, folder, file, model)(F.col(text)).alias("_pieces"))
    return found.select(key, F.posexplode("_pieces").alias("piece", "_p")).select(key, "piece", "_p.*")
