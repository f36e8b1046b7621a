"""Token ids of a public byte-level BPE, through tiktoken with a local rank file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("TALVERK_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

# fixed value: the published pre-tokenization pattern of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A cut is safe where white space follows something else, and where a run of letters ends before a mark or a digit:
#: no pre-token of the pattern reaches over such a place, nor looks over it, so the parts have the ids of the whole.
_CUT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])")
_LONE = regex.compile(r"(?<=\S)(?= )")
#: Texts beyond this many characters are cut into blocks of about this size before the pattern sees them.
BLOCK = 20_000
#: Parts up to PART characters are remembered, at most REMEMBER of them; then the memory is emptied.
PART, REMEMBER = 48, 150_000


class Encoder:
    """encode(text) gives the ids of a text; decode(ids) the text, by way of its bytes. No special tokens exist."""

    def __init__(self, folder: str = TOKENIZERS, file: str = BYTE_BPE_50K):
        with open(os.path.join(folder, file), "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding(file, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def blocks(self, text: str) -> Iterator[str]:
        """Parts of a long text that begin and end at safe places; a run without a safe place stays whole."""
        begin = 0
        while len(text) - begin > BLOCK:
            cut = _CUT.search(text, begin + BLOCK)
            if cut is None:
                break
            yield text[begin : cut.start()]
            begin = cut.start()
        yield text[begin:]

    def _part(self, part: str) -> bytes:
        ids = np.array(self.bpe.encode_ordinary(part), np.int32).tobytes()
        if len(part) <= PART and not part[-1].isspace():
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[part] = ids
        return ids

    def packed(self, text: str | None) -> bytes:
        """The ids of the text as 32-bit integers; nothing for a null or empty text. Lone surrogates count as U+FFFD."""
        if not text:
            return b""
        if not text.isascii():
            try:
                text.encode()
            except UnicodeEncodeError:
                text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        get, part, out = self.known.get, self._part, []
        for block in self.blocks(text) if len(text) > BLOCK else (text,):  # parts are cut before spaces that follow no white space
            words = [word for word in _LONE.split(block) if word] if "\0" in block else block.replace(" ", "\0 ").split("\0")
            found = list(map(get, words))  # no remembered part ends in white space
            if None in found:
                if any(ids is None and (not word or word[-1].isspace()) for word, ids in zip(words, found)):
                    words = [word for word in _LONE.split(block) if word]
                    found = list(map(get, words))
                found = [part(word) if ids is None else ids for word, ids in zip(words, found)]
            out += found
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no whole character, as at the edges of a piece, become U+FFFD."""
        return self.bytes_of(ids).decode("utf-8", "replace")

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bpe.decode_single_token_bytes, ids))


@lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZERS, file: str = BYTE_BPE_50K) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(folder, file)


def ids_udf(folder: str = TOKENIZERS, file: str = BYTE_BPE_50K):
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        own = encoder(folder, file)
        packed = [own.packed(text) for text in texts.to_pylist()]
        offsets = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), np.int32)))

    return ids


def token_ids(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, file: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids array<int>): every row with the ids of its text.

    A null or empty text has an empty list, white space has its ids; marker strings are ordinary text. Rows are neither
    dropped nor merged, whatever their key. Nothing is shuffled.
    """
    return df.select(F.col(key), ids_udf(folder, file)(F.col(text)).alias("ids"))
