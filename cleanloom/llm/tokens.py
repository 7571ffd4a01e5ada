"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabulary file of ranks; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern that splits text before the merges of this vocabulary, and the same without its one look-ahead.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
# The first bytes of white space beyond ASCII in UTF-8, and ASCII separators that count as white space.
RARE_WHITE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\x1c", b"\x1d", b"\x1e", b"\x1f")


class Tokenizer:
    """Byte-level BPE over a file of ranks.

    The look-ahead of the pattern only parts a run of white space from its last character where a word follows. Texts are cut
    at those places first, which gives the same tokens and lets the splitter run without look-ahead, much faster.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.exact = tiktoken.Encoding("exact", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=PLAIN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for k, i in ranks.items():
            self.length[i] = len(k)

    def cuts(self, raw: bytes) -> list[int] | None:
        """Byte offsets before the last character of a run of white space that a word follows; None if only the full pattern will do."""
        if any(x in raw for x in RARE_WHITE):
            return None
        a = np.frombuffer(raw, dtype=np.uint8)
        if len(a) < 3:
            return []
        white = (a == 32) | ((a >= 9) & (a <= 13))
        return (np.flatnonzero(white[:-2] & white[1:-1] & ~white[2:]) + 1).tolist()

    def parts(self, text: str) -> Iterator[list[int]]:
        raw = text.encode("utf-8", "surrogatepass") if text.isascii() else text.encode("utf-8", "replace")
        at = self.cuts(raw)
        if at is None:
            yield self.exact.encode_ordinary(text)
            return
        start = 0
        for end in at:
            yield self.plain.encode_ordinary(raw[start:end].decode())
            start = end
        yield self.plain.encode_ordinary(raw[start:].decode())

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.parts(text):
            out += p
        return out

    def count(self, text: str | None) -> int:
        return 0 if not text else sum(map(len, self.parts(text)))

    def offsets(self, text: str) -> np.ndarray:
        """Byte offset at which each token starts, and the end of the text."""
        return np.concatenate(([0], np.cumsum(self.length[np.asarray(self.ids(text), dtype=np.int64)]))) if text else np.zeros(1, dtype=np.int64)


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker and vocabulary."""
    return Tokenizer(path)


def token_count(path: str = VOCABULARY) -> Callable[[Column], Column]:
    """Column function text -> tokens; 0 for null."""

    @F.pandas_udf(T.LongType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from cleanloom.llm.tokens import tokenizer as get  # the worker's own copy, kept from task to task

        t = get(path)
        for p in parts:
            yield p.map(t.count).astype("int64")

    return run
