"""Problem 10: splitting oversized texts at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.tokens import VOCABULARY, Tokenizer

#: Kinds of boundary from the strongest: section, paragraph, line, sentence, word, character.
LEVELS = ("section", "paragraph", "line", "sentence", "word", "character", "end")
END = 6
#: Limits that one run may have.
MOST_LIMITS = 1000
# Turkish and English short forms whose full stop ends no sentence, in lower case.
SHORT = ("sn", "dr", "prof", "no", "vb", "vs", "ltd", "şti", "a.ş", "cad", "sk", "sok", "mah", "apt", "bulv", "mr", "mrs", "ms", "e.g", "i.e", "etc", "tel", "min", "max")
_SHORT = tuple(p + x.encode() for x in SHORT for p in (b" ", b"(", b"\n"))
_END = re.compile(rb"""[.!?]["')\]]*(?=[ \n\r\t])""")


def boundary_levels(raw: bytes) -> np.ndarray:
    """For each byte offset the strength of a cut before it: 5 section ... 1 word, 0 none; the end of the text counts 5."""
    a = np.frombuffer(raw, dtype=np.uint8)
    n = len(a)
    level = np.zeros(n + 1, dtype=np.int8)
    if not n:
        return level
    space = (a == 32) | (a == 9)
    newline = (a == 10) | ((a == 13) & np.concatenate((a[1:] != 10, [True])))
    level[:-1][space] = 1
    level[1:-1][space[1:] & space[:-1]] = 0
    ends = [m.end() for m in _END.finditer(raw) if raw[m.start()] != 46 or not (raw[max(0, m.start() - 6) : m.start()].lower().endswith(_SHORT) or raw[m.start() - 2 : m.start() - 1] in (b" ", b".", b""))]
    level[ends] = 2
    before = np.concatenate(([False], newline[:-1]))
    level[:-1][before] = 3
    # the line before is empty but for blanks and carriage returns: look at the last other byte
    solid = np.flatnonzero(~(space | (a == 10) | (a == 13)))
    breaks = np.concatenate(([0], np.cumsum(newline)))
    if len(solid):
        gap = breaks[solid[1:]] - breaks[solid[:-1]]
        starts = solid[1:][gap >= 2]
        level[starts] = 4
        lines = solid[1:][gap >= 1]
        level[lines[a[lines] == 35]] = 5
    level[n] = 5
    return level


class Cuts:
    """Token indices at which a text may be cut, by strength."""

    def __init__(self, offsets: np.ndarray, raw: bytes):
        strength = boundary_levels(raw)[offsets]
        strength[0] = 0
        self.by = [np.flatnonzero(strength == k).tolist() for k in (5, 4, 3, 2, 1)]
        self.n = len(offsets) - 1
        a = np.frombuffer(raw, dtype=np.uint8)
        self.whole = ((a[offsets[:-1]] & 0xC0) != 0x80).tolist()  # a token may begin inside a character
        self.strength = strength

    def last(self, low: int, high: int) -> tuple[int, int] | None:
        """(index, kind) of the last cut of the strongest kind within low..high."""
        for kind, at in enumerate(self.by):
            k = bisect_right(at, high) - 1
            if k >= 0 and at[k] >= low:
                return at[k], kind
        return None

    def whole_before(self, at: int, low: int) -> int:
        """The last token from ``at`` down to ``low`` that begins a character."""
        while at > low and not self.whole[at]:
            at -= 1
        return at


def atoms(cuts: Cuts, size: int) -> list[int]:
    """Ends of the parts of a text, none longer than ``size`` tokens, by the hierarchy of separators.

    The text falls into its sections; those that are too long into paragraphs, those into lines, sentences, words and at last
    characters. A part that fits isn't cut further.
    """
    ends: list[int] = []
    todo = [(0, cuts.n, 0)]
    while todo:
        first, end, level = todo.pop()
        if end - first <= size:
            ends.append(end)
        elif level < len(cuts.by):
            at = cuts.by[level]
            inside = at[bisect_right(at, first) : bisect_left(at, end)]
            edges = [first, *inside, end]
            todo += [(x, y, level + 1) for x, y in zip(edges[-2::-1], edges[:0:-1])]
        else:
            while end - first > size:
                first = cuts.whole_before(first + size, first + 1)
                ends.append(first)
            ends.append(end)
    return ends


def split_points(cuts: Cuts, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(first token, one past the last, tokens shared with the piece before, kind of the boundary at the end) of each piece.

    Parts (see atoms) are packed greedily: a piece takes the next part as long as it fits with the overlap before it. A piece after the
    first begins exactly ``overlap`` tokens before the last one's end, or a few more where that token stands inside a character.
    The last piece ends with the text.
    """
    n = cuts.n
    if n <= limit:
        return [(0, n, 0, END)] if n else []
    out: list[tuple[int, int, int, int]] = []
    start = shared = end = 0
    kind = {5: 0, 4: 1, 3: 2, 2: 3, 1: 4, 0: 5}
    # the first bytes of an overlap may belong to a character that begins up to three tokens before
    for at in atoms(cuts, limit - overlap - (3 if overlap else 0)):
        if at - start > limit:
            out.append((start, end, shared, kind[int(cuts.strength[end])]))
            start = cuts.whole_before(end - overlap, start + 1) if overlap else end
            shared = end - start
        end = at
    out.append((start, n, shared, END))
    return out


def full_points(cuts: Cuts, limit: int, least: float) -> list[tuple[int, int, int, int]]:
    """As split_points() without overlap, but each piece fills at least the share ``least`` of the limit: it ends at the strongest
    boundary beyond that, else at any, else within a word."""
    out: list[tuple[int, int, int, int]] = []
    start = 0
    while start + limit < cuts.n:
        last, low = start + limit, start + 1
        at, kind = cuts.last(max(low, start + int(limit * least)), last) or cuts.last(low, last) or (cuts.whole_before(last, low), 5)
        out.append((start, at, 0, kind))
        start = at
    return [*out, (start, cuts.n, 0, END)]


def split_text(text: str, t: Tokenizer, limits: Sequence[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int, int, str, str]]:
    """(limit, overlap, piece, first byte, tokens, shared tokens, boundary, text) for each limit that the text exceeds."""
    raw = text.encode("utf-8", "replace")
    if len(raw) <= min((m for m, _ in limits), default=0):
        return
    offsets = t.offsets(text)
    todo = [x for x in limits if len(offsets) - 1 > x[0]]
    cuts = Cuts(offsets, raw) if todo else None
    at = offsets.tolist() if todo else []
    for limit, overlap in todo:
        for k, (first, end, shared, kind) in enumerate(split_points(cuts, limit, overlap)):
            yield limit, overlap, k, at[first], end - first, shared, LEVELS[kind], raw[at[first] : at[end]].decode("utf-8", "ignore")


def wanted_limits(limits: DataFrame, kind: str) -> list[tuple[int, int]]:
    """(max_tokens, overlap_tokens) of a kind in order; each is work of its own over all texts, so more than MOST_LIMITS are an error."""
    rows = limits.where((F.col("limit_kind") == kind) & (F.col("max_tokens") > 0)).select("max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("o")).distinct().take(MOST_LIMITS + 1)
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    return sorted((int(r[0]), int(r[1])) for r in rows)


def split_texts(documents: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of the texts that exceed a limit: (doc_id, max_tokens, overlap_tokens, piece_no, start_byte, n_tokens, shared_tokens, boundary, piece).

    limits: rows of limit_kind 'piece' with max_tokens and overlap_tokens; each is applied to every document by itself. A text is
    encoded once for all limits. Cuts follow the hierarchy section, paragraph, line, sentence, word, character; boundary is the
    kind at the end of a piece, ``end`` for the last one. Without overlaps the pieces join to the text exactly. Texts within a limit, null and empty ones give no rows; the
    same id with the same text counts once for each row; long texts are split by their worker in one pass; there is no shuffle.
    """
    wanted = wanted_limits(limits, "piece")
    if any(o < 0 or o * 2 >= m for m, o in wanted):
        raise ValueError("an overlap must be less than half its limit")
    schema = f"{id_col} long, max_tokens int, overlap_tokens int, piece_no int, start_byte long, n_tokens int, shared_tokens int, boundary string, piece string"
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cleanloom.llm.tokens import tokenizer

        t = tokenizer(vocabulary)
        names = [c.split()[0] for c in schema.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for part in parts:
            rows: list[tuple] = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for x in split_text(text, t, wanted):
                    rows.append((key, *x))
                    if len(rows) == 4000:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    docs = documents.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    shortest = min((m for m, _ in wanted), default=0)
    return docs.where(F.octet_length(text_col) > shortest).mapInArrow(run, schema)
