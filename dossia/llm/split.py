"""Splitting long texts at natural boundaries, where the topic changes.

A long text is cut from left to right.  In the window of sizes a piece may have, the
coarsest boundary there is wins - paragraph, sentence, word - and among those the one in
the deepest valley of lexical cohesion: the similarity of the blocks of words before and
after it, against the peaks the curve of the whole text climbs to on either side; where
the curve is flat the last one in the window.  Only where no boundary fits is a text cut
between two characters.  A coarser boundary is never passed over where one fits, so the
finest one a text is cut at tells at which it can be cut (chunk_boundary).  Every piece but the first repeats the end of its predecessor,
less where a whole paragraph or sentence would not fit otherwise.

Texts are cut one by one in a map over the scan; nothing is shuffled.

Defined results: null and empty texts give one piece with that text; pieces in order
without their overlaps are the text, character by character; lengths are in code points.
page_number of a piece is that of its first character that is no white space; it is null
where the chunk's is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1400, 220
BLOCK_WORDS = 30

_LINE = r"(?:\r\n|[\n\r\v\x1c-\x1e\x85  ])"
_BLANK_LINES = re.compile(rf"{_LINE}[^\S\r\n]*{_LINE}\s*|\f")
_SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+")
_WORD_GAP = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_]{3,}")

LEVELS = ("none", "word", "sentence", "paragraph")


def _spans(text: str, gap: re.Pattern, start: int, end: int):
    at = start
    for m in gap.finditer(text, start, end):
        yield at, m.start(), m.end()
        at = m.end()
    yield at, end, end


def _cosine(a: Counter, b: Counter) -> float:
    if len(a) > len(b):
        a, b = b, a
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0


class _Cohesion:
    """Lexical cohesion along a text: the similarity of the blocks of words before and after each of its boundaries, and the depth of the valleys."""

    def __init__(self, text: str, boundaries: list[int]) -> None:
        self.text, self.boundaries = text, boundaries
        self.words: list[str] | None = None
        self.depths: dict[int, float] | None = None

    def _read(self) -> None:
        found = list(_WORD.finditer(self.text))
        self.words = [m[0][:6].lower() for m in found]
        self.places = [m.start() for m in found]

    @staticmethod
    def valleys(s: list[float]) -> list[float]:
        """Depth of each point under the peaks that the curve climbs to on its two sides."""
        left, right = list(s), list(s)
        for i in range(1, len(s)):
            if s[i - 1] >= s[i]:
                left[i] = left[i - 1]
        for i in range(len(s) - 2, -1, -1):
            if s[i + 1] >= s[i]:
                right[i] = right[i + 1]
        return [a + b - 2 * x for a, b, x in zip(left, right, s)]

    def deepest(self, positions: list[int]) -> int:
        """The boundary in the deepest valley of the whole curve; of equals the last."""
        if len(positions) == 1:
            return positions[0]
        if self.depths is None:
            if self.words is None:
                self._read()
            at = [bisect_left(self.places, p) for p in self.boundaries]
            s = [_cosine(Counter(self.words[max(0, i - BLOCK_WORDS) : i]), Counter(self.words[i : i + BLOCK_WORDS])) for i in at]
            self.depths = dict(zip(self.boundaries, self.valleys(s)))
        return max(positions, key=lambda p: (self.depths[p], p))

    def deepest_gap(self, lo: int, hi: int) -> int:
        """The same among the words that begin in (lo, hi], the blocks moved on word by word; 0 if there is none."""
        if self.words is None:
            self._read()
        i, end = bisect_left(self.places, lo + 1), bisect_left(self.places, hi + 1)
        if i >= end:
            return 0
        w, n = self.words, len(self.words)
        a, b = Counter(w[max(0, i - BLOCK_WORDS) : i]), Counter(w[i : i + BLOCK_WORDS])
        dot = sum(k * b[x] for x, k in a.items() if x in b)
        aa, bb = sum(k * k for k in a.values()), sum(k * k for k in b.values())
        at, s = [], []
        for j in range(i, end):
            at.append(self.places[j])
            s.append(dot / sqrt(aa * bb) if dot else 0.0)
            x = w[j]  # from the block behind to the block before
            dot += b[x] - a[x] - 1
            aa, bb = aa + 2 * a[x] + 1, bb - 2 * b[x] + 1
            a[x], b[x] = a[x] + 1, b[x] - 1
            if j >= BLOCK_WORDS:
                x = w[j - BLOCK_WORDS]
                dot, aa = dot - b[x], aa - 2 * a[x] + 1
                a[x] -= 1
            if j + BLOCK_WORDS < n:
                x = w[j + BLOCK_WORDS]
                dot, bb = dot + a[x], bb + 2 * b[x] + 1
                b[x] += 1
        best = max(((d, p) for d, p in zip(self.valleys(s), at) if self.text[p - 1].isspace()), default=(0.0, 0))
        return best[1] if best[0] > 1e-9 else 0


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(begin, start, end, boundary) of each piece: text[start:end] is new, text[begin:start] repeats; boundary ends the piece."""
    n = len(text)
    if n <= limit:
        return [(0, 0, n, "end")]
    ends: dict[int, tuple[list[int], list[int]]] = {3: ([], []), 2: ([], [])}  # level -> ends of units, starts of the next
    for _, b, nxt in _spans(text, _BLANK_LINES, 0, n):
        if nxt > b:
            ends[3][0].append(b)
            ends[3][1].append(nxt)
    for m in _SENTENCE_GAP.finditer(text):
        ends[2][0].append(m.start())
        ends[2][1].append(m.end())
    for unit_ends, next_starts in ends.values():
        unit_ends.append(n)
        next_starts.append(n)
    cohesion = _Cohesion(text, sorted({p for _, starts in ends.values() for p in starts if p < n}))
    out: list[tuple[int, int, int, str]] = []
    start = 0
    first = {3: 0, 2: 0}
    while True:
        if out:
            begin = max(out[-1][1], start - overlap)
        else:
            begin = 0
        if n - begin <= limit:
            out.append((_word_start(text, begin, start, out), start, n, "end"))
            return out
        room = limit - (min(overlap, start - out[-1][1]) if out else 0)
        least = room // 4
        end, kind = 0, ""
        for level in (3, 2):
            unit_ends, next_starts = ends[level]
            i = first[level]
            while i < len(unit_ends) and next_starts[i] <= start:
                i += 1
            first[level] = i
            good, early, late = [], 0, 0
            while i < len(unit_ends) and unit_ends[i] <= start + limit:
                p = next_starts[i]
                if p <= start + room:
                    if p >= start + least:
                        good.append(p)
                    else:
                        early = p
                elif not late and unit_ends[i] > start:  # fits with less overlap
                    late = min(p, start + limit)
                i += 1
            end = cohesion.deepest(good) if good else late or early
            if end > start:
                kind = LEVELS[level]
                break
        else:
            end = cohesion.deepest_gap(start + least, start + room) or _last_gap(text, start + least, start + room) or _last_gap(text, start + room, start + limit) or _last_gap(text, start, start + least)
            kind = "word"
            if end <= start and (text[start + limit].isspace() or text[start + limit - 1].isspace()):
                end = start + limit  # the word fits, the white space behind it does not
            if end <= start:
                end, kind = _between(text, start + room, start), "none"
        begin = max(out[-1][1], min(start, max(start - overlap, end - limit))) if out else 0
        out.append((_word_start(text, begin, start, out), start, end, "end" if end == n else kind))
        if end == n:
            return out
        start = end


def coarsest(pieces: list[tuple[int, int, int, str]]) -> str:
    """The finest kind of boundary a text had to be cut at, which is the coarsest at which all between two boundaries fits; whole if it was not cut."""
    return LEVELS[min(LEVELS.index(k) for *_, k in pieces[:-1])] if len(pieces) > 1 else "whole"


def _last_gap(text: str, lo: int, hi: int) -> int:
    """The last position in (lo, hi] that follows white space and begins a word; 0 if there is none."""
    for p in range(min(hi, len(text) - 1), lo, -1):
        if text[p - 1].isspace() and not text[p].isspace():
            return p
    return 0


def _between(text: str, p: int, start: int) -> int:
    """p, moved back so that no mark is parted from its letter."""
    import unicodedata

    q = p
    while q > start + 1 and q < len(text) and unicodedata.combining(text[q]):
        q -= 1
    return q if q > start + 1 else p


def _word_start(text: str, begin: int, start: int, out: list) -> int:
    """begin moved to the first word beginning in [begin, start), if one does."""
    if not out or begin >= start:
        return begin
    if begin == 0 or text[begin - 1].isspace() and not text[begin].isspace():
        return begin
    m = re.compile(r"\s+(?=\S)").search(text, begin, start)
    return m.end() if m and m.end() < start else begin


def _pieces(limit: int, overlap: int):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("_key", pa.int64()), ("piece_no", pa.int32()), ("text", pa.string()), ("page_number", pa.int64()), ("start", pa.int32()), ("overlap", pa.int32()), ("boundary", pa.string()), ("chunk_boundary", pa.string())])
        for b in batches:
            rows: list[tuple] = []
            for key, text, page in zip(*(c.to_pylist() for c in b.columns)):
                if text is None:
                    rows.append((key, 0, None, page, 0, 0, "end", "whole"))
                    continue
                pieces = cut(text, limit, overlap)
                coarse = coarsest(pieces)
                for no, (begin, start, end, kind) in enumerate(pieces):
                    own = text[begin:end]
                    skip = len(own) - len(own.lstrip())
                    at = None if page is None else page + text.count("\f", 0, begin + (skip if skip < len(own) else 0))
                    rows.append((key, no, own, at, start, start - begin, kind, coarse))
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return run


def split_texts(chunks: DataFrame, key: str = "chunk_id", text: str = "text", page: str = "page_number", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """key, piece_no, text, page_number, start (of what is new), overlap, boundary (that ends it), chunk_boundary (the coarsest at which the whole text can be cut)."""
    out = chunks.select(F.col(key).cast("long"), text, F.col(page).cast("long")).mapInArrow(
        _pieces(limit, overlap), "_key long, piece_no int, text string, page_number long, start int, overlap int, boundary string, chunk_boundary string"
    )
    return out.withColumnRenamed("_key", key)


def long_texts(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """chunk_id, boundary of the chunks that had to be cut."""
    pieces = split_texts(chunks.filter(F.length("text") > limit))
    return pieces.filter(F.col("piece_no") == 0).select("chunk_id", F.col("chunk_boundary").alias("boundary")).distinct()
