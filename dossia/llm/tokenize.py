"""Encoding a corpus with a public byte-level BPE vocabulary.

The distinct words of a batch are put in order, which is the depth-first walk of
their trie; every node keeps the last token of the encoding of its prefix, found
from the nodes above it, so a prefix shared by many words is worked out once.  A
word's encoding is read back from the last tokens.  Words once encoded stay in a
table of the Python worker, so the whole corpus is encoded in one map over the
scan, without a shuffle.

Defined results: null and empty texts give no ids (an empty list); special tokens
are never made, their spelling in a text is ordinary text; lone surrogates become
U+FFFD.  Repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata

from pyspark.sql import DataFrame

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _class(initial: str) -> str:
    """A regular-expression class of all characters whose general category begins with `initial`."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == initial
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}" if start == c - 1 else f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class TrieEncoder:
    """Byte-level BPE over a file of ranks."""

    def __init__(self, path: str, keep: int = 400_000) -> None:
        import numpy as np

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._splits: dict[int, tuple[int, int]] = {}
        self._valid: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        letter, number = _class("L"), _class("N")
        self.pattern = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_WHITE}{letter}{number}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
        )
        self.white_runs = re.compile(f" [{_WHITE}]|[{_WHITE}] ")
        self.keep = keep
        self.np = np
        self._reset()

    def _reset(self) -> None:
        self.segments: dict[str, int] = {}
        self.firsts: dict[str, int] = {}
        self.pool = self.np.zeros(1 << 16, dtype=self.np.int32)
        self.used = 0
        self.starts: list[int] = []
        self.lengths: list[int] = []

    # --- which tokens may stand side by side -------------------------------------------------

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a byte is its own two halves."""
        got = self._splits.get(token)
        if got is None:
            b = self.bytes_of[token]
            got = (token, token)
            for cut in range(len(b) - 1, 0, -1):
                left, right = self.ranks.get(b[:cut]), self.ranks.get(b[cut:])
                if left is not None and right is not None and left < token and right < token and self.side_by_side(left, right, token):
                    got = (left, right)
                    break
            self._splits[token] = got
        return got

    def side_by_side(self, left: int, right: int, below: int | None = None) -> bool:
        """No merge earlier than those that made both tokens (or than `below`) joins bytes across their border."""
        key = (left, right)
        if below is None:
            got = self._valid.get(key)
            if got is not None:
                return got
        limit = below if below is not None else 1 << 30
        a, b, ok = left, right, None
        while ok is None:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < limit and self.split(joined) == (a, b):
                ok = False
                break
            # undo the later of the two merges
            sa, sb = self.split(a), self.split(b)
            if a > b and sa[0] != a:
                limit, a = a, sa[1]
            elif sb[0] != b:
                limit, b = b + 1, sb[0]
            elif sa[0] != a:
                limit, a = a, sa[1]
            else:
                ok = True
        if below is None:
            self._valid[key] = ok
        return ok

    # --- the trie ----------------------------------------------------------------------------

    def encode_words(self, words: set[str]) -> None:
        """Encodings of all words into self.words; the words in order are a depth-first walk of their trie."""
        ranks, longest, side = self.ranks, self.longest, self.side_by_side
        before = b""
        last: list[int] = [-1]
        for raw, word in sorted((w.encode("utf-8", "replace"), w) for w in words):
            shared = 0
            for x, y in zip(before, raw):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                for start in range(max(0, end - longest), end):
                    token = ranks.get(raw[start:end])
                    if token is not None and (start == 0 or side(last[start], token)):
                        last.append(token)
                        break
            before = raw
            out, at = [], len(raw)
            while at:
                out.append(last[at])
                at -= len(self.bytes_of[last[at]])
            self.words[word] = out[::-1]

    # --- texts -------------------------------------------------------------------------------

    def _learn(self, pieces: set[str], space: str, table: dict[str, int]) -> None:
        new = {p: self.pattern.findall(space + p) for p in pieces}
        unseen = {w for ws in new.values() for w in ws if w not in self.words}
        if len(self.words) > self.keep:
            self.words.clear()
            unseen = {w for ws in new.values() for w in ws}
        self.encode_words(unseen)
        for p, ws in new.items():
            ids = [i for w in ws for i in self.words[w]]
            if self.used + len(ids) > len(self.pool):
                self.pool = self.np.concatenate([self.pool, self.np.zeros(max(len(self.pool), len(ids)), dtype=self.np.int32)])
            self.pool[self.used : self.used + len(ids)] = ids
            table[p] = len(self.starts)
            self.starts.append(self.used)
            self.lengths.append(len(ids))
            self.used += len(ids)

    def encode_batch(self, texts: list[str | None]):
        """(offsets, ids) of all texts as numpy arrays; ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        np = self.np
        if len(self.starts) > self.keep:
            self._reset()
        first: list[str | None] = []
        rest: list[list[str]] = []
        for t in texts:
            if not t:
                first.append(None)
                rest.append([])
            elif self.white_runs.search(t):  # runs of blanks go over the borders of pieces: whole words instead
                first.append(t)
                rest.append([])
            else:
                head, *tail = t.split(" ")
                first.append(head)
                rest.append(tail)
        new: set[str] = set()
        for tail in rest:
            new.update(tail)
        self._learn(new.difference(self.segments), " ", self.segments)
        self._learn({f for f in first if f is not None}.difference(self.firsts), "", self.firsts)
        index: list[int] = []
        counts = np.zeros(len(texts) + 1, dtype=np.int64)
        get = self.segments.__getitem__
        for i, (f, tail) in enumerate(zip(first, rest)):
            if f is not None:
                index.append(self.firsts[f])
                index.extend(map(get, tail))
            counts[i + 1] = len(index)
        at = np.asarray(index, dtype=np.int64)
        starts, lengths = np.asarray(self.starts, dtype=np.int64), np.asarray(self.lengths, dtype=np.int64)
        n = lengths[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])] if len(at) else np.zeros(0, dtype=np.int32)
        self.firsts.clear()
        return ends[counts], ids


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def _slices(texts: list[str | None], most: int = 4_000_000):
    """Parts of the batch of about `most` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encode(path: str, lists: bool):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _slices(texts):
                offsets, ids = encoder(path).encode_batch(texts[lo:hi])
                keys = b.column(0).slice(lo, hi - lo)
                if lists:
                    second = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                else:
                    second = pa.array(offsets[1:] - offsets[:-1], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, second], names=["_key", "_out"])

    return run


def _path(name: str, folder: str | None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, name)


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE_50K, folder: str | None = None) -> DataFrame:
    """key, ids: the token ids of every text."""
    kind = dict(docs.dtypes)[key]
    out = docs.select(key, text).mapInArrow(_encode(_path(tokenizer, folder), True), f"_key {kind}, _out array<int>")
    return out.withColumnsRenamed({"_key": key, "_out": "ids"})


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE_50K, folder: str | None = None) -> DataFrame:
    """key, n_tokens: the number of tokens of every text."""
    kind = dict(docs.dtypes)[key]
    out = docs.select(key, text).mapInArrow(_encode(_path(tokenizer, folder), False), f"_key {kind}, _out long")
    return out.withColumnsRenamed({"_key": key, "_out": "n_tokens"})
