"""Packing normalised text into chunks for search: paragraphs up to a size, with an overlap of characters.

Texts are packed one by one in a map over the scan; packing is greedy, so it has no form as a join.

Defined results: null, empty and blank texts give no chunk; a paragraph over the size is packed by
sentences, a sentence over it is cut by characters; a table (it begins with `[TABLE `) over the size
is packed by lines and every chunk of it repeats its first line; a chunk of fewer than `least`
characters joins the one before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

SIZE, OVERLAP, LEAST = 1400, 220, 160

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def normalize(text: str) -> str:
    """Lines without outer and doubled blanks, at most one empty line between them."""
    lines = [" ".join(x.split()) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def pack(parts: Iterable[str], size: int, overlap: int, glue: str, head: str = "") -> list[str]:
    """Parts joined by glue up to the size; each chunk after the first begins with head, or else the end of its predecessor."""
    out: list[str] = []
    now = head
    fresh = True  # nothing but what is repeated
    for p in parts:
        if not fresh and len(now) + len(glue) + len(p) > size:
            out.append(now)
            now, fresh = head or (now[-overlap:].strip() if overlap else ""), True
        now = f"{now}{glue}{p}" if now else p
        fresh = False
    return [*out, now] if not fresh else out


def chunk_text(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    text = normalize(text)
    runs: list[str] = []
    plain: list[str] = []

    def close() -> None:
        runs.extend(pack(plain, size, overlap, "\n\n"))
        plain.clear()

    for p in (x.strip() for x in text.split("\n\n")):
        if not p:
            continue
        if len(p) <= size:
            plain.append(p)
            continue
        close()
        if p.startswith("[TABLE "):
            title, *lines = p.split("\n")
            runs.extend(pack(lines, size, 0, "\n", title))
        else:
            pieces = [s[i : i + size] for s in _SENTENCE.split(p) for i in range(0, len(s), size)]
            runs.extend(pack(pieces, size, overlap, " "))
    close()
    out: list[str] = []
    for c in runs:
        if out and len(c) < least:
            out[-1] = f"{out[-1]}\n\n{c}"
        else:
            out.append(c)
    return out


def chunks(texts: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """key, chunk_no, chunk."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(k, i, c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for i, c in enumerate(chunk_text(t, size, overlap, least))]
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), b.column(0).type), pa.array(list(cols[1]), pa.int32()), pa.array(list(cols[2]), pa.string())], names=[key, "chunk_no", "chunk"])

    return texts.select(key, text).mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, chunk_no int, chunk string")
