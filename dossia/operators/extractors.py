"""Extractors that a user registers by name and runs over texts in one pass.

An extractor is a function of a text that yields (start, value) pairs; it is shipped to the tasks
with the map, so it may hold anything that can be pickled.  A null text has no values; an extractor
that fails on a text yields one row with the error instead of failing the job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

Extractor = Callable[[str], Iterable[tuple[int, str]]]


class Registry:
    def __init__(self) -> None:
        self.known: dict[str, Extractor] = {}

    def add(self, name: str, f: Extractor) -> None:
        if name in self.known:
            raise ValueError(f"{name} is there already")
        self.known[name] = f

    def pattern(self, name: str, pattern: str, group: int = 1) -> None:
        """An extractor made of a pattern."""
        p = re.compile(pattern)
        self.add(name, lambda t: ((m.start(), m[group]) for m in p.finditer(t)))

    def run(self, texts: DataFrame, key: str, text: str, names: list[str] | None = None) -> DataFrame:
        """key, extractor, start, value, error: what the named extractors (or all) find, each text read once."""
        chosen = {n: self.known[n] for n in names or self.known}

        def extract(batches):
            import pyarrow as pa

            for b in batches:
                rows = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for n, f in chosen.items() if t is not None else ():
                        try:
                            rows += [(k, n, s, v, None) for s, v in f(t)]
                        except Exception as e:
                            rows.append((k, n, None, None, f"{type(e).__name__}: {e}"))
                cols = list(zip(*rows)) if rows else [[]] * 5
                types = (b.column(0).type, pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=[key, "extractor", "start", "value", "error"])

        return texts.select(key, text).mapInArrow(extract, f"{key} {dict(texts.dtypes)[key]}, extractor string, start int, value string, error string")
