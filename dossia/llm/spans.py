"""Long spans that stand verbatim in more than one record, by relative Lempel-Ziv factors.

Every record is parsed against all records as reference.  The index of the references is
cut into blocks by hash, and a record is only held against the blocks it can match:

* parse points: of every window of starts the least hash of GRAM characters is kept, so a
  span of MIN_SPAN characters has a parse point in both records, whatever stands around it;
* a block of the index is the parse points of one hash; those of a single record are
  dropped.  What one batch already shows to be shared is spread by record, so a hash that
  a third of all records have sends one row a batch to its task;
* around each shared point the record's cores are cut: the GRAM characters with `a` steps
  of text before and `b` behind them, a + b fixed.  A span of MIN_SPAN characters over
  the point has a core in common (steps are shorter than what the sum of the two sides
  leaves over), so factors meet in a hash join of cores, and few others do;
* the factor of two equal cores is checked at its borders: greedily lengthened to both
  sides by the characters kept beside the core, it must come to MIN_SPAN characters.
  Cores of more than HOT records are split by their exact borders instead of being paired.

Rows are per core, some for each parse point, not per character; work follows the length of
the corpus and of what is shared in it.

Defined results: null, empty and shorter texts and rows without an id share nothing; lengths are in code
points; repeated rows of one id are one record; a span shared only within one record
does not count.  A group of n records that share one span yields its n(n-1)/2 pairs in
shared_pairs, which is the result asked for; shared_spans has one row per record and
span, and shared_classes one row per record whatever the size of its group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossia.operators.graphs import components
from dossia.session import materialize

MIN_SPAN = 200
GRAM = 80
HOT = 256
_B1, _B2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def __init__(self, base: int) -> None:
        import numpy as np

        self.base, self.inverse, self.n = np.uint64(base), np.uint64(pow(base, -1, 1 << 64)), 0
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int):
        import numpy as np

        while len(self.up) < n:
            m = np.uint64(len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * np.uint64(pow(int(self.base), int(m), 1 << 64))])
                self.down = np.concatenate([self.down, self.down * np.uint64(pow(int(self.inverse), int(m), 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS: dict[int, _Powers] = {}


def gram_hashes(codes, k: int, base: int = _B1):
    """Mixed 64-bit hashes of all windows of k codes; equal windows have equal hashes wherever they stand."""
    import numpy as np

    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS.setdefault(base, _Powers(base)).upto(len(codes) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * down[:n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _sliding(a, w: int, fold, fill):
    """fold over every w consecutive elements, in time that does not depend on w."""
    import numpy as np

    pad = (-len(a)) % w
    blocks = np.concatenate([a, np.full(pad, fill, dtype=a.dtype)]).reshape(-1, w)
    head = fold.accumulate(blocks, axis=1).ravel()
    tail = fold.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(tail[: len(a) - w + 1], head[w - 1 : len(a)])


def parse_points(hashes, window: int):
    """Positions whose hash is the least of some `window` consecutive ones (all of them on ties)."""
    import numpy as np

    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64)
    least = _sliding(hashes, window, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    edge = np.zeros(window - 1, dtype=np.uint64)
    # a hash is the least of some window if it is the largest of the minima of the windows over it
    most = _sliding(np.concatenate([edge, least, edge]), window, np.maximum, np.uint64(0))
    return np.flatnonzero(hashes == most)


def _raw(text: str) -> bytes:
    return text.encode("utf-32-le", "surrogatepass")


def _codes(text: str):
    import numpy as np

    return np.frombuffer(_raw(text), dtype=np.uint32)


def shape(min_span: int = MIN_SPAN, gram: int = GRAM) -> tuple[int, int, int]:
    """(step, steps, border): a core is gram + steps * step characters, with border characters kept on each side."""
    step = max(1, min_span // 10)
    steps = max(0, (min_span - gram) // step - 1)
    return step, steps, min_span - gram - steps * step


def _points(min_span: int, gram: int):
    """hash, doc, shared: the parse points of each record; of a hash that several records of a batch have, all are shared, and one more row tells the other batches."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids, hs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = gram_hashes(_codes(text), gram)
                own = np.unique(h[parse_points(h, min_span - gram + 1)])
                ids.append(np.full(len(own), key, dtype=np.int64))
                hs.append(own)
            doc, h = np.concatenate(ids), np.concatenate(hs)
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            first = np.ones(len(h), dtype=bool)
            first[1:] = h[1:] != h[:-1]
            group = np.cumsum(first) - 1
            lo = doc[first]
            shared = np.zeros(len(lo), dtype=bool)
            np.logical_or.at(shared, group, doc != lo[group])
            sure = shared[group]
            told = first & sure
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([h, h[told]]).view(np.int64)), pa.array(np.concatenate([doc, doc[told]])), pa.array(np.concatenate([sure, np.zeros(told.sum(), dtype=bool)])), pa.array(np.concatenate([np.zeros(len(h), dtype=bool), np.ones(told.sum(), dtype=bool)]))],
                names=["hash", "doc", "sure", "told"],
            )

    return run


def _cores(min_span: int, gram: int):
    """The cores around the shared parse points of each record, with the characters beside them; first and last start of those that repeat in a run."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        step, steps, border = shape(min_span, gram)
        core = gram + steps * step
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("before", pa.string()), ("after", pa.string())])
        for b in batches:
            out: list[tuple] = []
            for key, text, hits in zip(*(c.to_pylist() for c in b.columns)):
                raw = _raw(text)
                codes = np.frombuffer(raw, dtype=np.uint32)
                h = gram_hashes(codes, gram)
                p = parse_points(h, min_span - gram + 1)
                p = p[np.isin(h[p].view(np.int64), np.array(hits, dtype=np.int64))]
                s = np.unique((p[:, None] - step * np.arange(steps + 1)[None, :]).ravel())
                s = s[(s >= 0) & (s + core <= len(codes))]
                if not len(s):
                    continue
                h1 = gram_hashes(codes, core, _B2)[s].view(np.int64)
                runs: dict[tuple, list[int]] = {}
                single = len(np.unique(h1)) == len(h1)
                for i, (x, k) in enumerate(zip(s.tolist(), h1.tolist())):
                    left, right = text[max(0, x - border) : x], text[x + core : x + core + border]
                    if single:
                        out.append((k, xxh3_64_intdigest(raw[4 * x : 4 * (x + core)]) - (1 << 63), key, x, x, left, right))
                        continue
                    was = runs.get((k, left, right))
                    if was is not None and x - was[-1] <= core:
                        was[-1] = x
                    else:
                        if was is not None:
                            out.append((k, xxh3_64_intdigest(raw[4 * was[0] : 4 * (was[0] + core)]) - (1 << 63), key, was[0], was[-1], left, right))
                        runs[k, left, right] = [x, x]
                out += [(k, xxh3_64_intdigest(raw[4 * x : 4 * (x + core)]) - (1 << 63), key, x, y, left, right) for (k, left, right), (x, y) in runs.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    return run


def shared_cores(docs: DataFrame, key: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """h1, h2, doc, first, last, before, after, hot: the cores that more than one record has; hot where more than `hot` have it."""
    long = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).filter((F.length("text") >= min_span) & F.col("doc").isNotNull())
    points = long.mapInArrow(_points(min_span, gram), "hash long, doc long, sure boolean, told boolean")
    # what is sure needs no company: it is spread by record
    place = F.when(F.col("sure"), F.xxhash64("doc")).otherwise(F.lit(0))
    block = Window.partitionBy("hash", "place")
    seen = points.withColumn("place", place).withColumns({"lo": F.min("doc").over(block), "hi": F.max("doc").over(block), "any": F.max("told").over(block)})
    hits = seen.filter(~F.col("told") & (F.col("sure") | F.col("any") | (F.col("lo") < F.col("hi"))))
    hits = materialize(hits.groupBy("doc").agg(F.collect_set("hash").alias("hits")))  # of one record: bounded by its length
    cores = long.join(hits, "doc").select("doc", "text", "hits").mapInArrow(_cores(min_span, gram), "h1 long, h2 long, doc long, first int, last int, before string, after string")
    cores = materialize(cores)
    many = cores.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("h1", "h2", (F.col("n") > hot).alias("hot"))
    return materialize(cores.join(many, ["h1", "h2"]))


def _common(a: str, b: str, border: int, back: bool) -> Column:
    """How many characters two borders have in common, counted from the core."""
    x, y = F.col(a), F.col(b)
    same = [(F.substring(x, -i, i) == F.substring(y, -i, i) if back else F.substring(x, 1, i) == F.substring(y, 1, i)).cast("int") for i in range(1, border + 1)]
    return F.least(reduce(lambda p, q: p + q, same), F.length(x), F.length(y))


def _met(cores: DataFrame, border: int) -> DataFrame:
    """Pairs of different records with one core whose factor comes to the full length: doc_a < doc_b, and how far it reaches to either side."""
    cool = cores.filter(~F.col("hot"))
    a = cool.select("h1", "h2", *[F.col(c).alias(f"{c}_a") for c in ("doc", "first", "last", "before", "after")])
    b = cool.select("h1", "h2", *[F.col(c).alias(f"{c}_b") for c in ("doc", "first", "last", "before", "after")])
    pairs = a.join(b, ["h1", "h2"]).filter(F.col("doc_a") < F.col("doc_b"))
    pairs = pairs.withColumn("x", _common("before_a", "before_b", border, True)).withColumn("y", _common("after_a", "after_b", border, False))
    return pairs.filter(F.col("x") + F.col("y") >= border)


def _split(cores: DataFrame, border: int) -> DataFrame:
    """Hot cores by each exact span of full length over them: only records that share it have the same h1, h2, x, span."""
    each = cores.filter("hot").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(border))))
    each = each.filter((F.length("before") >= F.col("x")) & (F.length("after") >= border - F.col("x")))
    span = F.concat(F.when(F.col("x") > 0, F.expr("right(before, x)")).otherwise(""), F.lit("\x00"), F.expr(f"left(after, {border} - x)"))
    return each.select("h1", "h2", "x", span.alias("span"), "doc", "first", "last")


def shared_pairs(cores: DataFrame, min_span: int = MIN_SPAN, gram: int = GRAM) -> DataFrame:
    """doc_a, doc_b: the pairs of records with a factor of full length."""
    border = shape(min_span, gram)[2]
    found = _met(cores, border).select("doc_a", "doc_b")
    k = _split(cores, border).select("h1", "h2", "x", "span", "doc").distinct()
    by = ["h1", "h2", "x", "span"]
    hot = k.withColumnRenamed("doc", "doc_a").join(k.withColumnRenamed("doc", "doc_b"), by).filter("doc_a < doc_b").select("doc_a", "doc_b")
    return found.unionByName(hot).distinct()


def shared_links(cores: DataFrame, min_span: int = MIN_SPAN, gram: int = GRAM) -> DataFrame:
    """doc_a, doc_b: links that join all records of a group, but no more than in proportion to its size where the group is hot."""
    border = shape(min_span, gram)[2]
    found = _met(cores, border).select("doc_a", "doc_b")
    k, by = _split(cores, border), ["h1", "h2", "x", "span"]
    least = k.groupBy(*by).agg(F.min("doc").alias("doc_a"))
    return found.unionByName(k.join(least, by).filter(F.col("doc_a") < F.col("doc")).select("doc_a", F.col("doc").alias("doc_b"))).distinct()


def shared_factors(cores: DataFrame, min_span: int = MIN_SPAN, gram: int = GRAM) -> DataFrame:
    """doc, start, end: the factors of each record, lengthened as far as some other record goes with it (by at most a border)."""
    step, steps, border = shape(min_span, gram)
    core = gram + steps * step
    met = _met(cores, border)
    reach = lambda d: met.select(F.col(f"doc_{d}").alias("doc"), F.col(f"first_{d}").alias("first"), F.col(f"last_{d}").alias("last"), "x", "y")
    k, by = _split(cores, border), ["h1", "h2", "x", "span"]
    many = k.groupBy(*by).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select(*by)
    hot = k.join(many, by, "left_semi").select("doc", "first", "last", "x", (F.lit(border) - F.col("x")).alias("y"))
    both = reach("a").unionByName(reach("b")).unionByName(hot)
    best = both.groupBy("doc", "first", "last").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return best.select("doc", (F.col("first") - F.col("x")).alias("start"), (F.col("last") + core + F.col("y")).alias("end"))


def shared_spans(cores: DataFrame, min_span: int = MIN_SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, start, length: the maximal stretches of each record that factors cover."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = shared_factors(cores, min_span, gram).withColumn("gap", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("gap").over(order))
    spans = runs.groupBy("doc", "run").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    return spans.select(F.col("doc").alias("doc_id"), "start", "length")


def shared_parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, n_spans, shared_chars, shared_part: one row for every record, also those that share nothing."""
    spans = shared_spans(shared_cores(docs, key, text)).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum("length").alias("shared_chars"))
    all_docs = docs.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n_chars"))
    return all_docs.join(spans, "doc_id", "left").select(
        "doc_id", "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(0.0).alias("shared_part")
    )


def shared_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, class_id for every record: the least id among the records that shared spans join to it."""
    cores = shared_cores(docs, key, text, min_span, gram, hot)
    joined = components(shared_links(cores, min_span, gram).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")))
    ids = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id")).distinct()
    return ids.join(joined.select(F.col("node").alias("doc_id"), F.col("component").alias("least")), "doc_id", "left").select("doc_id", F.coalesce("least", "doc_id").alias("class_id"))
