"""Mixing sources to target weights.

Each source is a stream of blocks of equal size in tokens; block k of a source with
share w has release time floor(k / w) and deadline ceil((k + 1) / w), counted in
blocks (the windows of Pfair scheduling), and earliest-deadline-first fills the slots.
The schedule repeats after as many slots as the shares' common denominator, so it is
worked out once for one period and the slot of any block follows by arithmetic; nothing
that grows with the corpus is scheduled on the driver.  Shares with a common denominator
of up to MAX_PERIOD are kept exactly, others to half of 1 / MAX_PERIOD; a plan with more
than MAX_SLOTS slots in all is refused.

Defined results: sources without tokens get no block and their share goes to the
others in proportion; a document belongs to the block in which it begins, so a
source is off its target by less than a block and a document; null and empty texts
count 0 tokens.  The total is the largest one for which every source can give its
share with max_repeats passes.  Repeated rows of one doc_id are one document; a
mix_id whose sources are all empty gives no rows.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossia.llm.tokenize import token_counts
from dossia.session import materialize

BLOCK_TOKENS = 4096
MAX_PERIOD = 1_000_000
MAX_SLOTS = 4_000_000  # of all mixes, as they go to the tasks: 32 MB
BUCKET_ROWS = 200_000


def pfair_period(weights: list[int]) -> list[list[int]]:
    """Slots of each source in one period of sum(weights) slots, by earliest deadline among the released blocks."""
    period = sum(weights)
    slots: list[list[int]] = [[] for _ in weights]
    waiting = [(0, i) for i in range(len(weights))]  # release of the next block
    released: list[tuple[int, int, int]] = []
    for t in range(period):
        while waiting and (waiting[0][0] <= t or not released):  # where none is released the next release is taken
            _, i = heapq.heappop(waiting)
            heapq.heappush(released, (-(-(len(slots[i]) + 1) * period // weights[i]), -weights[i], i))
        _, _, i = heapq.heappop(released)
        slots[i].append(t)
        if len(slots[i]) < weights[i]:
            heapq.heappush(waiting, (len(slots[i]) * period // weights[i], i))
    return slots


def whole_weights(shares: list[float], most: int = MAX_PERIOD) -> list[int]:
    """Integer weights in proportion to the shares, read as decimal numbers: exact while their sum is at most `most`.

    Beyond it the nearest weights of that sum, off by half of 1 / most at the most; a share smaller than that cannot be planned.
    """
    exact = [Fraction(repr(s)) for s in shares]
    exact = [s / sum(exact) for s in exact]
    scale = math.lcm(*[s.denominator for s in exact])
    if scale <= most:
        w = [int(s * scale) for s in exact]
    else:
        w = [round(s * most) for s in exact]
        if min(w) == 0:
            raise ValueError(f"a share is below half of 1/{most}")
    g = math.gcd(*w)
    return [x // g for x in w]


def plan_mixes(targets: list[tuple[int, str, float, int]], tokens: dict[str, int], block_tokens: int = BLOCK_TOKENS) -> list[tuple]:
    """(mix_id, source, period, slots, blocks, block_tokens, tokens of source) for every source that gives anything."""
    out = []
    for mix in sorted({t[0] for t in targets}):
        live = [(s, share, repeats) for m, s, share, repeats in targets if m == mix and share and share > 0 and repeats and repeats > 0 and tokens.get(s, 0) > 0]
        if not live:
            continue
        weights = whole_weights([x[1] for x in live])
        period = sum(weights)
        total = min(tokens[s] * repeats * period / w for (s, _, repeats), w in zip(live, weights))
        size = max(1, min(block_tokens, int(total // period)))
        slots = int(total // size)
        places = pfair_period(weights)

        def blocks(i: int, slots: int) -> int:
            return slots // period * weights[i] + sum(1 for x in places[i] if x < slots % period)

        while any(blocks(i, slots) * size > tokens[s] * repeats for i, (s, _, repeats) in enumerate(live)):
            slots -= 1  # a block begun early must not need one pass too many
        out += [(mix, s, period, places[i], blocks(i, slots), size, tokens[s]) for i, (s, _, _) in enumerate(live)]
    return out


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens; one row a document."""
    counts = token_counts(docs.select(F.struct("doc_id", "source").alias("k"), "text"), "k").select("k.doc_id", "k.source", "n_tokens")
    return counts.dropDuplicates(["doc_id"])


def source_starts(sizes: DataFrame, buckets: int) -> DataFrame:
    """sizes with start: the tokens of its source before the document, in an order mixed by hash.

    Two levels: sums of hash buckets, then a running sum inside a bucket; no task holds a whole source.
    """
    mixed = sizes.withColumn("_h", F.xxhash64(F.lit(17), "doc_id")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sums = mixed.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_n"))
    offset = sums.withColumn("_off", F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source", "_b", "_off")
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    run = mixed.withColumn("_run", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return run.join(offset, ["source", "_b"]).select("doc_id", "source", "n_tokens", (F.col("_off") + F.col("_run")).alias("start"))


def mixture(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, max_targets: int = 10_000) -> DataFrame:
    """mix_id, slot, start, source, doc_id, repeat_no, n_tokens: order by slot, start for the stream of a mix."""
    return _mixed(docs, targets, block_tokens, max_targets)[0]


def _mixed(docs: DataFrame, targets: DataFrame, block_tokens: int, max_targets: int) -> tuple[DataFrame, DataFrame]:
    """The mixture and the sizes of the documents it is made of."""
    spark = docs.sparkSession
    want = targets.filter("mix_id is not null and source is not null").dropDuplicates(["mix_id", "source"]).select("mix_id", "source", "target_share", "max_repeats").limit(max_targets + 1).collect()
    if len(want) > max_targets:
        raise ValueError("too many targets to plan on the driver")
    named = sorted({r.source for r in want if r.source is not None})
    sizes = materialize(document_sizes(docs.filter(F.col("source").isin(named))))
    totals = sizes.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()
    tokens, buckets = {r.source: r.n for r in totals}, max([64, *[r.rows // BUCKET_ROWS for r in totals]])
    plan = plan_mixes([(r.mix_id, r.source, r.target_share, r.max_repeats) for r in want], tokens, block_tokens)
    if sum(len(p[3]) for p in plan) > MAX_SLOTS:
        raise ValueError("the shares have too fine common denominators to plan so many mixes at once")
    schema = T.StructType([T.StructField("mix_id", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("period", T.LongType()), T.StructField("slots", T.ArrayType(T.LongType())), T.StructField("blocks", T.LongType()), T.StructField("size", T.LongType()), T.StructField("total", T.LongType())])
    plans = F.broadcast(spark.createDataFrame(plan, schema))  # one row a target, checked above
    placed = source_starts(sizes, buckets).join(plans, "source")
    passes = F.ceil(F.col("blocks") * F.col("size") / F.col("total")).cast("int")
    each = placed.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.greatest(passes - 1, F.lit(0)))))
    each = each.withColumn("at", F.col("start") + F.col("repeat_no") * F.col("total")).withColumn("block", F.floor(F.col("at") / F.col("size")))
    each = each.filter(F.col("block") < F.col("blocks"))
    n = F.size("slots")
    slot = F.floor(F.col("block") / n) * F.col("period") + F.get("slots", (F.col("block") % n).cast("int"))
    return each.select("mix_id", slot.alias("slot"), F.col("at").alias("start"), "source", "doc_id", "repeat_no", "n_tokens"), sizes


def shares(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, max_targets: int = 10_000) -> DataFrame:
    """mix_id, source, target_share, max_repeats, n_docs, n_tokens, most_repeats, actual_share, unused_tokens.

    What each source really gives, and what max_repeats passes over it would give beyond that, which
    the scarcest source of the mix leaves unused.
    """
    mixed, sizes = _mixed(docs, targets, block_tokens, max_targets)
    got = mixed.groupBy("mix_id", "source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), (F.max("repeat_no") + 1).alias("most_repeats"))
    full = targets.dropDuplicates(["mix_id", "source"]).join(got, ["mix_id", "source"], "left").fillna(0, ["n_docs", "n_tokens", "most_repeats"])
    there = sizes.groupBy("source").agg(F.sum("n_tokens").alias("_there"))
    total = F.sum("n_tokens").over(Window.partitionBy("mix_id"))
    return full.join(there, "source", "left").select(
        "mix_id",
        "source",
        "target_share",
        "max_repeats",
        "n_docs",
        "n_tokens",
        "most_repeats",
        F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0).alias("actual_share"),
        (F.coalesce("_there", F.lit(0)) * F.col("max_repeats") - F.col("n_tokens")).alias("unused_tokens"),
    )
