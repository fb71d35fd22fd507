"""Components and matchings over edge tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, component (the least node of it), by alternating large-star and small-star rounds.

    Every round moves edges towards the least neighbour; a hub's edges are spread over its
    neighbours, so no task holds a component and rounds grow with the logarithm of its size.
    Self-loops keep nodes without other edges.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    cur = materialize(e.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # small star: each node's smaller neighbours (and itself) to the least of them
        down = large.select(F.col("v").alias("n"), F.col("u").alias("s"))
        low = down.groupBy("n").agg(F.min("s").alias("m"))
        small = down.join(low, "n").select(F.col("m").alias("u"), F.col("s").alias("v")).unionByName(low.select(F.col("m").alias("u"), F.col("n").alias("v"))).filter("u <> v").distinct()
        new = materialize(small)
        same = new.count() == cur.count() and new.join(cur, ["u", "v"], "left_anti").isEmpty()
        cur = new
        if same:
            break
    else:
        raise ValueError("components did not settle")
    return nodes.join(cur.select(F.col("v").alias("node"), "u"), "node", "left").select("node", F.coalesce("u", "node").alias("component"))


def _augment(left: dict, start, seen: set, owner: dict) -> bool:
    stack = [(start, iter(left[start]))]
    path = []
    while stack:
        node, it = stack[-1]
        for r in it:
            if r in seen:
                continue
            seen.add(r)
            path.append((node, r))
            if r not in owner:
                for n, x in path:
                    owner[x] = n
                return True
            stack.append((owner[r], iter(left[owner[r]])))
            break
        else:
            stack.pop()
            if path:
                path.pop()
    return False


def max_matching(edges: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """group, matched: the size of a maximum one-to-one matching of each group's edges, worked out component by component.

    A component is in one task: what is joined by edges cannot be matched apart.
    """
    named = edges.select(group, F.concat(F.lit("l"), F.col(left).cast("string")).alias("_l"), F.concat(F.lit("r"), F.col(right).cast("string")).alias("_r")).distinct()
    named = named.select(group, *[F.concat_ws("/", F.col(group).cast("string"), c).alias(c) for c in ("_l", "_r")])
    parts = components(named, "_l", "_r")
    whole = named.join(parts.select(F.col("node").alias("_l"), "component"), "_l")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adj: dict = {}
        for x, y in zip(pdf["_l"], pdf["_r"]):
            adj.setdefault(x, []).append(y)
        owner: dict = {}
        n = sum(_augment(adj, x, set(), owner) for x in sorted(adj))
        return pd.DataFrame({group: [pdf[group].iloc[0]], "matched": [n]})

    kind = dict(edges.dtypes)[group]
    each = whole.groupBy("component").applyInPandas(run, f"{group} {kind}, matched long")
    return each.groupBy(group).agg(F.sum("matched").alias("matched"))


def nearest(left: DataFrame, right: DataFrame, block: str, value: str, left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id, distance: the nearest right row of the block for each left row, without making pairs.

    Both sides are sorted together; the candidates are the last right row before and the first
    one after.  Ties go to the smaller distance, then the smaller right id.
    """
    from pyspark.sql import Window

    l = left.select(block, F.col(value).alias("_v"), F.col(left_id).alias("_l"), F.lit(None).cast("struct<v:double,id:bigint>").alias("_r"))
    r = right.select(block, F.col(value).alias("_v"), F.lit(None).cast("long").alias("_l"), F.struct(F.col(value).cast("double").alias("v"), F.col(right_id).cast("long").alias("id")).alias("_r"))
    u = l.unionByName(r)
    back = Window.partitionBy(block).orderBy("_v", F.col("_r.id").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(block).orderBy(F.col("_v").desc(), F.col("_r.id").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    w = u.withColumn("_b", F.last("_r", ignorenulls=True).over(back)).withColumn("_a", F.last("_r", ignorenulls=True).over(ahead)).filter("_l is not null")
    cand = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.round(F.abs(F.col(f"{c}.v") - F.col("_v")), 6).alias("d"), F.col(f"{c}.id").alias("id"))) for c in ("_b", "_a")]))
    best = F.array_min(cand)
    return w.withColumn("_m", best).filter("_m is not null").select(F.col("_l").alias(left_id), F.col("_m.id").alias(right_id), F.col("_m.d").alias("distance"))
