"""Vectors: similarity, nearest neighbours, leader clusters, hybrid scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossia.session import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one is null, empty or zero."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


BLOCK_BYTES = 32 << 20


def nearest_vectors(base: DataFrame, queries: DataFrame, k: int, vec: str = "embedding", key: str = "vec_id", least: float | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, key, score, rank: the k base rows with the largest cosine for every query.

    Queries are cut by hash into blocks of at most about block_bytes, each a matrix that is broadcast and held against
    the batches of one pass over the base; a task keeps the best k of its batches, and the best of all tasks are ranked
    with a limit before the shuffle.  Null, empty and zero vectors and vectors of another length than most queries have
    no neighbours.
    """
    spark = base.sparkSession
    usable = queries.filter(F.col(vec).isNotNull() & F.col(key).isNotNull() & (F.size(vec) > 0)).select(F.col(key).cast("long").alias("query_id"), vec)
    n, dim = usable.agg(F.count("*"), F.mode(F.size(vec))).first()
    usable = usable.filter(F.size(vec) == (dim or 0))
    blocks = max(1, -(-n * (dim or 1) * 8 * 2 // block_bytes))  # twice: hashed blocks are not all alike
    hits = None
    for b in range(blocks):
        q = usable.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect() if blocks > 1 else usable.collect()
        ids = np.array([r.query_id for r in q], dtype=np.int64)
        m = np.array([r[vec] for r in q], dtype=np.float64).reshape(len(q), dim or 0)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(norm > 0, norm, np.nan)
        part = base.filter(F.size(vec) == (dim or 0)).select(F.col(key).cast("long").alias(key), vec).mapInPandas(_held_against(spark.sparkContext.broadcast((ids, m)), k, vec, key), f"query_id long, {key} long, score double")
        hits = part if hits is None else hits.unionByName(part)
    if least is not None:
        hits = hits.filter(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", key, "score", "rank")


def _held_against(shared, k: int, vec: str, key: str):
    def run(batches):
        qid, qm = shared.value
        best_s = np.full((len(qid), k), -2.0)
        best_k = np.zeros((len(qid), k), dtype=np.int64)
        for pdf in batches:
            pdf = pdf[pdf[key].notna()]
            if not len(pdf) or not len(qid):
                continue
            b = np.stack(pdf[vec].to_numpy()).astype(np.float64)
            norm = np.linalg.norm(b, axis=1, keepdims=True)
            b /= np.where(norm > 0, norm, np.nan)
            keys = pdf[key].to_numpy(dtype=np.int64)
            for lo in range(0, len(qid), 512):
                s = np.nan_to_num(np.round(qm[lo : lo + 512] @ b.T, 9), nan=-2.0)
                s[qid[lo : lo + 512, None] == keys[None, :]] = -2.0  # not its own neighbour
                s = np.concatenate([best_s[lo : lo + 512], s], axis=1)
                ks = np.concatenate([best_k[lo : lo + 512], np.broadcast_to(keys, (len(s), len(keys)))], axis=1)
                top = np.lexsort((ks, -s), axis=1)[:, :k]
                best_s[lo : lo + 512] = np.take_along_axis(s, top, axis=1)
                best_k[lo : lo + 512] = np.take_along_axis(ks, top, axis=1)
        at = np.nonzero(best_s > -2)
        yield pd.DataFrame({"query_id": qid[at[0]], key: best_k[at], "score": best_s[at]})

    return run


def _leaders(vectors: list[np.ndarray], threshold: float) -> tuple[list[int], list[np.ndarray]]:
    """The cluster of each vector sum, taken in order, and the sums of the clusters."""
    sums: list[np.ndarray] = []
    labels = []
    for x in vectors:
        if sums:
            c = np.stack(sums)
            s = c @ x / np.maximum(np.linalg.norm(c, axis=1) * np.linalg.norm(x), 1e-12)
            best = int(np.argmax(s))
            if s[best] >= threshold:
                sums[best] = sums[best] + x
                labels.append(best)
                continue
        labels.append(len(sums))
        sums.append(x)
    return labels, sums


def leader_clusters(df: DataFrame, group: str, key: str, vec: str, threshold: float, block_rows: int = 1000) -> DataFrame:
    """group, key, cluster: vectors join the nearest centre of their group at or above the threshold, else lead a new cluster.

    Equal vectors are one, taken in order of frequency, then of the smallest key, and so
    always in one cluster.  A group of more than block_rows distinct vectors is cut into
    blocks by the hash of the vector; the centres of its blocks are then clustered in the
    same way, by weight, so that block borders do not part like vectors.  The centres of a
    group are in one task.  Null vectors are in no cluster.
    """
    kinds = dict(df.dtypes)
    rows = df.select(group, key, vec).filter(F.col(vec).isNotNull())
    equal = rows.groupBy(group, vec).agg(F.count("*").alias("_n"), F.min(key).alias("_first"))
    blocks = equal.groupBy(group).agg(F.ceil(F.count("*") / block_rows).cast("long").alias("_blocks"))
    # <=>: rows of the null group too
    cut = equal.alias("e").join(blocks.alias("b"), F.col(f"e.{group}").eqNullSafe(F.col(f"b.{group}"))).select(f"e.{group}", vec, "_n", "_first", F.pmod(F.xxhash64(vec), F.col("_blocks")).alias("_block"))

    def unit(v) -> np.ndarray:
        x = np.asarray(v, dtype=np.float64)
        return x / max(np.linalg.norm(x), 1e-12)

    def in_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_n", "_first"], ascending=[False, True])
        labels, sums = _leaders([unit(v) * n for v, n in zip(pdf[vec], pdf["_n"])], threshold)
        at = pd.Series(labels)
        first, n = pdf["_first"].groupby(at.to_numpy()).min(), pdf["_n"].groupby(at.to_numpy()).sum()
        lead = ~at.duplicated().to_numpy()
        return pd.DataFrame({group: pdf[group], "_block": pdf["_block"], "_first": pdf["_first"], "_own": labels, "_sum": [list(sums[k]) if f else None for k, f in zip(labels, lead)], "_least": [first[k] for k in labels], "_weight": [n[k] for k in labels]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["_block"].nunique() == 1:
            return pd.DataFrame({group: pdf[group], "_block": pdf["_block"], "_own": pdf["_own"], "cluster": pdf["_own"]})
        pdf = pdf.sort_values(["_weight", "_least"], ascending=[False, True])
        labels, _ = _leaders([np.asarray(v) for v in pdf["_sum"]], threshold)
        return pd.DataFrame({group: pdf[group], "_block": pdf["_block"], "_own": pdf["_own"], "cluster": labels})

    g, k = f"{group} {kinds[group]}", kinds[key]
    owned = materialize(cut.groupBy(group, "_block").applyInPandas(in_block, f"{g}, _block long, _first {k}, _own long, _sum array<double>, _least {k}, _weight long"))
    merged = owned.filter("_sum is not null").groupBy(group).applyInPandas(merge, f"{g}, _block long, _own long, cluster long")

    def same(a: str, b: str, *columns: str) -> Column:
        return F.expr(" and ".join(f"{a}.`{c}` <=> {b}.`{c}`" for c in columns))

    firsts = owned.alias("o").join(merged.alias("m"), same("o", "m", group, "_block", "_own")).select(f"o.{group}", "_first", "cluster")
    keyed = rows.alias("r").join(equal.alias("q"), same("r", "q", group, vec)).select(f"r.{group}", f"r.{key}", "_first")
    return keyed.alias("k").join(firsts.alias("f"), same("k", "f", group, "_first")).select(f"k.{group}", f"k.{key}", "cluster")


def hybrid_score(semantic: Column, lexical: Column, phrase: Column, extra: Column) -> Column:
    """0.32 semantic + 0.62 lexical + 1.2 phrase + extras."""
    return 0.32 * F.coalesce(semantic, F.lit(0.0)) + 0.62 * lexical + 1.2 * phrase + extra
