"""Keeping derived state in step with a new run, and replaying edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_actions(old: DataFrame, new: DataFrame, keys: list[str], basis: str, decided: str) -> DataFrame:
    """keys, action: insert, keep (same basis), replace, reverify (decided, basis changed), delete or flag (orphans, undecided or decided)."""
    o = old.select(*keys, F.col(basis).alias("_ob"), F.coalesce(F.col(decided), F.lit(False)).alias("_od"), F.lit(1).alias("_o"))
    n = new.select(*keys, F.col(basis).alias("_nb"), F.lit(1).alias("_n"))
    j = o.join(n, keys, "full_outer")
    action = (
        F.when(F.col("_o").isNull(), "insert")
        .when(F.col("_n").isNull() & F.col("_od"), "flag")
        .when(F.col("_n").isNull(), "delete")
        .when(F.col("_ob").eqNullSafe(F.col("_nb")), "keep")
        .when(F.col("_od"), "reverify")
        .otherwise("replace")
    )
    return j.select(*keys, action.alias("action"))


def replay(edits: DataFrame, keys: list[str], order: list[str], action: str, value: str) -> DataFrame:
    """keys, value, alive, n_edits after all edits in order: ADD and REFINE set a value, REMOVE takes the key out, RESTORE brings the last value back."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last_value = F.last(F.when(F.col(action).isin("ADD", "REFINE"), F.col(value)), ignorenulls=True).over(w)
    alive = F.last(F.when(F.col(action) == "REMOVE", False).when(F.col(action).isin("ADD", "RESTORE"), True), ignorenulls=True).over(w)
    e = edits.select(*keys, last_value.alias("value"), F.coalesce(alive, F.lit(False)).alias("alive"), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("_rn"))
    return e.groupBy(*keys).agg(F.max_by("value", "_rn").alias("value"), F.max_by("alive", "_rn").alias("alive"), F.count("*").alias("n_edits"))


def cycles(df: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """df with cycle: the number of start rows so far; rows before the first start have 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cycle", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def islands(df: DataFrame, keys: list[str], order: list[str], gap: Column) -> DataFrame:
    """df with island: a new one begins where gap (an expression over lag) holds, and at a key's first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_g", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).withColumn("island", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_g")


def set_changes(expected: Column, actual: Column) -> tuple[Column, Column]:
    """(missing, added) of two arrays, sorted."""
    return F.array_sort(F.array_except(expected, actual)), F.array_sort(F.array_except(actual, expected))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; null where both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u)


def orphans(groups: DataFrame, touched: DataFrame, key: str, decided: str) -> DataFrame:
    """key, action: keep where a run touched the group; else flag it where it is decided, delete it where not."""
    t = touched.select(key, F.lit(True).alias("_t")).distinct()
    return groups.join(t, key, "left").select(key, F.when(F.col("_t"), "keep").when(F.col(decided), "flag").otherwise("delete").alias("action"))


def absent(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key is not in `known`; nulls are equal."""
    k = known.select(*[F.col(c).alias(f"_k_{c}") for c in keys]).distinct()
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return new.join(k, same, "left_anti")


def stored(old: DataFrame, new: DataFrame, key: str, value: str, reviewed: str) -> DataFrame:
    """key, value, reviewed after a new run: reviewed rows and those it does not know stay, others take its value, what is new is added unreviewed."""
    o = old.select(key, F.col(value).alias("_ov"), F.coalesce(F.col(reviewed), F.lit(False)).alias("_or"))
    n = new.select(key, F.col(value).alias("_nv"), F.lit(True).alias("_n"))
    j = o.join(n, key, "full_outer")
    kept = F.coalesce("_or", F.lit(False)) | F.col("_n").isNull()
    return j.select(key, F.when(kept, F.col("_ov")).otherwise(F.col("_nv")).alias(value), F.coalesce("_or", F.lit(False)).alias(reviewed))
