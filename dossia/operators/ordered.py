"""Ordered look-back that survives hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossia.session import materialize, parallelism


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with _range: rows cut by range over (keys, order), so a key holding a third of all rows is spread over many tasks.

    Borders of ranges come of a sample, so the cut is written down once; everything that is
    worked out from it reads the same one.
    """
    return materialize(df.repartitionByRange(parallelism(df.sparkSession), *keys, *order).withColumn("_range", F.spark_partition_id()))


def lag_by(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """df with, for each `name: column` of values, the column of the row before it in its key by order (null at a key's first row).

    Only the last row of each key in each range crosses to the next, at most one row a range and key.  Ties in order
    follow the order of `values`' columns.
    """
    ranged = in_ranges(df, keys, order)
    inner = Window.partitionBy("_range", *keys).orderBy(*order, *values.values())
    rows = ranged.withColumns({f"_lag_{k}": F.lag(F.struct(F.col(c).alias("v"))).over(inner) for k, c in values.items()})
    packed = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate([*order, *values.values()])], *[F.col(c).alias(f"v_{k}") for k, c in values.items()])
    lasts = ranged.groupBy("_range", *keys).agg(F.max(packed).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_range")
    before = lasts.withColumn("_before", F.lag("_last").over(across)).filter(F.col("_before").isNotNull())
    joined = rows.join(*_on_key(before, keys, "_before"), "left")
    return joined.select(*df.columns, *[F.when(F.col(f"_lag_{k}").isNotNull(), F.col(f"_lag_{k}.v")).otherwise(F.col(f"_before.v_{k}")).alias(k) for k in values])


def _on_key(per_range: DataFrame, keys: list[str], *columns: str):
    """The right side and the condition that join what there is per range and key to the rows of it."""
    right = per_range.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k_{k}") for k in keys], *columns)
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return right, same


def running_by(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value from the first row of its key by order up to each row: summed inside its range, plus what the ranges before it sum to."""
    ranged = in_ranges(df.withColumn("_value", value), keys, order)
    rows = ranged.withColumn("_run", F.sum("_value").over(Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = ranged.groupBy("_range", *keys).agg(F.sum("_value").alias("_n"))
    across = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_off", F.sum("_n").over(across)).filter(F.col("_off").isNotNull())
    return rows.join(*_on_key(before, keys, "_off"), "left").select(*df.columns, (F.coalesce("_run", F.lit(0)) + F.coalesce("_off", F.lit(0))).alias(name))


def ranks_by(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with the number of each row in its key by order, from 1."""
    return running_by(df, keys, order, F.lit(1).cast("long"), name)
