"""Comparing values of two sides: tolerances, keyed comparison, trigger rules, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tolerance(expected: Column) -> Column:
    """max(0.01, 0.1 % of the expected value); fixed values of the comparison."""
    return F.greatest(F.lit(0.01), F.abs(expected) * 0.001)


def changed(expected: Column, later: Column) -> Column:
    return F.abs(later - expected) > tolerance(expected)


def change_pct(expected: Column, later: Column) -> Column:
    """Change against the expected value in percent; null where that is 0."""
    return F.when(expected != 0, F.abs(later - expected) / F.abs(expected) * 100)


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once: of duplicates neither is taken."""
    once = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n = 1").select(*keys)
    return df.join(once, keys, "left_semi")


def keyed_compare(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, left_value, right_value, status: only_left, only_right, equal, differs, unknown (a null is never equal)."""
    a = unique_keys(left, keys).select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = unique_keys(right, keys).select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    j = a.join(b, keys, "full_outer")
    status = (
        F.when(F.col("_r").isNull(), "only_left")
        .when(F.col("_l").isNull(), "only_right")
        .when(F.col("left_value").isNull() | F.col("right_value").isNull(), "unknown")
        .when(changed(F.col("left_value"), F.col("right_value")), "differs")
        .otherwise("equal")
    )
    return j.select(*keys, "left_value", "right_value", status.alias("status"))


def trigger_numeric(kind: Column, pct: Column, op: Column, threshold: Column, expected: Column, later: Column, same_unit: Column, guard: float = 200.0) -> Column:
    """FIRES, NOT_FIRING, UNDETERMINED or NOT_EVALUABLE for the change expected -> later under a rule."""
    diff, share = changed(expected, later), change_pct(expected, later)
    down_up = diff & F.when(kind == "DECREASE", later < expected).otherwise(later > expected)
    small = F.coalesce((F.coalesce(pct, F.lit(0.0)) != 0) & share.isNotNull() & (share <= pct), F.lit(False))
    any_change = diff & ((F.coalesce(pct, F.lit(0.0)) == 0) | share.isNull() | (share > pct))
    holds = F.when(op == "<", later < threshold).when(op == "<=", later <= threshold).when(op == ">", later > threshold).when(op == ">=", later >= threshold)
    far = (later > 0) & (threshold > 0) & ((later / threshold > guard) | (later / threshold < 1 / guard))

    def fires(c: Column) -> Column:
        return F.when(c, "FIRES").otherwise("NOT_FIRING")

    return (
        F.when(kind.isNull() | (kind == "NOT_EVALUABLE"), "NOT_EVALUABLE")
        .when(expected.isNull() | later.isNull(), "UNDETERMINED")
        .when(kind == "PRESENCE", fires((expected != 0) & (F.abs(later) <= 1e-7)))
        .when(kind == "COUNT_CHANGE", fires(later != expected))
        .when(kind.isin("DECREASE", "INCREASE"), fires(down_up & ~small))
        .when(kind == "ANY_CHANGE_PCT", fires(any_change))
        .when((kind == "ABS_THRESHOLD") & ~F.coalesce(same_unit, F.lit(False)), "UNDETERMINED")
        .when((kind == "ABS_THRESHOLD") & far, "UNDETERMINED")
        .when(kind == "ABS_THRESHOLD", fires(holds))
        .otherwise("UNDETERMINED")
    )


def trigger_grade(order: Column, expected: Column, later: Column) -> Column:
    """FIRES on a downgrade by place in an ordered list, UNDETERMINED where a grade is not in it."""
    a, b = F.array_position(order, expected), F.array_position(order, later)
    return F.when((F.coalesce(a, F.lit(0)) == 0) | (F.coalesce(b, F.lit(0)) == 0), "UNDETERMINED").when(b < a, "FIRES").otherwise("NOT_FIRING")


def any_component(statuses: Column) -> Column:
    """Of several components: FIRES if one fires, else UNDETERMINED if one is, else NOT_FIRING."""
    return F.when(F.array_contains(statuses, "FIRES"), "FIRES").when(F.array_contains(statuses, "UNDETERMINED"), "UNDETERMINED").otherwise("NOT_FIRING")


def magnitude_gate(a: Column, b: Column, ratio: float = 20.0) -> Column:
    """True where two positive values are too far apart to be the same quantity."""
    return (a > 0) & (b > 0) & (F.greatest(a, b) / F.least(a, b) >= ratio)


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds; null if none does."""
    return F.coalesce(*[F.when(c, F.lit(r)) for c, r in rules])


def printed_precision_differs(a: Column, b: Column) -> Column:
    """Whether no pair of two lists of printed numbers agrees within one unit of the coarser last place."""

    def places(x: Column) -> Column:
        return F.length(F.regexp_extract(x, r"\.(\d+)$", 1))

    def near(x: Column, y: Column) -> Column:
        return F.abs(x.try_cast("double") - y.try_cast("double")) <= F.pow(F.lit(10.0), -F.least(places(x), places(y)).cast("double")) + 1e-9

    return ~F.exists(a, lambda x: F.exists(b, lambda y: F.coalesce(near(x, y), F.lit(False))))


def consecutive_changes(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """df with previous value and change: ADDED (first), VALUE_MISSING, VALUE_CHANGED, UNCHANGED."""
    w = Window.partitionBy(*keys).orderBy(*order)
    prev = df.withColumn("previous", F.lag(value).over(w)).withColumn("_rn", F.row_number().over(w))
    v, p = F.col(value), F.col("previous")
    kind = F.when(F.col("_rn") == 1, "ADDED").when(v.isNull() & p.isNotNull(), "VALUE_MISSING").when(p.isNull() & v.isNotNull(), "ADDED").when(changed(p, v), "VALUE_CHANGED").otherwise("UNCHANGED")
    return prev.withColumn("change", kind).drop("_rn")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; order must end in a column that has no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def weighted_mean(signals: dict[str, tuple[float, Column]], veto: Column, substantive: list[str], least: int, cap: float) -> Column:
    """The mean of the signals that are there by their weights: 0 under a veto or without signals, at most `cap` where fewer than `least` of the substantive ones are there."""
    present = lambda names: sum((F.when(signals[n][1].isNotNull(), signals[n][0] if names is signals else 1.0).otherwise(0.0) for n in names), F.lit(0.0))
    total = present(signals)
    mean = F.coalesce(sum((w * F.coalesce(c, F.lit(0.0)) for w, c in signals.values()), F.lit(0.0)) / F.nullif(total, F.lit(0.0)), F.lit(0.0))
    return F.when(veto, 0.0).when(present(substantive) < least, F.least(mean, F.lit(cap))).otherwise(mean)
