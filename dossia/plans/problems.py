"""Queries of the general training-data problems (1, 4, 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.operators import drift, nested, units
from dossia.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.unit_findings(table(spark, d, "rule_observations"), table(spark, d, "matrix_params"), table(spark, d, "trigger_rules"))


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    """Every observation that states a quantity, in the unit of its parameter."""
    return units.to_parameter_units(table(spark, d, "rule_observations"), table(spark, d, "matrix_params"))[0].distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.attempt_cases(table(spark, d, "audit_log"))


def p4_attempts(spark: SparkSession, d: str) -> DataFrame:
    return nested.attempts_table(table(spark, d, "audit_log")).distinct()


def p4_logs(spark: SparkSession, d: str) -> DataFrame:
    return nested.log_table(table(spark, d, "audit_log"))


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """table_name, n_rows, n_columns of each flat table of the log details, with how many of its rows hang on another row."""
    tables = nested.flat_tables(table(spark, d, "audit_log"), "log_id", "details")
    out = None
    for name, t in sorted(tables.items()):
        one = t.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.lit(len(t.columns) - 5).alias("n_columns"), F.count(F.when(F.col("parent_no") >= 0, 1)).alias("n_linked"))
        out = one if out is None else out.unionByName(one)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_found(table(spark, d, "metric_files"))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unify(table(spark, d, "metric_files"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """All records of all files in one typed table."""
    return drift.unified_table(table(spark, d, "metric_files"))


QUERIES = {f.__name__: f for f in (p1_found, p1_values, p4_found, p4_attempts, p4_logs, p4_tables, p5_found, p5_unified, p5_table)}
SQL: dict[str, str] = {}
