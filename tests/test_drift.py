import datetime
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dossia.operators import drift as D
from dossia.operators.ordered import lag_by, ranks_by

SCHEMA = "file_id long, suite_id string, written_at timestamp_ntz, payload string, fields string"


def files(spark, rows):
    return spark.createDataFrame([(i, s, datetime.datetime(2025, 1, d), p, None) for i, s, d, p in rows], SCHEMA)


def recs(*rows):
    return json.dumps([{"object_id": o} | r for o, r in rows])


def test_changes(spark):
    rows = [
        (1, "s", 1, recs(("a", {"x": 1, "y": "t", "z": 5}), ("b", {"x": 2, "z": None}))),
        (2, "s", 2, json.dumps({"records": [{"object_id": "a", "w": 1, "y": {"v": 1}, "q": 9}, {"object_id": "b", "w": 2.0}]})),
        (3, "s", 3, '{"object_id": "a", "w": null, "y": null}\n{"object_id": "b", "q": "no"}\n'),
        (4, "s", 4, recs(("a", {"w": "s", "y": [1]}))),
        (4, "s", 4, recs(("a", {"w": "s", "y": [1]}))),
        (9, "t", 1, recs(("a", {"k": 1}))),
        (8, "t", 2, "broken"),
        (7, "t", 3, None),
        (6, "t", 4, recs(("a", {"k": 1}))),
    ]
    got = {tuple(r) for r in D.drift_found(files(spark, rows)).collect()}
    assert got == {
        (2, "x", "renamed"), (2, "z", "removed"), (2, "q", "added"), (2, "y", "retyped"),
        (3, "q", "retyped"),
        (4, "q", "removed"), (4, "w", "retyped"), (4, "y", "retyped"),
        (8, "k", "removed"), (6, "k", "added"),
    }


def test_rename_needs_equal_values(spark):
    rows = [(1, "s", 1, recs(("a", {"x": 1}), ("b", {"x": 2}))), (2, "s", 2, recs(("a", {"y": 1}), ("b", {"y": 3})))]
    assert {tuple(r) for r in D.drift_found(files(spark, rows)).collect()} == {(2, "x", "removed"), (2, "y", "added")}


def test_matching_is_one_to_one():
    old = {"a_score": {1: 10, 2: 20}, "b": {1: 10, 2: 20}}
    new = {"a_scores": {1: 10, 2: 20}, "bb": {1: 10}}
    assert D.match_fields(old, new) == {"a_score": "a_scores", "b": "bb"}
    assert D.match_fields({}, new) == {} and D.match_fields(old, {}) == {}


def test_empty(spark):
    assert D.drift_found(files(spark, [])).count() == 0
    assert D.unify(files(spark, [])).count() == 0


def test_unified_names_follow_renames(spark):
    rows = [(1, "s", 1, recs(("a", {"x": 1}))), (2, "s", 2, recs(("a", {"y": 1}))), (3, "s", 3, recs(("a", {"z": 1})))]
    got = {(r.file_id, r.field_name, r.column_name) for r in D.unify(files(spark, rows)).collect()}
    assert got == {(1, "x", "z"), (2, "y", "z"), (3, "z", "z")}


def test_one_typed_table(spark):
    rows = [
        (1, "s", 1, recs(("a", {"x": 1, "File_id": "f", "m": True}), ("b", {"x": None, "n": {"k": 2}}))),
        (2, "s", 2, recs(("a", {"y": 1.0, "M": 5, "mixed": "t"}), (None, {"y": 3, "mixed": 4}))),
        (3, "t", 1, None),
    ]
    df = D.unified_table(files(spark, rows))
    assert dict(df.dtypes) | {"y": "double", "m_2": "boolean", "M": "double", "mixed": "string", "n": "string", "File_id_2": "string"} == dict(df.dtypes)
    got = {(r.file_id, r.record_no): r for r in df.collect()}
    assert len(got) == 4 and got[1, 0]["y"] == 1.0 and got[1, 1]["y"] is None and got[1, 1]["n"] == '{"k": 2}' and got[2, 1]["mixed"] == "4"
    assert D.unified_table(files(spark, [])).count() == 0


def test_many_renames_are_followed(spark):
    rows = [(i, "s", 1 + i, recs(("a", {f"f{i}": 1}))) for i in range(25)]
    assert {r.column_name for r in D.unify(files(spark, rows)).collect()} == {"f24"}


def test_lag_of_a_hot_key(spark):
    rows = [("hot", i, i * 10) for i in range(500)] + [(f"k{i}", i, i) for i in range(50)]
    rows += [(None, i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(7)
    got = {(r.k, r.o): r.before for r in lag_by(df, ["k"], ["o"], {"before": "v"}).collect()}
    assert all(got["hot", i] == (None if i == 0 else (i - 1) * 10) for i in range(500))
    assert all(got[None, i] == (None if i == 0 else i - 1) for i in range(300))
    assert all(got[f"k{i}", i] is None for i in range(50))


@pytest.mark.parametrize("partitions", [8, 64])
def test_lags_and_ranks_as_by_a_window(spark, partitions):
    """With columns that are neither key, order nor value, a hot key, null keys and ties."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.range(6000).select(
            F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("k"), F.col("id") % 97)).alias("k"), (F.xxhash64("id") % 2000).alias("o"), F.col("id").alias("v"), F.rand(3).alias("x"), F.repeat(F.lit("y"), 20).alias("y")
        )
        df = df.repartition(13, "x")
        w = Window.partitionBy("k").orderBy("o", "v")
        want = {r.v: (r.before, r.no) for r in df.select("v", F.lag("v").over(w).alias("before"), F.row_number().over(w).alias("no")).collect()}
        got = {r.v: r.before for r in lag_by(df, ["k"], ["o"], {"before": "v"}).collect()}
        assert got == {v: b for v, (b, _) in want.items()}
        ranks = {r.v: r["no"] for r in ranks_by(df, ["k"], ["o", "v"], "no").collect()}
        assert ranks == {v: n for v, (_, n) in want.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
