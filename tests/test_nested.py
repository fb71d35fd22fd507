import json

from dossia.operators import nested as N

SCHEMA = "log_id long, details string, row_no long, attempts string"


def cases(spark, rows):
    df = spark.createDataFrame([(i, d, 0, "x") for i, d in rows], SCHEMA)
    return sorted(tuple(r) for r in N.attempt_cases(df).collect())


A = {"code": "A-1", "pages_scanned": 3, "found": True}


def test_shapes(spark):
    deep = {"code": "C", "found": "нет", "pages_scanned": 1, "hits": [{"page": 1, "found": True}], "retries": [A, {"code": "D", "scan": {"found": "да", "pages_scanned": "7"}, "retries": [{"code": "E", "found": 1, "pages_scanned": 2.0}]}]}
    rows = [
        (1, json.dumps({"attempts": [A, {"code": None, "found": True, "pages_scanned": 1}, {"code": "B", "found": False, "pages_scanned": 9}, {"code": "B", "found": "true", "pages_scanned": 0}]})),
        (2, json.dumps({"run": {"batches": [{"attempts": [deep]}, {"attempts": [A]}]}})),
        (3, json.dumps({"attempts": json.dumps([A])})),
        (4, json.dumps({"attempts": A})),
        (5, '{"attempts": [{"code": "A", "pages_sc'),
        (6, None),
        (7, ""),
        (8, "null"),
        (10, json.dumps({"attempts": [[A], [[A]]]})),
        (9, json.dumps([{"attempts": []}, 5])),
        (1, json.dumps({"attempts": [A, {"code": None, "found": True, "pages_scanned": 1}, {"code": "B", "found": False, "pages_scanned": 9}, {"code": "B", "found": "true", "pages_scanned": 0}]})),
    ]
    assert cases(spark, rows) == [(1, 0, -1, "A-1"), (2, 1, 0, "A-1"), (2, 2, 0, "D"), (2, 3, 2, "E"), (2, 4, -1, "A-1"), (3, 0, -1, "A-1"), (4, 0, -1, "A-1"), (10, 0, -1, "A-1"), (10, 1, -1, "A-1")]


def test_empty_and_deep(spark):
    assert cases(spark, []) == []
    assert cases(spark, [(1, "[" * 100_000)]) == []
    wide = json.dumps({"attempts": [A] * 5000})
    assert len(cases(spark, [(1, wide)])) == 5000


def test_plan_inlines_singletons():
    edges = [("$", "attempts", "object", 9, 9), ("attempts", "result", "object", 4, 0), ("attempts", "retries", "object", 3, 3), ("retries", "retries", "object", 1, 1), ("attempts", "code", "value", 9, 0), ("retries", "code", "value", 3, 0), ("attempts", "hits", "object", 2, 2), ("hits", "page", "value", 2, 0)]
    t = N.plan_tables(edges)
    assert t["attempts"] == t["retries"] and t["hits"] == "hits" and "result" not in t


def test_attempts_and_retries_of_other_members_are_numbered_in_one_walk(spark):
    retry = {"code": "R", "found": True, "pages_scanned": 2}
    other = {"code": "O", "found": True, "pages_scanned": 1, "a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 6}
    log = {"retries": [retry], "attempts": [other | {"retries": [retry | {"retries": [retry]}]}, "skipped", 7, None, other]}
    df = spark.createDataFrame([(1, json.dumps(log), 0, "x"), (1, json.dumps(log), 0, "x")], SCHEMA)
    t = N.inline_tables(df, "log_id", "details", N.ATTEMPTS)[1]
    assert t["attempts"] != t["retries"]
    # the first retries are of no attempt
    assert {(r.attempt_no, r.parent_no, r.code) for r in N.attempts_table(df).collect()} == {(1, -1, "O"), (2, 1, "R"), (3, 2, "R"), (4, -1, "O")}
    assert [r.n_attempts for r in N.log_table(df).collect()] == [4]


def test_flat_tables_keep_every_value(spark):
    log = {"status": "ok", "Status": 5, "row_no": True, "attempts": [{"code": "A", "n": 1, "tags": ["x", 2]}, "note", 7, {"code": "B", "n": None, "at": {"x": 1.5}}], "empty": [], "list": [[1], [{"k": 1}]]}
    df = spark.createDataFrame([(1, json.dumps(log), 0, "x"), (2, json.dumps({"status": None, "attempts": []}), 0, "x"), (2, json.dumps({"status": None, "attempts": []}), 0, "x")], SCHEMA)
    t = N.flat_tables(df, "log_id", "details")
    assert dict(t["attempts"].dtypes) == {"log_id": "bigint", "row_no": "bigint", "parent_table": "string", "parent_no": "bigint", "element": "string", "at.x": "double", "code": "string", "n": "double", "value": "string"}
    a = {r.row_no: r for r in t["attempts"].collect()}
    assert [a[i]["value"] for i in range(4)] == [None, "note", "7", None] and a[3]["at.x"] == 1.5 and a[0]["n"] == 1.0
    assert {(r.parent_table, r.parent_no, r["value"]) for r in t["tags"].collect()} == {("attempts", 0, "x"), ("attempts", 0, "2")}
    root = {r.log_id: r for r in t["$"].collect()}
    assert set(root) == {1, 2} and root[1]["status_2"] == "ok" and root[1]["Status"] == 5.0 and root[1]["row_no_2"] is True
    assert sorted((r["k"], r["value"]) for r in t["list"].collect() if r["k"] is None) == [(None, 1.0)] and t["list"].count() == 2
    parents = {(r.log_id, name, r.row_no) for name, x in t.items() for r in x.select("log_id", "row_no").collect()}
    for x in t.values():
        assert all((r.log_id, r.parent_table, r.parent_no) in parents for r in x.filter("parent_no >= 0").collect())


def test_parent_links(spark, data):
    rows = N.attempts_table(spark.read.parquet(f"{data}/audit_log.parquet")).distinct()
    rows.createOrReplaceTempView("att")
    orphans = spark.sql("select count(*) n from att a left anti join att b on a.log_id = b.log_id and a.parent_no = b.attempt_no where a.parent_no >= 0").first().n
    assert orphans == 0
    assert spark.sql("select count(*) n from att where parent_no >= attempt_no").first().n == 0
