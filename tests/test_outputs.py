import json

from dossia.sources.outputs import nested_submission_parts

COLUMNS = ["code", "place", "no"]


def test_parts_are_ordered_and_hold_every_check(spark):
    rows = [("hot" if i % 3 else f"o{i % 4}", f"P{i * 7 % 11}", None if i % 5 == 0 else f"ось {i % 4}", i) for i in range(500)] + [(None, "P1", "x", 900)]
    df = spark.createDataFrame(rows, "object_id string, code string, place string, no long").repartition(7)
    parts: dict = {}
    for r in nested_submission_parts(df, "object_id", COLUMNS, 50).collect():
        parts[r.object_id, r.part] = json.loads(r.checks)
        assert len(parts[r.object_id, r.part]) == r.n_checks <= 50
    order = lambda x: (x[0], x[1] is not None, x[1] or "", x[2])
    for o in {r[0] for r in rows}:
        mine = sorted(k[1] for k in parts if k[0] == o)
        assert mine == list(range(len(mine)))
        got = [tuple(c.get(x) for x in COLUMNS) for p in mine for c in parts[o, p]]
        assert got == sorted((r[1:] for r in rows if r[0] == o), key=order)
        assert all(len(parts[o, p]) == 50 for p in mine[:-1])
