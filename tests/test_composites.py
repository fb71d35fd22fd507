import __spark_entry__ as entry


def test_checks_of_all_objects_are_merged(spark, data):
    q = entry.queries()
    every = q["snk08_collapse"](spark, data).collect()
    of = {r.id: r.object_id for r in spark.read.parquet(f"{data}/document_versions.parquet").select("id", "object_id").collect()}
    seen = {r.document_version_id for r in spark.read.parquet(f"{data}/rule_observations.parquet").select("document_version_id").collect()}
    objects = {of[k] for k in seen if k in of}
    assert {r.object_id for r in every} == objects and len(objects) > 1
    keys = [(r.object_id, r.parameter_code, r.dataset_stage) for r in every]
    assert len(keys) == len(set(keys))


def test_more_values_than_the_limit_are_refused(spark):
    import pytest

    from dossia.operators.units import few

    df = spark.range(11).toDF("id")
    assert few(df, 11) == list(range(11))
    with pytest.raises(ValueError):
        few(df, 10)


def test_matching_within_one_percent(spark, data, tmp_path):
    """Against augmenting paths over the edges of a small table."""
    import random

    rng = random.Random(5)
    obs = [(i, rng.choice("AB"), rng.choice(["PD", "RD"]), str(round(100 * 1.004 ** rng.randint(0, 12), 3)), rng.choice([1, 2, 3]), "x", "2024-01-01") for i in range(60)]
    spark.createDataFrame(obs, "observation_id long, parameter_code string, stage string, normalized_value string, document_version_id long, extra string, ingested_at string").write.parquet(f"{tmp_path}/rule_observations.parquet")
    spark.createDataFrame([(1, "D1"), (2, "D1"), (3, "D2")], "id long, object_id string").write.parquet(f"{tmp_path}/document_versions.parquet")
    got = {r.object_id: r.matched for r in entry.queries()["join13_max_matching"](spark, str(tmp_path)).collect()}
    code = {1: "D1", 2: "D1", 3: "D2"}
    want = {}
    for d in ("D1", "D2"):
        own = [(o[0], o[1], o[2], float(o[3])) for o in obs if code[o[4]] == d]
        edges = {a[0]: [b[0] for b in own if b[2] != "PD" and b[1] == a[1] and abs(a[3] - b[3]) <= 0.01 * min(a[3], b[3])] for a in own if a[2] == "PD"}
        owner = {}

        def augment(a, seen):
            for b in edges[a]:
                if b not in seen:
                    seen.add(b)
                    if b not in owner or augment(owner[b], seen):
                        owner[b] = a
                        return True
            return False

        want[d] = sum(augment(a, set()) for a in edges)
    assert got == {d: n for d, n in want.items() if n}
