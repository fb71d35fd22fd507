import numpy as np
import pytest

from dossia.operators.vectors import leader_clusters


@pytest.mark.parametrize("block_rows", [1000, 5])
def test_blocks_do_not_part_like_vectors(spark, block_rows):
    rng = np.random.default_rng(3)
    base = np.eye(4)
    rows = [(i * 700, i % 2, [float(x) for x in base[i % 4] + rng.normal(0, 0.02, 4)]) for i in range(60)]
    rows += [(100_000 + v, g, u) for v, g, u in rows]  # equal vectors far away by id
    rows += [(5, 0, None), (6, None, [1.0, 0.0, 0.0, 0.0]), (7, None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.label, r.cluster) for r in leader_clusters(df, "label", "vec_id", "embedding", 0.8, block_rows).collect()}
    assert got.keys() == {v for v, _, e in rows if e}
    assert all(got[v] == got[100_000 + v] for v, _, _ in rows[:60])
    assert len({got[i * 700] for i in range(60)}) == 4  # two directions a label, whatever the blocks
    assert all(got[i * 700] == got[i % 4 * 700] for i in range(60))
    assert got[6] == got[7] == (None, 0)


def test_order_is_that_of_frequency(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.8, 0.6]), (3, 0, [0.8, 0.6]), (4, 0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert {r.vec_id: r.cluster for r in leader_clusters(df, "label", "vec_id", "embedding", 0.75).collect()} == {2: 0, 3: 0, 1: 0, 4: 1}
