from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dossia.llm import mixture as M


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8))
def test_pfair(weights):
    slots = M.pfair_period(weights)
    period = sum(weights)
    assert sorted(x for s in slots for x in s) == list(range(period))
    for w, own in zip(weights, slots):
        for k, t in enumerate(own):  # within its window: less than one block from the ideal
            assert k * period / w - 1 < t < (k + 1) * period / w
        for t in range(1, period + 1):
            assert abs(sum(1 for x in own if x < t) - t * w / period) < 1


def test_whole_weights():
    assert M.whole_weights([0.5, 0.25, 0.25]) == [2, 1, 1]
    assert M.whole_weights([0.3, 0.3]) == [1, 1]
    assert M.whole_weights([0.99995, 0.00005]) == [19_999, 1]
    assert M.whole_weights([0.1] * 10) == [1] * 10
    w = M.whole_weights([1 / 3, 2 / 3 - 1e-7, 1e-7 + 1e-6])
    assert abs(w[2] / sum(w) - 1.1e-6) <= 5e-7
    with pytest.raises(ValueError):
        M.whole_weights([1 - 1e-9, 1e-9])


def test_a_tiny_share_is_kept(spark):
    docs = spark.createDataFrame([(i, "слово дело " * 20, "a" if i < 2000 else "b") for i in range(2003)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([(1, "a", 0.9985, 1), (1, "b", 0.0015, 1)], "mix_id int, source string, target_share double, max_repeats int")
    got = {r.source: r for r in M.shares(docs, targets, block_tokens=50).collect()}
    assert got["b"].n_docs == 3 and abs(got["b"].actual_share - 0.0015) < 0.0003
    assert got["b"].unused_tokens == 0 and got["a"].unused_tokens >= 0


def test_too_many_slots_are_refused(spark):
    docs = spark.createDataFrame([(1, "слово", "a"), (2, "дело", "b")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([(i, s, x, 1) for i in range(5) for s, x in (("a", 0.999999), ("b", 0.000001))], "mix_id int, source string, target_share double, max_repeats int")
    with pytest.raises(ValueError):
        M.mixture(docs, targets)


def test_more_than_one_bucket(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "слово " * (i % 7), "a") for i in range(300)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([(1, "a", 1.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    whole = {(r.doc_id, r.start) for r in M.mixture(docs, targets, 16).collect()}
    monkeypatch.setattr(M, "BUCKET_ROWS", 2)
    split = {(r.doc_id, r.start) for r in M.mixture(docs, targets, 16).collect()}
    assert split != whole and abs(len(split) - len(whole)) <= 1  # what follows the last whole block differs


def test_plan_leaves_out_what_is_empty():
    plan = M.plan_mixes([(1, "a", 0.5, 1), (1, "b", 0.3, 2), (1, "none", 0.2, 1), (2, "none", 1.0, 1), (3, "a", 0.0, 1)], {"a": 10_000, "b": 1_000}, 100)
    assert {p[1] for p in plan} == {"a", "b"} and {p[0] for p in plan} == {1}
    by = {p[1]: p for p in plan}
    assert by["b"][4] * by["b"][5] <= 2_000 and by["a"][4] / by["b"][4] == pytest.approx(5 / 3, rel=0.1)


def test_mixture(spark, data):
    docs, targets = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/mix_targets.parquet")
    mixed = M.mixture(docs, targets, block_tokens=512).cache()
    share = {(r.mix_id, r.source): r for r in M.shares(docs, targets, block_tokens=512).collect()}
    uses = Counter((r.mix_id, r.doc_id) for r in mixed.collect())
    source = {r.doc_id: r.source for r in docs.collect()}
    for (mix, doc), n in uses.items():
        assert n <= share[mix, source[doc]].max_repeats
    for r in share.values():
        if r.n_docs:
            assert abs(r.actual_share - r.target_share) < 0.06
    assert len(share) == targets.count()
    assert mixed.select("mix_id", "doc_id", "repeat_no").distinct().count() == mixed.count()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "слово " * 50, "a"), (3, "слово " * 50, "a"), (4, "x", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([(1, "a", 1.0, 2), (1, "z", 0.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    got = M.mixture(docs, targets).collect()
    assert Counter(r.doc_id for r in got if r.n_tokens) == {3: 2}
    assert M.mixture(docs.limit(0), targets).count() == 0
    assert M.mixture(docs, targets.limit(0)).count() == 0


def test_starts_run_through_a_source(spark):
    sizes = spark.createDataFrame([(i, "s" if i % 3 else "t", i % 7) for i in range(1000)], "doc_id long, source string, n_tokens long")
    rows = M.source_starts(sizes, buckets=16).collect()
    for s in "st":
        own = sorted((r.start, r.n_tokens) for r in rows if r.source == s)
        total = 0
        for start, n in sorted(own, key=lambda x: (x[0], x[1])):
            assert start == total
            total += n
