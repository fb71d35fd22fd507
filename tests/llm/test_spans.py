import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dossia.llm import spans as S


def brute_pairs(texts, n=200):
    seen = {}
    for i, t in texts.items():
        for k in range(len(t or "") - n + 1):
            seen.setdefault(t[k : k + n], set()).add(i)
    return {(a, b) for ids in seen.values() for a in ids for b in ids if a < b}


def brute_cover(texts, n=200):
    seen = {}
    for i, t in texts.items():
        for k in range(len(t or "") - n + 1):
            seen.setdefault(t[k : k + n], {}).setdefault(i, []).append(k)
    out = {}
    for places in seen.values():
        if len(places) > 1:
            for i, ks in places.items():
                for k in ks:
                    out.setdefault(i, set()).update(range(k, k + n))
    return {i: len(v) for i, v in out.items()}


def corpus(seed, n=40):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("абвгдежз ") for _ in range(k))
    texts = {i: text(rng.randint(150, 900)) for i in range(n)}
    for i in range(0, n - 3, 3):
        k = rng.choice([198, 199, 200, 201, 240, 400])
        span = text(k)
        for j in (i, i + 1) if i % 2 else (i, i + 1, i + 2):
            at = rng.choice([0, len(texts[j]), rng.randint(0, len(texts[j]))])
            texts[j] = texts[j][:at] + span + texts[j][at:]
    return texts


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 40))
def test_points_do_not_depend_on_surroundings(seed, window):
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 30, 300).astype(np.uint64)
    brute = sorted({j + k for j in range(len(h) - window + 1) for k in range(window) if h[j + k] == h[j : j + window].min()})
    assert S.parse_points(h, window).tolist() == brute
    a = set((S.parse_points(h[50:200], window) + 50).tolist())
    assert {p for p in a if 50 + window <= p < 200 - window} == {p for p in brute if 50 + window <= p < 200 - window}


def test_hashes_depend_on_the_window_only():
    a, b = S._codes("абвгде" * 30), S._codes("xx" + "абвгде" * 30)
    assert (S.gram_hashes(a, 20) == S.gram_hashes(b, 20)[2:]).all()
    assert len(S.gram_hashes(a, 1000)) == 0


def run(spark, texts, repeat=False, hot=S.HOT):
    rows = [(i, t, 0, 0) for i, t in texts.items()]
    df = spark.createDataFrame(rows + rows * repeat, "doc_id long, text string, doc int, start int")
    return df, S.shared_cores(df, hot=hot)


def test_pairs_and_spans_equal_brute_force(spark):
    for seed, hot in ((1, S.HOT), (2, S.HOT), (3, 1), (4, 0)):
        texts = corpus(seed) | {900: None, 901: "", 902: "а" * 199, 903: "😀" * 210, 904: "x" + "😀" * 205}
        df, w = run(spark, texts, hot=hot)
        assert {tuple(r) for r in S.shared_pairs(w).collect()} == brute_pairs(texts)
        cover = {}
        for r in S.shared_spans(w).collect():
            cover[r.doc_id] = cover.get(r.doc_id, 0) + r.length
        assert cover == brute_cover(texts)


def test_copies_runs_and_repeated_rows(spark):
    texts = {1: "ab" * 300, 2: "ba" * 200, 3: "-" * 500, 4: "x" + "-" * 230 + "y", 5: "-" * 199, 6: "q" * 50 + "слово и дело " * 40, 7: "q" * 50 + "слово и дело " * 40}
    for hot in (S.HOT, 0):
        df, w = run(spark, texts, repeat=True, hot=hot)
        assert {tuple(r) for r in S.shared_pairs(w).collect()} == brute_pairs(texts)
        cover = {}
        for r in S.shared_spans(w).collect():
            cover[r.doc_id] = cover.get(r.doc_id, 0) + r.length
        assert cover == brute_cover(texts)


def test_parts_have_every_record(spark):
    texts = corpus(5, 12) | {900: None, 901: ""}
    df, _ = run(spark, texts)
    df = df.unionByName(df.limit(2).selectExpr("cast(null as long) doc_id", "text", "doc", "start"))
    got = {r.doc_id: r for r in S.shared_parts(df).collect()}
    want = brute_cover(texts)
    assert set(got) == set(texts)
    assert all(got[i].shared_chars == want.get(i, 0) for i in texts)
    assert all(0 <= r.shared_part <= 1 for r in got.values())


def test_empty(spark):
    df, w = run(spark, {1: None})
    assert S.shared_pairs(w).count() == 0 and S.shared_spans(w).count() == 0


def test_spans_at_every_border(spark):
    """Two records with 195 to 205 characters in common, the rest different, at their ends or inside."""
    rng, texts = random.Random(9), {}
    text = lambda k, a: "".join(rng.choice(a) for _ in range(k))
    for i, k in enumerate(range(195, 206)):
        span = text(k, "абвгдежз ")
        for j, (x, y) in enumerate([(0, 30), (30, 0), (77, 91)]):
            texts[10 * i + j] = text(x, "klm") + span + text(y, "nop")
    for hot in (S.HOT, 1):
        _, w = run(spark, texts, hot=hot)
        assert {tuple(r) for r in S.shared_pairs(w).collect()} == brute_pairs(texts)


def test_a_hot_span_is_one_class_with_few_links(spark):
    rng = random.Random(4)
    text = lambda k: "".join(rng.choice("абвгдежз ") for _ in range(k))
    span, almost = text(260), text(195)
    texts = {i: text(80) + (span if i % 2 else almost) + text(80) for i in range(120)} | {500: text(300), 501: None}
    df, w = run(spark, texts, hot=20)
    assert S.shared_links(w).count() < 6 * 60  # of 1770 pairs
    assert {tuple(r) for r in S.shared_pairs(w).collect()} == brute_pairs(texts)
    classes = {r.doc_id: r.class_id for r in S.shared_classes(df, hot=20).collect()}
    assert classes == {i: 1 if i < 120 and i % 2 else i for i in texts}
