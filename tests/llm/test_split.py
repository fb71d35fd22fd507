import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dossia.llm import split as S


def brute_class(text, limit=1400):
    import re

    fits = lambda parts: all(len(p) <= limit for p in parts)
    paragraphs = re.split(r"\n[ \t]*\n\s*|\f", text)
    if fits(paragraphs):
        return "paragraph"
    sentences = [s for p in paragraphs for s in re.split(r"(?<=[.!?])\s+", p)]
    if fits(sentences):
        return "sentence"
    return "word" if fits(text.split()) else "none"


def check(text, limit=1400, overlap=220):
    pieces = S.cut(text, limit, overlap)
    assert "".join(text[s:e] for _, s, e, _ in pieces) == text
    for i, (b, s, e, _) in enumerate(pieces):
        assert e - b <= limit and 0 <= s - b <= overlap and (e > s or not text)
        if i:
            assert b >= pieces[i - 1][1]
        else:
            assert b == s == 0
    return pieces


def sentence(rng, n):
    return " ".join("".join(rng.choice("абвгде") for _ in range(rng.randint(2, 9))) for _ in range(n)) + "."


@pytest.mark.parametrize("seed", range(30))
def test_invariants(seed):
    rng = random.Random(seed)
    parts = [" ".join(sentence(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 8))]
    text = rng.choice(["\n\n", "\f", "\n \n", "\r\n\r\n"]).join(parts)
    pieces = check(text)
    assert S.coarsest(pieces) == (brute_class(text.replace("\r\n", "\n")) if len(text) > 1400 else "whole")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="аб .!\n\f\r \u0306", max_size=400))
def test_any_text(text):
    check(text, 50, 10)


def test_hard_cases():
    assert S.cut("") == [(0, 0, 0, "end")]
    check("x" * 100_000)
    check(("x" * 1399 + " ") * 5)
    check(("x" * 1400 + "\n\n") * 5)
    check("и\u0306" * 3000)
    assert {k for *_, k in S.cut("x" * 5000)} == {"none", "end"}
    assert S.coarsest(S.cut("x" * 1401)) == "none"
    assert S.coarsest(S.cut(("x" * 1400 + "   ") * 3)) == "word"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="аб .!\n\f", min_size=51, max_size=400))
def test_the_finest_cut_tells_the_class(text):
    assert S.coarsest(check(text, 50, 10)) == brute_class(text, 50)


def test_moving_blocks_give_the_same_curve():
    rng = random.Random(8)
    text = " ".join(rng.choice(["насос", "труба", "стена", "кирпич", "и", "вода"]) for _ in range(300))
    c = S._Cohesion(text, [])
    c._read()
    depth = lambda i: S._cosine(Counter(c.words[max(0, i - S.BLOCK_WORDS) : i]), Counter(c.words[i : i + S.BLOCK_WORDS]))
    at = [p for p in c.places if 200 < p <= 900]
    s = c.valleys([depth(c.places.index(p)) for p in at])
    assert c.deepest_gap(200, 900) == max(zip([round(x, 9) for x in s], at))[1]


def test_words_without_sentences_are_cut_where_the_topic_changes():
    rng = random.Random(3)
    text = " ".join(rng.choice(["насос", "труба", "клапан", "вода"]) for _ in range(130)) + " "
    change = len(text)
    text += " ".join(rng.choice(["стена", "кирпич", "раствор", "кладка"]) for _ in range(300))
    assert change in [e for _, _, e, _ in S.cut(text, 1300, 100)]


def test_cuts_where_the_topic_changes():
    rng = random.Random(3)
    one, two = ["насос труба клапан вода напор", "вода труба насос"], ["стена кирпич раствор кладка", "кладка стена кирпич"]
    first = [f"{rng.choice(one)} {rng.choice(one)} {rng.choice(one)}.".capitalize() for _ in range(14)]
    second = [f"{rng.choice(two)} {rng.choice(two)} {rng.choice(two)}.".capitalize() for _ in range(14)]
    text = " ".join(first) + " " + " ".join(second)
    change = len(" ".join(first)) + 1
    ends = [e for _, _, e, _ in S.cut(text, 1300, 100)]
    assert change in ends


def test_rows(spark):
    text = "раз два. " * 150 + "\f" + "три. " * 500
    df = spark.createDataFrame([(1, text, 7, 0), (1, text, 7, 0), (2, None, None, 0), (3, "", 1, 0), (4, "коротко", None, 0)], "chunk_id long, text string, page_number int, start int")
    got = [r for r in S.split_texts(df).collect() if r.chunk_id == 1]
    assert {r.page_number for r in got} == {7, 8}
    assert {(r.chunk_id, r.text) for r in S.split_texts(df).filter("chunk_id > 1").collect()} == {(2, None), (3, ""), (4, "коротко")}
    assert {tuple(r) for r in S.long_texts(df).collect()} == {(1, "sentence")}
    assert S.long_texts(df.limit(0)).count() == 0
