import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dossia.llm import lookalikes as L


@pytest.mark.parametrize(
    "text, faults",
    [
        ("обычный текст № 5 м² «x» — 7‰", []),
        ("\uff11\uff12", ["full_width"]),
        ("а\u00a0б", ["blank"]),
        ("а\tб", ["blank"]),
        ("а\u200bб", ["invisible"]),
        ("и\u0306", ["accent"]),
        ("а\u0301", []),
        ("Mосква", ["alphabets"]),
        ("кΒт", ["alphabets"]),
        ("м3 А5B", []),
        ("line\nend\f", []),
        ("", []),
    ],
)
def test_faults(text, faults):
    assert L.faults(text) == faults


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aаеeоoxхмmТT\u200b\u3000 \uff45\uff11 и\u0308\u0306\n№²", max_size=30))
def test_simplify(text):
    once = L.simplify(text)
    assert L.simplify(once) == once
    assert not {"full_width", "blank", "invisible", "accent"} & set(L.faults(once))
    assert L.skeleton(once) == L.skeleton(text)


def test_classes_are_transitive():
    u = L.lookalike_classes()
    assert len({u.find(c) for c in "AАΑ\uff21"}) == 1
    assert u.find("и\u0306") == u.find("й") and u.find(" ") == u.find(" ") and u.find("\u200b") == u.find("")
    assert u.find("A") != u.find("B")


def test_resolve():
    assert L.resolve("Mосквa") == "Москва"
    assert L.resolve("Тhe") == "The" and L.resolve("wеld") == "weld"


def rows(spark, texts):
    return spark.createDataFrame([("t", i, t, None) for i, t in enumerate(texts)], "src string, row_id long, text string, canonical string")


def test_canonical(spark):
    texts = ["Стальная балка", "Cтальнaя\u00a0балка", "С\u200bтальная", "Стальная\u3000балка", "COM", "СОМ СОМ", "и\u0306", None, "", "wеldеd 5\n\f", "Сталь", "5 м²", "м² м", "5 m²", "½Zж x"]
    got = {r.row_id: r.canonical for r in L.canonical_texts(rows(spark, texts)).collect()}
    assert got[0] == got[1] == got[3] == "Стальная балка" and got[2] == "Стальная"
    assert got[4] == "СОМ"  # the more frequent spelling stands for both
    assert got[6] == unicodedata.normalize("NFC", "и\u0306") and got[7] is None and got[8] == "" and got[9] == "welded 5\n\f" and got[10] == "Сталь"
    joined = {r.row_id: r.canonical for r in L.canonical_texts(rows(spark, texts), max_patterns=0).collect()}
    assert joined == got


def test_what_looks_the_same_is_the_same(spark, data):
    c = spark.read.parquet(f"{data}/chunks.parquet")
    o, f = spark.read.parquet(f"{data}/rule_observations.parquet"), spark.read.parquet(f"{data}/doc_facts.parquet")
    done = L.canonical_texts(L.sources(o, c, f)).collect()
    by = {}
    for r in done:
        if r.canonical is not None:
            assert not L.faults(r.canonical)
            by.setdefault(L.skeleton(r.text), set()).add(r.canonical)
    assert all(len(v) == 1 for v in by.values())


def test_found(spark):
    o = spark.createDataFrame([(1, "\uff15 м"), (2, "5 м"), (1, "\uff15 м"), (3, None)], "observation_id long, value string")
    c = spark.createDataFrame([(1, "x\ny"), (2, "и\u0306")], "chunk_id long, text string")
    f = spark.createDataFrame([(1, "AР"), (2, "AP"), (3, "АР.2"), (4, None), (5, "Z1"), (6, "КЖ²"), (7, "КЖ\u00a02"), (8, "")], "doc_id long, section_key string")
    for most in (L.MAX_PATTERNS, 0):
        got = {tuple(r) for r in L.dirty_rows(o, c, f, most).collect()}
        assert got == {("rule_observations", 1), ("chunks", 2), *(("doc_facts", i) for i in (1, 2, 5, 7))}
    # letters of two alphabets side by side that have no twin stand for themselves, and are found all the same
    o = spark.createDataFrame([(1, "ДZ"), (2, "кВтR"), (3, "ДД Z")], "observation_id long, value string")
    for most in (L.MAX_PATTERNS, 0):
        assert {r.row_id for r in L.dirty_rows(o, c.limit(0), f.limit(0), most).collect()} == {1, 2}
    assert L.dirty_rows(o.limit(0), c.limit(0), f.limit(0)).count() == 0


def test_longest_pattern_wins():
    a = L._automaton([("ab", "X"), ("abc", "Y")])
    assert L.rewrite("abc ab abcd", a) == "Y X abcd"
    assert L.rewrite("abc", L._automaton([])) == "abc"
