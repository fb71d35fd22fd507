import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossia.llm import scans as S

GOOD = "Резервный насос показан на чертеже 25, площадью 40 м² из бетона В25 W6 и листа 2х4."
COMPOUND = "Монолитно-каркасная служба показана в осях."


@pytest.mark.parametrize("line", ["7", "- 7 -", "— 12 —", "7 / 12", "стр. 3", "Стр. 3 из 1О", "Лист 12", "Page 3 of 9", "Лист 1б"])
def test_page_marks(line):
    assert S.page_mark(line)


@pytest.mark.parametrize("line", ["", "м².", "84,4 м.", "количестве 239 штук.", "Лист", "чертеже 12", "В25", "об", "лист 5 позиции 7"])
def test_no_page_marks(line):
    assert not S.page_mark(line)


def test_keys_of_lines():
    assert S.line_key("ООО «Вектор» Том 34") == S.line_key("OOО «ВЕКТ0Р»  Том З4".replace("O", "О"))
    assert S.line_key("Том 34") != S.line_key("Том 35")


def test_deletes_meet():
    assert S.deletes("п0казан", S.READ_AS) & S.deletes("показан", S.PRINTED)
    assert S.distance("п0казан", "показан") < 1 <= S.distance("пxказан", "показан")


def brute_distance(a, b):
    """Least cost over all ways to read b as a, by plain recursion."""
    import functools

    @functools.cache
    def d(i, j):
        if not i or not j:
            return float(i + j)
        out = [d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (0 if a[i - 1] == b[j - 1] else S.COST.get((b[j - 1], a[i - 1]), 1.0))]
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            out.append(d(i - 2, j - 2) + 1)
        if i > 1 and (a[i - 2 : i], b[j - 1]) in S.PARTS:
            out.append(d(i - 2, j - 1) + S.PART_COST)
        return min(out)

    return d(len(a), len(b))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="о0нпrnmасе", max_size=8), st.text(alphabet="о0нпrnmасе", max_size=8))
def test_distance(a, b):
    assert S.distance(a, b) == pytest.approx(brute_distance(a, b))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="абвгдеож", min_size=1, max_size=10), st.integers(0, 9), st.sampled_from("абвx"), st.integers(0, 3))
def test_one_edit_always_meets(word, at, letter, kind):
    at %= len(word)
    edited = [word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + word[at : at + 2][::-1] + word[at + 2 :]][kind]
    assert S.deletes(edited, S.READ_AS) & S.deletes(word, S.PRINTED)


def test_edits_off_the_list(spark):
    clean = [(100 + i, "Площадка смонтирована, конструкция рассчитана, modern system.") for i in range(120)]
    read = ["рассчптана", "расчитана", "расссчитана", "рассчтиана", "modem systern", "рассчитано", "скобка"]
    f = frames(spark, [], clean + list(enumerate(read)), [])
    got = {r.row_id: r.repaired for r in S.repaired(*f).collect()}
    assert [got[i] for i in range(7)] == ["рассчитана"] * 4 + ["modem system"] + ["рассчитано", "скобка"]


def test_long_tokens_cost_little(spark):
    import time

    hard = "о" * 20_000
    f = frames(spark, [], [(i, f"{GOOD} {hard[: 10_000 + i]}") for i in range(3)], [])
    began = time.time()
    got = {r.row_id: r.repaired for r in S.repaired(*f).collect()}
    assert got[1] == f"{GOOD} {hard[:10_001]}" and time.time() - began < 60
    assert len(S.deletes("о" * S.LONGEST, S.PRINTED)) < 1000


def frames(spark, pages=(), chunks=(), obs=()):
    p = spark.createDataFrame([(i, d, n, t, None) for i, d, n, t in pages], "page_id long, document_version_id long, page_number int, text string, headers string")
    c = spark.createDataFrame(list(chunks), "chunk_id long, text string")
    o = spark.createDataFrame(list(obs), "observation_id long, context string")
    return p, c, o


def test_noise(spark):
    clean = [(100 + i, f"{GOOD} {COMPOUND}") for i in range(30)]
    chunks = [
        *clean,
        (1, "Резервный на-\nсос показан."),
        (2, "Монолитно-\nкаркасная служба"),
        (3, "Резервный нас0с"),
        (4, "Резервпый насос"),
        (5, "площадью 4З м²"),
        (6, "бетона В25 W6 и листа 2х4"),
        (7, "насос\nстр. 4\nпоказан"),
        (8, "1\n2\n3\n"),
        (9, None),
        (10, ""),
        (11, "Резер¬\nвпый насос"),
    ]
    pages = [(i, 5, i, f"ООО «Альфа»{'' if i else ' '}\nПервая строка {i}\nвторая {i}\nтретья {i}\nчетвёртая {i}\n- {i} -") for i in range(3)] + [(9, 6, 1, None), (0, 5, 0, "ООО «Альфа» \nПервая строка 0\nвторая 0\nтретья 0\nчетвёртая 0\n- 0 -")]
    got = {tuple(r) for r in S.noise_found(*frames(spark, pages, chunks, [(1, "Резервный на\u00ad\nсос"), (2, None)])).collect()}
    want = {
        ("chunks", 1, "hyphen"), ("chunks", 3, "misread"), ("chunks", 4, "misread"), ("chunks", 5, "misread"), ("chunks", 7, "page_number"), ("chunks", 11, "hyphen"), ("chunks", 11, "misread"),
        ("rule_observations", 1, "hyphen"),
    } | {("ocr_pages", i, n) for i in range(3) for n in ("header", "page_number")}
    assert got == want


def test_repair_and_both_ways(spark):
    chunks = [*[(100 + i, f"{GOOD} {COMPOUND}") for i in range(30)], (1, "Резерв-\nпый нас0с пока-\nзан на чертеже 2б, площадью\n40 м².\n\nМонолитно-\nкаркасная служба"), (2, None), (3, "а | б\nв | г")]
    pages = [(i, 5, i, f"Том 1\nРезервный насос {i}\nпоказан\nстрока {i}\n{i} / 9") for i in range(4)]
    f = frames(spark, pages, chunks, [])
    a = {(r.src, r.row_id): (r.noise, r.repaired) for r in S.repaired(*f).collect()}
    b = {(r.src, r.row_id): (r.noise, r.repaired) for r in S.repaired(*f, max_entries=0).collect()}
    assert a == b
    assert a["chunks", 1][1] == "Резервный насос показан на чертеже 26, площадью 40 м².\n\nМонолитно-каркасная служба"
    assert a["chunks", 2] == ([], None) and a["chunks", 3][1] == "а | б\nв | г"
    assert a["ocr_pages", 2][1] == "Резервный насос 2 показан строка 2"


def test_ties_fall_by_the_word_before_both_ways(spark, monkeypatch):
    clean = ["Стальная балка показана.", "Стеклянная банка показана.", "Стеклянная банка балка показана."]
    read = ["Стальная бапка", "Стеклянная бапка", "Стеклянная бапка бапка", "Другая бапка", "Сталь\u00ad\nная бапка"]
    chunks = [(100 + i, clean[i % 3]) for i in range(300)] + list(enumerate(read))
    f = frames(spark, [], chunks, [(9, "Стеклянная бапка")])
    get = lambda df: {(r.src, r.row_id): (r.noise, r.repaired) for r in df.collect()}
    small = get(S.repaired(*f))
    assert [small["chunks", i][1] for i in range(3)] == ["Стальная балка", "Стеклянная банка", "Стеклянная банка балка"]
    assert small["chunks", 4][1] == "Стальная балка" and small["rule_observations", 9][1] == "Стеклянная банка"
    assert get(S.repaired(*f, max_entries=0)) == small
    by_join, calls = S._repair_by_join, []
    monkeypatch.setattr(S, "_repair_by_join", lambda *a: calls.append(1) or by_join(*a))
    lex = S.lexicon(S.scan_sources(*f))
    assert S.corrections(lex).count() + S.compounds(lex).count() <= 2  # it is the three bigrams that are too many for 2
    assert get(S.repaired(*f, max_entries=3)) == small and not calls
    assert get(S.repaired(*f, max_entries=2)) == small and calls


def test_empty(spark):
    assert S.repaired(*frames(spark)).count() == 0


def test_clean_text_is_left_alone(spark, data):
    o = spark.read.parquet(f"{data}/rule_observations.parquet")
    empty = spark.read.parquet(f"{data}/ocr_pages.parquet"), spark.read.parquet(f"{data}/chunks.parquet")
    done = S.repaired(*empty, o).filter("src = 'rule_observations'").join(o.select(F.col("observation_id").alias("row_id"), "context"), "row_id")
    assert done.filter(~F.col("context").contains("\n") & F.array_contains("noise", "hyphen")).count() == 0
    flagged = done.filter(~F.col("context").contains("\n") & F.array_contains("noise", "misread")).count()
    assert flagged <= 0.01 * done.count()


def test_long_and_many_lines(spark):
    text = "\n".join(f"строка номер {i}" for i in range(5000))
    assert S.page_marks(text, "any") == []
    assert len(S.outer_lines(text)) == 4
    assert S.join_lines("") == ""
