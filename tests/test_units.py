import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dossia.operators import units as U

P = U.QuantityParser()


@pytest.mark.parametrize(
    "text, number, unit",
    [
        ("5,6115×10⁴ кг", 56115.0, "кг"),
        ("(кг) 9,8445·10³", 9844.5, "кг"),
        ("1.37e+02", 137.0, ""),
        ("≈ \uff13 569,4 м3/сут", 3569.4, "м3/сут"),
        ("не менее 357 ‰", 357.0, "‰"),
        ("1\u200d\u3000897", 1897.0, ""),
        ("шт.: 682", 682.0, "шт"),
        ("1'238", 1238.0, ""),
        ("6878ккал/ч", 6878.0, "ккал/ч"),
        ("кΒт: 5", 5.0, "квт"),
        ("—", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_quantity(text, number, unit):
    assert P.quantity(text) == (number, unit)


@pytest.mark.parametrize(
    "text, number, unit",
    [
        ("(м3) 10044", 10044.0, "м3"),
        ("м2: 80,11", 80.11, "м2"),
        ("м3/ч: 46,51", 46.51, "м3/ч"),
        ("тыс. м3/ч: 1,904", 1904.0 / 1000, "тысм3/ч"),
        ("м2 100", 100.0, "м2"),
        ("(м2) -1,565·10³", -1565.0, "м2"),
        ("кгс/см2: 2.904", 2.904, "кгс/см2"),
        ("7,5 м3", 7.5, "м3"),
        ("м²5", 5.0, "м2"),
        ("шт5", 5.0, "шт"),
        ("м3", None, None),
    ],
)
def test_units_that_end_in_a_digit_before_the_number(text, number, unit):
    assert P.quantity(text) == (number, unit)


def test_words_with_numbers_are_no_units():
    assert P.quantity("см. лист 90")[1] not in P.keys
    assert P.quantity("см. п. 9")[1] not in P.keys


@pytest.mark.parametrize(
    "context, value, unit",
    [
        ("Ширина (щит) 4 в осях 2 и 9 (мин.): 200,82", 200.82, "мин"),
        ("Ширина (щит) 4, ккал/ч: 3,077·10⁴", 30770.0, "ккал/ч"),
        ("Ширина (щит) 4, куб. м: 1,754·10³", 1754.0, "кубм"),
        ("Ширина (щит) 4 составляет 4 692,1 м3/ч", 4692.1, "м3/ч"),
        ("Ширина (щит) 4 составляет 4\n692,1 милли-\nметров", 4692.1, "миллиметров"),
        ("Другое 4, см: 77", 77.0, None),
        ("в количестве 136 штук", 77.0, None),
        (None, 77.0, None),
    ],
)
def test_context(context, value, unit):
    assert P.context(context, "Ширина (щит) 4", value) == unit


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_is_read(text):
    number, unit = P.quantity(text)
    assert (number is None) == (unit is None) or unit is not None


def test_estimates_find_scale_and_snap():
    random.seed(1)
    graph = U.conversion_graph([("см", "мм", 50, 10.001, 10.0, 0.0), ("xx", "мм", 20, 24.02, 24.0, 0.0), ("yy", "xx", 9, 7.7, 7.7, 0.0)])
    to = U.propagate(graph, "мм")
    assert to["см"][0] == 10.0
    assert abs(to["xx"][0] - 24.0) < 1e-12
    assert abs(to["yy"][0] - 24.0 * 7.7) < 1e-9
    assert to["км"][0] == 1e6


def test_estimates_are_robust(spark):
    rows = [("a", "b", float(i), i * 3.6 * (1000 if i % 10 == 0 else 1)) for i in range(1, 101)]
    (est,) = U.estimate_links(spark.createDataFrame(rows, "source_a string, source_b string, a double, b double"))
    assert abs(est[3] - 3.6) < 1e-9 and est[2] == 100


OBS = "observation_id long, parameter_code string, value string, normalized_value string, context string, extra string"
PAR = "code string, unit string, parameter_name string"
RUL = "code string, kind string, op string, threshold double, threshold_unit string"


def found(spark, obs, par=None, rul=None):
    o = spark.createDataFrame(obs, OBS)
    p = spark.createDataFrame(par if par is not None else [("A", "мм", "Ширина"), ("K", "класс", "Класс")], PAR)
    r = spark.createDataFrame(rul if rul is not None else [("A", "ABS_THRESHOLD", ">=", 1.0, "м")], RUL)
    return {tuple(x) for x in U.unit_findings(o, p, r).collect()}


def test_found(spark):
    got = found(
        spark,
        [
            (1, "A", "100 см", "1000", None, None),
            (2, "A", "99 см", "99", None, None),
            (2, "A", "99 см", "99", None, None),
            (3, "A", "150", "1500", "Ширина, см: 150", None),
            (4, "A", "150", "1500", None, None),
            (5, "A", None, "5", None, None),
            (6, "A", "не указано", None, None, None),
            (7, "K", "В25", "25", None, None),
            (8, None, "5 м", "5", None, None),
            (9, "A", "5 кг", "5", None, None),
            (10, "A", "1000,5", "0.9995 м", None, None),
        ],
    )
    assert got == {(1, "threshold"), (2, "normalized"), (3, "threshold"), (4, "normalized"), (10, "threshold")}


def test_spellings_outside_the_table_are_converted_by_their_links(spark):
    par = [("A", "мм", "Ширина"), ("B", "м3", "Объём"), ("S", "сажень", "Глубина"), ("K", "класс", "Класс")]
    rul = [("A", "ABS_THRESHOLD", ">=", 1.0, "м")]
    obs = [(i, "A", f"{i} дюйм", str(25.4 * i), None, None) for i in range(1, 31)]  # scale
    obs += [(50, "A", "50 дюйм", "50", None, None)]  # normalized, and over a metre
    obs += [(100 + i, "A", f"{i} отметка", str(2 * i + 300), None, None) for i in range(10, 30)]  # scale and offset
    obs += [(140, "A", "500 отметка", "500", None, None)]
    obs += [(200 + i, c, f"см. лист {i}", str(7 * i * i % 90), None, None) for i in range(1, 40) for c in "AB"]  # no unit: nothing agrees
    obs += [(300 + i, c, f"{i} поз", str(i), None, None) for i in range(1, 40) for c in "AB"]  # no unit: of two dimensions
    obs += [(400 + i, "S", f"{i} м", str(i / 2.1336), None, None) for i in range(1, 9)] + [(450, "S", "2", "7", None, None), (451, "S", "2,1336 м", "5", None, None)]
    obs += [(500 + i, "K", f"В{i}", "7", None, None) for i in range(10, 20)]
    got = found(spark, obs, par, rul)
    assert got == {(50, "normalized"), (50, "threshold"), (140, "normalized"), (140, "threshold"), (450, "normalized"), (451, "normalized")}
    o, p = spark.createDataFrame(obs, OBS), spark.createDataFrame(par, PAR)
    std = {r.observation_id: r.value_std for r in U.to_parameter_units(o, p)[0].collect()}
    assert abs(std[10] - 254.0) < 1e-6 and abs(std[120] - 340.0) < 1e-6 and abs(std[402] - 2 / 2.1336) < 1e-6
    assert not [k for k in std if 200 < k < 400 or k >= 500]
    assert U.readings(o, p).count() == 0


def test_empty_tables(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, "A", "1 м", "1", None, None)], par=[]) == set()
    assert found(spark, [(1, "A", "1 м", "1 м", None, None)], rul=[]) == set()


def test_conversions_come_back_from_links_without_the_table(spark, data, monkeypatch):
    """With one spelling a dimension left in the table, all others are converted by their links."""
    import os

    folder = os.path.join(os.path.dirname(data), "sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("the links of the smallest tables are too few")
    o, p = spark.read.parquet(f"{folder}/rule_observations.parquet"), spark.read.parquet(f"{folder}/matrix_params.parquet")
    full = {r.observation_id: r.value_std for r in U.to_parameter_units(o, p)[0].collect() if r.value_std is not None}
    monkeypatch.setattr(U, "KNOWN_UNITS", {d: {next(iter(g)): 1} for d, g in U.KNOWN_UNITS.items()})
    cut = {r.observation_id: r.value_std for r in U.to_parameter_units(o, p)[0].collect() if r.value_std is not None}
    same = sum(k in cut and abs(cut[k] - v) <= 1e-3 * abs(v) + 1e-9 for k, v in full.items())
    assert same >= 0.99 * len(full) and len(cut) >= 0.99 * len(full)
