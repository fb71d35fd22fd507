import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from dossia.functions import text as T
from dossia.operators import compare as C
from dossia.operators import graphs, layout, state, vectors
from dossia.sources import files, outputs
from dossia.streaming import events as S


@pytest.mark.parametrize(
    "kind, pct, op, threshold, expected, later, unit, outcome",
    [
        ("DECREASE", 0.0, None, None, 10.0, 9.0, True, "FIRES"),
        ("DECREASE", 20.0, None, None, 10.0, 9.0, True, "NOT_FIRING"),
        ("DECREASE", None, None, None, 10.0, 11.0, True, "NOT_FIRING"),
        ("INCREASE", 0.0, None, None, 10.0, 10.005, True, "NOT_FIRING"),
        ("ANY_CHANGE_PCT", 5.0, None, None, 10.0, 10.4, True, "NOT_FIRING"),
        ("ANY_CHANGE_PCT", 5.0, None, None, 0.0, 10.4, True, "FIRES"),
        ("ABS_THRESHOLD", None, ">", 5.0, 1.0, 6.0, True, "FIRES"),
        ("ABS_THRESHOLD", None, ">", 5.0, 1.0, 6.0, False, "UNDETERMINED"),
        ("ABS_THRESHOLD", None, ">", 5.0, 1.0, 6000.0, True, "UNDETERMINED"),
        ("PRESENCE", None, None, None, 3.0, 0.0, True, "FIRES"),
        ("COUNT_CHANGE", None, None, None, 3.0, 3.0, True, "NOT_FIRING"),
        ("ENUM_DOWNGRADE", None, None, None, 3.0, 3.0, True, "UNDETERMINED"),
        ("DECREASE", None, None, None, None, 3.0, True, "UNDETERMINED"),
        (None, None, None, None, 1.0, 3.0, True, "NOT_EVALUABLE"),
    ],
)
def test_trigger(spark, kind, pct, op, threshold, expected, later, unit, outcome):
    df = spark.createDataFrame([(kind, pct, op, threshold, expected, later, unit)], "kind string, pct double, op string, threshold double, e double, l double, u boolean")
    out = df.select(C.trigger_numeric(*[F.col(c) for c in ("kind", "pct", "op", "threshold", "e", "l", "u")]).alias("x")).first().x
    assert out == outcome


def test_printed_precision(spark):
    df = spark.createDataFrame([(["12.5"], ["12.54"]), (["12.5"], ["12.7"]), (["1", "9.00"], ["8.99"]), ([], ["1"])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(C.printed_precision_differs(F.col("a"), F.col("b")).alias("x")).collect()] == [False, True, False, True]


def test_components_match_union_find(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(100)] + [(7, None)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    want = {x: min(y for y in list(parent) if find(y) == find(x)) for x in list(parent)}
    assert got == want


def test_matching(spark):
    e = spark.createDataFrame([("g", 1, 10), ("g", 1, 11), ("g", 2, 10), ("g", 3, 10), ("h", 1, 1)], "g string, l long, r long")
    assert {tuple(r) for r in graphs.max_matching(e, "g", "l", "r").collect()} == {("g", 2), ("h", 1)}


def test_nearest(spark):
    random.seed(2)
    left = [(i % 3, i, round(random.random() * 100, 2)) for i in range(60)]
    right = [(i % 3, i, round(random.random() * 100, 2)) for i in range(90)]
    l, r = spark.createDataFrame(left, "b long, l long, v double"), spark.createDataFrame(right, "b long, r long, v double")
    got = {x.l: (x.distance, x.r) for x in graphs.nearest(l, r, "b", "v", "l", "r").collect()}
    want = {i: min((round(abs(v - w), 6), j) for c, j, w in right if c == b) for b, i, v in left}
    assert got == want


def test_replay(spark):
    rows = [("k", 1, "ADD", 1), ("k", 2, "REFINE", 2), ("k", 3, "REMOVE", None), ("k", 4, "RESTORE", None), ("m", 1, "ADD", 5), ("m", 2, "REMOVE", None)]
    got = {r.k: (r.value, r.alive, r.n_edits) for r in state.replay(spark.createDataFrame(rows, "k string, o long, a string, v long"), ["k"], ["o"], "a", "v").collect()}
    assert got == {"k": (2, True, 4), "m": (5, False, 2)}


def test_rows_against_first_word(spark):
    words = [("p", i, 0.0, y) for i, y in enumerate([10.0, 12.0, 13.4, 14.0, 30.0, 33.6])]
    got = {r.word_no: r.row_no for r in layout.cluster_rows(spark.createDataFrame(words, "page string, word_no long, x0 double, y0 double"), "page").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3}


def test_cells(spark):
    words = [(1, i, float(x), float(x + 10)) for i, x in enumerate([0, 15, 40, 52, 80])]
    got = {r.word_no: r.cell_no for r in layout.cluster_cells(spark.createDataFrame(words, "row long, word_no long, x0 double, x1 double"), ["row"]).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_anchor_and_numbers():
    w = "площадь общая этажа 1 площадь этажа равна 17 140,2 м2".split()
    assert layout.find_anchor(w, ["площадь", "этажа"]) == (4, 5)
    assert layout.numbers_after(w, 5) == [17140.2]
    assert layout.find_anchor(w, ["нет"]) is None and layout.find_anchor(w, []) is None


def test_alignment():
    assert layout.longest_alignment(list("abcd"), list("acxd")) == [(0, 0), (2, 1), (3, 3)]


def test_vectors_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.nearest_vectors(df.repartition(5), df.filter("vec_id % 50 = 0 and embedding is not null"), 3).collect()}
    f = np.array([np.float32(x) for x in v], dtype=np.float64)
    n = f / np.linalg.norm(f, axis=1, keepdims=True)
    for q in range(0, 200, 50):
        s = n @ n[q]
        s[q] = -9
        assert [got[q, k] for k in (1, 2, 3)] == list(np.argsort(-s)[:3])


def test_text_functions(spark):
    df = spark.createDataFrame([("Ёлка – дом  12-а",)], "t string")
    r = df.select(T.search_text(F.col("t")).alias("s"), T.tokens(F.col("t")).alias("k"), T.stem(F.lit("вентиляционный")).alias("m"), T.key_form(F.lit("Ст.01,012-003")).alias("f"), T.ngrams(F.array(*map(F.lit, "abc"))).alias("g")).first()
    assert r.s == "елка - дом 12-а" and r.k == ["елка", "дом", "12-а"] and r.m == "вентиляционн" and r.f == "1.12-3" and r.g == ["a b c", "a b", "b c"]


@pytest.mark.parametrize("text, day", [("2024-05-31", "2024-05-31"), ("31.05.2024", "2024-05-31"), ("31/05/24", "2024-05-31"), ("45443", "2024-05-31"), ("31.02.2024", None), ("скоро", None), (None, None)])
def test_dates(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(T.any_date(F.col("t")).alias("d")).first().d
    assert (str(got) if got else None) == day


def xlsx(rows):
    out = io.BytesIO()
    shared = sorted({c for r in rows for c in r})
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{c}</t></si>" for c in shared) + "</sst>")
        body = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="s"><v>{shared.index(c)}</v></c>' for j, c in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_registries(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffШифр;Статус;Дата;Прочее\n1-АР;Согласовано;31.05.2024;x\n".encode())
    (tmp_path / "b.csv").write_bytes("Шифр\tСтадия\n2-КЖ\tПД\n".encode("cp1251"))
    (tmp_path / "c.json").write_text(json.dumps({"object_id": "O", "files": [{"file_name": "f.pdf", "revision": 2}]}))
    (tmp_path / "d.xlsx").write_bytes(xlsx([["Шифр", "Статус"], ["3-ОВ", "DRAFT"]]))
    rows = files.normalize_registry(files.read_registry(spark, str(tmp_path))).collect()
    by = {r.file[-5:]: r for r in rows}
    assert by["a.csv"].document_code == "1-АР" and by["a.csv"].is_approved and str(by["a.csv"].approved_on) == "2024-05-31" and by["a.csv"].unknown_columns == ["Прочее"]
    assert by["b.csv"].stage == "pd" and by["b.csv"].document_code == "2-КЖ"
    assert by["c.jso" if "c.jso" in by else ".json"].object_id == "O"
    assert by[".xlsx"].document_code == "3-ОВ" and not by[".xlsx"].is_approved


def test_packages(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("x")
    (tmp_path / "in" / "sub" / "b.PDF").write_text("y")
    (tmp_path / "in" / "sub" / "Thumbs.db").write_text("z")
    got = {r.relative_path: (r.extension, r.reason) for r in files.scan_package(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.txt": ("txt", None), "sub/b.PDF": ("pdf", None), "sub/Thumbs.db": ("db", "service_file")}
    z = tmp_path / "p.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("ok.txt", "1")
        f.writestr("../evil.txt", "1")
        f.writestr("OK.txt", "2")
        f.writestr("__MACOSX/x", "1")
    got = {r.member: r.reason for r in files.scan_zip(spark, str(z)).collect()}
    assert got == {"ok.txt": None, "../evil.txt": "unsafe_path", "OK.txt": "duplicate_name", "__MACOSX/x": "service_file"}


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([("o", "b", 2), ("o", "a", 1)], "g string, code string, n long")
    assert json.loads(outputs.nested_submission(df, "g", ["code", "n"]).first().checks) == [{"code": "a", "n": 1}, {"code": "b", "n": 2}]
    outputs.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("sep", ";").option("header", "true").csv(str(tmp_path / "c")).count() == 2
    outputs.write_xml(df, str(tmp_path / "x"), "check", "checks")
    assert spark.read.option("rowTag", "check").xml(str(tmp_path / "x")).count() == 2
    outputs.write_partitioned(df, str(tmp_path / "p"), ["g"], ["code"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_retries_stream_equals_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").filter("event_type in ('error', 'purchase')").select("user_id", "ts", (F.col("event_type") == "error").alias("bad"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = []
    q = S.attempts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "bad").writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.user_id: (r.n_attempts, r.n_failed, r.status) for r in out}
    want = {r.user_id: (r.n_attempts, r.n_failed, r.status) for r in S.attempts_batch(e, "user_id", "ts", "bad").collect()}
    assert got == want


def test_keyed_compare_drops_repeated_keys(spark):
    a = spark.createDataFrame([("k", 1.0), ("d", 1.0), ("d", 2.0), ("n", None)], "key string, v double")
    b = spark.createDataFrame([("k", 1.005), ("d", 1.0), ("n", 1.0), ("x", 1.0)], "key string, v double")
    assert {r.key: r.status for r in C.keyed_compare(a, b, ["key"], "v").collect()} == {"k": "equal", "d": "only_right", "n": "unknown", "x": "only_right"}


def test_medians_of_hot_groups(spark):
    import statistics as st

    from dossia.operators.statistics import medians

    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 40}", float(rng.randint(0, 50)) if i % 13 else None, i) for i in range(2000)] + [("one", 5.0, 1), ("none", None, 1)]
    got = {r.k: (r.n, r.m) for r in medians(spark.createDataFrame(rows, "k string, v double, n long"), ["k"], "v", "m").collect()}
    own = {}
    for k, v, _ in rows:
        if v is not None:
            own.setdefault(k, []).append(v)
    assert got == {k: (len(v), st.median(v)) for k, v in own.items()}
