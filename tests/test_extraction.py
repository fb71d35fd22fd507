import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from dossia.operators import chunking as C
from dossia.operators import layout
from dossia.operators.extractors import Registry
from dossia.operators.ordered import running_by
from dossia.sources import files, outputs, steps


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="абв .!\n\r\t", max_size=600), st.integers(20, 120))
def test_chunks_hold_every_word_in_order(text, size):
    out = C.chunk_text(text, size, 0, 1)
    assert "".join(" ".join(out).split()) == "".join(text.split())
    assert all(0 < len(c) <= size for c in out)


def test_chunks():
    a, b = "а" * 900, "б" * 900
    assert [len(x) for x in C.chunk_text(f"{a}\n\n\n{b}")] == [900, 220 + 2 + 900]
    assert C.chunk_text("длинный\n\n" + "ж" * 1400 + "\n\nкороткий")[-1].endswith("\n\nкороткий")
    table = C.chunk_text("[TABLE 1]\n" + "\n".join(f"строка {i} | {i}" for i in range(300)))
    assert len(table) > 2 and all(x.startswith("[TABLE 1]\n") and len(x) <= 1400 for x in table)
    assert C.chunk_text("") == C.chunk_text(" \n\t") == []
    assert "".join(C.chunk_text("x" * 5000, 1400, 0)) == "x" * 5000 or len(C.chunk_text("x" * 5000, 1400, 0)) == 4


def test_chunks_of_rows(spark):
    df = spark.createDataFrame([(1, "раз. " * 600, 0), (1, "раз. " * 600, 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, chunk_no int")
    got = C.chunks(df, "doc_id", "text").collect()
    assert {r.doc_id for r in got} == {1} and [r.chunk_no for r in got][:2] == [0, 1]


def test_tightest_anchor():
    def brute(words, anchor, most):
        hits = []

        def walk(first, at, rest):
            if not rest:
                hits.append((first, at))
                return
            for j in range(at + 1, min(len(words), at + most + 2)):
                if words[j] == rest[0]:
                    walk(first, j, rest[1:])

        for i, w in enumerate(words):
            if w == anchor[0]:
                walk(i, i, anchor[1:])
        return min(hits, key=lambda x: (x[1] - x[0], x), default=None)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), min_size=1, max_size=4))
    def check(words, anchor):
        assert layout.find_anchor(words, anchor) == brute(words, anchor, layout.ANCHOR_GAP)

    check()


def test_numbers_after_are_those_of_the_text(spark, data):
    got = {}
    for r in entry.queries()["str07_numbers_after"](spark, data).collect():
        got.setdefault(r.chunk_id, []).append((r.no, r.value))
    texts = {r.chunk_id: r.text for r in spark.read.parquet(f"{data}/chunks.parquet").collect() if r.text}
    assert got
    for k, rows in got.items():
        there = [float(x.replace(",", ".")) for x in re.findall(r"\d+(?:[.,]\d+)?", texts[k])]
        assert [n for n, _ in sorted(rows)] == list(range(len(rows))) and all(v in there or v >= 1000 for _, v in rows)


def test_registry_of_extractors(spark):
    r = Registry()
    r.pattern("numbers", r"(\d+)")
    r.add("bad", lambda t: 1 / 0)
    with pytest.raises(ValueError):
        r.pattern("bad", "x")
    df = spark.createDataFrame([(1, "a 5 b 17"), (2, None)], "k long, t string")
    got = {tuple(x) for x in r.run(df, "k", "t").collect()}
    assert got == {(1, "numbers", 2, "5", None), (1, "numbers", 6, "17", None), (1, "bad", None, None, "ZeroDivisionError: division by zero")}


def test_running_sums(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 31)).alias("k"), F.xxhash64("id").alias("o"), F.when(F.col("id") % 11 != 0, F.col("id") % 100).alias("v"), F.lit("x").alias("run"))
    want = {r.o: r.s for r in df.select("o", F.coalesce(F.sum("v").over(Window.partitionBy("k").orderBy("o")), F.lit(0)).alias("s")).collect()}
    assert {r.o: r.s for r in running_by(df, ["k"], ["o"], F.col("v"), "s").collect()} == want


def test_steps(spark, tmp_path):
    text = """ISO-10303-21;
HEADER;FILE_NAME('a','b');ENDSEC;DATA;
#1=IFCBUILDINGSTOREY('L1',$,'x',$);
#2= IFCWALL('G1',$,'It''s (a) wall, \\X2\\0421\\X0\\',$,$,$,$,$);
#3=IFCRELCONTAINEDINSPATIALSTRUCTURE('C',$,$,$,(#2,#9),#1);
#4=IFCPROPERTYSINGLEVALUE('Fire',$,IFCLABEL('REI 60'),$);
#5=IFCPROPERTYSINGLEVALUE('Ext',$,IFCBOOLEAN(.T.),$);
#6=IFCPROPERTYSET('S',$,'Pset',$,(#4,#5));
#7=IFCRELDEFINESBYPROPERTIES('R',$,$,$,(#2,#9),#6);
#8=IFCFURNITURE('N',$,'no element',$);
#9=IFCDOOR('G2',$,$,$,$,$,$,$);
#10=IFCQUANTITYAREA('GrossArea',$,$,5.);#11=IFCQUANTITYAREA('NetArea',$,$,4.);
#12=IFCELEMENTQUANTITY('Q',$,'Qto',$,$,(#10,#11));#13=IFCRELDEFINESBYPROPERTIES('R',$,$,$,(#9),#12);
ENDSEC;END-ISO-10303-21;
"""
    (tmp_path / "m.ifc").write_text(text, encoding="utf-8")
    s = steps.read_step(spark, f"file://{tmp_path}/m.ifc")
    e = {r.guid: r for r in steps.elements(s).collect()}
    assert set(e) == {"G1", "G2"} and e["G1"].name == "It's (a) wall, С" and e["G1"].storey_guid == "L1" and e["G2"].name is None
    assert {(r.id, r.pset, r.name, r.value_text, r.value_bool) for r in steps.properties(s).collect()} == {(i, "Pset", *v) for i in (2, 9) for v in (("Fire", "REI 60", None), ("Ext", ".T.", True))}
    assert [(r.id, r.area, r.volume) for r in steps.metrics(steps.quantities(s)).collect()] == [(9, 5.0, None)]


def test_registries_of_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"object_id": "O1", "documents": [{"file_id": "1", "object_id": null}, 5, {"file_id": 2}]}', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"file_id": "3"}\n\nbroken\n{"files": [{"file_id": "4"}], "stage": "PD"}\n', encoding="utf-8")
    (tmp_path / "c.json").write_text('[{"file_id": "5", "x": [1]}]', encoding="utf-8")
    got = {r.fields["file_id"]: (r.fields.get("object_id"), r.fields.get("doc_stage"), r.unknown.get("x")) for r in files.read_registry(spark, f"file://{tmp_path}/*.json").collect()}
    assert got == {"1": (None, None, None), "2": ("O1", None, None), "3": (None, None, None), "4": (None, "PD", None), "5": (None, None, "[1]")}


def test_columns_of_a_workbook():
    assert [outputs.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
