import unicodedata

import __spark_entry__ as entry
from dossia.functions.chars import plain_py


def test_all_contexts_are_normalized(spark, tmp_path):
    texts = ["Ширина\u00a0\u2009 В\u202f25", "нас\u200bос \uff21\uff13", "е\u0308лка и\u0306", "10⁴ м² № 5", "Ёж – кот\u2028\u2011 x", "Обычный  текст", "", None]
    rows = [(i, t, f"2024-01-0{1 + i % 9}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "observation_id long, context string, ingested_at string").write.parquet(f"{tmp_path}/rule_observations.parquet")
    dash = str.maketrans("ё–—‑", "е---")
    want = {i: " ".join(unicodedata.normalize("NFC", plain_py(t)).lower().translate(dash).split()) for i, t in enumerate(texts) if t is not None}
    got = {r.observation_id: r.body for r in entry.queries()["str01_normalize"](spark, str(tmp_path)).collect()}
    assert got == want
    assert got[0] == "ширина в 25" and got[1] == "насос a3" and got[2] == "елка й"


def test_every_context_has_its_row(spark, data):
    want = spark.read.parquet(f"{data}/rule_observations.parquet").filter("context is not null").select("observation_id").distinct().count()
    assert entry.queries()["str01_normalize"](spark, data).count() == want


def test_reading_errors(spark):
    from dossia.operators.statistics import reading_errors

    rows = [("A", "насос В25", "нас0с В25"), ("A", "a b", ""), ("B", "", "x"), ("B", "№ 5 м²", "№ 5 м²"), ("C", "😀б", "😀в")]
    got = {r.k: (r.edits, r.chars, r.word_edits, r.words) for r in reading_errors(spark.createDataFrame(rows, "k string, reference string, read string"), "k", "reference", "read").collect()}
    assert got == {"A": (4, 12, 3, 4), "B": (1, 6, 1, 3), "C": (1, 2, 1, 1)}
