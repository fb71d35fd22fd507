"""Tables in texts: a title line `[TABLE n] title`, a line of headings, lines of cells parted by bars.

Read with expressions over the scan, without a shuffle.  Defined results: a row with fewer cells than
headings has nulls, cells beyond the headings are left out; a table without rows gives none; headings are
known whatever characters they are made of, one that is none of the known ones has no role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.functions.chars import fold_looks, plain

# Headings and the role of their column.
ROLES = {"поз.": "key", "поз": "key", "№": "key", "номер": "key", "наименование": "name", "кол.": "quantity", "количество": "quantity", "площадь": "area", "примечание": "note"}

_TABLE = r"\[TABLE \d+\][^\n]*\n(?:[^\n]*\|[^\n]*(?:\n|$))+"


def cells(line: Column) -> Column:
    return F.transform(F.split(line, r"\|"), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def tables(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, table_no, title, headings, lines: the tables of each text."""
    plain = F.replace(F.col(text), F.lit("\r"), F.lit(""))
    t = texts.filter(F.col(text).contains("[TABLE ")).select(key, F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(_TABLE), F.lit(0)))).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x != "")
    t = t.select(key, F.regexp_extract("t", r"^\[TABLE (\d+)\]", 1).cast("int").alias("table_no"), F.trim(F.regexp_extract("t", r"^\[TABLE \d+\]([^\n]*)", 1)).alias("title"), lines.alias("lines"))
    return t.select(key, "table_no", "title", cells(F.get("lines", F.lit(1))).alias("headings"), F.slice("lines", 3, 1 << 20).alias("lines"))


def rows(table: DataFrame, key: str) -> DataFrame:
    """key, table_no, title, row_no, and a column for each role."""
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    r = table.select(key, "table_no", "title", F.transform("headings", lambda h: known[fold_looks(plain(h))]).alias("roles"), F.posexplode("lines").alias("row_no", "line")).withColumn("cells", cells(F.col("line")))
    role = lambda name: F.get("cells", F.when(F.array_position("roles", name) > 0, F.array_position("roles", name).cast("int") - 1))
    return r.select(key, "table_no", "title", "row_no", *[F.nullif(role(x), F.lit("")).alias(x) for x in ("key", "name", "quantity", "area", "note")])
