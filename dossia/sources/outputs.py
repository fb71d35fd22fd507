"""Writing results: nested JSON, CSV with marks, XML."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossia.session import materialize


def nested_submission(findings: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """by, n_checks, checks: one JSON text a group, its checks in the order of their columns."""
    return findings.groupBy(by).agg(F.count("*").alias("n_checks"), F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("checks"))


def nested_submission_parts(findings: DataFrame, by: str, columns: list[str], part_rows: int = 1000) -> DataFrame:
    """by, part, n_checks, checks: the same in ordered parts of at most part_rows checks, none of which holds a hot group.

    Rows are numbered within their group by range partitions and the counts of the partitions before, so that no task
    sorts a whole group; the columns must order the rows of a group fully, else equal rows may change places.
    """
    # written once: the partitions of a second evaluation might have other borders
    cut = materialize(findings.select(by, *columns).repartitionByRange(by, *columns).withColumn("_p", F.spark_partition_id()))
    order = [F.col(c).asc_nulls_first() for c in columns]
    counts = cut.groupBy(by, "_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(by).alias("_by"), F.col("_p").alias("_q"), before.alias("_before"))
    rows = cut.withColumn("_i", F.row_number().over(Window.partitionBy(by, "_p").orderBy(*order)) - 1)
    rows = rows.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_q")))
    rows = rows.withColumn("part", F.floor((F.col("_before") + F.col("_i")) / part_rows).cast("long"))
    return rows.groupBy(by, "part").agg(F.count("*").alias("n_checks"), F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("checks"))


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with ; between fields and a header in every file; with mark, the mark of UTF-8 that spreadsheets look for stands before it."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("sep", ";").option("header", "true").csv(path)


def workbook(sheets: dict[str, list[list[str]]], first: str) -> bytes:
    """An XLSX file of small sheets of text, `first` the one that stands first in it."""
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for i, rows in enumerate(sheets.values(), 1):
            cells = ["".join(f'<c t="inlineStr" r="{column_name(c)}{r}"><is><t>{escape(x)}</t></is></c>' for c, x in enumerate(row)) for r, row in enumerate(rows, 1)]
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{r}">{x}</row>' for r, x in enumerate(cells, 1)) + "</sheetData></worksheet>")
        order = sorted(enumerate(sheets, 1), key=lambda x: x[1] != first)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rels}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in order) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rels}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
    return buffer.getvalue()


def column_name(i: int) -> str:
    """A, B, ... Z, AA for columns 0, 1, ..."""
    name = ""
    while i >= 0:
        name = chr(65 + i % 26) + name
        i = i // 26 - 1
    return name


def write_xml(df: DataFrame, path: str, row: str = "row", root: str = "rows") -> None:
    df.write.mode("overwrite").option("rowTag", row).option("rootTag", root).xml(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """Parquet by partition columns; a hot partition value is spread over files by the order columns."""
    df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).write.mode("overwrite").partitionBy(*by).parquet(path)
