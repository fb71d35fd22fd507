"""Queries of file readers and writers and of building models, with their SQL: tables are written out in each form and read back."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.operators.units import few
from dossia.plans.relational import V, versions
from dossia.session import shared_dir, table
from dossia.sources import files, outputs, steps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/dossia-{uuid.uuid4().hex}-{name}"


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One file, through the file system of the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(content))
    out.close()


REGISTRY = "select dataset_file_id as file_id, object_id, doc_stage, document_code, approval_status from {v} where dataset_file_id is not null"


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).filter("dataset_file_id is not null").select(F.col("dataset_file_id").alias("file_id"), "object_id", "doc_stage", "document_code", "approval_status")


def _fields(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.nullif(F.col("fields")[c], F.lit("")).alias(c) for c in ("file_id", "object_id", "doc_stage", "document_code", "approval_status")])


@query("select n_nationkey::int as key, length(n_name) + 1 as size_bytes, sha256(n_name || chr(10)) as sha256, 'txt' as extension from nation")
def src01_package(spark, d):
    """A folder of files: one text file a nation, in folders below it."""
    folder = fresh(spark, "package")
    table(spark, d, "nation").select("n_nationkey", "n_name").repartition("n_nationkey").write.partitionBy("n_nationkey").text(folder)
    p = files.scan_package(spark, folder).filter(F.col("reason").isNull() & (F.col("extension") == "txt"))
    return p.select(F.regexp_extract("relative_path", r"n_nationkey=(\d+)/", 1).cast("int").alias("key"), "size_bytes", "sha256", "extension")


@query("select code || '.txt' as member, strlen(parameter_name) as size_bytes, sha256(parameter_name) as sha256, null::varchar as reason from matrix_params union all select '../evil.txt', 1, null, 'unsafe_path'")
def src02_zip(spark, d):
    """Members of an archive, a member that leaves its folder refused."""
    rows = few(table(spark, d, "matrix_params").select(F.struct("code", "parameter_name")), 10_000)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for r in rows:
            z.writestr(f"{r.code}.txt", r.parameter_name)
        z.writestr("../evil.txt", "x")
    path = f"{fresh(spark, 'zip')}/package.zip"
    put(spark, path, buffer.getvalue())
    return files.scan_zip(spark, path).select("member", "size_bytes", "sha256", "reason")


@query(REGISTRY.format(v=V))
def src03_registry_csv(spark, d):
    """A registry as CSV files with ; and Russian headings."""
    folder = fresh(spark, "csv")
    names = {"file_id": "ID файла", "object_id": "Код объекта", "doc_stage": "Стадия", "document_code": "Шифр", "approval_status": "Статус"}
    outputs.write_csv(_registry(spark, d).withColumnsRenamed(names), folder)
    return _fields(files.read_registry(spark, f"{folder}/*.csv"))


@query("select code as document_code, parameter_name as file_name from matrix_params")
def src04_registry_xlsx(spark, d):
    """A registry as a workbook; the sheet that stands first in it is not the first by file name."""
    rows = few(table(spark, d, "matrix_params").select(F.struct("code", "parameter_name")), 10_000)
    path = f"{fresh(spark, 'xlsx')}/registry.xlsx"
    put(spark, path, outputs.workbook({"Пояснения": [["нет"]], "Реестр": [["Шифр", "Имя файла"], *[[r.code, r.parameter_name] for r in rows]]}, first="Реестр"))
    f = F.col("fields")
    return files.read_registry(spark, path).select(f["document_code"].alias("document_code"), f["file_name"].alias("file_name"))


@query(REGISTRY.format(v=V))
def src05_registry_json(spark, d):
    """A registry as JSON lines."""
    folder = fresh(spark, "json")
    _registry(spark, d).write.json(folder)
    return _fields(files.read_registry(spark, f"{folder}/*.json"))


@query(f"select id, object_id, document_code from {V}")
def snk04_csv(spark, d):
    """CSV with a mark of UTF-8 before the headings, as spreadsheets want it, read back."""
    folder = fresh(spark, "csv")
    outputs.write_csv(versions(spark, d).select("id", "object_id", "document_code"), folder, mark=True)
    r = files.read_registry(spark, f"{folder}/*.csv")
    return r.select(F.col("unknown")["id"].cast("long").alias("id"), F.nullif(F.col("fields")["object_id"], F.lit("")).alias("object_id"), F.nullif(F.col("fields")["document_code"], F.lit("")).alias("document_code"))


def _model(spark: SparkSession, d: str) -> DataFrame:
    """The parts as the elements of a building model in STEP form, written out and read."""
    folder = fresh(spark, "step")
    n, k = F.col("n").cast("string"), F.col("p_partkey").cast("string")
    ref = lambda i: F.concat(F.lit("#"), (F.col("n") + i).cast("string"))
    line = lambda i, *parts: F.concat(ref(i), F.lit("="), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(";"))
    kind = F.when(F.col("p_size") % 2 == 0, "IFCWALL").otherwise("IFCDOOR")
    p = table(spark, d, "part").withColumn("n", F.col("p_partkey") * 10 + 100)
    entities = F.array(
        line(0, kind, "('P", k, "',$,'", F.regexp_replace("p_name", "'", "''"), "',$,$,$,$,$)"),
        line(1, "IFCPROPERTYSINGLEVALUE('Brand',$,IFCLABEL('", F.col("p_brand"), "'),$)"),
        line(2, "IFCPROPERTYSINGLEVALUE('Size',$,IFCINTEGER(", F.col("p_size").cast("string"), "),$)"),
        line(3, "IFCPROPERTYSET('S", k, "',$,'Pset_Common',$,(", ref(1), ",", ref(2), "))"),
        line(4, "IFCRELDEFINESBYPROPERTIES('R", k, "',$,$,$,(", ref(0), "),", ref(3), ")"),
        F.when(F.col("p_size") % 3 != 0, line(5, "IFCQUANTITYAREA('NetArea',$,$,", F.col("p_retailprice").cast("string"), ")")),
        line(6, "IFCQUANTITYVOLUME('NetVolume',$,$,", F.col("p_size").cast("string"), ".)"),
        line(7, "IFCELEMENTQUANTITY('Q", k, "',$,'Qto_Base',$,$,(", ref(5), ",", ref(6), "))"),
        line(8, "IFCRELDEFINESBYPROPERTIES('T", k, "',$,$,$,(", ref(0), "),", ref(7), ")"),
        F.when(F.col("p_partkey") % 7 != 0, line(9, "IFCRELCONTAINEDINSPATIALSTRUCTURE('C", k, "',$,$,$,(", ref(0), "),#", (F.col("p_partkey") % 5 + 1).cast("string"), ")")),
    )
    storeys = spark.range(1, 6).select(F.concat(F.lit("#"), F.col("id").cast("string"), F.lit("=IFCBUILDINGSTOREY('L"), F.col("id").cast("string"), F.lit("',$,'\\X2\\042D044204300436\\X0\\ "), F.col("id").cast("string"), F.lit("',$);")).alias("line"))
    p.select(F.explode(F.array_compact(entities)).alias("line")).unionByName(storeys).write.text(folder)
    # the parts of one table are one model
    return steps.read_step(spark, folder).withColumn("file", F.lit("model"))


_PART = "select 'P' || p_partkey as guid, case when p_size % 2 = 0 then 'IFCWALL' else 'IFCDOOR' end as ifc_type, p_name as name, case when p_partkey % 7 <> 0 then 'L' || (p_partkey % 5 + 1) end as storey_guid, case when p_size % 3 <> 0 then p_retailprice end as area, p_size::double as volume, p_brand, p_size from part"


@query(f"select guid, ifc_type, name, storey_guid, area, volume from ({_PART})")
def src10_elements(spark, d):
    """Elements of a building model with storey, first area and first volume."""
    m = _model(spark, d)
    return steps.elements(m).join(steps.metrics(steps.quantities(m)), ["file", "id"], "left").select("guid", "ifc_type", "name", "storey_guid", "area", "volume")


@query(f"select guid, 'Brand' as name, p_brand as value_text, null::double as value_num from ({_PART}) union all select guid, 'Size', p_size::varchar, p_size::double from ({_PART})")
def src10_properties(spark, d):
    """Properties of elements, as text and as numbers where they are."""
    m = _model(spark, d)
    return steps.properties(m).join(steps.elements(m).select("file", "id", "guid"), ["file", "id"]).select("guid", "name", "value_text", "value_num")


@query(f"select storey_guid, ifc_type, round(sum(area), 2) as sum_area, sum(volume) as sum_volume, count(*) as count_elements from ({_PART}) where ifc_type in ('IFCWALL', 'IFCDOOR') group by 1, 2 order by 1 nulls first, 2 limit 200")
def ifc01_spec_query(spark, d):
    """Elements grouped by storey and type with sums of their metrics."""
    m = _model(spark, d)
    q = steps.spec_query(steps.elements(m), steps.metrics(steps.quantities(m)), ["IFCWALL", "IFCDOOR"], ["storey_guid", "ifc_type"])
    return q.withColumn("sum_area", F.round("sum_area", 2))


@query(f"select guid, ifc_type, name, 2.0 + contains(name, 'blue')::int + contains(lower(name || ' ' || ifc_type || ' ' || guid || ' ' || 'Pset_Common Brand ' || p_brand || ' Pset_Common Size ' || p_size), 'brand#1')::int as relevance from ({_PART}) where ifc_type = 'IFCDOOR' and relevance > 2 order by relevance desc, guid limit 50")
def ifc02_question(spark, d):
    """The elements a question asks for, by the type it names and its other words."""
    m = _model(spark, d)
    return steps.answer(steps.elements(m), steps.properties(m), "Площадь дверей blue Brand#1", 50)


@query(f"select guid || ':' || k as observation_key, ifc_type as entity, k as attribute, v as value from (select guid, ifc_type, 'area' as k, area as v from ({_PART}) union all select guid, ifc_type, 'volume', volume from ({_PART})) where v is not null")
def ifc03_observations(spark, d):
    """Metrics of elements as observations, one row an attribute that is there."""
    m = _model(spark, d)
    e = steps.elements(m).join(steps.metrics(steps.quantities(m)), ["file", "id"])
    flat = e.select("guid", "ifc_type", F.explode(F.create_map(F.lit("area"), F.col("area"), F.lit("volume"), F.col("volume"))).alias("attribute", "value")).filter("value is not null")
    return flat.select(F.concat_ws(":", "guid", "attribute").alias("observation_key"), F.col("ifc_type").alias("entity"), "attribute", "value")
