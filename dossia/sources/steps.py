"""Building models in the STEP text form: entities, and the element tables that follow from them.

A file is split at semicolons by the text reader, so one large model is read by many tasks;
all that links entities is a join on (file, id).  Lists inside lists (geometry) are not read.

Defined results: `$` and `*` are null; text that is no entity, or holds a semicolon inside a
string, is left out; an element without a container has no storey; of several areas or
volumes the first in the order of its quantity sets counts.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Entities that are building elements.
ELEMENTS = ["IFCWALL", "IFCWALLSTANDARDCASE", "IFCDOOR", "IFCWINDOW", "IFCSLAB", "IFCBEAM", "IFCCOLUMN", "IFCROOF", "IFCSTAIR", "IFCRAILING", "IFCCOVERING", "IFCPLATE", "IFCMEMBER", "IFCPIPESEGMENT", "IFCDUCTSEGMENT", "IFCFLOWTERMINAL", "IFCFURNISHINGELEMENT", "IFCBUILDINGELEMENTPROXY"]
_ENTITY = r"(?s)^\s*#(\d+)\s*=\s*([A-Z0-9]+)\s*\((.*)\)\s*$"
_ARGUMENT = r"'(?:[^']|'')*'|(?:[A-Z0-9]+)?\((?:[^()']|'(?:[^']|'')*')*\)|[^,()'\s][^,()']*"


@F.pandas_udf(StringType())
def _unicode(s: pd.Series) -> pd.Series:
    code = re.compile(r"\\X2\\((?:[0-9A-F]{4})+)\\X0\\")
    return s.map(lambda x: None if x is None else code.sub(lambda m: bytes.fromhex(m[1]).decode("utf-16-be", "replace"), x))


def step_text(c: Column) -> Column:
    """The text of a string argument, or of a value such as IFCLABEL('x'); null for $ and *."""
    inner = F.regexp_replace(F.regexp_extract(c, r"(?s)^(?:[A-Z0-9]+\()?'?(.*?)'?\)?$", 1), "''", "'")
    return F.when(~c.isin("$", "*"), F.when(inner.contains("\\X2\\"), _unicode(inner)).otherwise(inner))


def references(c: Column) -> Column:
    """The ids an argument refers to."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"#(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def read_step(spark: SparkSession, path: str) -> DataFrame:
    """file, id, kind, args: the entities of model files."""
    s = spark.read.option("lineSep", ";").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    body = F.regexp_extract("value", _ENTITY, 3)
    return s.filter(F.col("value").rlike(_ENTITY)).select("file", F.regexp_extract("value", _ENTITY, 1).cast("long").alias("id"), F.regexp_extract("value", _ENTITY, 2).alias("kind"), F.regexp_extract_all(body, F.lit(_ARGUMENT), F.lit(0)).alias("args"))


def elements(step: DataFrame) -> DataFrame:
    """file, id, guid, ifc_type, name, container_guid, storey_guid."""
    arg = lambda i: F.get("args", F.lit(i))
    e = step.filter(F.col("kind").isin(ELEMENTS)).select("file", "id", step_text(arg(0)).alias("guid"), F.col("kind").alias("ifc_type"), step_text(arg(2)).alias("name")).filter("guid is not null")
    inside = step.filter("kind = 'IFCRELCONTAINEDINSPATIALSTRUCTURE'").select("file", F.explode(references(arg(4))).alias("id"), F.get(references(arg(5)), F.lit(0)).alias("container"))
    places = step.filter(F.col("kind").isin("IFCBUILDINGSTOREY", "IFCBUILDING", "IFCSITE", "IFCSPACE")).select("file", F.col("id").alias("container"), step_text(arg(0)).alias("container_guid"), (F.col("kind") == "IFCBUILDINGSTOREY").alias("is_storey"))
    at = inside.join(places, ["file", "container"]).groupBy("file", "id").agg(F.min_by(F.struct("container_guid", "is_storey"), "container").alias("at"))
    return e.join(at, ["file", "id"], "left").select("file", "id", "guid", "ifc_type", "name", F.col("at.container_guid").alias("container_guid"), F.when(F.col("at.is_storey"), F.col("at.container_guid")).alias("storey_guid"))


def _sets(step: DataFrame, kind: str, members: int) -> DataFrame:
    """file, id (of the element), set_id, set_name, no, member: members of the property or quantity sets of each element."""
    arg = lambda i: F.get("args", F.lit(i))
    of = step.filter("kind = 'IFCRELDEFINESBYPROPERTIES'").select("file", F.explode(references(arg(4))).alias("id"), F.get(references(arg(5)), F.lit(0)).alias("set_id"))
    sets = step.filter(F.col("kind") == kind).select("file", F.col("id").alias("set_id"), step_text(arg(2)).alias("set_name"), F.posexplode(references(arg(members))).alias("no", "member"))
    return of.join(sets, ["file", "set_id"])


def properties(step: DataFrame) -> DataFrame:
    """file, id, pset, name, value_text, value_num, value_bool of each element."""
    arg = lambda i: F.get("args", F.lit(i))
    p = step.filter("kind = 'IFCPROPERTYSINGLEVALUE'").select("file", F.col("id").alias("member"), step_text(arg(0)).alias("name"), step_text(arg(2)).alias("value_text"))
    j = _sets(step, "IFCPROPERTYSET", 4).join(p, ["file", "member"])
    flag = F.when(F.col("value_text") == ".T.", True).when(F.col("value_text") == ".F.", False)
    return j.select("file", "id", F.col("set_name").alias("pset"), "name", "value_text", F.col("value_text").try_cast("double").alias("value_num"), flag.alias("value_bool"))


def quantities(step: DataFrame) -> DataFrame:
    """file, id, qto, no (order within the element), name, value_num of each element."""
    arg = lambda i: F.get("args", F.lit(i))
    q = step.filter(F.col("kind").startswith("IFCQUANTITY")).select("file", F.col("id").alias("member"), step_text(arg(0)).alias("name"), arg(3).try_cast("double").alias("value_num"))
    j = _sets(step, "IFCELEMENTQUANTITY", 5).join(q, ["file", "member"])
    return j.select("file", "id", F.col("set_name").alias("qto"), F.struct("set_id", "no").alias("no"), "name", "value_num")


def metrics(quantity: DataFrame) -> DataFrame:
    """file, id, area, volume: the first quantity whose name has the word."""
    first = lambda w: F.min_by(F.when(F.col("name").ilike(f"%{w}%"), F.col("value_num")), F.when(F.col("name").ilike(f"%{w}%"), F.col("no")))
    return quantity.groupBy("file", "id").agg(first("area").alias("area"), first("volume").alias("volume"))


def spec_query(element: DataFrame, metric: DataFrame, types: list[str] | None, group_by: list[str], limit: int = 200) -> DataFrame:
    """Elements of some types grouped by type or storey: count, and the sums of area and volume where there are any; the first `limit` groups by key."""
    e = element.filter(F.col("ifc_type").isin(types)) if types else element
    g = e.join(metric, ["file", "id"], "left").groupBy(*group_by).agg(F.sum("area").alias("sum_area"), F.sum("volume").alias("sum_volume"), F.count("*").alias("count_elements"))
    return g.orderBy(*group_by).limit(limit)


# Beginnings of words by which questions name elements and metrics.
TYPE_WORDS = {"стен": "IFCWALL", "wall": "IFCWALL", "двер": "IFCDOOR", "door": "IFCDOOR", "окн": "IFCWINDOW", "window": "IFCWINDOW", "плит": "IFCSLAB", "slab": "IFCSLAB", "балк": "IFCBEAM", "beam": "IFCBEAM", "колонн": "IFCCOLUMN", "column": "IFCCOLUMN"}
METRIC_WORDS = {"площад": "area", "area": "area", "объем": "volume", "volume": "volume"}


def answer(element: DataFrame, prop: DataFrame, question: str, limit: int) -> DataFrame:
    """guid, ifc_type, name, relevance: elements of the types a question names that hold one of its other words in name or properties; two for the type, one for each word."""
    words = re.findall(r"[0-9a-zа-я#]+", question.lower().replace("ё", "е"))
    types = sorted({t for w in words for k, t in TYPE_WORDS.items() if w.startswith(k)})
    free = [w for w in words if len(w) >= 3 and not any(w.startswith(k) for k in [*TYPE_WORDS, *METRIC_WORDS])]
    e = element.filter(F.col("ifc_type").isin(types)) if types else element
    said = prop.groupBy("file", "id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "pset", "name", "value_text"))), " ").alias("said"))
    hay = F.lower(F.concat_ws(" ", "name", "ifc_type", "guid", "said"))
    hits = sum((F.when(hay.contains(w), 1).otherwise(0) for w in free), F.lit(0))
    out = e.join(said, ["file", "id"], "left").withColumn("hits", hits)
    if free:
        out = out.filter("hits > 0")
    return out.select("guid", "ifc_type", "name", (F.col("hits") + (2 if types else 0)).cast("double").alias("relevance")).orderBy(F.col("relevance").desc(), "guid").limit(limit)
