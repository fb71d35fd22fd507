"""Files whose schema drifts, as one table with a list of changes.

Every file is profiled by field (types, and a sketch of its values by object); a file
is held against the one before it in its suite; fields that went and fields that came
are matched one to one by value agreement and likeness of name; matched fields are one
column of the unified tables, one long with a row a value, one wide and typed.

Defined results: payloads that hold no record (null, empty, broken text, other JSON)
give a file without fields: it is compared like any other, so its successor's fields
come out as added.  Repeated files count once.  A field that is null in every record is
present and has no type.  Records without object_id take part in presence and type only.
Order within a suite is written_at, then file_id.
"""

from __future__ import annotations

import json
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.operators.ordered import lag_by
from dossia.session import materialize

RECORD_LISTS = ("records", "items", "rows", "data")


def parse_records(payload: str | None) -> list[dict]:
    """The records of any layout: an array, an object with a list of records, one record per line."""
    if not payload or not payload.strip():
        return []
    try:
        top = json.loads(payload)
    except (ValueError, RecursionError):
        out = []
        for line in payload.splitlines():
            if line.strip():
                try:
                    out.append(json.loads(line))
                except (ValueError, RecursionError):
                    continue
        return [r for r in out if isinstance(r, dict)]
    if isinstance(top, dict):
        inner = next((top[k] for k in RECORD_LISTS if isinstance(top.get(k), list)), None)
        top = inner if inner is not None else [top]
    return [r for r in top if isinstance(r, dict)] if isinstance(top, list) else []


def json_kind(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    return {int: "number", float: "number", str: "string", dict: "object", list: "array"}[type(value)]


def _canon(value) -> str:
    """One text for equal values: 1 and 1.0 are equal, key order does not matter."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def _sketch(value) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(_canon(value).encode("utf-8", "surrogatepass")) >> 1 or 1


FIELDS = "array<struct<name:string,kind:string,kinds:array<string>,objects:array<long>,marks:array<long>>>"


def _profile(batches):
    import pyarrow as pa
    from xxhash import xxh3_64_intdigest

    field = pa.struct([("name", pa.string()), ("kind", pa.string()), ("kinds", pa.list_(pa.string())), ("objects", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))])
    for b in batches:
        profiles = []
        for payload in b.column(b.schema.get_field_index("payload")).to_pylist():
            by: dict[str, dict] = {}
            for r in parse_records(payload):
                oid = r.get("object_id")
                obj = xxh3_64_intdigest(_canon(oid).encode("utf-8", "surrogatepass")) >> 1 if oid is not None else None
                for k, v in r.items():
                    if k == "object_id":
                        continue
                    f = by.setdefault(k, {"kinds": {}, "vals": {}})
                    kind = json_kind(v)
                    if kind:
                        f["kinds"][kind] = f["kinds"].get(kind, 0) + 1
                        if obj is not None:
                            f["vals"][obj] = _sketch(v)
            profiles.append([{"name": k, "kind": min(f["kinds"], key=lambda x: (-f["kinds"][x], x)) if f["kinds"] else None, "kinds": sorted(f["kinds"]), "objects": list(f["vals"]), "marks": list(f["vals"].values())} for k, f in sorted(by.items())])
        keep = [b.column(i) for i, n in enumerate(b.schema.names) if n != "payload"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(profiles, pa.list_(field))], names=[n for n in b.schema.names if n != "payload"] + ["fields"])


def profile_files(files: DataFrame) -> DataFrame:
    """file_id, suite_id, written_at, fields: name, type and value sketch of each field, one row a file."""
    f = files.select("file_id", "suite_id", "written_at", "payload").dropDuplicates(["file_id"])
    return f.mapInArrow(_profile, f"file_id long, suite_id string, written_at timestamp_ntz, fields {FIELDS}")


def agreement(old: dict[int, int], new: dict[int, int]) -> int:
    """Objects with equal values in both sketches; -1 if one differs (nulls and absences fit anything)."""
    n = 0
    for o, m in new.items():
        was = old.get(o)
        if was is None:
            continue
        if was != m:
            return -1
        n += 1
    return n


def match_fields(gone: dict[str, dict[int, int]], came: dict[str, dict[int, int]]) -> dict[str, str]:
    """Maximum-weight one-to-one matching old -> new; only pairs whose values agree are edges, weight is agreement, then likeness of name."""
    olds, news = sorted(gone), sorted(came)
    weight = {}
    for i, o in enumerate(olds):
        for j, w in enumerate(news):
            a = agreement(gone[o], came[w])
            if a > 0:
                weight[i, j] = 1.0 + 0.01 * a / (1 + a) + 0.1 * SequenceMatcher(None, o, w).ratio()
    n = max(len(olds), len(news))
    if not weight:
        return {}
    # Hungarian method on costs; absent edges cost as much as no match
    cost = [[-weight.get((i, j), 0.0) for j in range(n)] for i in range(n)]
    inf = float("inf")
    u, v, p, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = [inf] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return {olds[p[j] - 1]: news[j - 1] for j in range(1, n + 1) if (p[j] - 1, j - 1) in weight}


def _diff(batches):
    """Changes from one file to the next; a field in both that has no type in the older one may be retyped: `unsure`."""
    import pyarrow as pa

    for b in batches:
        out = []
        for row in b.to_pylist():
            kinds = {f["name"]: f["kind"] for f in row["fields"] or []}
            were = {f["name"]: f["kind"] for f in row["old_fields"] or []}
            new = {f["name"]: dict(zip(f["objects"], f["marks"])) for f in row["fields"] or []}
            old = {f["name"]: dict(zip(f["objects"], f["marks"])) for f in row["old_fields"] or []}
            gone = {k: v for k, v in old.items() if k not in new}
            came = {k: v for k, v in new.items() if k not in old}
            renamed = match_fields(gone, came)
            head = (row["file_id"], row["suite_id"], row["written_at"])
            out += [(*head, o, "renamed", w) for o, w in renamed.items()]
            out += [(*head, o, "removed", None) for o in gone if o not in renamed]
            taken = set(renamed.values())
            out += [(*head, w, "added", None) for w in came if w not in taken]
            for k in new:
                if k in old and kinds[k] is not None and kinds[k] != were[k]:
                    out.append((*head, k, "unsure" if were[k] is None else "retyped", None))
        cols = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.timestamp("us"), pa.string(), pa.string(), pa.string()))], names=["file_id", "suite_id", "written_at", "field_name", "change", "new_name"])


def field_changes(profiles: DataFrame) -> DataFrame:
    """file_id, suite_id, written_at, field_name, change (renamed, removed, added, retyped), new_name."""
    order = lag_by(profiles.select("suite_id", "written_at", "file_id"), ["suite_id"], ["written_at"], {"before_id": "file_id"})
    pairs = order.filter(F.col("before_id").isNotNull()).select("file_id", "before_id")
    old = profiles.select(F.col("file_id").alias("before_id"), F.col("fields").alias("old_fields"))
    both = pairs.join(profiles, "file_id").join(old, "before_id").select("file_id", "suite_id", "written_at", "fields", "old_fields")
    diff = materialize(both.mapInArrow(_diff, "file_id long, suite_id string, written_at timestamp_ntz, field_name string, change string, new_name string"))
    # a type before the file before it: only looked up for fields that had none there
    asked = diff.filter(F.col("change") == "unsure").select("suite_id", "field_name").distinct()
    typed = profiles.select("suite_id", "written_at", "file_id", F.explode("fields").alias("f")).select("suite_id", "written_at", "file_id", F.col("f.name").alias("field_name"), F.col("f.kind").alias("kind")).filter(F.col("kind").isNotNull())
    typed = typed.join(asked, [typed["suite_id"].eqNullSafe(asked["suite_id"]), typed["field_name"] == asked["field_name"]], "left_semi")
    was = lag_by(typed, ["suite_id", "field_name"], ["written_at", "file_id"], {"kind_before": "kind"})
    other = was.filter(F.col("kind") != F.col("kind_before")).select("file_id", "field_name")
    retyped = diff.filter(F.col("change") == "unsure").join(other, ["file_id", "field_name"], "left_semi").withColumn("change", F.lit("retyped"))
    return diff.filter(F.col("change") != "unsure").unionByName(retyped)


def drift_found(files: DataFrame) -> DataFrame:
    return field_changes(materialize(profile_files(files))).select("file_id", "field_name", "change").distinct()


def latest_names(profiles: DataFrame) -> DataFrame:
    """file_id, names: for each field of a file the latest name of it in its suite.

    Names are followed through the renames that come after the file, one rename of a field
    a round, until none applies; each round goes on in time, so there are no more than files.
    """
    changes = materialize(field_changes(profiles).filter(F.col("change") == "renamed").select("suite_id", F.col("field_name").alias("name"), "new_name", F.col("written_at").alias("at"), F.col("file_id").alias("by")))
    names = profiles.select("file_id", "suite_id", "written_at", F.explode("fields.name").alias("field_name")).withColumn("name", F.col("field_name")).withColumn("since", F.struct("written_at", "file_id"))
    while True:
        step = names.join(changes, ["suite_id", "name"]).filter(F.struct("at", "by") > F.col("since"))
        step = materialize(step.groupBy("file_id", "field_name").agg(F.min_by(F.struct("new_name", "at", "by"), F.struct("at", "by")).alias("to")))
        if step.isEmpty():
            break
        names = materialize(
            names.join(step, ["file_id", "field_name"], "left").select("file_id", "suite_id", "written_at", "field_name", F.coalesce("to.new_name", "name").alias("name"), F.when(F.col("to").isNotNull(), F.struct(F.col("to.at").alias("written_at"), F.col("to.by").alias("file_id"))).otherwise(F.col("since")).alias("since"))
        )
    return names.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "name"))).alias("names"))


def _named(files: DataFrame, profiles: DataFrame) -> DataFrame:
    one = files.select("file_id", "suite_id", "written_at", "payload").dropDuplicates(["file_id"])
    return one.join(latest_names(profiles), "file_id", "left").select("file_id", "suite_id", "written_at", "payload", "names")


CELLS = "file_id long, suite_id string, written_at timestamp_ntz, record_no long, object_id string, field_name string, column_name string, value string, kind string"


def _cells(batches):
    import pyarrow as pa

    types = (pa.int64(), pa.string(), pa.timestamp("us"), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
    for b in batches:
        out = []
        for row in b.to_pylist():
            names = dict(row["names"] or [])
            for no, r in enumerate(parse_records(row["payload"])):
                oid = r.get("object_id")
                for k, v in r.items():
                    if k != "object_id":
                        out.append((row["file_id"], row["suite_id"], row["written_at"], no, None if oid is None else str(oid), k, names.get(k, k), _text(v), json_kind(v)))
        cols = list(zip(*out)) if out else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=[x.split(" ")[0] for x in CELLS.split(", ")])


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else _canon(value)


def unify(files: DataFrame) -> DataFrame:
    """Every value of every record in one long table; column_name is the latest name of the field in its suite."""
    return _named(files, materialize(profile_files(files))).mapInArrow(_cells, CELLS)


def columns_of(kinds: DataFrame, most: int = 5_000) -> list[tuple[str, str]]:
    """(column, type) of the wide table from column_name, kind (null for none): double where all values are numbers, boolean where all are, else string; refuses more than `most` columns."""
    named = kinds.groupBy("column_name").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi")).limit(most + 1).collect()
    if len(named) > most:
        raise ValueError("too many fields for one table")
    of = {"number": "double", "boolean": "boolean"}
    return sorted((r.column_name, of.get(r.lo, "string") if r.lo == r.hi else "string") for r in named)


def _rows(columns: list[tuple[str, str]]):
    def run(batches):
        import pyarrow as pa

        kinds = {"double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
        schema = pa.schema([("file_id", pa.int64()), ("suite_id", pa.string()), ("written_at", pa.timestamp("us")), ("record_no", pa.int64()), ("object_id", pa.string()), *((f"c{i}", kinds[t]) for i, (_, t) in enumerate(columns))])
        place = {c: i for i, (c, _) in enumerate(columns)}
        for b in batches:
            head: list[list] = [[] for _ in range(5)]
            body: list[list] = [[] for _ in columns]
            for row in b.to_pylist():
                names = dict(row["names"] or [])
                for no, r in enumerate(parse_records(row["payload"])):
                    oid = r.get("object_id")
                    for h, x in zip(head, (row["file_id"], row["suite_id"], row["written_at"], no, None if oid is None else str(oid))):
                        h.append(x)
                    new: list = [None] * len(columns)
                    for k, v in r.items():
                        if k != "object_id":
                            i = place[names.get(k, k)]
                            t = columns[i][1]
                            new[i] = _text(v) if t == "string" else None if v is None else float(v) if t == "double" else v
                    for c, x in zip(body, new):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*head, *body], schema)], schema=schema)

    return run


def unified_table(files: DataFrame) -> DataFrame:
    """All records in one typed table: file_id, suite_id, written_at, record_no, object_id and one column per field by its latest name.

    A field named like another one but for case, or like one of the first columns, gets a number behind its name.
    """
    profiles = materialize(profile_files(files))
    named = materialize(_named(files, profiles))
    fields = profiles.join(named.select("file_id", "names"), "file_id").select("names", F.explode("fields").alias("f"))
    columns = columns_of(fields.select(F.coalesce(F.col("names")[F.col("f.name")], F.col("f.name")).alias("column_name"), F.explode_outer("f.kinds").alias("kind")))
    out = named.mapInArrow(_rows(columns), "file_id long, suite_id string, written_at timestamp_ntz, record_no long, object_id string" + "".join(f", c{i} {t}" for i, (_, t) in enumerate(columns)))
    taken, titles = {"file_id", "suite_id", "written_at", "record_no", "object_id"}, []
    for c, _ in columns:
        title, n = c, 1
        while title.lower() in taken:
            n += 1
            title = f"{c}_{n}"
        taken.add(title.lower())
        titles.append(title)
    return out.toDF("file_id", "suite_id", "written_at", "record_no", "object_id", *titles)
