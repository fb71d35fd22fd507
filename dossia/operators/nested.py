"""Nested JSON records as related flat tables, by shared inlining.

1. The schema graph (which element holds which, how often in lists) is counted
   over all records in one distributed pass; it has one row per pair of element
   names, so only it reaches the driver.
2. Elements that are repeated, shared by several parents or recursive get a table;
   singletons are inlined into the element that holds them.  Elements whose
   members are alike (`attempts` and their `retries`) are one table.
3. A second pass, again without a shuffle, writes every record as rows of these
   tables with the key of the record, a number in reading order and table and number
   of the parent row.  Elements given as one family are also numbered together in the
   same walk, whichever tables they are in.
4. flat_tables makes one table with typed columns of each, by member.

Defined results: null, empty and cut-off JSON, and JSON too deep to parse, give no
rows; lists given as JSON text are read as lists, an object where a list is usual as
a list of one; every value of a list of values, or beside the objects of a list, is a
row with the one member `value`, which takes no number of its family; repeated records
give repeated rows (callers take distinct keys).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.session import materialize

MAX_SCHEMA_EDGES = 200_000
ROOT = "$"
VALUE = "value"


def _loads(text: str | None):
    if not text:
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _unquote(value):
    """Lists and objects given as JSON text."""
    if isinstance(value, str) and value[:1] in "[{":
        inner = _loads(value)
        return inner if isinstance(inner, (dict, list)) else value
    return value


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "null" if value is None else "string"


def _edges(batches):
    """parent, child, kind, n, n_list; a list of values is an element whose one member is `value`."""
    import pyarrow as pa

    seen: dict[tuple[str, str, str], list[int]] = {}

    def count(parent: str, child: str, kind: str, many: bool) -> None:
        c = seen.setdefault((parent, child, kind), [0, 0])
        c[0] += 1
        c[1] += many

    for b in batches:
        for text in b.column(0).to_pylist():
            top = _loads(text)
            stack = [(ROOT, top)] if isinstance(top, (dict, list)) else []
            while stack:
                name, node = stack.pop()
                if isinstance(node, list):
                    for x in map(_unquote, node):
                        if isinstance(x, (dict, list)):
                            stack.append((name, x))
                        else:
                            count(name, VALUE, _kind(x), False)
                    continue
                for key, value in node.items():
                    value = _unquote(value)
                    if isinstance(value, (dict, list)):
                        count(name, key, "object", isinstance(value, list))
                        stack.append((key, value))
                    else:
                        count(name, key, _kind(value), False)
    rows = [(p, c, k, n, m) for (p, c, k), (n, m) in seen.items()]
    yield pa.RecordBatch.from_pydict({"parent": [r[0] for r in rows], "child": [r[1] for r in rows], "kind": [r[2] for r in rows], "n": [r[3] for r in rows], "n_list": [r[4] for r in rows]}, schema=pa.schema([("parent", pa.string()), ("child", pa.string()), ("kind", pa.string()), ("n", pa.int64()), ("n_list", pa.int64())]))


def schema_graph(records: DataFrame, json_col: str) -> DataFrame:
    """parent, child, kind (object for objects and lists, else the type of a value), n, n_list: how often child stands in parent, and how often as a list."""
    e = records.select(json_col).mapInArrow(_edges, "parent string, child string, kind string, n long, n_list long")
    return e.groupBy("parent", "child", "kind").agg(F.sum("n").alias("n"), F.sum("n_list").alias("n_list"))


def plan_tables(edges: list[tuple[str, str, str, int, int]], alike: float = 0.5, always: tuple[str, ...] = ()) -> dict[str, str]:
    """element name -> its table, for the elements that get one (those of `always` in any case); every other object is inlined into its holder."""
    objects = [e for e in edges if e[2] == "object"]
    members: dict[str, set[str]] = {}
    for p, c, *_ in edges:
        members.setdefault(p, set()).add(c)
    parents: dict[str, set[str]] = {}
    repeated: set[str] = set()
    for p, c, _, _, n_list in objects:
        parents.setdefault(c, set()).add(p)
        if n_list or c in always:
            repeated.add(c)

    def reach(a: str) -> set[str]:
        found, todo = set(), [a]
        while todo:
            for p, c, *_ in objects:
                if p == todo[-1] and c not in found:
                    found.add(c)
                    todo.insert(0, c)
            todo.pop()
        return found

    below = {c: reach(c) for c in parents}
    names = sorted(repeated | {c for c in parents if c in below[c]}, key=lambda c: (len(parents[c] & repeated), c))
    table: dict[str, str] = {}
    for c in names:  # an element is the table of the first one whose members are alike
        own = members.get(c, set()) - {VALUE}
        table[c] = next((t for t in dict.fromkeys(table.values()) if len(own & members.get(t, set())) >= max(1, alike * len(own | members.get(t, set()) - {VALUE}))), c)
    for c, ps in parents.items():  # shared by tables that differ
        if c not in table and len({table.get(p, p) for p in ps}) > 1 and c != ROOT:
            table[c] = c
    return table


ROWS = "_id long, table string, element string, row_no long, parent_table string, parent_no long, family_no long, parent_family_no long"


def near_member(names: list[str], vals: list[str | None], name: str, depth: int) -> str | None:
    """The first non-null member `name` of a row: its own, else one inlined at most `depth` objects below."""
    end, best = f".{name}", None
    for n, v in zip(names, vals):
        if v is not None:
            if n == name:
                return v
            if best is None and n.endswith(end) and n.count(".") <= depth:
                best = v
    return best


def _shred(table: dict[str, str], family: frozenset[str], only: frozenset[str] | None, members: tuple[tuple[str, int], ...]):
    def run(batches):
        import pyarrow as pa

        fields = [("_id", pa.int64()), ("table", pa.string()), ("element", pa.string()), ("row_no", pa.int64()), ("parent_table", pa.string()), ("parent_no", pa.int64()), ("family_no", pa.int64()), ("parent_family_no", pa.int64())]
        fields += [(m, pa.string()) for m, _ in members] or [("names", pa.list_(pa.string())), ("vals", pa.list_(pa.string()))]
        schema = pa.schema(fields)
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                top = _loads(text)
                if not isinstance(top, (dict, list)):
                    continue
                numbers: dict[str, int] = {}
                count = 0

                def new_row(own: str, name: str, holder: tuple, no: int | None) -> tuple:
                    """A row of a table: (table, number, family number, names, values)."""
                    at = numbers.get(own, 0)
                    numbers[own] = at + 1
                    row = (own, at, no, [], [])
                    if only is None or own in only:
                        out.append((key, own, name, at, holder[0], holder[1], no, holder[2], row[3], row[4]))
                    return row

                # node, its name, the row that holds it, path inside that row
                stack: list[tuple] = [(top, ROOT, None, "")]
                while stack:
                    node, name, row, path = stack.pop()
                    if isinstance(node, list):
                        stack.extend((_unquote(x), name, row, path) for x in reversed(node))
                        continue
                    holder = row or (None, -1, None)
                    own = table.get(name)
                    if not isinstance(node, dict):  # a value of a list
                        names, vals = new_row(own or name, name, holder, None)[3:]
                        names.append(VALUE)
                        vals.append(node if node is None or isinstance(node, str) else json.dumps(node, ensure_ascii=False))
                        continue
                    if row is None or own is not None:
                        no = None
                        if row is not None and name in family:
                            no, count = count, count + 1
                        row, path = new_row(own or ROOT if row is not None else ROOT, name, holder, no), ""
                    deeper = []
                    for k, v in node.items():
                        v = _unquote(v)
                        if isinstance(v, (dict, list)):
                            deeper.append((v, k, row, f"{path}{k}."))
                        else:
                            row[3].append(path + k)
                            row[4].append(v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False))
                    stack.extend(reversed(deeper))
            if members:
                out = [(*r[:8], *[near_member(r[8], r[9], m, depth) for m, depth in members]) for r in out]
            cols = list(zip(*out)) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def shred(records: DataFrame, id_col: str, json_col: str, table: dict[str, str], family: tuple[str, ...] = (), only: frozenset[str] | None = None, members: dict[str, int] | None = None) -> DataFrame:
    """One row per row of every flat table (or those of `only`): key, table, element, number in the table, parent row, number among the elements of `family` and that of the parent.

    Then names and vals (inlined members by path), or with `members` (name: how many objects below it may stand) just those, as text.
    """
    members = members or {}
    schema = ROWS + (", names array<string>, vals array<string>" if not members else "".join(f", `{m}` string" for m in members))
    return records.select(F.col(id_col).cast("long"), json_col).mapInArrow(_shred(table, frozenset(family), only, tuple(members.items())), schema)


def schema_edges(records: DataFrame, json_col: str) -> list[tuple[str, str, str, int, int]]:
    edges = schema_graph(records, json_col).limit(MAX_SCHEMA_EDGES + 1).collect()
    if len(edges) > MAX_SCHEMA_EDGES:
        raise ValueError("the records have no schema: too many pairs of names")
    return [tuple(e) for e in edges]


def table_columns(edges: list[tuple[str, str, str, int, int]], table: dict[str, str]) -> dict[str, dict[str, str]]:
    """table -> path of member -> type: double where all values are numbers, boolean where all are, else string."""
    below: dict[str, list[tuple[str, str]]] = {}
    for p, c, k, *_ in edges:
        below.setdefault(p, []).append((c, k))
    kinds: dict[str, dict[str, set[str]]] = {ROOT: {}}
    for top in [ROOT, *table]:
        own = kinds.setdefault(table.get(top, top), {})
        todo = [(top, "")]
        while todo:
            name, path = todo.pop()
            for c, k in below.get(name, []):
                if k != "object":
                    own.setdefault(path + c, set()).add(k)
                elif c not in table:
                    todo.append((c, f"{path}{c}."))
    of = {"number": "double", "boolean": "boolean"}
    return {t: {c: of.get(next(iter(k - {"null"})), "string") if len(k - {"null"}) == 1 else "string" for c, k in sorted(cols.items())} for t, cols in kinds.items()}


def flat_tables(records: DataFrame, id_col: str, json_col: str) -> dict[str, DataFrame]:
    """name -> table: id_col, row_no (with id_col its key), parent_table and parent_no (the foreign key), element, and one typed column per member; names that differ in case only, or clash with the first columns, get a number."""
    edges = schema_edges(records, json_col)
    table = plan_tables(edges)
    rows = materialize(shred(records, id_col, json_col, table))
    out = {}
    for name, columns in table_columns(edges, table).items():
        taken, members = {id_col.lower(), "row_no", "parent_table", "parent_no", "element"}, []
        own = F.map_from_arrays("names", "vals")
        for c, kind in columns.items():
            title, n = c, 1
            while title.lower() in taken:
                n += 1
                title = f"{c}_{n}"
            taken.add(title.lower())
            members.append(F.col("_own")[c].try_cast(kind).alias(title) if kind != "string" else F.col("_own")[c].alias(title))
        out[name] = rows.filter(F.col("table") == name).withColumn("_own", own).select(F.col("_id").alias(id_col), "row_no", "parent_table", "parent_no", "element", *members).dropDuplicates([id_col, "row_no"])
    return out


def inline_tables(records: DataFrame, id_col: str, json_col: str, family: tuple[str, ...] = (), only: tuple[str, ...] | None = None, members: dict[str, int] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The shredded rows (of the tables of the elements `only`) and the table of each element."""
    table = plan_tables(schema_edges(records, json_col), always=family)
    wanted = None if only is None else frozenset(table.get(e, e) for e in only)
    return shred(records, id_col, json_col, table, family, wanted, members), table


# What says yes and no.
YES = ["true", "1", "1.0", "да", "yes", "y", "t", "истина", "найдено", "on"]
NO = ["false", "0", "0.0", "нет", "no", "n", "f", "ложь", "не найдено", "off"]


ATTEMPTS = ("attempts", "retries")


def attempts_table(logs: DataFrame) -> DataFrame:
    """log_id, attempt_no, parent_no (-1 where it is no retry), code string, pages_scanned bigint, found boolean, location, stage string."""
    rows, _ = inline_tables(logs, "log_id", "details", ATTEMPTS, ATTEMPTS, {"code": 0, "pages_scanned": 1, "found": 1, "location": 0, "stage": 0})
    a = rows.filter(F.col("family_no").isNotNull() & ((F.col("element") == "attempts") | F.col("parent_family_no").isNotNull()))
    flag = F.lower(F.trim("found"))
    return a.select(
        F.col("_id").alias("log_id"),
        F.col("family_no").alias("attempt_no"),
        F.when((F.col("element") == "retries") & F.col("parent_family_no").isNotNull(), F.col("parent_family_no")).otherwise(F.lit(-1).cast("long")).alias("parent_no"),
        "code",
        F.floor(F.trim("pages_scanned").try_cast("double")).cast("long").alias("pages_scanned"),
        F.when(flag.isin(YES), True).when(flag.isin(NO), False).alias("found"),
        "location",
        "stage",
    )


def attempt_cases(logs: DataFrame) -> DataFrame:
    a = attempts_table(logs)
    return a.filter(F.col("code").isNotNull() & F.col("found") & (F.col("pages_scanned") >= 1)).select("log_id", "attempt_no", "parent_no", "code").distinct()


def log_table(logs: DataFrame) -> DataFrame:
    """log_id with the inlined members of the record itself: status, note, run_no and the number of attempts."""
    rows, _ = inline_tables(logs, "log_id", "details", ATTEMPTS, (ROOT, *ATTEMPTS), {"status": 0, "note": 0, "run_no": 1})
    one = rows.groupBy(F.col("_id").alias("log_id"))
    first = lambda c: F.max(F.when(F.col("table") == ROOT, c))
    number = F.when(F.col("family_no").isNotNull() & ((F.col("element") == "attempts") | F.col("parent_family_no").isNotNull()), F.col("family_no"))
    return one.agg(first(F.col("status")).alias("status"), first(F.col("note")).alias("note"), first(F.col("run_no").try_cast("long")).alias("run_no"), F.count_distinct(number).alias("n_attempts"))
