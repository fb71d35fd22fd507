"""Queries of comparison, joins, aggregates, windows, sets and sorts, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossia.functions.text import any_date, revision_number
from dossia.operators import compare as C
from dossia.operators import graphs, state, statistics
from dossia.operators.units import few, small
from dossia.session import materialize, table
from dossia.sources.files import APPROVED, approved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Document versions, one row each (deliveries repeat rows)."""
    return table(spark, d, "document_versions").dropDuplicates(["id"])


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations, one row each: of repeated ones the last ingested."""
    o = table(spark, d, "rule_observations")
    return o.groupBy("observation_id").agg(F.max_by(F.struct(*[c for c in o.columns if c != "observation_id"]), "ingested_at").alias("r")).select("observation_id", "r.*")


V = "(select distinct on (id) * from document_versions)"
O = "(select distinct on (observation_id) * from rule_observations order by observation_id, ingested_at desc)"
NUM = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def number(c: str):
    return F.when(F.col(c).rlike(NUM), F.col(c).try_cast("double"))


SQLNUM = "case when regexp_full_match(normalized_value, '-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?') then try_cast(normalized_value as double) end"
APP = "lower(trim(approval_status)) in (" + ", ".join(f"'{a}'" for a in APPROVED) + ")"


# --- windows over versions --------------------------------------------------------------------


@query("""
select event_id, user_id, event_type, value, previous,
  case when rn = 1 then 'ADDED' when value is null and previous is not null then 'VALUE_MISSING' when previous is null and value is not null then 'ADDED'
       when abs(value - previous) > greatest(0.01, abs(previous) * 0.001) then 'VALUE_CHANGED' else 'UNCHANGED' end as change,
  round(case when previous <> 0 then abs(value - previous) / abs(previous) * 100 end, 4) as change_pct
from (select *, lag(value) over w as previous, row_number() over w as rn from events window w as (partition by user_id, event_type order by ts, event_id))
""")
def win01_change_events(spark, d):
    """Each value against the one before it of its key, with the tolerance rule."""
    e = C.consecutive_changes(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")
    return e.select("event_id", "user_id", "event_type", "value", "previous", "change", F.round(C.change_pct(F.col("previous"), F.col("value")), 4).alias("change_pct"))


@query(f"""
select document_version_id, parameter_code, count(distinct normalized_value) as n_values, count(*) as n_rows from {O}
where normalized_value is not null group by all having count(distinct normalized_value) > 1
""")
def win02_conflicts(spark, d):
    """Parameters with more than one value in one document version."""
    g = observations(spark, d).filter("normalized_value is not null").groupBy("document_version_id", "parameter_code")
    return g.agg(F.countDistinct("normalized_value").alias("n_values"), F.count("*").alias("n_rows")).filter("n_values > 1")


@query(f"""
select object_id, dataset_stage, id, created_at from (select *, row_number() over (partition by object_id, dataset_stage order by created_at desc, id desc) as rn from {V}) where rn = 1
""")
def win03_latest_per_key(spark, d):
    """The last version of every object and stage, as an aggregate (no window over a hot object)."""
    g = versions(spark, d).groupBy("object_id", "dataset_stage").agg(F.max(F.struct("created_at", "id")).alias("m"))
    return g.select("object_id", "dataset_stage", F.col("m.id").alias("id"), F.col("m.created_at").alias("created_at"))


@query(f"""
select parameter_code, location, stage, document_version_id, page, observation_id, confidence from
 (select *, row_number() over (partition by parameter_code, location, stage, document_version_id, page order by confidence desc nulls last, observation_id) as rn from {O}) where rn = 1
""")
def win04_best_per_key(spark, d):
    """Of observations at one place the one with most confidence, ties to the smaller id."""
    o = observations(spark, d)
    keys = ["parameter_code", "location", "stage", "document_version_id", "page"]
    return C.top_per_key(o, keys, [F.col("confidence").desc_nulls_last(), F.col("observation_id")]).select(*keys, "observation_id", "confidence")


@query(f"""
select document_version_id, page, observation_id, rank from
 (select *, row_number() over (partition by document_version_id, page order by confidence desc nulls last, observation_id) as rank from {O}) where rank <= 2
""")
def win05_cap_per_page(spark, d):
    """At most two hits a page, the best first."""
    o = observations(spark, d)
    w = Window.partitionBy("document_version_id", "page").orderBy(F.col("confidence").desc_nulls_last(), "observation_id")
    return o.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select("document_version_id", "page", "observation_id", "rank")


@query("""
with e as (select user_id, event_id % 7 as item, value, event_id, ts, case event_type when 'signup' then 'ADD' when 'purchase' then 'REFINE' when 'error' then 'REMOVE' when 'click' then 'RESTORE' end as act from events where event_type <> 'view'),
s as (select user_id, item, row_number() over w as rn,
  last_value(case when act in ('ADD','REFINE') then value end ignore nulls) over (w rows between unbounded preceding and current row) as v,
  coalesce(last_value(case when act = 'REMOVE' then false when act in ('ADD','RESTORE') then true end ignore nulls) over (w rows between unbounded preceding and current row), false) as alive
  from e window w as (partition by user_id, item order by ts, event_id))
select user_id, item, arg_max(coalesce(v, -1), rn) as value, arg_max(alive, rn) as alive, count(*) as n_edits from s group by all
""")
def win06_event_replay(spark, d):
    """The state after all edits of a key in order: set, change, take out, bring back."""
    e = table(spark, d, "events").filter("event_type <> 'view'")
    act = F.create_map(*[F.lit(x) for x in ("signup", "ADD", "purchase", "REFINE", "error", "REMOVE", "click", "RESTORE")])[F.col("event_type")]
    e = e.select("user_id", (F.col("event_id") % 7).alias("item"), "value", "event_id", "ts", act.alias("act"))
    return state.replay(e, ["user_id", "item"], ["ts", "event_id"], "act", "value").withColumn("value", F.coalesce("value", F.lit(-1.0)))


@query("""
select user_id, cycle, count(*) as n, min(ts) as opened, max(ts) as closed, round(greatest(0, epoch(max(ts)) - epoch(min(ts))), 1) as seconds from
 (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as cycle from events)
group by all
""")
def win07_cycles(spark, d):
    """Rows after each start marker as one cycle, with its length."""
    e = state.cycles(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    sec = F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))
    return e.groupBy("user_id", "cycle").agg(F.count("*").alias("n"), F.min("ts").alias("opened"), F.max("ts").alias("closed"), F.round(F.greatest(F.lit(0.0), sec / 1e6), 1).alias("seconds"))


@query("""
select user_id, island, count(*) as n, min(event_id) as first_id from
 (select *, sum(g) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as island from
  (select *, case when coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 6 hour, true) then 1 else 0 end as g from events)) group by all
""")
def win09_gaps_and_islands(spark, d):
    """Runs of a key without a gap over six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.col("ts") - F.lag("ts").over(w)) > F.expr("interval 6 hours")
    e = state.islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], gap)
    return e.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""
select event_id, user_id, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between 8 preceding and current row) as head_id from events
""")
def win10_nearest_above(spark, d):
    """The nearest header-like row at most eight rows above."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-8, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w).alias("head_id"))


@query("""
select user_id, count(*) as n_rows from (select *, sum(case when event_type = 'signup' then 1 else 0 end) over w as a, sum(case when event_type = 'error' then 1 else 0 end) over w as b
 from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)) where a >= 1 and b = 0 group by all
""")
def win11_between_markers(spark, d):
    """Rows after the first begin marker and before the first end marker."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").withColumn("a", F.sum((F.col("event_type") == "signup").cast("int")).over(w)).withColumn("b", F.sum((F.col("event_type") == "error").cast("int")).over(w))
    return e.filter("a >= 1 and b = 0").groupBy("user_id").agg(F.count("*").alias("n_rows"))


# --- filters ----------------------------------------------------------------------------------


@query(f"""
select organization_id, project_id, count(*) as n from {V} where organization_id = 3 and object_id is not null and dataset_stage in ('PD', 'RD') group by all
""")
def flt01_scope_filter(spark, d):
    """Equality and IN predicates that reach the scan."""
    v = table(spark, d, "document_versions").filter((F.col("organization_id") == 3) & F.col("object_id").isNotNull() & F.col("dataset_stage").isin("PD", "RD"))
    return v.dropDuplicates(["id"]).groupBy("organization_id", "project_id").agg(F.count("*").alias("n"))


@query("""
select o_orderstatus, o_orderpriority, count(*) as n from orders where o_orderstatus in ('O', 'P') and o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01' group by all
""")
def flt03_status_and_dates(spark, d):
    """IN lists and half-open date ranges."""
    o = table(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    return o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


_REV = "case when regexp_extract(revision, '([0-9]+)', 1) <> '' then cast(regexp_extract(revision, '([0-9]+)', 1) as int) when regexp_extract(lower(revision), 'rev\\s*\\.?\\s*([a-z])\\b', 1) <> '' then ascii(regexp_extract(lower(revision), 'rev\\s*\\.?\\s*([a-z])\\b', 1)) - 96 else -1 end"
_DATE = """coalesce(
 case when regexp_matches(approval_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_strptime(substr(approval_date, 1, 10), '%Y-%m-%d') end,
 case when regexp_full_match(approval_date, '[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}') then try_strptime(approval_date, '%d.%m.%Y') end,
 case when regexp_full_match(approval_date, '[0-9]{2}/[0-9]{2}/[0-9]{4}') then try_strptime(approval_date, '%d/%m/%Y') end,
 case when regexp_full_match(approval_date, '[0-9]{2}\\.[0-9]{2}\\.[0-9]{2}') then try_strptime(substr(approval_date, 1, 6) || '20' || substr(approval_date, 7, 2), '%d.%m.%Y') end,
 case when regexp_full_match(approval_date, '[0-9]{2}/[0-9]{2}/[0-9]{2}') then try_strptime(substr(approval_date, 1, 6) || '20' || substr(approval_date, 7, 2), '%d/%m/%Y') end)"""


@query(f"""
select object_id, dataset_stage, document_code, id, rev from (select *, row_number() over (partition by object_id, dataset_stage, document_code order by rev desc, day desc nulls last, id desc) as rn from
 (select *, {_REV} as rev, cast({_DATE} as date) as day from {V} where {APP})) where rn = 1
""")
def flt04_current_revision(spark, d):
    """Of approved versions the one with the greatest revision, then date, then id."""
    v = versions(spark, d).filter(approved(F.col("approval_status"))).withColumn("rev", revision_number(F.col("revision"))).withColumn("day", any_date(F.col("approval_date")))
    keys = ["object_id", "dataset_stage", "document_code"]
    return C.top_per_key(v, keys, [F.col("rev").desc(), F.col("day").desc_nulls_last(), F.col("id").desc()]).select(*keys, "id", "rev")


@query(f"select id, object_id from {V} a where not exists (select 1 from document_versions b where b.id = a.successor_id)")
def flt05_without_successor(spark, d):
    """Versions whose successor is not there."""
    v = versions(spark, d)
    return v.join(table(spark, d, "document_versions").select(F.col("id").alias("s")), F.col("successor_id") == F.col("s"), "left_anti").select("id", "object_id")


@query(f"""
select id, list_filter([case when approval_status is null then 'no_status' end, case when not coalesce({APP}, false) and approval_status is not null then 'not_approved' end, case when discipline is null then 'no_discipline' end, case when successor_id is not null then 'superseded' end], lambda x: x is not null) as reasons from {V}
""")
def flt06_reasons(spark, d):
    """All reasons that keep a version out, as an array; empty where it may pass."""
    ok = F.coalesce(approved(F.col("approval_status")), F.lit(False))
    r = F.array_compact(F.array(F.when(F.col("approval_status").isNull(), "no_status"), F.when(~ok & F.col("approval_status").isNotNull(), "not_approved"), F.when(F.col("discipline").isNull(), "no_discipline"), F.when(F.col("successor_id").isNotNull(), "superseded")))
    return versions(spark, d).select("id", r.alias("reasons"))


@query("""
select distinct p.code from matrix_params p where exists (select 1 from rule_observations o join document_versions v on v.id = o.document_version_id where o.parameter_code = p.code and v.created_at >= timestamp '2025-11-01')
""")
def flt07_affected_parameters(spark, d):
    """Parameters read in documents that changed: a semi join."""
    new = table(spark, d, "document_versions").filter(F.col("created_at") >= F.lit("2025-11-01").cast("timestamp_ntz")).select("id").distinct()
    codes = table(spark, d, "rule_observations").select("parameter_code", "document_version_id").join(new, F.col("document_version_id") == F.col("id"), "left_semi").select("parameter_code").distinct()
    return table(spark, d, "matrix_params").join(codes, F.col("code") == F.col("parameter_code"), "left_semi").select("code").distinct()


@query("""
select code, case when unit is null or trim(unit) = '' then 'NONE' when lower(unit) = 'класс' then 'ENUM_CLASS' when unit like '% / %' then 'NUMERIC_COMPOUND' when lower(unit) in ('шт', 'шт.', 'штук', 'ед.') then 'NUMERIC_COUNT' else 'NUMERIC_SIMPLE' end as unit_class from matrix_params
""")
def flt08_unit_class(spark, d):
    """What kind of quantity a unit stands for."""
    u = F.col("unit")
    c = F.when(u.isNull() | (F.trim(u) == ""), "NONE").when(F.lower(u) == "класс", "ENUM_CLASS").when(u.like("% / %"), "NUMERIC_COMPOUND").when(F.lower(u).isin("шт", "шт.", "штук", "ед."), "NUMERIC_COUNT").otherwise("NUMERIC_SIMPLE")
    return table(spark, d, "matrix_params").select("code", c.alias("unit_class"))


@query(f"""
select observation_id, rank from (select o.observation_id, row_number() over (order by case p.review_priority when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end, o.confidence desc nulls last, o.observation_id) as rank
 from {O} o join (select distinct on (code) * from matrix_params) p on p.code = o.parameter_code) where rank <= 200
""")
def flt10_review_queue(spark, d):
    """The first 200 of the queue: priority, confidence, id (top-k, no full sort)."""
    pr = F.when(F.col("review_priority") == "HIGH", 1).when(F.col("review_priority") == "MEDIUM", 2).otherwise(3)
    p = small(table(spark, d, "matrix_params").dropDuplicates(["code"]).select(F.col("code").alias("parameter_code"), "review_priority"))
    top = observations(spark, d).join(p, "parameter_code").select("observation_id", "confidence", pr.alias("pr")).orderBy("pr", F.col("confidence").desc_nulls_last(), "observation_id").limit(200)
    w = Window.orderBy("pr", F.col("confidence").desc_nulls_last(), "observation_id")  # over the 200 rows only
    return top.select("observation_id", F.row_number().over(w).alias("rank"))


# --- joins ------------------------------------------------------------------------------------


@query(f"""
select v.dataset_stage, p.section, count(*) as n, count(distinct o.document_version_id) as n_docs from {O} o join {V} v on v.id = o.document_version_id join (select distinct on (code) * from matrix_params) p on p.code = o.parameter_code group by all
""")
def join01_chain(spark, d):
    """Observation, version and parameter: one shuffle join, one broadcast of a fixed matrix."""
    p = small(table(spark, d, "matrix_params").dropDuplicates(["code"]).select(F.col("code").alias("parameter_code"), "section"))
    v = versions(spark, d).select(F.col("id").alias("document_version_id"), "dataset_stage")
    j = observations(spark, d).select("observation_id", "parameter_code", "document_version_id").join(p, "parameter_code").join(v, "document_version_id")
    return j.groupBy("dataset_stage", "section").agg(F.count("*").alias("n"), F.countDistinct("document_version_id").alias("n_docs"))


@query(f"""
select v.id, count(o.observation_id) as n, count(*) filter (where o.confidence >= 0.8) as n_sure, count(*) filter (where o.normalized_value is null and o.observation_id is not null) as n_empty,
 case when count(o.observation_id) = 0 then 'GRAY' when count(*) filter (where o.confidence < 0.5) > 0 then 'RED' when count(*) filter (where o.confidence < 0.8) > 0 then 'YELLOW' else 'GREEN' end as colour
from {V} v left join {O} o on o.document_version_id = v.id group by all
""")
def join02_outer_dashboard(spark, d):
    """Left join with conditional counts and a first-match colour; counted before joining."""
    g = observations(spark, d).groupBy(F.col("document_version_id").alias("id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.8).alias("n_sure"), F.count_if(F.col("normalized_value").isNull()).alias("n_empty"), F.count_if(F.col("confidence") < 0.5).alias("lo"), F.count_if(F.col("confidence") < 0.8).alias("mid")
    )
    j = versions(spark, d).select("id").join(g, "id", "left").fillna(0)
    colour = F.when(F.col("n") == 0, "GRAY").when(F.col("lo") > 0, "RED").when(F.col("mid") > 0, "YELLOW").otherwise("GREEN")
    return j.select("id", "n", "n_sure", "n_empty", colour.alias("colour"))


@query("select c_custkey, c_name from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P')")
def join03_semi(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000)")
def join04_anti(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 400000").select("o_custkey")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


_F = "(select distinct on (doc_id) * from doc_facts)"


@query(f"""
with f as (select doc_id, sha256, file_id, filename from {_F}), r as (select id, content_hash, dataset_file_id, document_code from {V}),
m1 as (select f.doc_id, r.id, 'sha' as how from f join (select content_hash, min(id) as id from r group by 1 having count(*) = 1) r on r.content_hash = f.sha256 where f.sha256 in (select sha256 from f group by 1 having count(*) = 1)),
f2 as (select * from f where doc_id not in (select doc_id from m1)), r2 as (select * from r where id not in (select id from m1)),
m2 as (select f2.doc_id, r2.id, 'file_id' as how from f2 join (select dataset_file_id, min(id) as id from r2 group by 1 having count(*) = 1) r2 on r2.dataset_file_id = f2.file_id where f2.file_id in (select file_id from f2 group by 1 having count(*) = 1)),
f3 as (select *, regexp_extract(filename, '^([^_.]+)', 1) as base from f2 where doc_id not in (select doc_id from m2)), r3 as (select * from r2 where id not in (select id from m2)),
m3 as (select f3.doc_id, r3.id, 'base' as how from f3 join (select document_code, min(id) as id from r3 group by 1 having count(*) = 1) r3 on r3.document_code = f3.base where f3.base in (select base from f3 group by 1 having count(*) = 1))
select * from m1 union all select * from m2 union all select * from m3
""")
def join05_cascading_match(spark, d):
    """Files to registry rows by hash, else unique file id, else unique base name; every row used once."""
    left = table(spark, d, "doc_facts").dropDuplicates(["doc_id"]).select("doc_id", "sha256", "file_id", F.regexp_extract("filename", r"^([^_.]+)", 1).alias("base"))
    right = versions(spark, d).select("id", F.col("content_hash").alias("sha256"), F.col("dataset_file_id").alias("file_id"), F.col("document_code").alias("base"))
    out = None
    for key, how in (("sha256", "sha"), ("file_id", "file_id"), ("base", "base")):
        m = materialize(C.unique_keys(left, [key]).join(C.unique_keys(right, [key]).select(key, "id"), key).select("doc_id", "id", F.lit(how).alias("how")))
        out = m if out is None else out.unionByName(m)
        left, right = left.join(m, "doc_id", "left_anti"), right.join(m, "id", "left_anti")
    return out


_SIDE = "(select parameter_code, location, any_value(v) as v from (select parameter_code, location, {n} as v from {o} where stage = '{s}' and location is not null) group by 1, 2 having count(*) = 1)"


@query(f"""
select coalesce(a.parameter_code, b.parameter_code) as parameter_code, coalesce(a.location, b.location) as location, a.v as left_value, b.v as right_value,
 case when b.parameter_code is null then 'only_left' when a.parameter_code is null then 'only_right' when a.v is null or b.v is null then 'unknown' when abs(b.v - a.v) > greatest(0.01, abs(a.v) * 0.001) then 'differs' else 'equal' end as status
from {_SIDE.format(n=SQLNUM, o=O, s="PD")} a full outer join {_SIDE.format(n=SQLNUM, o=O, s="RD")} b on a.parameter_code = b.parameter_code and a.location = b.location
""")
def join06_keyed_compare(spark, d):
    """Two stages compared by key; keys that repeat on a side are taken out of it."""
    o = observations(spark, d).filter("location is not null").select("parameter_code", "location", "stage", number("normalized_value").alias("v"))
    return C.keyed_compare(o.filter("stage = 'PD'"), o.filter("stage = 'RD'"), ["parameter_code", "location"], "v")


@query(f"""
with c as (select distinct v.object_id, v.document_code, v.dataset_stage, v.id, o.parameter_code from {V} v join {O} o on o.document_version_id = v.id where v.document_code is not null and v.object_id is not null),
n as (select id, count(*) as n from c group by 1)
select a.id as id_a, b.id as id_b, count(*) as n_common, round(count(*)::double / least(any_value(na.n), any_value(nb.n)), 6) as overlap, round(count(*)::double / (any_value(na.n) + any_value(nb.n) - count(*)), 6) as jaccard
from c a join c b on a.object_id = b.object_id and a.document_code = b.document_code and a.parameter_code = b.parameter_code and a.id < b.id join n na on na.id = a.id join n nb on nb.id = b.id
group by a.id, b.id having count(*) >= 2
""")
def join08_scored_pairs(spark, d):
    """Versions of one document scored by the parameters they share (an inverted-index join: pairs come from shared keys only)."""
    v = versions(spark, d).filter("document_code is not null and object_id is not null").select("object_id", "document_code", "id")
    o = table(spark, d, "rule_observations").select(F.col("document_version_id").alias("id"), "parameter_code").distinct()
    c = v.join(o, "id")
    n = c.groupBy("id").agg(F.count("*").alias("n"))
    c = c.join(n, "id")
    a, b = c.select("object_id", "document_code", "parameter_code", F.col("id").alias("id_a"), F.col("n").alias("na")), c.select("object_id", "document_code", "parameter_code", F.col("id").alias("id_b"), F.col("n").alias("nb"))
    p = a.join(b, ["object_id", "document_code", "parameter_code"]).filter("id_a < id_b").groupBy("id_a", "id_b").agg(F.count("*").alias("n_common"), F.first("na").alias("na"), F.first("nb").alias("nb")).filter("n_common >= 2")
    k = F.col("n_common")
    return p.select("id_a", "id_b", "n_common", F.round(k / F.least("na", "nb"), 6).alias("overlap"), F.round(k / (F.col("na") + F.col("nb") - k), 6).alias("jaccard"))


@query("""
with p as (select s.s_suppkey, c.c_custkey, round(abs(s.s_acctbal - c.c_acctbal), 6) as distance from supplier s join customer c on c.c_nationkey = s.s_nationkey),
s as (select *, row_number() over (partition by s_suppkey order by distance, c_custkey) as r from p), c as (select *, row_number() over (partition by c_custkey order by distance, s_suppkey) as r from p)
select s.s_suppkey, s.c_custkey, s.distance from s join c on s.s_suppkey = c.s_suppkey and s.c_custkey = c.c_custkey where s.r = 1 and c.r = 1
""")
def join10_mutual_best(spark, d):
    """Pairs in which each is the other's nearest in its block, found by sorting, without making the pairs of a block."""
    s, c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("b"), "s_suppkey", F.col("s_acctbal").alias("v")), table(spark, d, "customer").select(F.col("c_nationkey").alias("b"), "c_custkey", F.col("c_acctbal").alias("v"))
    a = graphs.nearest(s, c, "b", "v", "s_suppkey", "c_custkey")
    b = graphs.nearest(c, s, "b", "v", "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey")
    return a.join(b, ["s_suppkey", "c_custkey"]).select("s_suppkey", "c_custkey", "distance")


@query(f"""
with recursive e as (select distinct id as a, successor_id as b from {V} where successor_id is not null union select id, predecessor_id from {V} where predecessor_id is not null),
s as (select a, b from e union select b, a from e), n as (select a as node from s union select b from s),
r(node, reach) as (select node, node from n union select r.node, s.b from r join s on s.a = r.reach)
select node, min(reach) as component from r group by 1
""")
def join12_components(spark, d):
    """Versions joined by predecessor and successor links, by rounds of least neighbours."""
    v = versions(spark, d)
    e = v.filter("successor_id is not null").select(F.col("id").alias("a"), F.col("successor_id").alias("b")).unionByName(v.filter("predecessor_id is not null").select(F.col("id").alias("a"), F.col("predecessor_id").alias("b")))
    return graphs.components(e)


@query(f"""
with o as (select v.object_id, o.parameter_code, o.normalized_value, o.stage = 'PD' as l from {O} o join {V} v on v.id = o.document_version_id where v.object_id is not null and o.normalized_value is not null and o.stage is not null)
select object_id, sum(least(a, b))::bigint as matched from (select object_id, parameter_code, normalized_value, count(*) filter (where l) as a, count(*) filter (where not l) as b from o group by 1, 2, 3) where least(a, b) > 0 group by 1
""")
def join13_equal_matching(spark, d):
    """The largest one-to-one matching on equal parameter and value, by object: nodes that are equal are one class, of which the smaller side is matched."""
    v = versions(spark, d).select(F.col("id").alias("document_version_id"), "object_id").filter("object_id is not null")
    o = observations(spark, d).join(v, "document_version_id").filter("normalized_value is not null and stage is not null")
    left = F.col("stage") == "PD"
    g = o.groupBy("object_id", "parameter_code", "normalized_value").agg(F.least(F.count_if(left), F.count_if(~left)).alias("n")).filter("n > 0")
    return g.groupBy("object_id").agg(F.sum("n").alias("matched"))


@query()
def join13_max_matching(spark, d):
    """The largest one-to-one matching of two stages' observations of a parameter within one percent, by object; tested by brute force."""
    v = versions(spark, d).select(F.col("id").alias("document_version_id"), "object_id").filter("object_id is not null")
    o = observations(spark, d).join(v, "document_version_id").select("object_id", "parameter_code", "stage", "observation_id", number("normalized_value").alias("v")).filter("v > 0 and stage is not null")
    # values within one percent share a step of the logarithm, or stand in neighbouring ones
    o = o.withColumn("step", F.floor(F.log("v") / 0.01))
    a = o.filter("stage = 'PD'").select("object_id", "parameter_code", "step", F.col("observation_id").alias("l"), F.col("v").alias("vl"))
    b = o.filter("stage <> 'PD'").select("object_id", "parameter_code", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"), F.col("observation_id").alias("r"), F.col("v").alias("vr"))
    e = a.join(b, ["object_id", "parameter_code", "step"]).filter("abs(vl - vr) <= 0.01 * least(vl, vr)").select("object_id", "l", "r").distinct()
    return graphs.max_matching(e, "object_id", "l", "r")


@query(f"""
with e as (select event_id, user_id, ts from events), q as (select user_id, ts as from_ts, event_id as price_id, lead(ts) over (partition by user_id order by ts, event_id) as to_ts from events where event_type = 'purchase')
select e.event_id, q.price_id from e left join q on q.user_id = e.user_id and q.from_ts <= e.ts and (q.to_ts > e.ts or q.to_ts is null)
""")
def join15_as_of(spark, d):
    """The entry in force at each row: last one at or before it, by one sort instead of a range join."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("price_id"))


@query(f"""
with v as (select id, successor_id from {V}), i as (select successor_id as id, count(*) as n_in from v where successor_id is not null group by 1)
select v.id, coalesce(i.n_in, 0) as n_in, case when v.successor_id is null then 0 else 1 end as n_out, v.successor_id is null as is_tip, coalesce(i.n_in, 0) <= 1 as is_linear from v left join i on i.id = v.id
""")
def join16_chain_degrees(spark, d):
    """In and out degree of each version in its chain: tips and forks."""
    v = versions(spark, d).select("id", "successor_id")
    i = v.filter("successor_id is not null").groupBy(F.col("successor_id").alias("id")).agg(F.count("*").alias("n_in"))
    j = v.join(i, "id", "left").fillna(0, ["n_in"])
    return j.select("id", "n_in", F.col("successor_id").isNotNull().cast("int").alias("n_out"), F.col("successor_id").isNull().alias("is_tip"), (F.col("n_in") <= 1).alias("is_linear"))


@query(f"""
select v.id, o.parameter_code, o.observation_id from {V} v left join (select *, row_number() over (partition by document_version_id order by confidence desc nulls last, observation_id desc) as rn from {O}) o on o.document_version_id = v.id and o.rn = 1
""")
def join17_outer_top1(spark, d):
    """Each version with its best observation, also versions without any; the best is an aggregate."""
    best = observations(spark, d).groupBy(F.col("document_version_id").alias("id")).agg(F.max(F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), "observation_id", "parameter_code")).alias("m"))
    return versions(spark, d).select("id").join(best, "id", "left").select("id", F.col("m.parameter_code").alias("parameter_code"), F.col("m.observation_id").alias("observation_id"))


@query(f"""
with c as (select object_id, discipline, dataset_stage, min(id) as id, count(*) as n from {V} where object_id is not null and discipline is not null group by 1, 2, 3)
select a.object_id, a.discipline, a.id as id_a, a.n as n_a, b.id as id_b, b.n as n_b from c a join c b on a.object_id = b.object_id and a.discipline = b.discipline and a.dataset_stage < b.dataset_stage
""")
def join18_stage_pairs(spark, d):
    """Documents of one object and discipline in different stages: pairs of the representatives of each stage, with how many each stands for (join18_members)."""
    c = versions(spark, d).filter("object_id is not null and discipline is not null").groupBy("object_id", "discipline", "dataset_stage").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    a, b = c.withColumnsRenamed({"id": "id_a", "n": "n_a", "dataset_stage": "sa"}), c.withColumnsRenamed({"id": "id_b", "n": "n_b", "dataset_stage": "sb"})
    return a.join(b, ["object_id", "discipline"]).filter("sa < sb").select("object_id", "discipline", "id_a", "n_a", "id_b", "n_b")


@query(f"select id, min(id) over (partition by object_id, discipline, dataset_stage) as representative from {V} where object_id is not null and discipline is not null")
def join18_members(spark, d):
    """Each document with the one that stands for it in join18_stage_pairs."""
    v = versions(spark, d).filter("object_id is not null and discipline is not null").select("object_id", "discipline", "dataset_stage", "id")
    keys = ["object_id", "discipline", "dataset_stage"]
    r = v.groupBy(*keys).agg(F.min("id").alias("representative"))
    same = F.lit(True)
    for k in keys:
        same = same & v[k].eqNullSafe(r[k])
    return v.join(r, same).select("id", "representative")


@query(f"select id, min(id) over (partition by content_hash) as first_id from {V} where content_hash is not null")
def join19_same_hash(spark, d):
    """The first version with the same content."""
    v = versions(spark, d).filter("content_hash is not null").select("id", "content_hash")
    return v.join(v.groupBy("content_hash").agg(F.min("id").alias("first_id")), "content_hash").select("id", "first_id")


# --- aggregates -------------------------------------------------------------------------------


@query("select s.o_orderstatus, count(o.o_orderkey) as n from (values ('F'), ('O'), ('P'), ('X')) s(o_orderstatus) left join orders o on o.o_orderstatus = s.o_orderstatus group by 1")
def agg01_zero_filled(spark, d):
    """Counts over known statuses, 0 where there is none."""
    known = spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "o_orderstatus string")
    g = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return known.join(g, "o_orderstatus", "left").fillna(0, ["n"])


@query("select p_brand, p_type, count(*) as n, round(sum(q), 2) as qty from (select p_brand, p_type, p_partkey, q from part left join (select l_partkey, sum(l_quantity) as q from lineitem group by 1) on l_partkey = p_partkey) group by all")
def agg02_spec_groupby(spark, d):
    """Group by a list of columns with counts and sums of an optional measure, added up before joining."""
    q = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    return table(spark, d, "part").join(q, "p_partkey", "left").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.sum("q"), 2).alias("qty"))


@query("select max(revision) as top_revision, coalesce(sum(size), 0) as total_size, count(distinct object_id) as n_objects from (select distinct on (v.id) v.revision, f.size_bytes as size, v.object_id from document_versions v left join doc_facts f on f.doc_id = v.id)")
def agg03_scalars(spark, d):
    f = table(spark, d, "doc_facts").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "size_bytes")
    return versions(spark, d).join(f, "id", "left").agg(F.max("revision").alias("top_revision"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"), F.countDistinct("object_id").alias("n_objects"))


_Z = statistics.Z95


@query(f"""
select extractor, k, n, round(greatest(0, ((k::double/n) + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) - {_Z}*sqrt((k::double/n)*(1-k::double/n)/n + {_Z}*{_Z}/(4.0*n*n)) / (1 + {_Z}*{_Z}/n)), 6) as low,
 round(least(1, ((k::double/n) + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) + {_Z}*sqrt((k::double/n)*(1-k::double/n)/n + {_Z}*{_Z}/(4.0*n*n)) / (1 + {_Z}*{_Z}/n)), 6) as high
from (select extractor, count(*) filter (where confidence >= 0.8) as k, count(*) as n from {O} group by 1)
""")
def agg05_wilson(spark, d):
    """95 % bounds of a share by group."""
    g = observations(spark, d).groupBy("extractor").agg(F.count_if(F.col("confidence") >= 0.8).alias("k"), F.count("*").alias("n"))
    lo, hi = statistics.wilson(F.col("k"), F.col("n"))
    return g.select("extractor", "k", "n", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


@query(f"""
with x as (select observation_id, parameter_code, v from (select observation_id, parameter_code, {SQLNUM} as v from {O}) where v is not null), m as (select parameter_code, median(v) as med, count(*) as n from x group by 1 having count(*) >= 6),
a as (select x.*, med, abs(v - med) as dev from x join m using (parameter_code)), b as (select parameter_code, median(dev) * 1.4826 as mad from a group by 1)
select observation_id, round(dev / mad, 4) as z from a join b using (parameter_code) where mad > 0 and med > 0 and dev / mad >= 4.5 and dev >= 0.5 * med
""")
def agg06_mad_outliers(spark, d):
    """Values far from the median of their parameter, by the median distance and by a share of the median."""
    o = observations(spark, d).select("observation_id", "parameter_code", number("normalized_value").alias("v")).filter("v is not null")
    return statistics.mad_outliers(o, ["parameter_code"], "v").select("observation_id", F.round("z", 4).alias("z"))


@query("""
select o_orderkey, round(total, 2) as total, round(rows_sum, 2) as rows_sum, case when n_gap then 'UNDETERMINED' when abs(rows_sum - total) > abs(total) * 0.01 then 'DIFFERS' else 'EQUAL' end as status from
(select o.o_orderkey, o.o_totalprice as total, l.s as rows_sum, l.mx - l.mn + 1 <> l.nd as n_gap from orders o join (select l_orderkey, sum(l_extendedprice) as s, max(l_linenumber) as mx, min(l_linenumber) as mn, count(distinct l_linenumber) as nd from lineitem group by 1) l on l.l_orderkey = o.o_orderkey)
""")
def agg07_rows_against_total(spark, d):
    """The sum of rows against the printed total, undetermined where numbers are missing."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"), (F.max("l_linenumber") - F.min("l_linenumber") + 1).alias("span"), F.countDistinct("l_linenumber").alias("nd"))
    j = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("t")).join(l, "o_orderkey")
    st = F.when(F.col("span") != F.col("nd"), "UNDETERMINED").when(F.abs(F.col("s") - F.col("t")) > F.abs("t") * 0.01, "DIFFERS").otherwise("EQUAL")
    return j.select("o_orderkey", F.round("t", 2).alias("total"), F.round("s", 2).alias("rows_sum"), st.alias("status"))


@query(f"""
with x as (select extractor, coalesce(confidence >= 0.75, false) as p, normalized_value is not null as a from {O})
select extractor, tp, fp, fn, tn, round(tp::double / nullif(tp + fp, 0), 6) as precision, round(tp::double / nullif(tp + fn, 0), 6) as recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from
(select extractor, count(*) filter (where p and a) as tp, count(*) filter (where p and not a) as fp, count(*) filter (where not p and a) as fn, count(*) filter (where not p and not a) as tn from x group by grouping sets ((), (extractor)))
""")
def agg08_confusion(spark, d):
    """Confusion counts overall and by category in one pass."""
    o = observations(spark, d)
    return statistics.confusion(o, ["extractor"], F.coalesce(F.col("confidence") >= 0.75, F.lit(False)), F.col("normalized_value").isNotNull())


@query()
def agg09_character_errors(spark, d):
    """Edits by characters and by words of the reference, over all readings; tested by brute force (the SQL engine counts bytes)."""
    o = observations(spark, d).filter("normalized_value is not null").select("parameter_code", F.coalesce("value", F.lit("")).alias("read"), F.col("normalized_value").alias("reference"))
    return statistics.reading_errors(o, "parameter_code", "reference", "read")


@query("""
with m as (select date_trunc('day', max(ts)) + interval 1 day as e from events)
select event_type, count(*) filter (where ts >= e - interval 7 day) as this_week, count(*) filter (where ts < e - interval 7 day) as last_week, round(coalesce(sum(value) filter (where ts >= e - interval 7 day), 0), 2) as value_now, round(coalesce(sum(value) filter (where ts < e - interval 7 day), 0), 2) as value_before
from events, m where ts >= e - interval 14 day and ts < e group by 1
""")
def agg10_week_over_week(spark, d):
    """Two half-open weeks in one pass; the end comes from a scalar aggregate."""
    e = table(spark, d, "events")
    end = e.agg((F.date_trunc("day", F.max("ts")).cast("timestamp_ntz") + F.expr("interval 1 day")).alias("e")).first().e
    end = F.lit(end).cast("timestamp_ntz")
    now = F.col("ts") >= end - F.expr("interval 7 days")
    x = e.filter((F.col("ts") >= end - F.expr("interval 14 days")) & (F.col("ts") < end))
    return x.groupBy("event_type").agg(F.count_if(now).alias("this_week"), F.count_if(~now).alias("last_week"), F.round(F.coalesce(F.sum(F.when(now, F.col("value"))), F.lit(0.0)), 2).alias("value_now"), F.round(F.coalesce(F.sum(F.when(~now, F.col("value"))), F.lit(0.0)), 2).alias("value_before"))


@query(f"""
select parameter_code, case when count(distinct extractor) = 1 then min(extractor) end as common, (select y.extractor from (select extractor, count(*) as n from {O} z where z.parameter_code = x.parameter_code group by 1 order by n desc, extractor limit 1) y) as most from {O} x group by parameter_code
""")
def agg11_common_and_mode(spark, d):
    """The one value of a group where there is one, and the most frequent."""
    g = observations(spark, d).groupBy("parameter_code", "extractor").agg(F.count("*").alias("n"))
    a = g.groupBy("parameter_code").agg(F.count("extractor").alias("k"), F.min("extractor").alias("one"), F.min(F.struct((-F.col("n")).alias("m"), "extractor")).alias("top"))
    return a.select("parameter_code", F.when(F.col("k") == 1, F.col("one")).alias("common"), F.col("top.extractor").alias("most"))


@query(f"select document_code, to_json(list(struct_pack(id := id, stage := dataset_stage) order by id))::varchar as versions from {V} where document_code is not null group by 1")
def agg12_nested(spark, d):
    """Members of a group as a sorted array, as JSON."""
    v = versions(spark, d).filter("document_code is not null")
    return v.groupBy("document_code").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", F.col("dataset_stage").alias("stage")))), {"ignoreNullFields": "false"}).alias("versions"))


@query("""
select user_id, round(purchase, 4) as purchase, round(error, 4) as error, coalesce(purchase < error, false) as breaks_rule from (select user_id, max(value) filter (where event_type = 'purchase') as purchase, max(value) filter (where event_type = 'error') as error from events group by 1)
""")
def agg13_relation_rules(spark, d):
    """Several parameters of one key on one row, and a rule between them."""
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["purchase", "error"]).agg(F.max("value"))
    return p.select("user_id", F.round("purchase", 4).alias("purchase"), F.round("error", 4).alias("error"), F.coalesce(F.col("purchase") < F.col("error"), F.lit(False)).alias("breaks_rule"))


@query(f"""
with s as (select distinct dataset_stage from {V}), o as (select distinct object_id from {V}), p as (select object_id, dataset_stage, count(*) as n from {V} group by 1, 2)
select o.object_id, s.dataset_stage, case when p.n is null then 'MISSING' when p.n = 1 then 'SINGLE' else 'MANY' end as status from o cross join s left join p on p.object_id = o.object_id and p.dataset_stage = s.dataset_stage
""")
def agg15_completeness(spark, d):
    """Every object with every stage of the (few) stages there are, present or not: stages as an array, not a join."""
    v = versions(spark, d)
    n = v.groupBy("object_id", "dataset_stage").agg(F.count("*").alias("n"))
    stages = few(v.select("dataset_stage").distinct(), 1_000)
    want = v.select("object_id").distinct().select("object_id", F.explode(F.array(*[F.lit(s) for s in stages])).alias("dataset_stage"))
    j = want.join(n, ["object_id", "dataset_stage"], "left")
    return j.select("object_id", "dataset_stage", F.when(F.col("n").isNull(), "MISSING").when(F.col("n") == 1, "SINGLE").otherwise("MANY").alias("status"))


@query(f"""
select extractor, stage, round(avg(case when normalized_value is not null then 1.0 else 0.0 end), 6) as filled, round(avg(case when bbox_normalized is not null then 1.0 else 0.0 end), 6) as located from {O} group by cube (extractor, stage)
""")
def agg16_slices(spark, d):
    """Shares of filled fields by every slice of two dimensions."""
    o = observations(spark, d)
    return o.cube("extractor", "stage").agg(F.round(F.avg(F.col("normalized_value").isNotNull().cast("double")), 6).alias("filled"), F.round(F.avg(F.col("bbox_normalized").isNotNull().cast("double")), 6).alias("located"))


@query(f"""
select parameter_code, count(distinct document_version_id) as n_docs, count(distinct stage) as n_stages, list_sort(list(distinct stage)) as stages from {O} group by 1
""")
def agg17_registry_row(spark, d):
    g = observations(spark, d).groupBy("parameter_code")
    return g.agg(F.countDistinct("document_version_id").alias("n_docs"), F.countDistinct("stage").alias("n_stages"), F.array_sort(F.collect_set("stage")).alias("stages"))


@query("""
select split, count(*) as n, count(distinct c_nationkey) as n_nations from (select c_nationkey, ('0x' || substr(sha256(c_custkey::varchar), 1, 8))::bigint % 3 as split from customer) group by 1
""")
def arr07_hash_split(spark, d):
    """A split by hash that any engine repeats."""
    c = table(spark, d, "customer").withColumn("split", statistics.hash_split(F.col("c_custkey").cast("string")))
    return c.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("n_nations"))


@query(f"""
select doc_stage, round(sum(crit)::double / sum(sum(crit)) over (), 6) as share, sum(crit) as n_crit from (select v.doc_stage, case when o.confidence < 0.7 then 1 else 0 end as crit from {O} o join {V} v on v.id = o.document_version_id) group by 1
""")
def agg20_priors(spark, d):
    """The share of each group in the total: a window over the groups only."""
    v = versions(spark, d).select(F.col("id").alias("document_version_id"), "doc_stage")
    g = observations(spark, d).join(v, "document_version_id").groupBy("doc_stage").agg(F.sum((F.coalesce(F.col("confidence") < 0.7, F.lit(False))).cast("int")).alias("n_crit"))
    return g.select("doc_stage", F.round(F.col("n_crit") / F.sum("n_crit").over(Window.partitionBy()), 6).alias("share"), "n_crit")


@query(f"""
select kind, count(*) as n from (select case when value is null then 'NO_VALUE' when normalized_value is null then 'NOT_NORMALIZED' when page is null then 'NO_CITATION' when confidence < 0.6 then 'UNSURE' else 'OK' end as kind from {O}) group by 1
""")
def agg21_taxonomy(spark, d):
    k = F.when(F.col("value").isNull(), "NO_VALUE").when(F.col("normalized_value").isNull(), "NOT_NORMALIZED").when(F.col("page").isNull(), "NO_CITATION").when(F.col("confidence") < 0.6, "UNSURE").otherwise("OK")
    return observations(spark, d).groupBy(k.alias("kind")).agg(F.count("*").alias("n"))


# --- sorts and sets ---------------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def sort01_top_k(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50)


@query(f"select id, approval_status from {V} order by approval_status desc nulls last, id limit 100")
def sort02_nulls_last(spark, d):
    return versions(spark, d).select("id", "approval_status").orderBy(F.col("approval_status").desc_nulls_last(), "id").limit(100)


@query("select o_orderkey, (select count(*) from orders) as total from orders order by o_orderkey limit 25 offset 100")
def sort03_page(spark, d):
    """One page of rows with the count of all."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey").orderBy("o_orderkey").offset(100).limit(25).withColumn("total", F.lit(o.count()))


@query(f"""
select id, list_sort(list(code)) as missing from (select a.id, p.code from (select distinct id from {V}) a, (select distinct code from matrix_params where source_id) p where not exists (select 1 from rule_observations o where o.document_version_id = a.id and o.parameter_code = p.code)) group by 1
""")
def set01_missing(spark, d):
    """Expected parameters of a version that were not read: arrays, no join of all pairs."""
    codes = F.lit(few(table(spark, d, "matrix_params").filter("source_id").select("code").distinct(), 100_000) or None).cast("array<string>")
    got = table(spark, d, "rule_observations").groupBy(F.col("document_version_id").alias("id")).agg(F.collect_set("parameter_code").alias("got"))
    j = versions(spark, d).select("id").join(got, "id", "left").select("id", F.array_sort(F.array_except(F.coalesce(codes, F.array().cast("array<string>")), F.coalesce("got", F.array().cast("array<string>")))).alias("missing"))
    return j.filter(F.size("missing") > 0)


@query(f"""
with s as (select parameter_code, list(distinct document_version_id) filter (where stage = 'PD') as a, list(distinct document_version_id) filter (where stage = 'RD') as b from {O} group by 1)
select parameter_code, round(len(list_intersect(coalesce(a, []), coalesce(b, [])))::double / nullif(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), 0), 6) as jaccard from s
""")
def set02_jaccard(spark, d):
    """Likeness of the sets of versions of two stages, by counts of flags (no array holds a hot key's documents)."""
    o = observations(spark, d).groupBy("parameter_code", "document_version_id").agg(F.bool_or(F.col("stage") == "PD").alias("a"), F.bool_or(F.col("stage") == "RD").alias("b"))
    g = o.groupBy("parameter_code").agg(F.count_if(F.col("a") & F.col("b")).alias("i"), F.count_if(F.col("a") | F.col("b")).alias("u"))
    return g.select("parameter_code", F.round(F.col("i") / F.nullif("u", F.lit(0)), 6).alias("jaccard"))


@query("""
with a as (select o_orderkey as k, o_orderstatus as s, o_totalprice as t from orders where o_orderkey % 3 <> 0), b as (select o_orderkey as k, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as s, o_totalprice as t from orders where o_orderkey % 4 <> 0)
select coalesce(a.k, b.k) as k, case when b.k is null then 'removed' when a.k is null then 'added' when a.s is distinct from b.s or a.t is distinct from b.t then 'updated' else 'unchanged' end as change from a full outer join b on a.k = b.k
""")
def set04_version_diff(spark, d):
    """Two made versions of a table, row by row with null-safe comparison."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("t"))
    a = o.filter("k % 3 <> 0").withColumnsRenamed({"s": "s1", "t": "t1"}).withColumn("l", F.lit(1))
    b = o.filter("k % 4 <> 0").withColumn("s", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("s"))).withColumn("r", F.lit(1))
    same = F.col("s").eqNullSafe(F.col("s1")) & F.col("t").eqNullSafe(F.col("t1"))
    return a.join(b, "k", "full_outer").select("k", F.when(F.col("r").isNull(), "removed").when(F.col("l").isNull(), "added").when(same, "unchanged").otherwise("updated").alias("change"))


@query(f"""
select parameter_code, stage, normalized_value, max(confidence) as confidence, count(*) as n, list_sort(list(distinct document_version_id)) as docs from {O} where normalized_value is not null group by 1, 2, 3 having count(*) > 1
""")
def set05_merge_duplicates(spark, d):
    """Findings with one key merged: best confidence, all evidence."""
    o = observations(spark, d).filter("normalized_value is not null")
    return o.groupBy("parameter_code", "stage", "normalized_value").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"), F.array_sort(F.collect_set("document_version_id")).alias("docs")).filter("n > 1")


@query(f"select 'version' as kind, id, document_code as name from {V} union all select 'file', doc_id, filename from {_F}")
def set06_union_list(spark, d):
    a = versions(spark, d).select(F.lit("version").alias("kind"), "id", F.col("document_code").alias("name"))
    return a.unionByName(table(spark, d, "doc_facts").dropDuplicates(["doc_id"]).select(F.lit("file").alias("kind"), F.col("doc_id").alias("id"), F.col("filename").alias("name")))


@query("""
with o as (select o_orderkey as k, o_totalprice as basis, o_orderstatus = 'F' as decided from orders where o_orderkey % 3 <> 0), n as (select o_orderkey as k, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as basis from orders where o_orderkey % 4 <> 0)
select coalesce(o.k, n.k) as k, case when o.k is null then 'insert' when n.k is null and decided then 'flag' when n.k is null then 'delete' when o.basis is not distinct from n.basis then 'keep' when decided then 'reverify' else 'replace' end as action from o full outer join n on o.k = n.k
""")
def rev01_upsert_actions(spark, d):
    """What a new run does to each stored row."""
    o = table(spark, d, "orders")
    old = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("basis"), (F.col("o_orderstatus") == "F").alias("decided"))
    new = o.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("basis"))
    return state.upsert_actions(old, new, ["k"], "basis", "decided")


# --- document composites ----------------------------------------------------------------------


@query(f"""
select doc_id, min(doc_id) over (partition by stage, sha256) as kept_id, (select count(distinct g.stage) from {_F} g where g.sha256 = f.sha256) > 1 as cross_stage from {_F} f where sha256 is not null
""")
def doc01_integrity(spark, d):
    """Copies within a stage fold to the smallest id; copies across stages are reported."""
    f = table(spark, d, "doc_facts").dropDuplicates(["doc_id"]).filter("sha256 is not null").select("doc_id", "stage", "sha256")
    a = f.groupBy("stage", "sha256").agg(F.min("doc_id").alias("kept_id"))
    b = f.groupBy("sha256").agg((F.countDistinct("stage") > 1).alias("cross_stage"))
    return f.join(a.withColumnRenamed("stage", "s2"), (f.sha256 == a.sha256) & F.col("stage").eqNullSafe(F.col("s2")), "inner").drop(a.sha256).join(b, "sha256").select("doc_id", "kept_id", "cross_stage")


@query(f"""
select object_id, bool_or(dataset_stage = 'PD') as pd, bool_or(dataset_stage = 'RD') as rd, bool_or(dataset_stage = 'ID') as id,
 case when bool_or(dataset_stage = 'PD') and bool_or(dataset_stage = 'RD') and bool_or(dataset_stage = 'ID') then 'FULL' when bool_or(dataset_stage = 'PD') and bool_or(dataset_stage = 'RD') then 'PD_RD_ONLY' else 'PARTIAL' end as scenario from {V} group by 1
""")
def doc04_scenario(spark, d):
    s = {k: F.bool_or(F.col("dataset_stage") == k.upper()) for k in ("pd", "rd", "id")}
    g = versions(spark, d).groupBy("object_id").agg(*[v.alias(k) for k, v in s.items()])
    sc = F.when(F.col("pd") & F.col("rd") & F.col("id"), "FULL").when(F.col("pd") & F.col("rd"), "PD_RD_ONLY").otherwise("PARTIAL")
    return g.withColumn("scenario", sc)


_T = f"""(select p.parameter_code, p.location, a.v as expected, b.v as later, r.kind, r.pct, r.op, r.threshold, r.threshold_unit, m.unit from (select distinct parameter_code, location from {O} where location is not null) p
 join {_SIDE.format(n=SQLNUM, o=O, s="PD")} a using (parameter_code, location) join {_SIDE.format(n=SQLNUM, o=O, s="RD")} b using (parameter_code, location) join trigger_rules r on r.code = p.parameter_code join matrix_params m on m.code = p.parameter_code)"""


def _pairs(spark, d):
    o = observations(spark, d).filter("location is not null").select("parameter_code", "location", "stage", number("normalized_value").alias("v"))
    keys = ["parameter_code", "location"]
    a = C.unique_keys(o.filter("stage = 'PD'"), keys).select(*keys, F.col("v").alias("expected"))
    b = C.unique_keys(o.filter("stage = 'RD'"), keys).select(*keys, F.col("v").alias("later"))
    r = small(table(spark, d, "trigger_rules").withColumnRenamed("code", "parameter_code"))
    m = small(table(spark, d, "matrix_params").select(F.col("code").alias("parameter_code"), "unit"))
    return a.join(b, keys).join(r, "parameter_code").join(m, "parameter_code")


def _norm_unit(c: str):
    return F.regexp_replace(F.translate(F.lower(F.trim(c)), "²³", "23"), r"[\s.]+", "")


@query(f"""
select parameter_code, location, case when expected is null or later is null then 'UNDETERMINED'
 when kind in ('DECREASE', 'INCREASE') then case when abs(later - expected) > greatest(0.01, abs(expected) * 0.001) and (case when kind = 'DECREASE' then later < expected else later > expected end) and not coalesce(coalesce(pct, 0) <> 0 and expected <> 0 and abs(later - expected) / abs(expected) * 100 <= pct, false) then 'FIRES' else 'NOT_FIRING' end
 when kind = 'ANY_CHANGE_PCT' then case when abs(later - expected) > greatest(0.01, abs(expected) * 0.001) and (coalesce(pct, 0) = 0 or expected = 0 or abs(later - expected) / abs(expected) * 100 > pct) then 'FIRES' else 'NOT_FIRING' end
 when kind = 'ABS_THRESHOLD' and regexp_replace(translate(lower(trim(unit)), '²³', '23'), '[\\s.]+', '', 'g') <> regexp_replace(translate(lower(trim(threshold_unit)), '²³', '23'), '[\\s.]+', '', 'g') then 'UNDETERMINED'
 when kind = 'ABS_THRESHOLD' and later > 0 and threshold > 0 and (later / threshold > 200 or later / threshold < 1 / 200.0) then 'UNDETERMINED'
 when kind = 'ABS_THRESHOLD' then case when (op = '<' and later < threshold) or (op = '<=' and later <= threshold) or (op = '>' and later > threshold) or (op = '>=' and later >= threshold) then 'FIRES' else 'NOT_FIRING' end
 else 'UNDETERMINED' end as outcome from {_T}
""")
def num03_trigger_numeric(spark, d):
    """Rules over the change of a value between stages, with three outcomes."""
    p = _pairs(spark, d)
    out = C.trigger_numeric(F.col("kind"), F.col("pct"), F.col("op"), F.col("threshold"), F.col("expected"), F.col("later"), _norm_unit("unit") == _norm_unit("threshold_unit"))
    return p.select("parameter_code", "location", out.alias("outcome"))


@query("""
with o as (select ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'] as l), x as (select o_orderkey, o_custkey, o_orderpriority as later, lag(o_orderpriority) over (partition by o_custkey order by o_orderdate, o_orderkey) as expected from orders)
select o_orderkey, case when expected is null or coalesce(list_position(l, expected), 0) = 0 or coalesce(list_position(l, later), 0) = 0 then 'UNDETERMINED' when list_position(l, later) < list_position(l, expected) then 'FIRES' else 'NOT_FIRING' end as outcome from x, o
""")
def num04_trigger_grade(spark, d):
    """A downgrade by place in an ordered list."""
    order = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    o = table(spark, d, "orders").withColumn("expected", F.lag("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return o.select("o_orderkey", C.trigger_grade(order, F.col("expected"), F.col("o_orderpriority")).alias("outcome"))


@query("""
select l_orderkey, case when bool_or(l_quantity > 45) then 'FIRES' when bool_or(l_discount = 0) then 'UNDETERMINED' else 'NOT_FIRING' end as outcome from lineitem group by 1
""")
def num05_trigger_components(spark, d):
    """One outcome of several components: the strongest by order, as an aggregate."""
    s = F.when(F.col("l_quantity") > 45, "FIRES").when(F.col("l_discount") == 0, "UNDETERMINED").otherwise("NOT_FIRING")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(s).alias("s")).select("l_orderkey", C.any_component(F.col("s")).alias("outcome"))


@query(f"""
select parameter_code, location, case when expected is null or later is null then 'incomplete' when kind is null then 'no_rule' when (expected > 0 and later > 0 and greatest(expected, later) / least(expected, later) >= 20) then 'magnitude' end as gate,
 case when expected is null or later is null then 'NOT_COMPARABLE' when (expected > 0 and later > 0 and greatest(expected, later) / least(expected, later) >= 20) then 'NOT_COMPARABLE' when abs(later - expected) > greatest(0.01, abs(expected) * 0.001) then 'CANDIDATE' else 'EQUAL' end as verdict from {_T}
""")
def doc08_gate_and_verdict(spark, d):
    """Why two values cannot be compared, first reason that holds; else what the comparison says."""
    e, l = F.col("expected"), F.col("later")
    far = C.magnitude_gate(e, l)
    gate = C.first_reason((e.isNull() | l.isNull(), "incomplete"), (F.col("kind").isNull(), "no_rule"), (far, "magnitude"))
    verdict = F.when(e.isNull() | l.isNull() | far, "NOT_COMPARABLE").when(C.changed(e, l), "CANDIDATE").otherwise("EQUAL")
    return _pairs(spark, d).select("parameter_code", "location", gate.alias("gate"), verdict.alias("verdict"))
