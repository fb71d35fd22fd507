"""Queries of schedules, searches over pages, merged answers, imports and reports, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.functions.chars import FOLD_FROM, FOLD_TO, INVISIBLE
from dossia.operators import compare, schedules, state, statistics
from dossia.operators.units import few, small
from dossia.plans import relational as R
from dossia.plans.elements import fresh
from dossia.plans.extraction import C, FACTS, M, P, _PAIRS, params
from dossia.plans.relational import O, V, number, observations, versions
from dossia.session import materialize, table
from dossia.sources import outputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


# --- schedules ----------------------------------------------------------------------------------

# headings as the roles know them: look-alike letters as Cyrillic, no characters without ink
FOLD = f"regexp_replace(translate(c, '{FOLD_FROM}', '{FOLD_TO}'), '[{INVISIBLE}]', '', 'g')"
_ROWS = rf"""(with t as (select chunk_id, unnest(list_distinct(regexp_extract_all(replace(text, chr(13), ''), '\[TABLE [0-9]+\][^\n]*\n(?:[^\n]*\|[^\n]*(?:\n|$))+'))) as t from {C} where contains(text, '[TABLE ')),
l as (select chunk_id, regexp_extract(t, '^\[TABLE ([0-9]+)\]', 1)::int as table_no, list_filter(string_split(t, chr(10)), lambda x: x <> '') as lines from t),
h as (select chunk_id, table_no, list_transform(string_split(lines[2], '|'), lambda c: lower(trim({FOLD}))) as heads, unnest(lines[3:]) as line, generate_subscripts(lines[3:], 1) - 1 as row_no from l),
r as (select chunk_id, table_no, row_no::int as row_no, heads, list_transform(string_split(line, '|'), lambda c: trim(c)) as cells from h)
select chunk_id, table_no, row_no, nullif(cells[list_position(heads, 'поз.')], '') as key, nullif(cells[list_position(heads, 'наименование')], '') as name, nullif(cells[list_position(heads, 'кол.')], '') as quantity, nullif(cells[list_position(heads, 'примечание')], '') as note from r)"""


def _schedule(spark: SparkSession, d: str) -> DataFrame:
    return schedules.rows(schedules.tables(table(spark, d, "chunks").dropDuplicates(["chunk_id"]), "chunk_id", "text"), "chunk_id")


@query(f"select chunk_id, table_no, row_no, key, name, quantity, note from {_ROWS}")
def doc11_schedule_rows(spark, d):
    """Rows of the tables in texts, their columns by the roles of the headings."""
    return _schedule(spark, d).select("chunk_id", "table_no", "row_no", "key", "name", "quantity", "note")


@query(f"""
with r as (select regexp_replace(name, '\\s*[0-9]+$', '') as name, try_cast(quantity as double) as q from {_ROWS} where name is not null), g as (select name, count(*) as n, sum(q) as total, min(q) as least, max(q) as most from r where q is not null group by 1)
select name, n, total, case when n > 1 then round((most - least) / nullif(least, 0) * 100, 4) end as deviation_pct, n > 1 and most > least as is_suggestion from g
""")
def doc25_schedule_deviation(spark, d):
    """Quantities of one name over all schedules: total, and how far they are apart; no threshold is set for them, so any difference is a suggestion."""
    q = F.col("quantity").try_cast("double")
    r = _schedule(spark, d).filter("name is not null").select(F.regexp_replace("name", r"\s*[0-9]+$", "").alias("name"), q.alias("q")).filter("q is not null")
    g = r.groupBy("name").agg(F.count("*").alias("n"), F.sum("q").alias("total"), F.min("q").alias("least"), F.max("q").alias("most"))
    apart = F.when(F.col("n") > 1, F.round((F.col("most") - F.col("least")) / F.nullif("least", F.lit(0.0)) * 100, 4))
    return g.select("name", "n", "total", apart.alias("deviation_pct"), ((F.col("n") > 1) & (F.col("most") > F.col("least"))).alias("is_suggestion"))


@query(f"""
with r as (select chunk_id, table_no, row_no, lower(note) as material from {_ROWS} where note is not null)
select document_id, table_no, material, count(*) as n, list_sort(list(row_no)) as row_nos from r join {C} c using (chunk_id) group by 1, 2, 3 having count(*) > 1
""")
def doc23_repeated_keys(spark, d):
    """What the schedules of a document leave unclear if rows are known by their material: those that stand more than once in a table, with the rows that may be meant."""
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "document_id")
    k = _schedule(spark, d).filter("note is not null").select("chunk_id", "table_no", "row_no", F.lower("note").alias("material")).join(c, "chunk_id")
    return k.groupBy("document_id", "table_no", "material").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("row_no")).alias("row_nos")).filter("n > 1")


# --- extraction and search ------------------------------------------------------------------


@query(f"""
with o as (select observation_id, context from {O} where context is not null)
select observation_id, 'count' as kind, regexp_extract(context, 'в количестве ([0-9]+) штук', 1) as value from o where regexp_matches(context, 'в количестве ([0-9]+) штук')
union all select observation_id, 'grade', regexp_extract(context, '(В[0-9]{{2}}|W[0-9]+|А500С)', 1) from o where regexp_matches(context, '(В[0-9]{{2}}|W[0-9]+|А500С)')
union all select observation_id, 'compound', regexp_extract(context, '([0-9]+[хx][0-9]+)', 1) from o where regexp_matches(context, '([0-9]+[хx][0-9]+)')
union all select observation_id, 'number', regexp_extract(context, '(?:длиной|площадью|объёмом|массой) ([0-9]+(?:,[0-9]+)?)', 1) from o where regexp_matches(context, '(?:длиной|площадью|объёмом|массой) ([0-9]+(?:,[0-9]+)?)')
""")
def doc07_generic_observations(spark, d):
    """Numbers, grades, compounds and counts of a context, each by its extractor, in one pass."""
    kinds = {"count": r"в количестве ([0-9]+) штук", "grade": r"(В[0-9]{2}|W[0-9]+|А500С)", "compound": r"([0-9]+[хx][0-9]+)", "number": r"(?:длиной|площадью|объёмом|массой) ([0-9]+(?:,[0-9]+)?)"}
    o = observations(spark, d).filter("context is not null")
    found = F.array_compact(F.array(*[F.when(F.col("context").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("context", p, 1).alias("value"))) for k, p in kinds.items()]))
    return o.select("observation_id", F.explode(found).alias("f")).select("observation_id", "f.kind", "f.value")


@query(f"""
with o as (select observation_id, document_version_id, regexp_extract(context, 'чертеже ([0-9]+)', 1) as sought from {O} where regexp_matches(context, 'чертеже ([0-9]+)'))
select o.observation_id, min(p.page_number) as page_number, count(*) as n_pages from o join {P} p on p.document_version_id = o.document_version_id where contains(p.text, o.sought) group by 1
""")
def doc19_confirming_page(spark, d):
    """The first page of an observation's own document that holds the sought value."""
    o = observations(spark, d).select("observation_id", "document_version_id", F.regexp_extract("context", "чертеже ([0-9]+)", 1).alias("sought")).filter("sought <> ''")
    p = table(spark, d, "ocr_pages").dropDuplicates(["page_id"]).filter("text is not null").select("document_version_id", "page_number", "text")
    return o.join(p, "document_version_id").filter(F.contains("text", F.col("sought"))).groupBy("observation_id").agg(F.min("page_number").alias("page_number"), F.count("*").alias("n_pages"))


_STEMS = "list_distinct(list_transform(regexp_extract_all(lower({c}), '[а-яё]{{4,}}'), lambda w: left(w, 6)))"


@query(f"""
with m as (select code, unnest({_STEMS.format(c='parameter_name')}) as stem from {M}), p as (select page_id, unnest({_STEMS.format(c='text')}) as stem from {P} where text is not null), n as (select count(*) as n from {P} where text is not null),
w as (select stem, ln((any_value(n.n) + 1)::double / (count(*) + 1)) + 0.1 as weight from p, n where stem in (select stem from m) group by stem), t as (select m.code, sum(coalesce(w.weight, 0)) as total from m left join w using (stem) group by 1),
h as (select p.page_id, m.code, sum(w.weight) as got from p join m using (stem) join w using (stem) group by 1, 2)
select page_id, code, round(got / total, 4) as coverage from h join t using (code) where got / total >= 0.45 and (select count(*) from m x where x.code = h.code) >= 2
""")
def hyp04_rare_stem_pages(spark, d):
    """Pages that hold most of the weight of a parameter's stems, rare stems weighing more; an inverted index joined with the few stems that are sought."""
    stems = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit("[а-яё]{4,}"), F.lit(0)), lambda w: F.substring(w, 1, 6)))
    m = small(params(spark, d).select("code", F.explode(stems(F.col("parameter_name"))).alias("stem")))
    pages = table(spark, d, "ocr_pages").dropDuplicates(["page_id"]).filter("text is not null")
    n = pages.count()
    p = materialize(pages.select("page_id", F.explode(stems(F.col("text"))).alias("stem")).join(small(m.select("stem").distinct()), "stem", "left_semi"))
    w = small(p.groupBy("stem").agg(F.count("*").alias("df")).select("stem", statistics.inverse_frequency(F.lit(n), F.col("df")).alias("weight")))
    t = small(m.join(w, "stem", "left").groupBy("code").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("total"), F.count("*").alias("n_stems")))
    h = p.join(w, "stem").join(m, "stem").groupBy("page_id", "code").agg(F.sum("weight").alias("got")).join(t, "code")
    return h.filter("got / total >= 0.45 and n_stems >= 2").select("page_id", "code", F.round(F.col("got") / F.col("total"), 4).alias("coverage"))


@query(f"""
with w as (select code, list_distinct(list_transform(regexp_extract_all(lower(parameter_name), '[а-яё]{{4,}}'), lambda w: left(w, 6))) as stems from {M}), o as (select observation_id, list_distinct(list_transform(regexp_extract_all(lower(context), '[а-яё]{{4,}}'), lambda w: left(w, 6))) as stems from {O} where context is not null),
s as (select o.observation_id, w.code, len(list_intersect(o.stems, w.stems))::double / len(w.stems) as share from o, w), k as (select *, row_number() over (partition by observation_id order by share desc, code) as rn from s where share > 0) select observation_id, code, round(share, 4) as share from k where rn = 1
""")
def str16_best_row(spark, d):
    """The parameter most of whose name stands in a context, where no anchor is found: the stems of contexts joined with the few stems of names."""
    stems = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit("[а-яё]{4,}"), F.lit(0)), lambda w: F.substring(w, 1, 6)))
    names = params(spark, d).select("code", stems(F.col("parameter_name")).alias("stems")).filter(F.size("stems") > 0)
    known = small(names.select("code", F.size("stems").alias("n"), F.explode("stems").alias("stem")))
    own = observations(spark, d).filter("context is not null").select("observation_id", F.explode(stems(F.col("context"))).alias("stem"))
    shared = own.join(known, "stem").groupBy("observation_id", "code").agg((F.count("*") / F.first("n")).alias("share"))
    best = shared.groupBy("observation_id").agg(F.min(F.struct((-F.col("share")).alias("minus"), "code")).alias("b"))
    return best.select("observation_id", "b.code", F.round(-F.col("b.minus"), 4).alias("share"))


@query(f"""
select page_id, nullif(regexp_extract(text, 'этажа? ([0-9]+)', 1), '') as floor, nullif(regexp_extract(text, 'Секции ([0-9]+)', 1), '') as section, nullif(regexp_extract(text, 'чертеже ([0-9]+)', 1), '') as drawing, list_sort(list_distinct(regexp_extract_all(text, 'помещении ([0-9]+\\.[0-9]+)', 1))) as rooms,
 case when contains(text, '[TABLE') then 'table' when regexp_matches(text, '^\\s*(Лист|стр)') then 'sheet' else 'text' end as kind from {P} where text is not null
""")
def hyp09_sheet_facts(spark, d):
    """What a page says of itself: floor, section, drawing, rooms, kind."""
    p = table(spark, d, "ocr_pages").dropDuplicates(["page_id"]).filter("text is not null")
    one = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    kind = F.when(F.contains("text", F.lit("[TABLE")), "table").when(F.col("text").rlike(r"^\s*(Лист|стр)"), "sheet").otherwise("text")
    return p.select("page_id", one("этажа? ([0-9]+)").alias("floor"), one("Секции ([0-9]+)").alias("section"), one("чертеже ([0-9]+)").alias("drawing"), F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"помещении ([0-9]+\.[0-9]+)"), F.lit(1)))).alias("rooms"), kind.alias("kind"))


@query(f"""
with t as (select 'page' as source, page_id as id, len(regexp_extract_all(lower(text), 'насос')) as hits from {P} where contains(lower(text), 'насос') union all select 'chunk', chunk_id, len(regexp_extract_all(lower(text), 'насос')) from {C} where contains(lower(text), 'насос') union all select 'document', doc_id, len(regexp_extract_all(lower(text), 'насос')) from documents where contains(lower(text), 'насос')),
r as (select *, row_number() over (partition by source order by hits desc, id) as rn from t) select source, id, hits::int as hits from r where rn <= 5
""")
def rag04_merged_answers(spark, d):
    """The five best of each kind of source for one question; a kind without any does not spoil the others."""
    kinds = {"page": ("ocr_pages", "page_id"), "chunk": ("chunks", "chunk_id"), "document": ("documents", "doc_id")}
    out = None
    for name, (t, key) in kinds.items():
        hits = F.size(F.regexp_extract_all(F.lower("text"), F.lit("насос"), F.lit(0)))
        best = table(spark, d, t).dropDuplicates([key]).select(F.lit(name).alias("source"), F.col(key).alias("id"), hits.alias("hits")).filter("hits > 0").orderBy(F.col("hits").desc(), "id").limit(5)
        out = best if out is None else out.unionByName(best)
    return out


@query(f"select page_id, len(regexp_extract_all(text, '[0-9]+'))::bigint as n_numbers, sha256(lower(regexp_extract(text, '^[^\\n]*'))) as fingerprint from {P} where text is not null and regexp_matches(text, '[0-9]')")
def udf02_match_function(spark, d):
    """A function the caller gives is run over each page and says what it found, with a fingerprint; pages it does not match give no row."""
    import hashlib
    import re

    def match(text: str):
        numbers = re.findall("[0-9]+", text)
        return (len(numbers), hashlib.sha256(text.split("\n", 1)[0].lower().encode()).hexdigest()) if numbers else None

    def run(batches):
        for pdf in batches:
            rows = [(k, *m) for k, t in zip(pdf["page_id"], pdf["text"]) if t is not None and (m := match(t))]
            yield pd.DataFrame(rows, columns=["page_id", "n_numbers", "fingerprint"])

    p = table(spark, d, "ocr_pages").dropDuplicates(["page_id"]).select("page_id", "text")
    return p.mapInPandas(run, "page_id long, n_numbers long, fingerprint string")


# --- state, imports, reports ----------------------------------------------------------------


@query(f"select parameter_code, location, case when outcome is null then 'NO_RULE' when abs(coalesce(later, 0) - coalesce(expected, 0)) <= greatest(0.01, 0.001 * abs(expected)) then 'NEGATIVE_VERIFIED' when outcome = 'NOT_FIRING' then 'NEGATIVE_VERIFIED' when outcome in ('UNDETERMINED', 'NOT_EVALUABLE') then 'SUGGESTION' else 'CANDIDATE' end as verdict from (select x.parameter_code, x.location, x.outcome, c.left_value as expected, c.right_value as later from ({R.SQL['num03_trigger_numeric']}) x join {_PAIRS} c using (parameter_code, location) where c.left_value is not null and c.right_value is not null)")
def doc09_verdict(spark, d):
    """The verdict of a pair from its difference and the outcome of its trigger."""
    x = R.num03_trigger_numeric(spark, d)
    c = R.join06_keyed_compare(spark, d).filter("left_value is not null and right_value is not null").select("parameter_code", "location", "left_value", "right_value")
    v = F.when(F.col("outcome").isNull(), "NO_RULE").when(~compare.changed(F.col("left_value"), F.col("right_value")) | (F.col("outcome") == "NOT_FIRING"), "NEGATIVE_VERIFIED").when(F.col("outcome").isin("UNDETERMINED", "NOT_EVALUABLE"), "SUGGESTION").otherwise("CANDIDATE")
    return x.join(c, ["parameter_code", "location"]).select("parameter_code", "location", v.alias("verdict"))


@query("""
with s as (select o_orderkey as k, o_totalprice as v, o_orderstatus = 'F' as reviewed from orders where o_orderkey % 3 <> 0), n as (select o_orderkey as k, o_totalprice + 1 as v from orders where o_orderkey % 4 <> 0)
select coalesce(s.k, n.k) as k, case when s.reviewed or n.k is null then s.v else n.v end as v, coalesce(s.reviewed, false) as reviewed from s full join n on s.k = n.k
""")
def hyp10_stored_rows(spark, d):
    """Stored rows after a new run: reviewed ones kept, others replaced, new ones added."""
    o = table(spark, d, "orders")
    s = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") == "F").alias("reviewed"))
    n = o.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1).alias("v"))
    return state.stored(s, n, "k", "v", "reviewed")


@query(f"select observation_id, parameter_code, confidence from {O}")
def src11_import(spark, d):
    """Two deliveries of annotations as JSON lines, imported one after the other: typed, one row a natural key, the later one counts."""
    o = observations(spark, d).select("observation_id", "parameter_code", "confidence")
    first, second = fresh(spark, "json"), fresh(spark, "json")
    o.filter("observation_id % 2 = 0").withColumn("confidence", F.lit(0.0)).write.json(first)
    o.write.json(second)
    schema = "observation_id long, parameter_code string, confidence double"
    read = spark.read.schema(schema).json(first).withColumn("delivery", F.lit(1)).unionByName(spark.read.schema(schema).json(second).withColumn("delivery", F.lit(2)))
    last = read.groupBy("observation_id").agg(F.max_by(F.struct("parameter_code", "confidence"), "delivery").alias("r"))
    return last.select("observation_id", "r.*")


@query(f"""
select 'by_stage' as section, coalesce(stage, '-') as name, count(*)::double as value from {O} group by 2 union all select 'by_extractor', extractor, round(avg(confidence), 6) from {O} group by 2 union all select 'total', 'documents', count(*)::double from {V}
""")
def snk05_report(spark, d):
    """A report as rows of section, name and value, from small aggregates."""
    o = observations(spark, d)
    parts = [
        o.groupBy(F.coalesce("stage", F.lit("-")).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("by_stage").alias("section"), "name", "value"),
        o.groupBy(F.col("extractor").alias("name")).agg(F.round(F.avg("confidence"), 6).alias("value")).select(F.lit("by_extractor").alias("section"), "name", "value"),
        versions(spark, d).agg(F.count("*").cast("double").alias("value")).select(F.lit("total").alias("section"), F.lit("documents").alias("name"), "value"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"select code, parameter_name, coalesce(unit, '') as unit from {M}")
def snk03_xml(spark, d):
    """Rows written as XML and read back."""
    folder = f"{fresh(spark, 'xml')}"
    outputs.write_xml(params(spark, d).select("code", "parameter_name", F.coalesce("unit", F.lit("")).alias("unit")), folder)
    x = spark.read.option("rowTag", "row").schema("code string, parameter_name string, unit string").xml(folder)
    return x.select("code", "parameter_name", F.coalesce("unit", F.lit("")).alias("unit"))


@query(f"""
with r as (select * from (values ('high', 1000.0, true), ('low', 1.0, true), ('off', 0.0, false)) r(rule, bound, enabled)), o as (select {R.SQLNUM} as v from {O})
select rule, count(*) filter (where v > bound) as n_above, count(*) filter (where v is null) as n_unknown from o, r where enabled group by 1
""")
def udf04_rule_table(spark, d):
    """Rules kept as rows, switched on and off there: each enabled one counts in the same pass over the values."""
    rules = spark.createDataFrame([("high", 1000.0, True), ("low", 1.0, True), ("off", 0.0, False)], "rule string, bound double, enabled boolean")
    on = few(rules.filter("enabled").select(F.struct("rule", "bound")), 1_000)
    o = observations(spark, d).select(number("normalized_value").alias("v"))
    one = o.agg(*[F.struct(F.lit(r.rule).alias("rule"), F.count_if(F.coalesce(F.col("v") > r.bound, F.lit(False))).alias("n_above"), F.count_if(F.col("v").isNull()).alias("n_unknown")).alias(f"r{i}") for i, r in enumerate(on)])
    return one.select(F.explode(F.array(*[F.col(f"r{i}") for i in range(len(on))])).alias("r")).select("r.*")
