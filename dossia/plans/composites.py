"""Queries of composite operators over documents, findings and entities, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossia.functions import text as T
from dossia.operators import compare as C
from dossia.operators import entities, statistics, units, vectors
from dossia.operators.ordered import lag_by, ranks_by
from dossia.operators.units import few, small
from dossia.plans import relational as R
from dossia.plans.relational import O, SQLNUM, V, number, observations, versions
from dossia.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


M = "(select distinct on (code) * from matrix_params)"


def params(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "matrix_params").dropDuplicates(["code"])


@query("select distinct chunk_id from chunks where text ilike '%насосн%котельн%' or text ilike '%ливнев%' or text ilike '%вентиляционное сопряжение%'")
def flt02_any_pattern(spark, d):
    """A disjunction of case-blind patterns."""
    c = table(spark, d, "chunks")
    hit = None
    for p in ("%насосн%котельн%", "%ливнев%", "%вентиляционное сопряжение%"):
        hit = F.col("text").ilike(p) if hit is None else hit | F.col("text").ilike(p)
    return c.filter(hit).select("chunk_id").distinct()


@query(f"""
select code, len(string_split(trim(parameter_name), ' ')) >= 2 and length(parameter_name) >= 8 and lower(coalesce(unit, '')) not in ('', 'класс') as numeric_ok, lower(coalesce(unit, '')) = 'класс' as enum_ok from {M}
""")
def flt09_eligibility(spark, d):
    """Which extractor a parameter is fit for."""
    u = F.lower(F.coalesce("unit", F.lit("")))
    name = F.col("parameter_name")
    return params(spark, d).select("code", ((F.size(F.split(F.trim(name), " ")) >= 2) & (F.length(name) >= 8) & ~u.isin("", "класс")).alias("numeric_ok"), (u == "класс").alias("enum_ok"))


@query(f"select section, code, review_priority from {M} where source_pd and unit is not null order by section, code")
def flt11_active_parameters(spark, d):
    return params(spark, d).filter("source_pd and unit is not null").select("section", "code", "review_priority").orderBy("section", "code")


@query(f"""
select v.id, count(*) as n_params from {V} v join (select distinct document_version_id, parameter_code from rule_observations) o on o.document_version_id = v.id join {M} p on p.code = o.parameter_code and (v.discipline is null or starts_with(v.discipline, p.section)) group by 1
""")
def flt12_discipline(spark, d):
    """Parameters that apply to a version's discipline; an unknown one is open to all."""
    o = table(spark, d, "rule_observations").select(F.col("document_version_id").alias("id"), F.col("parameter_code").alias("code")).distinct()
    j = o.join(versions(spark, d).select("id", "discipline"), "id").join(small(params(spark, d).select("code", "section")), "code")
    return j.filter(F.col("discipline").isNull() | F.col("discipline").startswith(F.col("section"))).groupBy("id").agg(F.count("*").alias("n_params"))


@query(f"""
with o as (select observation_id, parameter_code, location, stage, normalized_value from {O}), l as (select * from o where stage = 'PD'), r as (select * from o where stage = 'RD'),
m1 as (select l.observation_id as l, r.observation_id as r, 'location' as how from (select parameter_code, location, min(observation_id) as observation_id from l where location is not null group by 1, 2 having count(*) = 1) l join (select parameter_code, location, min(observation_id) as observation_id from r where location is not null group by 1, 2 having count(*) = 1) r using (parameter_code, location)),
l2 as (select * from l where observation_id not in (select l from m1)), r2 as (select * from r where observation_id not in (select r from m1)),
m2 as (select l.observation_id, r.observation_id, 'value' from (select parameter_code, normalized_value, min(observation_id) as observation_id from l2 where normalized_value is not null group by 1, 2 having count(*) = 1) l join (select parameter_code, normalized_value, min(observation_id) as observation_id from r2 where normalized_value is not null group by 1, 2 having count(*) = 1) r using (parameter_code, normalized_value))
select * from m1 union all select * from m2
""")
def join07_fallback_keys(spark, d):
    """First the key, then for what is left another one, each unique on both sides."""
    o = observations(spark, d).select("observation_id", "parameter_code", "location", "stage", "normalized_value")
    left, right = o.filter("stage = 'PD'"), o.filter("stage = 'RD'")
    out = None
    for key, how in (("location", "location"), ("normalized_value", "value")):
        keys = ["parameter_code", key]
        a = C.unique_keys(left.filter(F.col(key).isNotNull()), keys).select(*keys, F.col("observation_id").alias("l"))
        b = C.unique_keys(right.filter(F.col(key).isNotNull()), keys).select(*keys, F.col("observation_id").alias("r"))
        m = a.join(b, keys).select("l", "r", F.lit(how).alias("how"))
        out = m if out is None else out.unionByName(m)
        left, right = left.join(m, left.observation_id == m.l, "left_anti"), right.join(m, right.observation_id == m.r, "left_anti")
    return out


@query(f"""
with p as ({R.SQL['join08_scored_pairs']}), s as (select *, overlap + 0.5 * jaccard as score from p), b as (select *, max(score) over (partition by id_b) as top from s)
select id_b, id_a, round(score, 6) as score from (select b.*, row_number() over (partition by b.id_b order by v.created_at desc, b.score desc, b.id_a) as rn from b join {V} v on v.id = b.id_a where b.score >= 0.8 * b.top) where rn = 1
""")
def join09_best_of_band(spark, d):
    """Of candidates near the best score the newest, then the best."""
    p = R.join08_scored_pairs(spark, d).withColumn("score", F.col("overlap") + 0.5 * F.col("jaccard"))
    p = p.withColumn("top", F.max("score").over(Window.partitionBy("id_b"))).filter("score >= 0.8 * top").join(versions(spark, d).select(F.col("id").alias("id_a"), "created_at"), "id_a")
    return C.top_per_key(p, ["id_b"], [F.col("created_at").desc(), F.col("score").desc(), F.col("id_a")]).select("id_b", "id_a", F.round("score", 6).alias("score"))


@query(f"""
select g.observation_id as gold_id, p.observation_id as found_id from {O} g left join (select *, row_number() over (partition by parameter_code, location order by confidence desc nulls last, observation_id) as rn from {O} where stage <> 'PD' and location is not null) p
 on p.parameter_code = g.parameter_code and p.location = g.location and p.rn = 1 where g.stage = 'PD'
""")
def join14_alignment(spark, d):
    """Every gold row with the best found row of its key."""
    o = observations(spark, d)
    best = C.top_per_key(o.filter("stage <> 'PD' and location is not null"), ["parameter_code", "location"], [F.col("confidence").desc_nulls_last(), F.col("observation_id")]).select("parameter_code", "location", F.col("observation_id").alias("found_id"))
    return o.filter("stage = 'PD'").join(best, ["parameter_code", "location"], "left").select(F.col("observation_id").alias("gold_id"), "found_id")


@query(f"""
select c.chunk_id, count(o.observation_id) as n_related from (select distinct on (chunk_id) * from chunks) c left join {O} o on o.document_version_id = c.document_id and o.page = c.page_number where c.text ilike '%ливнев%' group by 1
""")
def join20_related(spark, d):
    """Observations on the pages of the hits."""
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).filter(F.col("text").ilike("%ливнев%")).select("chunk_id", "document_id", "page_number")
    o = observations(spark, d).groupBy(F.col("document_version_id").alias("document_id"), F.col("page").alias("page_number")).agg(F.count("*").alias("n"))
    return c.join(o, ["document_id", "page_number"], "left").select("chunk_id", F.coalesce("n", F.lit(0)).alias("n_related"))


@query(f"""
select f.doc_id, coalesce(f.pages, o.top) as pages, f.pages is null and o.top is not null as filled from (select distinct on (doc_id) * from doc_facts) f left join (select document_version_id, max(page) as top from {O} group by 1) o on o.document_version_id = f.doc_id
""")
def agg18_backfill(spark, d):
    """A missing measure from the first thing that implies it."""
    o = observations(spark, d).groupBy(F.col("document_version_id").alias("doc_id")).agg(F.max("page").alias("top"))
    f = table(spark, d, "doc_facts").dropDuplicates(["doc_id"]).join(o, "doc_id", "left")
    return f.select("doc_id", F.coalesce("pages", "top").alias("pages"), (F.col("pages").isNull() & F.col("top").isNotNull()).alias("filled"))


@query(f"""
select object_id, count(distinct ('0x' || substr(sha256(document_code), 1, 8))::bigint % 3) as n_splits from {V} where document_code is not null group by 1
""")
def agg19_split_leakage(spark, d):
    """Objects whose documents fall into more than one split."""
    v = versions(spark, d).filter("document_code is not null").withColumn("s", statistics.hash_split(F.col("document_code")))
    return v.groupBy("object_id").agg(F.countDistinct("s").alias("n_splits"))


@query("""
with a as (select chunk_id, 0.8 as score from (select distinct chunk_id from chunks where text ilike '%ливнев%')), b as (select chunk_id, 0.6 as score from (select distinct chunk_id from chunks where text ilike '%насосн%'))
select chunk_id, max(score)::double as score from (select * from a union all select * from b) group by 1
""")
def set03_union_of_hits(spark, d):
    """Hits of two searches, the better score of each."""
    c = table(spark, d, "chunks").select("chunk_id", "text")
    a = c.filter(F.col("text").ilike("%ливнев%")).select("chunk_id", F.lit(0.8).alias("score"))
    b = c.filter(F.col("text").ilike("%насосн%")).select("chunk_id", F.lit(0.6).alias("score"))
    return a.unionByName(b).groupBy("chunk_id").agg(F.max("score").alias("score"))


@query("select doc_id, unnest(regexp_extract_all(text, '(?:СП|ГОСТ|IFC) ?[0-9]+(?:[.-][0-9]+)*')) as ref from documents where text is not null")
def str12_references(spark, d):
    """Identifiers of norms and codes in texts."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(?:СП|ГОСТ|IFC) ?[0-9]+(?:[.-][0-9]+)*"), F.lit(0))).alias("ref"))


@query(f"select code, trim(regexp_extract(parameter_name, '^([^(]+)', 1)) as head, regexp_extract(parameter_name, '\\(([^)]*)\\)', 1) as inside from {M}")
def str11_title_parts(spark, d):
    return params(spark, d).select("code", F.trim(F.regexp_extract("parameter_name", r"^([^(]+)", 1)).alias("head"), F.regexp_extract("parameter_name", r"\(([^)]*)\)", 1).alias("inside"))


@query("""
select doc_id, count(*) as n_claims from (select doc_id, unnest(string_split_regex(text, '[.!?]\\s+')) as s from documents where text is not null) where regexp_matches(s, 'полностью|отдельно|вручную') group by 1
""")
def str14_claims(spark, d):
    """Sentences with words of absolute claims."""
    s = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", r"[.!?]\s+")).alias("s"))
    return s.filter(F.col("s").rlike("полностью|отдельно|вручную")).groupBy("doc_id").agg(F.count("*").alias("n_claims"))


@query()
def str15_row_texts(spark, d):
    """The text of the row of each word: words of one page row joined in order."""
    o = observations(spark, d).filter("bbox_normalized is not null and value is not null")
    row = F.floor(F.col("bbox_normalized")[1] * 50)
    members = F.array_sort(F.collect_list(F.struct(F.col("bbox_normalized")[0].alias("x"), F.col("observation_id").alias("id"), F.col("value").alias("v"))))
    return o.groupBy("document_version_id", "page", row.alias("row_no")).agg(F.array_join(F.transform(members, lambda m: m["v"]), " ").alias("row_text"))


@query()
def num02_printed_precision(spark, d):
    """Lists of printed numbers of two stages that agree in no pair within one unit of the last place."""
    o = observations(spark, d).filter("location is not null").filter(F.col("normalized_value").rlike(r"^\d+(\.\d+)?$"))
    side = lambda s: F.array_sort(F.collect_set(F.when(F.col("stage") == s, F.col("normalized_value"))))
    g = o.groupBy("parameter_code", "location").agg(side("PD").alias("a"), side("RD").alias("b")).filter(F.size("a") * F.size("b") > 0)
    return g.select("parameter_code", "location", C.printed_precision_differs(F.col("a"), F.col("b")).alias("differs"))


@query()
def num07_unit_evidence(spark, d):
    """Where the unit of a reading comes from, by parameter: stated, another spelling or none of its own."""
    read = units.readings(table(spark, d, "rule_observations"), table(spark, d, "matrix_params")).dropDuplicates(["observation_id"])
    basis = F.when(F.col("own") & (F.col("unit_key") == F.col("target_key")), "stated").when(F.col("own"), "other_unit").when(F.col("unit_key") != F.col("target_key"), "context").otherwise("parameter")
    return read.groupBy("parameter_code", basis.alias("basis")).agg(F.count("*").alias("n"))


@query("""
with c as (select event_id, value, lag(value) over (partition by user_id, event_type order by ts, event_id) as p from events)
select event_id, case when p is null then 0 when value < p * 0.5 then 90 when value < p * 0.8 then 60 when abs(value - p) > greatest(0.01, abs(p) * 0.001) then 30 else 0 end as risk,
 case when p is null then 'none' when value < p * 0.5 then 'high' when value < p * 0.8 then 'medium' when abs(value - p) > greatest(0.01, abs(p) * 0.001) then 'low' else 'none' end as severity from c
""")
def num09_risk(spark, d):
    """A score of a change by how far a value fell."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("p", F.lag("value").over(w))
    v, p = F.col("value"), F.col("p")
    big, mid, any_change = v < p * 0.5, v < p * 0.8, C.changed(p, v)
    risk = F.when(p.isNull(), 0).when(big, 90).when(mid, 60).when(any_change, 30).otherwise(0)
    name = F.when(p.isNull(), "none").when(big, "high").when(mid, "medium").when(any_change, "low").otherwise("none")
    return e.select("event_id", risk.alias("risk"), name.alias("severity"))


@query("""
with q as (select embedding::double[] as e from embeddings where vec_id = 0), s as (select b.vec_id, list_cosine_similarity(b.embedding::double[], q.e) as s from embeddings b, q where b.vec_id <> 0), t as (select doc_id, lower(coalesce(text, '')) as t from documents)
select vec_id, round(0.32 * s + 0.62 * (contains(coalesce(t, ''), 'насос')::int + contains(coalesce(t, ''), 'чертеже')::int) / 2 + 1.2 * case when contains(coalesce(t, ''), 'на чертеже') then 0.2 else 0 end, 5) as score from s left join t on t.doc_id = s.vec_id
""")
def num12_hybrid_score(spark, d):
    """A vector and a lexical signal in one score: the vectors of texts and the words in them, every row against one query."""
    e = table(spark, d, "embeddings")
    one = e.filter("vec_id = 0").first()
    q = F.array(*[F.lit(float(x)) for x in one.embedding]) if one else F.lit(None).cast("array<double>")
    j = e.filter("vec_id <> 0").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.lower("text").alias("t")), "vec_id", "left")
    has = lambda w: F.coalesce(F.col("t").contains(w), F.lit(False)).cast("double")
    score = vectors.hybrid_score(vectors.cosine(F.col("embedding"), q), (has("насос") + has("чертеже")) / 2, has("на чертеже") * 0.2, F.lit(0.0))
    return j.select("vec_id", F.round(score, 5).alias("score"))


@query("""
with b as (select vec_id, label, embedding::double[] as e from embeddings), s as (select q.vec_id as query_id, b.vec_id, round(list_cosine_similarity(q.e, b.e), 6) as score from b q join b on b.label = 3 and b.vec_id <> q.vec_id where q.vec_id % 50 = 0)
select query_id, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s) where r <= 3
""")
def rag03_filtered_vectors(spark, d):
    """The nearest among vectors that pass a filter."""
    e = table(spark, d, "embeddings")
    return vectors.nearest_vectors(e.filter("label = 3"), e.filter("vec_id % 50 = 0"), 3).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("select event_id, str_split(rtrim(ltrim(props, '{'), '}'), ':')[1] as key from events")
def arr03_key_values(spark, d):
    """A text of key and value pairs as a map."""
    m = F.expr("str_to_map(rtrim('}', ltrim('{', props)), ',', ':')")
    return table(spark, d, "events").select("event_id", F.map_keys(m)[0].alias("key"))


@query(f"""
with m as (select id, object_id, dataset_stage, document_code, case when revision is null then null when revision like 'изм%' then 'change' when revision like 'кор%' then 'correction' when revision like 'Rev%' then 'rev' else 'number' end as kind,
 case when revision is null then -1 when revision like 'Rev%' then ascii(lower(right(revision, 1))) - 96 else cast(regexp_extract(revision, '([0-9]+)', 1) as int) end as value from {V} where document_code is not null),
c as (select object_id, dataset_stage, document_code, count(*) as n, count(distinct kind) as kinds, count(distinct value) as nv, arg_max(id, value) as newest from m group by 1, 2, 3)
select object_id, dataset_stage, document_code, n, kinds = 1 and nv = n as ordered, case when kinds = 1 and nv = n then newest end as newest from c where n > 1
""")
def doc02_revision_order(spark, d):
    """Variants of a document in order by the one kind of mark they carry; undecided where kinds mix or tie."""
    r = F.col("revision")
    kind = F.when(r.like("изм%"), "change").when(r.like("кор%"), "correction").when(r.like("Rev%"), "rev").when(r.isNotNull(), "number")
    v = versions(spark, d).filter("document_code is not null").select("id", "object_id", "dataset_stage", "document_code", kind.alias("kind"), T.revision_number(r).alias("value"))
    c = v.groupBy("object_id", "dataset_stage", "document_code").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"), F.countDistinct("value").alias("nv"), F.max_by("id", F.coalesce("value", F.lit(-1))).alias("newest")).filter("n > 1")
    ok = (F.col("kinds") == 1) & (F.col("nv") == F.col("n"))
    return c.select("object_id", "dataset_stage", "document_code", "n", ok.alias("ordered"), F.when(ok, F.col("newest")).alias("newest"))


@query(f"""
select p.page_id, m.code from (select distinct on (page_id) * from ocr_pages) p, (select code, lower(trim(regexp_extract(parameter_name, '^([^(]+)', 1))) as anchor from {M}) m where contains(lower(p.text), m.anchor)
""")
def doc05_tagging(spark, d):
    """Parameters whose anchor stands on a page: one automaton of all anchors over each text, no pairs of pages and parameters."""
    anchors = [(r.code, r.anchor) for r in few(params(spark, d).select(F.struct("code", F.lower(F.trim(F.regexp_extract("parameter_name", r"^([^(]+)", 1))).alias("anchor"))), 100_000)]
    pages = table(spark, d, "ocr_pages").dropDuplicates(["page_id"]).filter("text is not null")
    return entities.tag_texts(pages, "page_id", "text", anchors).select("page_id", "code").distinct()


@query(f"""
with c as ({R.SQL['join06_keyed_compare']}) select parameter_code, count(*) as n, count(*) filter (where status = 'differs') as n_differs, count(*) filter (where status = 'only_left') as n_missing,
 count(*) filter (where status = 'only_left') > greatest(3, 0.25 * count(*)) as is_partial from c group by 1
""")
def doc13_schedule_summary(spark, d):
    """Rows of two tables compared: how many differ, and whether one is only a part."""
    c = R.join06_keyed_compare(spark, d)
    g = c.groupBy("parameter_code").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "differs").alias("n_differs"), F.count_if(F.col("status") == "only_left").alias("n_missing"))
    return g.withColumn("is_partial", F.col("n_missing") > F.greatest(F.lit(3.0), 0.25 * F.col("n")))


@query(f"""
with s as (select document_version_id, coalesce(list_sort(list(distinct parameter_code) filter (where page < 100)), []) as a, coalesce(list_sort(list(distinct parameter_code) filter (where page >= 100)), []) as b from {O} group by 1)
select document_version_id, list_sort(list_filter(a, lambda x: not list_contains(b, x))) as missing, list_sort(list_filter(b, lambda x: not list_contains(a, x))) as added,
 case when len(list_filter(a, lambda x: not list_contains(b, x))) > 0 and len(list_filter(b, lambda x: not list_contains(a, x))) > 0 then 'MISSING_AND_ADDED' when len(list_filter(a, lambda x: not list_contains(b, x))) > 0 then 'MISSING' when len(list_filter(b, lambda x: not list_contains(a, x))) > 0 then 'ADDED' else 'SAME' end as status from s
""")
def doc15_set_compare(spark, d):
    """Two sets of a key: what is missing, what is added."""
    from dossia.operators.state import set_changes

    side = lambda c: F.collect_set(F.when(c, F.col("parameter_code")))
    g = observations(spark, d).groupBy("document_version_id").agg(side(F.col("page") < 100).alias("a"), side(F.col("page") >= 100).alias("b"))
    missing, added = set_changes(F.col("a"), F.col("b"))
    g = g.select("document_version_id", missing.alias("missing"), added.alias("added"))
    st = F.when((F.size("missing") > 0) & (F.size("added") > 0), "MISSING_AND_ADDED").when(F.size("missing") > 0, "MISSING").when(F.size("added") > 0, "ADDED").otherwise("SAME")
    return g.withColumn("status", st)


@query(f"select o.observation_id, case when v < p.min_value then 'below' else 'above' end as side from (select observation_id, parameter_code, {SQLNUM} as v from {O}) o join {M} p on p.code = o.parameter_code where v < p.min_value or v > p.max_value")
def hyp07_bounds(spark, d):
    """Values outside the bounds in force."""
    p = small(params(spark, d).select(F.col("code").alias("parameter_code"), "min_value", "max_value"))
    o = observations(spark, d).select("observation_id", "parameter_code", number("normalized_value").alias("v")).join(p, "parameter_code")
    low, high = F.col("v") < F.col("min_value"), F.col("v") > F.col("max_value")
    return o.filter(low | high).select("observation_id", F.when(low, "below").otherwise("above").alias("side"))


@query(f"""
select distinct o.document_version_id from (select document_version_id, parameter_code, {SQLNUM} as v from {O}) o where o.v > 1000 and not exists (select 1 from chunks c where c.document_id = o.document_version_id and c.text ilike '%несущ%')
""")
def hyp06_rule_without_evidence(spark, d):
    """Where a rule's condition holds there must be evidence; the rows without any."""
    o = observations(spark, d).select("document_version_id", number("normalized_value").alias("v")).filter("v > 1000").select("document_version_id").distinct()
    c = table(spark, d, "chunks").filter(F.col("text").ilike("%несущ%")).select("document_id").distinct()
    return o.join(c, F.col("document_version_id") == F.col("document_id"), "left_anti")


@query(f"""
with f as (select o.observation_id, o.document_version_id, v.object_id, o.confidence from {O} o join {V} v on v.id = o.document_version_id), a as (select *, row_number() over (partition by document_version_id order by confidence desc nulls last, observation_id) as r from f),
b as (select *, row_number() over (partition by object_id order by confidence desc nulls last, observation_id) as s from a where r <= 30) select observation_id, object_id from b where s <= 120
""")
def hyp01_limits(spark, d):
    """At most 30 findings a document and 120 an object, best first; the first cap bounds what the second sorts."""
    v = versions(spark, d).select(F.col("id").alias("document_version_id"), "object_id")
    f = observations(spark, d).join(v, "document_version_id")
    order = [F.col("confidence").desc_nulls_last(), F.col("observation_id")]
    return C.top_per_key(C.top_per_key(f, ["document_version_id"], order, 30), ["object_id"], order, 120).select("observation_id", "object_id")


@query(f"""
with x as (select observation_id, parameter_code, location, row_number() over (partition by parameter_code, lower(trim(location)) order by confidence desc nulls last, observation_id) as rn from {O})
select observation_id, parameter_code || coalesce(' @ ' || lower(trim(location)), '') || case when rn > 1 then ' #' || rn else '' end as export_id from x
""")
def rev04_export_identity(spark, d):
    """One name a finding: the strongest of a place has it, the others a number behind it."""
    o = observations(spark, d).select("observation_id", "parameter_code", F.lower(F.trim("location")).alias("place"), F.coalesce(-F.col("confidence"), F.lit(1.0)).alias("weak"))
    o = ranks_by(o, ["parameter_code", "place"], ["weak", "observation_id"], "rn")
    place = F.coalesce(F.concat(F.lit(" @ "), "place"), F.lit(""))
    return o.select("observation_id", F.concat("parameter_code", place, F.when(F.col("rn") > 1, F.concat(F.lit(" #"), F.col("rn").cast("string"))).otherwise(F.lit(""))).alias("export_id"))


@query(f"""
select p.code, coalesce(o.n, 0) as n, coalesce(o.n_stages, 0) as n_stages, case when o.n is null then 'NONE' when o.n_stages < 3 then 'PART' else 'FULL' end as support, r.kind from {M} p left join (select parameter_code, count(*) as n, count(distinct stage) as n_stages from {O} group by 1) o on o.parameter_code = p.code left join trigger_rules r on r.code = p.code
""")
def rev10_coverage(spark, d):
    """What there is for every parameter."""
    o = observations(spark, d).groupBy(F.col("parameter_code").alias("code")).agg(F.count("*").alias("n"), F.countDistinct("stage").alias("n_stages"))
    j = params(spark, d).select("code").join(o, "code", "left").join(table(spark, d, "trigger_rules").select("code", "kind"), "code", "left")
    s = F.when(F.col("n").isNull(), "NONE").when(F.col("n_stages") < 3, "PART").otherwise("FULL")
    return j.select("code", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_stages", F.lit(0)).alias("n_stages"), s.alias("support"), "kind")


@query(f"""
with x as (select observation_id, location, lag(location) over (partition by parameter_code order by observation_id) as other from {O})
select observation_id, case when location is null or other is null then 'NONE' when lower(trim(location)) = lower(trim(other)) then 'STRICT' when regexp_extract(location, '^([^0-9]+)', 1) = regexp_extract(other, '^([^0-9]+)', 1) then 'LOOSE' else 'NONE' end as level from x
""")
def rev11_location_match(spark, d):
    """How well two places agree."""
    o = lag_by(observations(spark, d).select("observation_id", "parameter_code", "location"), ["parameter_code"], ["observation_id"], {"other": "location"})
    a, b = F.col("location"), F.col("other")
    head = lambda c: F.regexp_extract(c, "^([^0-9]+)", 1)
    level = F.when(a.isNull() | b.isNull(), "NONE").when(F.lower(F.trim(a)) == F.lower(F.trim(b)), "STRICT").when(head(a) == head(b), "LOOSE").otherwise("NONE")
    return o.select("observation_id", level.alias("level"))


@query("select distinct log_id, action, logged_at from audit_log where action is not null order by logged_at desc, log_id limit 100")
def rev15_listing(spark, d):
    """The last hundred log rows."""
    return table(spark, d, "audit_log").filter("action is not null").select("log_id", "action", "logged_at").distinct().orderBy(F.col("logged_at").desc(), "log_id").limit(100)


@query(f"select observation_id, u.i - 1 as pos, round(u.x, 6) as x from {O} o, lateral (select unnest(bbox_normalized) as x, generate_subscripts(bbox_normalized, 1) as i) u where bbox_normalized is not null")
def snk06_flat_evidence(spark, d):
    """Nested evidence as flat rows."""
    return observations(spark, d).filter("bbox_normalized is not null").select("observation_id", F.posexplode("bbox_normalized").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"select object_id, parameter_code, dataset_stage, list_sort(list(distinct o.document_version_id)) as docs, max(confidence) as confidence from {O} o join {V} v on v.id = o.document_version_id group by 1, 2, 3")
def snk08_collapse(spark, d):
    """Checks of one parameter merged, evidence united, of all objects."""
    v = versions(spark, d).select(F.col("id").alias("document_version_id"), "object_id", "dataset_stage")
    return observations(spark, d).join(v, "document_version_id").groupBy("object_id", "parameter_code", "dataset_stage").agg(F.array_sort(F.collect_set("document_version_id")).alias("docs"), F.max("confidence").alias("confidence"))


@query("""
select event_id, coalesce(ts - lag(ts) over (partition by user_id, event_type order by ts, event_id) <= interval 12 hour, false) as cached from events
""")
def job05_time_to_live(spark, d):
    """Whether a key was asked within its time to live."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.coalesce((F.col("ts") - F.lag("ts").over(w)) <= F.expr("interval 12 hours"), F.lit(False)).alias("cached"))


@query("select doc_id, lower(stage) as stage, regexp_extract(section_key, '^[А-Я]+', 0) as section, coalesce(pages, 0) as pages, size_bytes // 1048576 as size_mb from (select distinct on (doc_id) * from doc_facts)")
def src15_document_facts(spark, d):
    """Fact records in one form."""
    f = table(spark, d, "doc_facts").dropDuplicates(["doc_id"])
    section = F.when(F.col("section_key").isNotNull(), F.regexp_extract("section_key", "^[А-Я]+", 0))
    return f.select("doc_id", F.lower("stage").alias("stage"), section.alias("section"), F.coalesce("pages", F.lit(0)).alias("pages"), F.expr("size_bytes div 1048576").alias("size_mb"))


@query()
def ent01_resolution(spark, d):
    """Names of readings resolved to the parameters they may mean: exact, contained, fuzzy, by shared stems."""
    p = params(spark, d)
    known = p.select(F.col("code").alias("entity_id"), F.col("parameter_name").alias("name"), F.col("section").alias("kind"))
    drafts = p.select(F.col("code").alias("draft_id"), F.regexp_replace("parameter_name", r"\s*\d+$", "").alias("name"), F.col("section").alias("kind"))
    return entities.resolve(drafts, known)


@query(f"select content_hash, document_code, id from {V}")
def sort05_content_order(spark, d):
    """An order made of content only: hash, name, then id as the last resort."""
    return versions(spark, d).select("content_hash", "document_code", "id").orderBy(F.col("content_hash").asc_nulls_last(), F.col("document_code").asc_nulls_last(), "id")
