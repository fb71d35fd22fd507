"""Queries of extraction, scoring, localisation and views over findings, with their SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossia.functions import text as T
from dossia.operators import chunking, compare, entities, layout
from dossia.operators.extractors import Registry
from dossia.operators.ordered import lag_by, ranks_by, running_by
from dossia.operators.units import few, small
from dossia.plans import relational as R
from dossia.plans.relational import O, SQLNUM, V, number, observations, versions
from dossia.session import shared_dir, table

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
P = "(select distinct on (page_id) * from ocr_pages)"
C = "(select distinct on (chunk_id) * from chunks)"
FACTS = "(select distinct on (doc_id) * from doc_facts)"


def params(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "matrix_params").dropDuplicates(["code"])


# --- counts, dates, metadata ----------------------------------------------------------------


@query(f"""
select extractor, count(*) as n, count(*) filter (where confidence >= 0.75) as n_sure, count(*) filter (where normalized_value is null) as n_empty, count(*) filter (where bbox_normalized is not null and page > 0) as n_placed, count(distinct case when stage = 'PD' then document_version_id end) as n_docs_pd from {O} group by 1
""")
def agg04_conditional_counts(spark, d):
    """Several conditions counted in one pass."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return observations(spark, d).groupBy("extractor").agg(
        F.count("*").alias("n"), n(F.col("confidence") >= 0.75).alias("n_sure"), n(F.col("normalized_value").isNull()).alias("n_empty"), n(F.col("bbox_normalized").isNotNull() & (F.col("page") > 0)).alias("n_placed"), F.count_distinct(F.when(F.col("stage") == "PD", F.col("document_version_id"))).alias("n_docs_pd")
    )


@query("""
with x as (select event_type, ts::date as day, count(*) as n from events group by 1, 2)
select event_type, day, n, sum(n) over (partition by event_type order by day range between interval 6 day preceding and current row)::bigint as n7, sum(n) over (partition by event_type order by day range between interval 13 day preceding and current row)::bigint as n14 from x
""")
def dt02_rolling_windows(spark, d):
    """Counts of the last 7 and 14 days at each day that has any; days are counted first, so a window holds days and not events."""
    x = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy(F.unix_date("day"))
    return x.select("event_type", "day", "n", F.sum("n").over(w.rangeBetween(-6, 0)).alias("n7"), F.sum("n").over(w.rangeBetween(-13, 0)).alias("n14"))


@query("select event_id, case event_id % 3 when 0 then date_trunc('second', ts) - interval 3 hour when 1 then date_trunc('second', ts) + interval 5 hour + interval 30 minute else date_trunc('second', ts) end as at from events")
def dt03_utc_naive(spark, d):
    """Times with and without a zone as UTC without one."""
    zone = F.when(F.col("event_id") % 3 == 0, "+03:00").when(F.col("event_id") % 3 == 1, "-05:30").otherwise("Z")
    text = F.concat(F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, d, "events").select("event_id", T.utc_naive(text).alias("at"))


@query("select event_id, case when b is not null then round(greatest(epoch_us(ts) - epoch_us(b), 0) / 1000000.0, 1) end as seconds from (select event_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as b from events)")
def dt04_duration(spark, d):
    """Seconds since the event before of the same user, never negative."""
    e = lag_by(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], {"before": "ts"})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return e.select("event_id", F.round(F.greatest(micros("ts") - micros("before"), F.lit(0)) / F.lit(1e6) + F.when(F.col("before").isNotNull(), 0.0), 1).alias("seconds"))


@query(f"""
select observation_id, u.k as key, u.v as value from (select observation_id, unnest([{{'k': 'location', 'v': location}}, {{'k': 'page', 'v': page::varchar}}, {{'k': 'bbox', 'v': '[' || array_to_string(bbox_normalized, ',') || ']'}}]) as u from {O}) where u.v is not null
""")
def arr08_metadata(spark, d):
    """Metadata as scalars: nulls and numbers that are none left out, lists as JSON text."""
    o = observations(spark, d)
    m = T.clean_metadata({"location": F.col("location"), "page": F.col("page"), "bbox": F.col("bbox_normalized"), "share": F.lit(float("nan"))}, dict(o.dtypes) | {"bbox": "array", "share": "double"})
    return o.select("observation_id", F.explode(m).alias("key", "value"))


# --- text ---------------------------------------------------------------------------------------


@query()
def str05_chunks(spark, d):
    """Texts normalised and packed for search; tested by invariants."""
    return chunking.chunks(table(spark, d, "documents").filter("text is not null").select("doc_id", "text"), "doc_id", "text")


@query()
def str07_numbers_after(spark, d):
    """All numbers among the 25 words after an anchor; tested against brute force."""
    return layout.numbers_at_anchor(table(spark, d, "chunks").dropDuplicates(["chunk_id"]), "chunk_id", "text", "показаны на чертеже")


RULES = {
    "drawing": r"чертеже ([0-9]+)",
    "concrete": r"бетона В([0-9]{2})",
    "count": r"в количестве ([0-9]+) штук",
    "slope": r"с уклоном ([0-9]+) ‰",
}


@query("with t as (select doc_id, text from documents where text is not null) " + " union all ".join(f"select doc_id, '{k}' as rule, unnest(regexp_extract_all(text, '{p}', 1)) as value from t" for k, p in RULES.items()))
def str18_rule_patterns(spark, d):
    """A pack of patterns, each with the value it is for, in one pass over the texts."""
    t = table(spark, d, "documents").filter("text is not null")
    found = F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("values")) for k, p in RULES.items()])
    return t.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.rule", F.explode("f.values").alias("value"))


@query("with t as (select distinct doc_id, text from documents where text is not null) " + " union all ".join(f"select doc_id, '{k}' as extractor, count(*)::bigint as n from (select doc_id, unnest(regexp_extract_all(text, '{p}', 1)) from t) group by doc_id" for k, p in list(RULES.items())[:2]))
def udf01_extractors(spark, d):
    """Extractors registered by name and run over each text once."""
    r = Registry()
    for k, p in RULES.items():
        r.pattern(k, p)
    found = r.run(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", ["drawing", "concrete"])
    return found.groupBy("doc_id", "extractor").agg(F.count("*").alias("n"))


@query(f"""
select distinct o.observation_id, m.code from {O} o, (select code, unnest(from_json(aliases_json, '["varchar"]')) as alias from {M} where aliases_json is not null) m where contains(lower(o.context), m.alias)
""")
def udf03_vocabulary(spark, d):
    """Parameters whose further phrases (a vocabulary kept as JSON with each) stand in a context, by one automaton of all phrases."""
    v = params(spark, d).select("code", F.explode(F.from_json("aliases_json", "array<string>")).alias("alias"))
    words = few(v.select(F.struct("code", "alias")), 100_000)
    o = observations(spark, d).filter("context is not null").select("observation_id", F.lower("context").alias("context"))
    return entities.tag_texts(o, "observation_id", "context", [(r.code, r.alias) for r in words]).select("observation_id", "code").distinct()


# --- numbers ------------------------------------------------------------------------------------

_PAIRS = f"({R.SQL['join06_keyed_compare']})"


@query(f"select parameter_code, location, abs(right_value - left_value) > greatest(0.01, 0.001 * abs(left_value)) as differs from {_PAIRS} where left_value is not null and right_value is not null")
def num01_tolerance(spark, d):
    """Equality within the larger of 0.01 and a thousandth."""
    c = R.join06_keyed_compare(spark, d).filter("left_value is not null and right_value is not null")
    return c.select("parameter_code", "location", compare.changed(F.col("left_value"), F.col("right_value")).alias("differs"))


@query(f"select parameter_code, count(*) as n, count(*) filter (where left_value > 0 and right_value > 0 and greatest(left_value, right_value) / least(left_value, right_value) >= 20) as n_apart from {_PAIRS} where left_value is not null and right_value is not null group by 1")
def num08_magnitude(spark, d):
    """Pairs too far apart to be the same quantity."""
    c = R.join06_keyed_compare(spark, d).filter("left_value is not null and right_value is not null")
    return c.groupBy("parameter_code").agg(F.count("*").alias("n"), F.count_if(compare.magnitude_gate(F.col("left_value"), F.col("right_value"))).alias("n_apart"))


@query(f"""
with n as (select parameter_code, location, stage, list_min(list_transform(regexp_extract_all(normalized_value, '[0-9]+(?:\\.[0-9]+)?'), lambda x: x::double)) as least from {O} where normalized_value is not null and location is not null),
g as (select parameter_code, location, min(least) filter (where stage = 'PD') as expected, min(least) filter (where stage = 'RD') as actual from n group by 1, 2)
select parameter_code, location, expected, actual, actual < expected as is_violation from g where expected is not null and actual is not null
""")
def num06_least_value(spark, d):
    """The least of the numbers in each side's values: a violation where the later one is less."""
    least = F.array_min(F.transform(F.regexp_extract_all("normalized_value", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double")))
    o = observations(spark, d).filter("normalized_value is not null and location is not null").select("parameter_code", "location", "stage", least.alias("least"))
    side = lambda s: F.min(F.when(F.col("stage") == s, F.col("least")))
    g = o.groupBy("parameter_code", "location").agg(side("PD").alias("expected"), side("RD").alias("actual")).filter("expected is not null and actual is not null")
    return g.withColumn("is_violation", F.col("actual") < F.col("expected"))


# --- layout -------------------------------------------------------------------------------------


@query(f"""
with w as (select document_version_id, page, floor(bbox_normalized[2] * 20)::int as band, observation_id, bbox_normalized[1] * 600 as x0, bbox_normalized[3] * 600 as x1 from {O} where bbox_normalized is not null),
n as (select *, case when x0 - lag(x1) over (partition by document_version_id, page, band order by x0, observation_id) > 12 then 1 else 0 end as new from w)
select observation_id, sum(new) over (partition by document_version_id, page, band order by x0, observation_id rows unbounded preceding)::int as cell_no from n
""")
def win09_cells(spark, d):
    """Words of a row in cells: a new one where the gap is wide."""
    b = lambda i: F.get("bbox_normalized", F.lit(i))
    o = observations(spark, d).filter("bbox_normalized is not null")
    w = o.select("document_version_id", "page", F.floor(b(1) * 20).alias("band"), F.col("observation_id").alias("word_no"), (b(0) * 600).alias("x0"), (b(2) * 600).alias("x1"))
    return layout.cluster_cells(w, ["document_version_id", "page", "band"]).select(F.col("word_no").alias("observation_id"), F.col("cell_no").cast("int").alias("cell_no"))


_CENTRES = f"select document_version_id as doc, page, observation_id as id, extractor, (bbox_normalized[1] + bbox_normalized[3]) / 2 as x, (bbox_normalized[2] + bbox_normalized[4]) / 2 as y from {O} where bbox_normalized is not null"


@query(f"""
with c as ({_CENTRES}), p as (select s.id as system_id, r.id as room_id, round(sqrt((s.x - r.x) ^ 2 + (s.y - r.y) ^ 2), 9) as dist from c s join c r on s.doc = r.doc and s.page // 20 = r.page // 20 and s.extractor = 'rule_pack' and r.extractor <> 'rule_pack' where abs(s.x - r.x) <= 0.3 and abs(s.y - r.y) <= 0.3),
k as (select *, row_number() over (partition by system_id order by dist, room_id) as rn, lead(dist) over (partition by system_id order by dist, room_id) as next from p)
select system_id, room_id, round(dist, 6) as distance, next is not null and next - dist <= 0.1 * next as is_ambiguous from k where rn = 1
""")
def doc14_nearest_label(spark, d):
    """The nearest label in a window around each mark of the same sheet; ambiguous where the next is within a tenth."""
    b = lambda i: F.get("bbox_normalized", F.lit(i))
    o = observations(spark, d).filter("bbox_normalized is not null").select(F.col("document_version_id").alias("doc"), F.floor(F.col("page") / 20).alias("sheet"), F.col("observation_id").alias("id"), "extractor", ((b(0) + b(2)) / 2).alias("x"), ((b(1) + b(3)) / 2).alias("y"))
    return layout.nearest_in_window(o.filter("extractor = 'rule_pack'"), o.filter("extractor <> 'rule_pack'"), ["doc", "sheet"], 0.3, 0.3, 0.1).select(F.col("mark").alias("system_id"), F.col("label").alias("room_id"), F.round("distance", 6).alias("distance"), "is_ambiguous")


@query(f"""
with c as (select document_version_id as doc, page // 20 as sheet, observation_id as id, extractor, bbox_normalized as b from {O} where bbox_normalized is not null), p as (select doc, sheet, id, (b[1] + b[3]) / 2 as x, (b[2] + b[4]) / 2 as y from c where extractor <> 'table_cell'), z as (select * from c where extractor = 'table_cell'),
k as (select p.id as mark_id, z.id as zone_id, row_number() over (partition by p.id order by round((z.b[3] - z.b[1]) * (z.b[4] - z.b[2]), 9), z.id) as rn, count(*) over (partition by p.id) as n_zones from p join z using (doc, sheet) where p.x >= z.b[1] and p.x <= z.b[3] and p.y >= z.b[2] and p.y <= z.b[4])
select mark_id, zone_id, n_zones from k where rn = 1
""")
def doc16_zones(spark, d):
    """The least zone of its sheet in which the centre of each mark lies; zones and marks meet on their sheet."""
    b = lambda i: F.get("bbox_normalized", F.lit(i))
    c = observations(spark, d).filter("bbox_normalized is not null").select(F.col("document_version_id").alias("doc"), F.floor(F.col("page") / 20).alias("sheet"), F.col("observation_id").alias("id"), "extractor", *[b(i).alias(f"b{i}") for i in range(4)])
    marks = c.filter("extractor <> 'table_cell'").select("doc", "sheet", F.col("id").alias("mark_id"), ((F.col("b0") + F.col("b2")) / 2).alias("x"), ((F.col("b1") + F.col("b3")) / 2).alias("y"))
    zones = c.filter("extractor = 'table_cell'").select("doc", "sheet", F.col("id").alias("zone_id"), "b0", "b1", "b2", "b3")
    inside = marks.join(zones, ["doc", "sheet"]).filter("x >= b0 and x <= b2 and y >= b1 and y <= b3")
    size = F.round((F.col("b2") - F.col("b0")) * (F.col("b3") - F.col("b1")), 9)
    return inside.groupBy("mark_id").agg(F.min(F.struct(size.alias("size"), "zone_id")).alias("z"), F.count("*").alias("n_zones")).select("mark_id", "z.zone_id", "n_zones")


@query(f"""
select page_id, list_filter([case when mean_conf < 55 then 'LOW_CONFIDENCE' end, case when coalesce(length(trim(text)), 0) = 0 then 'NO_TEXT' end, case when page_number < 1 then 'PAGE_OUT_OF_RANGE' end, case when length(text) < 200 then 'LITTLE_TEXT' end, case when lang = 'eng' and regexp_matches(text, '[а-яА-Я]') then 'WRONG_LANGUAGE' end], lambda x: x is not null) as reasons from {P}
""")
def doc17_page_quality(spark, d):
    """What speaks against a recognised page."""
    p = table(spark, d, "ocr_pages").dropDuplicates(["page_id"])
    rules = {
        "LOW_CONFIDENCE": F.col("mean_conf") < 55,
        "NO_TEXT": F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0,
        "PAGE_OUT_OF_RANGE": F.col("page_number") < 1,
        "LITTLE_TEXT": F.length("text") < 200,
        "WRONG_LANGUAGE": (F.col("lang") == "eng") & F.col("text").rlike("[а-яА-Я]"),
    }
    return p.select("page_id", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])).alias("reasons"))


# --- pairs and candidates -------------------------------------------------------------------

_TOKENS = "list_distinct(regexp_extract_all(lower(f.filename), '[0-9a-zа-я]+'))"


@query(f"""
with f as (select f.doc_id as id, f.building, f.extension, {_TOKENS} as title from {FACTS} f), s as (select document_version_id as id, list(distinct parameter_code) as labels from {O} group by 1),
l as (select id, successor_id from {V} where successor_id is not null), v as (select v.id, v.discipline, f.building, f.extension, f.title, s.labels from {V} v join f on f.id = v.id left join s on s.id = v.id),
p as (select a.id as id_a, b.id as id_b, a.building is not null and b.building is not null and a.building <> b.building as veto, case when len(a.title) > 0 and len(b.title) > 0 then len(list_intersect(a.title, b.title))::double / len(list_distinct(list_concat(a.title, b.title))) end as title,
 case when len(a.labels) >= 8 and len(b.labels) >= 8 then len(list_intersect(a.labels, b.labels))::double / len(list_distinct(list_concat(a.labels, b.labels))) end as labels, case when a.discipline is not null and b.discipline is not null then (a.discipline = b.discipline)::int end as kind, case when a.extension is not null and b.extension is not null then (a.extension = b.extension)::int end as format
 from l join v a on a.id = l.id join v b on b.id = l.successor_id),
q as (select *, (3.0 * coalesce(title, 0) + 2.0 * coalesce(labels, 0) + coalesce(kind, 0) + coalesce(format, 0)) / nullif(case when title is not null then 3.0 else 0 end + case when labels is not null then 2.0 else 0 end + case when kind is not null then 1.0 else 0 end + case when format is not null then 1.0 else 0 end, 0) as mean from p)
select id_a, id_b, veto, round(case when veto then 0.0 when (title is not null)::int + (labels is not null)::int < 2 then least(coalesce(mean, 0), 0.45) else coalesce(mean, 0) end, 4) as confidence from q
""")
def join11_pair_score(spark, d):
    """Versions and their successors scored by the weighted mean of the signals both have; another building is a veto, few signals a cap."""
    f = table(spark, d, "doc_facts").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "building", "extension", F.array_distinct(F.regexp_extract_all(F.lower("filename"), F.lit("[0-9a-zа-я]+"), F.lit(0))).alias("title"))
    s = observations(spark, d).groupBy(F.col("document_version_id").alias("id")).agg(F.collect_set("parameter_code").alias("labels"))
    v = versions(spark, d).select("id", "discipline").join(f, "id").join(s, "id", "left")
    side = lambda x: v.select(*[F.col(c).alias(f"{c}_{x}") for c in v.columns])
    links = versions(spark, d).filter("successor_id is not null").select(F.col("id").alias("id_a"), F.col("successor_id").alias("id_b"))
    p = links.join(side("a"), "id_a").join(side("b"), "id_b")
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    jaccard = lambda c: F.size(F.array_intersect(a(c), b(c))) / F.size(F.array_union(a(c), b(c)))
    signals = {
        "title": (3.0, F.when((F.size(a("title")) > 0) & (F.size(b("title")) > 0), jaccard("title"))),
        "labels": (2.0, F.when((F.size(a("labels")) >= 8) & (F.size(b("labels")) >= 8), jaccard("labels"))),
        "kind": (1.0, (a("discipline") == b("discipline")).cast("double")),
        "format": (1.0, (a("extension") == b("extension")).cast("double")),
    }
    veto = F.coalesce(a("building") != b("building"), F.lit(False))
    confidence = compare.weighted_mean(signals, veto, ["title", "labels"], 2, 0.45)
    return p.select("id_a", "id_b", veto.alias("veto"), F.round(confidence, 4).alias("confidence"))


@query(f"""
with o as (select v.object_id, o.* from {O} o join {V} v on v.id = o.document_version_id), e as (select object_id, parameter_code, arg_max_null(location, {{'c': coalesce(confidence, -1), 'i': observation_id}}) as place, max(observation_id) as k from o where stage = 'PD' group by 1, 2),
c as (select o.object_id, o.parameter_code, o.observation_id, o.normalized_value, row_number() over (partition by o.object_id, o.parameter_code order by (o.normalized_value is null)::int, (coalesce(o.location = e.place, false))::int desc, (coalesce(regexp_extract(o.location, '^([^0-9]+)', 1) = regexp_extract(e.place, '^([^0-9]+)', 1), false))::int desc, coalesce(o.confidence, -1) desc, o.observation_id) as rn from o join e using (object_id, parameter_code) where o.stage = 'RD')
select object_id, parameter_code, max(observation_id) filter (where rn = 1) as observation_id, least(count(distinct normalized_value) filter (where normalized_value is not null), 6)::int as n_values from c group by 1, 2
""")
def doc06_cross_stage(spark, d):
    """The later stage's reading that fits the earlier one best: not empty, same place, same kind of place, surest; an aggregate, so that no hot group is sorted."""
    v = versions(spark, d).select(F.col("id").alias("document_version_id"), "object_id")
    o = observations(spark, d).join(v, "document_version_id").filter("object_id is not null and parameter_code is not null")
    sure = F.coalesce("confidence", F.lit(-1.0))
    e = o.filter("stage = 'PD'").groupBy("object_id", "parameter_code").agg(F.max_by("location", F.struct(sure, "observation_id")).alias("place"))
    head = lambda c: F.regexp_extract(c, "^([^0-9]+)", 1)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rank = F.struct(F.col("normalized_value").isNotNull().cast("int"), flag(F.col("location") == F.col("place")), flag(head("location") == head("place")), sure, (-F.col("observation_id")).alias("m"))
    c = o.filter("stage = 'RD'").join(e, ["object_id", "parameter_code"])
    return c.groupBy("object_id", "parameter_code").agg(F.max_by("observation_id", rank).alias("observation_id"), F.least(F.count_distinct("normalized_value"), F.lit(6)).cast("int").alias("n_values"))


TIERS = ["rule_pack", "table_cell", "generic_anchor", "ocr_words"]


@query(f"""
with t as (select document_version_id, parameter_code, observation_id, normalized_value, list_position({TIERS}, extractor) as tier from {O} where normalized_value is not null), b as (select document_version_id, parameter_code, min(tier) as tier from t group by 1, 2)
select document_version_id, parameter_code, {TIERS}[b.tier] as tier_name, count(*) as n, min(observation_id) as observation_id from t join b using (document_version_id, parameter_code) where t.tier = b.tier group by 1, 2, 3
""")
def doc10_tier_cascade(spark, d):
    """Of the tiers that read a parameter in a document the first one counts."""
    tier = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("extractor"))
    t = observations(spark, d).filter("normalized_value is not null").groupBy("document_version_id", "parameter_code", tier.alias("tier")).agg(F.count("*").alias("n"), F.min("observation_id").alias("observation_id"))
    b = t.groupBy("document_version_id", "parameter_code").agg(F.min_by(F.struct("tier", "n", "observation_id"), "tier").alias("b"))
    return b.select("document_version_id", "parameter_code", F.get(F.array(*[F.lit(x) for x in TIERS]), (F.col("b.tier") - 1).cast("int")).alias("tier_name"), "b.n", "b.observation_id")


@query(f"select observation_id, regexp_extract(context, '([А-ЯЁ][а-яё]+ [^:,;.]*), ([^:,;]+): ([0-9]+(?:[.,][0-9]+)?)', 1) as key, regexp_extract(context, '([А-ЯЁ][а-яё]+ [^:,;.]*), ([^:,;]+): ([0-9]+(?:[.,][0-9]+)?)', 2) as unit, replace(regexp_extract(context, '([А-ЯЁ][а-яё]+ [^:,;.]*), ([^:,;]+): ([0-9]+(?:[.,][0-9]+)?)', 3), ',', '.')::double as value from {O} where regexp_matches(context, '([А-ЯЁ][а-яё]+ [^:,;.]*), ([^:,;]+): ([0-9]+(?:[.,][0-9]+)?)')")
def doc12_key_values(spark, d):
    """Lines of the form `name, unit: number`."""
    p = r"([А-ЯЁ][а-яё]+ [^:,;.]*), ([^:,;]+): ([0-9]+(?:[.,][0-9]+)?)"
    o = observations(spark, d).filter(F.col("context").rlike(p))
    g = lambda i: F.regexp_extract("context", p, i)
    return o.select("observation_id", g(1).alias("key"), g(2).alias("unit"), F.replace(g(3), F.lit(","), F.lit(".")).cast("double").alias("value"))


@query(f"""
with g as (select document_version_id, parameter_code, arg_max(normalized_value, {{'c': coalesce(confidence, -1), 'i': observation_id}}) as chosen, list_sort(list(distinct normalized_value)) as all_values from {O} where normalized_value is not null group by 1, 2)
select document_version_id, parameter_code, chosen, list_filter(all_values, lambda x: x <> chosen) as alternatives from g
""")
def doc22_alternatives(spark, d):
    """The surest value of each parameter of a document and the others it was read with."""
    g = observations(spark, d).filter("normalized_value is not null").groupBy("document_version_id", "parameter_code").agg(F.max_by("normalized_value", F.struct(F.coalesce("confidence", F.lit(-1.0)), "observation_id")).alias("chosen"), F.array_sort(F.collect_set("normalized_value")).alias("all_values"))
    return g.select("document_version_id", "parameter_code", "chosen", F.array_remove("all_values", F.col("chosen")).alias("alternatives"))


@query(f"""
with c as {_PAIRS}, r as (select distinct parameter_code, lower(trim(location)) as place from {O} where confidence >= 0.95)
select c.parameter_code, c.location, c.left_value, c.right_value from c where c.status = 'differs' and not exists (select 1 from r where r.parameter_code = c.parameter_code and r.place is not distinct from lower(trim(c.location)))
""")
def hyp02_unreported_differences(spark, d):
    """Differences that no sure finding of the same place reports."""
    c = R.join06_keyed_compare(spark, d).filter("status = 'differs'")
    r = observations(spark, d).filter("confidence >= 0.95").select(F.col("parameter_code").alias("_p"), F.lower(F.trim("location")).alias("_l")).distinct()
    return c.join(r, (c.parameter_code == r._p) & F.lower(F.trim(c.location)).eqNullSafe(r._l), "left_anti").select("parameter_code", "location", "left_value", "right_value")


@query(f"""
with m as (select a.page_id, max(contains(lower(a.text), 'насос')::int + contains(lower(a.text), 'чертеж')::int * 0.5) as score from {P} a where a.text is not null group by 1),
s as (select *, row_number() over (order by score desc, page_id) as rn, max(score) over () as top from m) select page_id, score::double as score from s where case when top > 0 then score > 0 and rn <= 8 else rn <= 3 end
""")
def rag02_sources(spark, d):
    """At most eight pages that hold words of the question, or the first three where none does."""
    p = table(spark, d, "ocr_pages").dropDuplicates(["page_id"]).filter("text is not null")
    low = F.lower("text")
    scored = p.select("page_id", (low.contains("насос").cast("double") + low.contains("чертеж").cast("double") * 0.5).alias("score"))
    top = scored.orderBy(F.col("score").desc(), "page_id").limit(8)  # eight rows: what follows is small
    w = Window.orderBy(F.col("score").desc(), "page_id")
    best = F.max("score").over(Window.partitionBy())
    return top.withColumn("rn", F.row_number().over(w)).withColumn("best", best).filter(F.when(F.col("best") > 0, F.col("score") > 0).otherwise(F.col("rn") <= 3)).select("page_id", "score")


# --- state and views ------------------------------------------------------------------------


@query("""
with g as (select o_orderkey as key, o_orderstatus <> 'O' as decided from orders where o_orderkey % 3 <> 0), t as (select o_orderkey as key from orders where o_orderkey % 4 <> 0)
select g.key, case when t.key is not null then 'keep' when g.decided then 'flag' else 'delete' end as action from g left join t on t.key = g.key
""")
def rev02_orphans(spark, d):
    """Groups a run has not touched: flagged where they are decided, else deleted."""
    from dossia.operators import state

    o = table(spark, d, "orders")
    return state.orphans(o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("key"), (F.col("o_orderstatus") != "O").alias("decided")), o.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("key")), "key", "decided")


@query(f"select o.observation_id, coalesce(p.matrix_code, upper(trim(o.parameter_code))) as canonical, try_cast(regexp_extract(p.matrix_code, '([0-9]+)$', 1) as int) as number from {O} o left join {M} p on p.code = upper(trim(o.parameter_code))")
def rev09_code_mapping(spark, d):
    """Codes of either convention as one comparable key."""
    p = small(params(spark, d).select("code", "matrix_code"))
    o = observations(spark, d).select("observation_id", F.upper(F.trim("parameter_code")).alias("code")).join(p, "code", "left")
    return o.select("observation_id", F.coalesce("matrix_code", "code").alias("canonical"), F.regexp_extract("matrix_code", "([0-9]+)$", 1).try_cast("int").alias("number"))


@query(f"""
with v as (select observation_id, parameter_code, {SQLNUM} as v from {O}), m as (select parameter_code, v, unnest([{{'f': 1.0005, 'r': false}}, {{'f': 1.05, 'r': true}}, {{'f': 0.5, 'r': true}}]) as m from v where v is not null and abs(v) >= 1)
select parameter_code, count(*) as n_cases, count(*) filter (where m.r and abs(v * m.f - v) > greatest(0.01, 0.001 * abs(v))) as n_detected, count(*) filter (where m.r) as n_seeded, count(*) filter (where not m.r and abs(v * m.f - v) > greatest(0.01, 0.001 * abs(v))) as n_false from m group by 1
""")
def rev12_seeded_changes(spark, d):
    """Values changed by known factors, within and beyond the tolerance: how many changes are seen, how many are seen where there is none."""
    o = observations(spark, d).select("parameter_code", number("normalized_value").alias("v")).filter("v is not null and abs(v) >= 1")
    seeds = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(r).alias("r")) for f, r in ((1.0005, False), (1.05, True), (0.5, True))])
    m = o.withColumn("m", F.explode(seeds)).withColumn("seen", compare.changed(F.col("v"), F.col("v") * F.col("m.f")))
    return m.groupBy("parameter_code").agg(F.count("*").alias("n_cases"), F.count_if(F.col("m.r") & F.col("seen")).alias("n_detected"), F.count_if(F.col("m.r")).alias("n_seeded"), F.count_if(~F.col("m.r") & F.col("seen")).alias("n_false"))


@query(f"""
with g as (select parameter_code, stage, count(*) as n, max(confidence) as best from {O} where stage is not null group by 1, 2)
select p.code, p.parameter_name as name, coalesce(string_agg(g.stage || '=' || g.n, ';' order by g.stage), '') as timeline, count(g.stage) as n_stages, max(g.best) as confidence from {M} p left join g on g.parameter_code = p.code group by 1, 2
""")
def ent02_portrait(spark, d):
    """An entity with its timeline by stage; counted before it is nested, so that no hot entity is gathered."""
    g = observations(spark, d).filter("stage is not null").groupBy(F.col("parameter_code").alias("code"), "stage").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))
    g = g.groupBy("code").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "stage", "n"))), ";").alias("timeline"), F.count("*").alias("n_stages"), F.max("best").alias("confidence"))
    return params(spark, d).select("code", F.col("parameter_name").alias("name")).join(g, "code", "left").select("code", "name", F.coalesce("timeline", F.lit("")).alias("timeline"), F.coalesce("n_stages", F.lit(0)).alias("n_stages"), "confidence")


@query(f"""
with c as (select distinct parameter_code, location, stage, normalized_value, document_version_id from {O}), h as (select * from c where document_version_id % 3 = 0)
select c.parameter_code, c.location, c.stage, c.normalized_value, c.document_version_id from c where not exists (select 1 from h where h.parameter_code is not distinct from c.parameter_code and h.location is not distinct from c.location and h.stage is not distinct from c.stage and h.normalized_value is not distinct from c.normalized_value and h.document_version_id = c.document_version_id)
""")
def ent03_new_issues(spark, d):
    """Issues that are not there yet, by a key of five parts in which nulls are equal."""
    from dossia.operators import state

    keys = ["parameter_code", "location", "stage", "normalized_value", "document_version_id"]
    c = observations(spark, d).select(*keys).distinct()
    return state.absent(c, c.filter("document_version_id % 3 = 0"), keys)


@query(f"""
with k as (select doc_id, coalesce(pages, 0) as pages, row_number() over (order by coalesce(pages, 0) desc, doc_id) - 1 as i from {FACTS})
select doc_id, pages, (case when (i // 8) % 2 = 0 then i % 8 else 7 - i % 8 end)::int as worker from k
""")
def sort06_longest_first(spark, d):
    """Work dealt out longest first, to and fro over eight workers; ranks by ranges, no global sort in one task."""
    f = table(spark, d, "doc_facts").dropDuplicates(["doc_id"]).select("doc_id", F.coalesce("pages", F.lit(0)).alias("pages"), (-F.coalesce("pages", F.lit(0))).alias("less"))
    i = F.col("rank") - 1
    return ranks_by(f, [], ["less", "doc_id"]).select("doc_id", "pages", F.when(F.floor(i / 8) % 2 == 0, i % 8).otherwise(7 - i % 8).cast("int").alias("worker"))


@query(f"""
select document_version_id, count(*) as n, string_agg(parameter_code || '/' || coalesce(stage, ''), ';' order by coalesce(p.review_priority, ''), o.observation_id) as findings from {O} o join {M} p on p.code = o.parameter_code where o.confidence >= 0.9 group by 1
""")
def snk02_protocol(spark, d):
    """Findings of a document in the order of priority, nested."""
    p = small(params(spark, d).select(F.col("code").alias("parameter_code"), F.coalesce("review_priority", F.lit("")).alias("priority")))
    o = observations(spark, d).filter("confidence >= 0.9").join(p, "parameter_code")
    line = F.struct("priority", "observation_id", F.concat("parameter_code", F.lit("/"), F.coalesce("stage", F.lit(""))).alias("line"))
    return o.groupBy("document_version_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), ";").alias("findings"))


@query(f"select page_id, len(regexp_extract_all(text, '[0-9]+')) as n_numbers from {P} where text is not null and regexp_matches(text, '[0-9]')")
def src13_cached_scan(spark, d):
    """Pages that pass a cheap test are read once by content: what the cache holds is joined, the rest is read and added to it."""
    p = table(spark, d, "ocr_pages").dropDuplicates(["page_id"]).filter("text is not null").filter(F.col("text").rlike("[0-9]")).select("page_id", "text", F.sha2("text", 256).alias("sha"))
    cache = f"{shared_dir(spark).rstrip('/')}/dossia-{uuid.uuid4().hex}-cache"
    read = lambda rows: rows.dropDuplicates(["sha"]).select("sha", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("n_numbers"))
    read(p.filter("page_id % 2 = 0")).write.parquet(cache)  # an earlier run
    read(p.join(spark.read.parquet(cache).select("sha"), "sha", "left_anti")).write.mode("append").parquet(cache)
    return p.select("page_id", "sha").join(spark.read.parquet(cache), "sha").select("page_id", "n_numbers")


@query(f"""
select doc_id, stage, sum(size_bytes) over (partition by stage order by doc_id)::bigint as used, sum(size_bytes) over (partition by stage order by doc_id) <= 1000000000 as is_accepted from {FACTS} where size_bytes is not null
""")
def src17_quota(spark, d):
    """Stored bytes against a cap, in order of arrival; running sums by ranges."""
    f = table(spark, d, "doc_facts").dropDuplicates(["doc_id"]).filter("size_bytes is not null").select("doc_id", "stage", "size_bytes")
    r = running_by(f, ["stage"], ["doc_id"], F.col("size_bytes"), "used")
    return r.select("doc_id", "stage", "used", (F.col("used") <= 1_000_000_000).alias("is_accepted"))
