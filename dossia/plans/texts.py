"""Queries of text, search, vector, layout, date, file and streaming operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossia.functions import text as T
from dossia.operators import layout, retrieval, statistics, vectors
from dossia.operators.ordered import lag_by
from dossia.operators.units import small
from dossia.plans.relational import O, V, observations, versions
from dossia.session import table
from dossia.sources import files, outputs
from dossia.streaming import events as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


_NORM = "trim(regexp_replace(translate(lower({c}), 'ё–—‑', 'е---'), '\\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query()
def str01_normalize(spark, d):
    """One form for search over all contexts: case, ё, dashes, blanks of any kind, accents; tested by brute force."""
    return observations(spark, d).filter("context is not null").select("observation_id", T.search_text_any(F.col("context")).alias("body"))


@query()
def str01_nfkc(spark, d):
    """Compatibility forms, which has no built-in: an Arrow function."""
    return observations(spark, d).select("observation_id", T.nfkc("value").alias("value"))


@query()
def str02_sequence_ratio(spark, d):
    """Likeness of neighbouring names of a section."""
    p = table(spark, d, "matrix_params").dropDuplicates(["code"])
    w = Window.partitionBy("section").orderBy("code")
    return p.withColumn("before", F.lag("parameter_name").over(w)).select("code", F.round(T.sequence_ratio("before", "parameter_name"), 6).alias("ratio"))


@query("select word, regexp_replace(word, '^(.{4,}?)(?:" + "|".join(T.RU_ENDINGS) + ")$', '\\1') as stem from (select distinct unnest(regexp_extract_all(lower(parameter_name), '[а-я]+')) as word from matrix_params)")
def str03_stem(spark, d):
    """The light stemmer over the words of names."""
    w = table(spark, d, "matrix_params").select(F.explode(F.regexp_extract_all(F.lower("parameter_name"), F.lit("[а-я]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", T.stem(F.col("word")).alias("stem"))


@query(f"""
select code, token, 1 as n from (select code, unnest(regexp_extract_all({_NORM.format(c='parameter_name')}, '[0-9a-zа-я]+(?:[-_/.][0-9a-zа-я]+)*')) as token from (select distinct on (code) * from matrix_params))
where length(token) >= 2 and token not in ({_STOP}) group by 1, 2
""")
def str04_tokens(spark, d):
    """Distinct tokens of a text without stop words."""
    return table(spark, d, "matrix_params").dropDuplicates(["code"]).select("code", F.explode(T.tokens(F.col("parameter_name"))).alias("token")).withColumn("n", F.lit(1))


@query(f"""
with t as (select code, regexp_extract_all({_NORM.format(c='parameter_name')}, '[0-9a-zа-я]+(?:[-_/.][0-9a-zа-я]+)*') as r from (select distinct on (code) * from matrix_params)),
w as (select code, list_filter(list_filter(r, lambda x, i: list_position(r, x) = i), lambda x: length(x) >= 2 and x not in ({_STOP})) as w from t)
select code, unnest(flatten(list_transform([4, 3, 2], lambda n: list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))))) as phrase from w
""")
def str04_ngrams(spark, d):
    """Phrases of four to two words."""
    return table(spark, d, "matrix_params").dropDuplicates(["code"]).select("code", F.explode(T.ngrams(T.tokens(F.col("parameter_name")))).alias("phrase"))


@query()
def str06_anchor_values(spark, d):
    """Where an anchor phrase stands and the number after it."""
    return layout.anchored_values(table(spark, d, "chunks").dropDuplicates(["chunk_id"]), "chunk_id", "text", "показаны на чертеже")


@query("select doc_id, grade from (select doc_id, unnest(regexp_extract_all(text, 'А500С|В[0-9]{2}|W[0-9]+|F[0-9]{2,3}|Ду[0-9]+|ПБ[0-9]+')) as grade from documents where text is not null) group by all")
def str08_grades(spark, d):
    """Marks of grades in texts."""
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("А500С|В[0-9]{2}|W[0-9]+|F[0-9]{2,3}|Ду[0-9]+|ПБ[0-9]+"), F.lit(0))).alias("grade")).distinct()


@query("select p_partkey, string_split(p_name, ' ')[1] as first_part, string_split(p_name, ' ')[2] as second_part, len(string_split(p_name, ' ')) as n from part")
def str09_compound_split(spark, d):
    """Components of a compound, nothing where one is missing."""
    s = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.get(s, F.lit(0)).alias("first_part"), F.get(s, F.lit(1)).alias("second_part"), F.size(s).alias("n"))


@query("""
select doc_id, regexp_extract(filename, '^([0-9]+)-', 1) as code_number, regexp_extract(filename, '^[0-9]+-([А-Я]+[0-9]*)', 1) as section, lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) as extension, regexp_extract(filename, '(изм|Rev|кор)', 1) as mark from (select distinct on (doc_id) * from doc_facts)
""")
def str10_filename_facts(spark, d):
    """What a file name says: code, section, revision mark, extension."""
    f = F.col("filename")
    return table(spark, d, "doc_facts").dropDuplicates(["doc_id"]).select("doc_id", F.regexp_extract(f, "^([0-9]+)-", 1).alias("code_number"), F.regexp_extract(f, "^[0-9]+-([А-Я]+[0-9]*)", 1).alias("section"), F.lower(F.regexp_extract(f, r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), F.regexp_extract(f, "(изм|Rev|кор)", 1).alias("mark"))


@query(f"""
select o.observation_id, regexp_extract(o.value, p.regex_pattern) as found from {O} o join (select distinct on (code) * from matrix_params) p on p.code = o.parameter_code where p.regex_pattern is not null and o.value is not null
""")
def str13_column_pattern(spark, d):
    """Patterns that come from a column, each row its own."""
    p = table(spark, d, "matrix_params").dropDuplicates(["code"]).filter("regex_pattern is not null").select(F.col("code").alias("parameter_code"), "regex_pattern")
    o = observations(spark, d).filter("value is not null").join(small(p), "parameter_code")
    return o.select("observation_id", F.expr("regexp_extract(value, regex_pattern, 0)").alias("found"))


@query(f"select id, regexp_replace(translate(regexp_replace(lower(trim(document_code)), '^ст\\.?\\s*', ''), ',', '.'), '(^|[.\\-/])0+([0-9])', '\\1\\2', 'g') as key from {V} where document_code is not null")
def str17_key_form(spark, d):
    return versions(spark, d).filter("document_code is not null").select("id", T.key_form(F.col("document_code")).alias("key"))


@query(f"""
select document_code, array_to_string(list_transform(regexp_extract_all(lower(document_code), '[0-9]+|[^0-9]+'), lambda p: case when regexp_full_match(p, '[0-9]+') then lpad(regexp_replace(p, '^0+([0-9])', '\\1'), 20, '0') else p end), '') as sort_key from (select distinct document_code from {V} where document_code is not null)
""")
def sort04_natural(spark, d):
    """Codes in an order in which their numbers compare as numbers."""
    v = versions(spark, d).filter("document_code is not null").select("document_code").distinct()
    return v.withColumn("sort_key", T.natural_key(F.col("document_code"))).orderBy("sort_key")


@query("""
with t as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[а-яё]{4,}'))) as term from documents where text is not null), n as (select count(*) as n from documents where text is not null)
select term, count(*) as df, round(ln((n.n + 1)::double / (count(*) + 1)) + 0.1, 6) as weight from t, n group by term, n.n
""")
def agg14_inverse_frequency(spark, d):
    """Weights of terms by the texts that have them, over all texts."""
    t = table(spark, d, "documents").filter("text is not null")
    n = t.count()
    terms = t.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[а-яё]{4,}"), F.lit(0)))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", F.round(statistics.inverse_frequency(F.lit(n), F.col("df")), 6).alias("weight"))


@query("""
select doc_id, round((case when b like '%вентиляционн%' then 1.2 else 0 end + case when b like '%резервуар%' then 1.2 else 0 end) / 2.4, 6) as lexical, case when b like '%вентиляционный резервуар%' then 0.2 else 0 end::double as phrase,
 round(0.62 * round((case when b like '%вентиляционн%' then 1.2 else 0 end + case when b like '%резервуар%' then 1.2 else 0 end) / 2.4, 6) + 1.2 * case when b like '%вентиляционный резервуар%' then 0.2 else 0 end, 6) as score
from (select doc_id, trim(regexp_replace(translate(lower(coalesce(text, '')), 'ё–—‑', 'е---'), '\\s+', ' ', 'g')) as b from documents) where b like '%вентиляционн%' or b like '%резервуар%' order by score desc, doc_id limit 20
""")
def rag01_lexical_search(spark, d):
    """The 20 best texts for a question."""
    return retrieval.lexical_search(table(spark, d, "documents"), "Вентиляционный резервуар", 20, "doc_id")


@query()
def rag01_search_by_page(spark, d):
    """The same over chunks with at most two hits a page."""
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"])
    return retrieval.lexical_search(c, "Длина вентиляционного проёма в осях", 20, "chunk_id", page=["document_id", "page_number"])


@query("""
with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 50 = 0), b as (select vec_id, embedding::double[] as e from embeddings),
s as (select query_id, vec_id, round(list_cosine_similarity(q.e, b.e), 6) as score from q, b where query_id <> vec_id), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, vec_id, score from r where rank <= 5
""")
def num11_vector_top_k(spark, d):
    """The five nearest of every vector whose id is divisible by 50, against all."""
    b = table(spark, d, "embeddings")
    return vectors.nearest_vectors(b, b.filter("vec_id % 50 = 0"), 5).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("""
with c as (select label, vec_id, embedding::double[] as e, lag(embedding::double[]) over (partition by label order by vec_id) as p from embeddings)
select vec_id, round(list_cosine_similarity(e, p), 6) as score, round(list_inner_product(e, p), 6) as dot from c where p is not null
""")
def num10_cosine(spark, d):
    """Similarity to the vector before in the same class, with JVM arrays."""
    e = lag_by(table(spark, d, "embeddings").select("label", "vec_id", "embedding"), ["label"], ["vec_id"], {"p": "embedding"}).filter("p is not null")
    return e.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("p")), 6).alias("score"), F.round(vectors.dot(F.col("embedding"), F.col("p")), 6).alias("dot"))


@query()
def num13_leader_clusters(spark, d):
    """Vectors of a label joined to the nearest centre; the leaders of hashed blocks are merged over the whole label."""
    return vectors.leader_clusters(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.2)


@query()
def win08_row_clusters(spark, d):
    """Words of a page in rows, each against the first word of its row."""
    o = observations(spark, d).filter("bbox_normalized is not null")
    w = o.select(F.concat_ws("/", "document_version_id", "page").alias("page_key"), F.col("observation_id").alias("word_no"), (F.get("bbox_normalized", F.lit(0)) * 600).alias("x0"), (F.get("bbox_normalized", F.lit(1)) * 800).alias("y0"))
    return layout.cluster_rows(w, "page_key")


@query(f"""
select observation_id, round(case when u > 0 then w * h / u end, 6) as iou from (select *, (greatest(a[3]-a[1],0)*greatest(a[4]-a[2],0) + greatest(b[3]-b[1],0)*greatest(b[4]-b[2],0) - w*h) as u from
 (select *, greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) as w, greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0) as h from
  (select observation_id, bbox_normalized as a, lag(bbox_normalized) over (partition by document_version_id order by observation_id) as b from {O} where bbox_normalized is not null)) where b is not null)
""")
def arr05_box_overlap(spark, d):
    """Overlap of each box with the one before it in the document."""
    o = observations(spark, d).filter("bbox_normalized is not null").withColumn("b", F.lag("bbox_normalized").over(Window.partitionBy("document_version_id").orderBy("observation_id"))).filter("b is not null")
    return o.select("observation_id", F.round(layout.iou(F.col("bbox_normalized"), F.col("b")), 6).alias("iou"))


@query(f"select document_version_id, min(bbox_normalized[1]) as x0, min(bbox_normalized[2]) as y0, max(bbox_normalized[3]) as x1, max(bbox_normalized[4]) as y1 from {O} where bbox_normalized is not null group by 1")
def arr05_box_union(spark, d):
    o = observations(spark, d).filter("bbox_normalized is not null").groupBy("document_version_id").agg(layout.box_union("bbox_normalized").alias("u"))
    return o.select("document_version_id", *[F.col("u")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query()
def arr06_alignment(spark, d):
    """Ordered lists of the parameters of two stages aligned by a longest common subsequence."""
    o = observations(spark, d).filter("location is not null")
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("stage") == s, F.struct("page", "observation_id", "parameter_code")))), lambda x: x["parameter_code"])
    g = o.groupBy("document_version_id").agg(side("PD").alias("a"), side("RD").alias("b"))
    return layout.align_lists(g, "document_version_id", "a", "b")


@query("select event_id, (props->>'$.k')::bigint as k from events")
def arr02_json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query(f"select document_code, sha256(string_agg(id::varchar || ':' || dataset_stage, ',' order by id)) as digest from {V} where document_code is not null group by 1")
def arr01_group_digest(spark, d):
    """One digest of a group, the same in any order of rows."""
    v = versions(spark, d).filter("document_code is not null")
    members = F.transform(F.array_sort(F.collect_list(F.struct("id", "dataset_stage"))), lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["dataset_stage"]))
    return v.groupBy("document_code").agg(F.sha2(F.array_join(members, ","), 256).alias("digest"))


@query("select user_id, n_keys, round(same::double / n_keys, 6) as agreement from (select user_id, count(*) as n_keys, count(*) filter (where n_days = n_total) as same from (select user_id, event_type, count(distinct ts::date) as n_days, count(*) as n_total from events group by 1, 2) group by 1)")
def arr04_map_agreement(spark, d):
    """Share of keys on which two maps of a row agree."""
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.countDistinct(F.to_date("ts")).alias("a"), F.count("*").alias("b"))
    m = g.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "a"))).alias("a"), F.map_from_entries(F.collect_list(F.struct("event_type", "b"))).alias("b"))
    keys = F.array_union(F.map_keys("a"), F.map_keys("b"))
    same = F.size(F.filter(keys, lambda k: F.col("a")[k] == F.col("b")[k]))
    return m.select("user_id", F.size(keys).cast("long").alias("n_keys"), F.round(same / F.size(keys), 6).alias("agreement"))


@query(f"""
select id, cast(coalesce(
 case when regexp_matches(approval_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_strptime(substr(approval_date, 1, 10), '%Y-%m-%d') end,
 case when regexp_full_match(approval_date, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}') then try_strptime(approval_date, '%d.%m.%Y') end,
 case when regexp_full_match(approval_date, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') then try_strptime(approval_date, '%d/%m/%Y') end,
 case when regexp_full_match(approval_date, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{2}}') then try_strptime(substr(approval_date, 1, 6) || '20' || substr(approval_date, 7, 2), '%d.%m.%Y') end,
 case when regexp_full_match(approval_date, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{2}}') then try_strptime(substr(approval_date, 1, 6) || '20' || substr(approval_date, 7, 2), '%d/%m/%Y') end) as date) as day from {V} where approval_date is not null
""")
def dt01_any_date(spark, d):
    """Dates written in several forms."""
    return versions(spark, d).filter("approval_date is not null").select("id", T.any_date(F.col("approval_date")).alias("day"))


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def job06_tumbling(spark, d):
    """Counts by day and type (the batch form of the stream)."""
    w = S.windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "value")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
with b as (select event_id, ts, event_type, unnest([0, 6, 12, 18]) as back from events), w as (select time_bucket(interval 6 hour, ts, timestamp '2000-01-01') - back * interval 1 hour as s, event_type from b)
select s as window_start, event_type, count(*) as n from w group by 1, 2
""")
def job06_sliding(spark, d):
    """Counts in windows of a day that begin every six hours."""
    w = S.windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "value", "1 day", "6 hours")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""
with g as (select *, case when coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 3 hour, true) then 1 else 0 end as b from events), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as session_start, max(ts) + interval 3 hour as session_end, count(*) as n from s group by user_id, k
""")
def job06_sessions(spark, d):
    s = S.sessions(table(spark, d, "events"), "ts", ["user_id"], "3 hours")
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n from events group by 1, 2 having date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from events)")
def job01_stream_windows(spark, d):
    """The same counts by a stream read to its end; windows the watermark has not passed stay open."""
    out = S.run_stream(spark, f"{d}/events.parquet", lambda s: S.windowed_counts(s, "ts", ["event_type"], "value"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("select distinct user_id, event_type from events")
def job02_stream_once(spark, d):
    """Each key once in a stream."""
    return S.run_stream(spark, f"{d}/events.parquet", lambda s: S.once(s, ["user_id", "event_type"], "ts", "60 days")).select("user_id", "event_type").distinct()


@query("""
with e as (select user_id, event_type = 'error' as bad, ts, event_id from events where event_type in ('error', 'purchase')), s as (select *, coalesce(sum(bad::int) over w, 0) as nb, coalesce(sum((not bad)::int) over w, 0) as ng from e window w as (partition by user_id order by ts rows between unbounded preceding and 1 preceding))
select user_id, count(*)::int as n_attempts, sum(bad::int)::int as n_failed, case when sum(bad::int) < count(*) then 'DONE' when sum(bad::int) >= 3 then 'FAILED' else 'PENDING' end as status from s where ng = 0 and nb < 3 group by 1
""")
def job03_retries(spark, d):
    """Attempts until success or three failures."""
    e = table(spark, d, "events").filter("event_type in ('error', 'purchase')").select("user_id", "ts", (F.col("event_type") == "error").alias("bad"))
    return S.attempts_batch(e, "user_id", "ts", "bad")


_RETRIES = """
with e as (select user_id, event_type = 'error' as bad, ts, event_id from events where event_type in ('error', 'purchase')), s as (select *, coalesce(sum(bad::int) over w, 0) as nb, coalesce(sum((not bad)::int) over w, 0) as ng from e window w as (partition by user_id order by ts rows between unbounded preceding and 1 preceding))
select user_id, count(*)::int as n_attempts, sum(bad::int)::int as n_failed, case when sum(bad::int) < count(*) then 'DONE' when sum(bad::int) >= 3 then 'FAILED' else 'PENDING' end as status from s where ng = 0 and nb < 3 group by 1
"""


@query(_RETRIES)
def job03_stream_retries(spark, d):
    """The same by a stream that keeps the state of each key; the last batch of a key counts."""

    def plan(s: DataFrame) -> DataFrame:
        return S.attempts(s.filter("event_type in ('error', 'purchase')").select("user_id", "ts", (F.col("event_type") == "error").alias("bad")), "user_id", "ts", "bad")

    r = S.run_stream(spark, f"{d}/events.parquet", plan, "update")
    return r.groupBy("user_id").agg(F.max_by(F.struct("n_attempts", "n_failed", "status"), "batch").alias("r")).select("user_id", "r.*")


@query(f"""
with f as (select v.object_id, o.parameter_code, o.location, o.observation_id, o.normalized_value, row_number() over (partition by v.object_id order by o.parameter_code nulls first, o.location nulls first, o.observation_id) - 1 as no from {O} o join {V} v on v.id = o.document_version_id where o.confidence < 0.55)
select object_id, (no // 1000)::int as part, count(*) as n_checks, string_agg(coalesce(parameter_code, '') || '|' || coalesce(location, '') || '|' || observation_id || '|' || coalesce(normalized_value, ''), chr(10) order by no) as checks from f group by 1, 2
""")
def snk01_submission(spark, d):
    """Checks of an object as nested JSON texts, in ordered parts of at most 1 000 checks; read back from the JSON for comparison."""
    v = versions(spark, d).select(F.col("id").alias("document_version_id"), "object_id")
    f = observations(spark, d).filter("confidence < 0.55").join(v, "document_version_id")
    parts = outputs.nested_submission_parts(f, "object_id", ["parameter_code", "location", "observation_id", "normalized_value"])
    read = F.from_json("checks", "array<struct<parameter_code:string,location:string,observation_id:long,normalized_value:string>>")
    line = lambda x: F.concat_ws("|", *[F.coalesce(x[c].cast("string"), F.lit("")) for c in ("parameter_code", "location", "observation_id", "normalized_value")])
    return parts.select("object_id", F.col("part").cast("int").alias("part"), "n_checks", F.array_join(F.transform(read, line), "\n").alias("checks"))


@query(f"select stage, is_approved, count(*) as n from (select case when doc_stage = 'project' then 'pd' when doc_stage = 'working' then 'rd' when doc_stage = 'as_built' then 'id' end as stage, coalesce(lower(trim(approval_status)) in ({', '.join(repr(a) for a in files.APPROVED)}), false) as is_approved from {V}) group by all")
def src06_normalize_registry(spark, d):
    """Stage and approval in one form."""
    return versions(spark, d).select(files.stage_of(F.col("doc_stage")).alias("stage"), F.coalesce(files.approved(F.col("approval_status")), F.lit(False)).alias("is_approved")).groupBy("stage", "is_approved").agg(F.count("*").alias("n"))


@query(f"select page_id, length(text) as n, substr(text, 1, 6000) as clipped from (select distinct on (page_id) * from ocr_pages) where text is not null")
def src16_fragments(spark, d):
    """Page texts as fragments of at most 6 000 characters, with their whole length."""
    p = table(spark, d, "ocr_pages").dropDuplicates(["page_id"]).filter("text is not null")
    return p.select("page_id", F.length("text").cast("long").alias("n"), F.substring("text", 1, 6000).alias("clipped"))
