"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossia.llm import lookalikes, mixture, scans, spans, split, tokenize
from dossia.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split.long_texts(table(spark, d, "chunks"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.dirty_rows(table(spark, d, "rule_observations"), table(spark, d, "chunks"), table(spark, d, "doc_facts"))


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical_texts(lookalikes.sources(table(spark, d, "rule_observations"), table(spark, d, "chunks"), table(spark, d, "doc_facts")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise_found(table(spark, d, "ocr_pages"), table(spark, d, "chunks"), table(spark, d, "rule_observations"))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "ocr_pages"), table(spark, d, "chunks"), table(spark, d, "rule_observations"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(table(spark, d, "documents"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(spans.shared_cores(table(spark, d, "documents")))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(spans.shared_cores(table(spark, d, "documents")))


def p9_parts(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_parts(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_classes(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p3_found, p3_texts, p6_found, p6_repaired, p7_ids, p8_mixture, p8_shares, p9_found, p9_spans, p9_parts, p9_classes)}
_SHARED = """w as (select doc_id, i, substr(text, i, 200) as s from documents, lateral (select unnest(range(1, length(text) - 198)) as i) where length(text) >= 200),
g as (select s from w group by s having count(distinct doc_id) > 1), x as (select w.* from w semi join g on w.s = g.s)"""

SQL: dict[str, str] = {
    "p2_found": r"""
with t as (select distinct chunk_id, text from chunks where length(text) > 1400), p as (select chunk_id, text, regexp_split_to_array(text, '\n[^\S\n]*\n\s*|\f') as ps from t),
q as (select chunk_id, text, ps, flatten(list_transform(ps, lambda x: string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) as ss from p)
select chunk_id, case when list_max(list_transform(ps, lambda x: length(x))) <= 1400 then 'paragraph' when list_max(list_transform(ss, lambda x: length(x))) <= 1400 then 'sentence'
 when list_max(list_transform(regexp_split_to_array(text, '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+'), lambda x: length(x))) <= 1400 then 'word' else 'none' end as boundary from q
""",
    "p3_found": r"""
with t as (select 'rule_observations' as src, observation_id as row_id, value as text from rule_observations union all select 'chunks', chunk_id, text from chunks union all select 'doc_facts', doc_id, section_key from doc_facts)
select distinct src, row_id from t where regexp_matches(text, '[\x{ff01}-\x{ff60}\x{ffe0}-\x{ffe6}]') or regexp_matches(text, '[\t\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]')
 or regexp_matches(text, '[\x{ad}\x{34f}\x{61c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}]') or length(nfc_normalize(text)) < length(text)
 or regexp_matches(text, '\p{Cyrillic}[\p{Latin}\p{Greek}]|\p{Latin}[\p{Cyrillic}\p{Greek}]|\p{Greek}[\p{Cyrillic}\p{Latin}]') or (src = 'doc_facts' and regexp_matches(regexp_replace(text, '\p{Cyrillic}', '', 'g'), '\p{L}'))
""",
    "p9_found": f"with {_SHARED} select distinct a.doc_id as doc_a, b.doc_id as doc_b from x a join x b on a.s = b.s and a.doc_id < b.doc_id",
    "p9_spans": f"""
with {_SHARED}, d as (select distinct doc_id, i from x), r as (select *, sum(case when coalesce(i - p > 200, true) then 1 else 0 end) over (partition by doc_id order by i) as k from (select *, lag(i) over (partition by doc_id order by i) as p from d))
select doc_id, (min(i) - 1)::int as start, (max(i) + 200 - min(i))::int as length from r group by doc_id, k
""",
    "p9_parts": f"""
with {_SHARED}, d as (select distinct doc_id, i from x), r as (select *, sum(case when coalesce(i - p > 200, true) then 1 else 0 end) over (partition by doc_id order by i) as k from (select *, lag(i) over (partition by doc_id order by i) as p from d)),
sp as (select doc_id, k, max(i) + 200 - min(i) as length from r group by doc_id, k), s as (select doc_id, count(*) as n_spans, sum(length)::bigint as shared_chars from sp group by doc_id)
select a.doc_id, a.n_chars, coalesce(s.n_spans, 0) as n_spans, coalesce(s.shared_chars, 0) as shared_chars, case when a.n_chars > 0 then coalesce(s.shared_chars, 0) / a.n_chars else 0.0 end as shared_part
from (select doc_id, max(coalesce(length(text), 0))::int as n_chars from documents group by doc_id) a left join s on a.doc_id = s.doc_id
""",
    "p9_classes": f"""
with recursive {_SHARED}, e as (select distinct a.doc_id as u, b.doc_id as v from x a join x b on a.s = b.s and a.doc_id <> b.doc_id),
c(n, m) as (select doc_id, doc_id from documents union select e.v, c.m from c join e on c.n = e.u)
select n as doc_id, min(m) as class_id from c group by n
""",
}
