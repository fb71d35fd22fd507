"""Lexical search over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.functions.text import ngrams, search_text, stem, token_weight, tokens
from dossia.operators.compare import top_per_key


def query_terms(spark: SparkSession, question: str) -> list[tuple[str, str, float]]:
    """(token, stem, weight) of a question."""
    row = spark.range(1).select(tokens(F.lit(question)).alias("t")).select(F.col("t"), F.transform("t", stem).alias("s"), F.transform("t", token_weight).alias("w")).first()
    return list(zip(row.t, row.s, row.w))


def query_phrases(spark: SparkSession, question: str, most: int = 6) -> list[str]:
    row = spark.range(1).select(ngrams(tokens(F.lit(question))).alias("g")).first()
    return list(row.g)[:most]


def lexical_search(texts: DataFrame, question: str, k: int, key: str, text: str = "text", page: list[str] | None = None, per_page: int = 2) -> DataFrame:
    """key, lexical, phrase, score: the k best texts by weight of the question's terms found, phrases on top.

    A plain disjunction over normalised text reaches the scan's filter; scores are JVM expressions;
    with `page`, at most `per_page` hits of one page are kept before the limit.  Score ties go to the smaller key.
    """
    spark = texts.sparkSession
    terms = query_terms(spark, question)
    if not terms:
        return texts.select(key, F.lit(0.0).alias("lexical"), F.lit(0.0).alias("phrase"), F.lit(0.0).alias("score")).limit(0)
    body = search_text(F.coalesce(F.col(text), F.lit("")))
    t = texts.withColumn("_body", body)
    hits = None
    for _, s, _ in terms:
        c = F.col("_body").contains(s)
        hits = c if hits is None else hits | c
    total = sum(w for *_, w in terms)
    lexical = sum((F.when(F.col("_body").contains(s), F.lit(w)).otherwise(F.lit(0.0)) for _, s, w in terms), F.lit(0.0)) / total
    phrases = query_phrases(spark, question)
    phrase = F.lit(0.0)
    for p in phrases:
        phrase = phrase + F.when(F.col("_body").contains(p), F.lit(len(p.split(" ")) / 10.0)).otherwise(F.lit(0.0))
    scored = t.filter(hits).withColumn("lexical", F.round(lexical, 6)).withColumn("phrase", F.round(phrase, 6)).withColumn("score", F.round(0.62 * F.col("lexical") + 1.2 * F.col("phrase"), 6))
    if page:
        scored = top_per_key(scored, page, [F.col("score").desc(), F.col(key)], per_page)
    return scored.select(key, "lexical", "phrase", "score").orderBy(F.col("score").desc(), key).limit(k)
