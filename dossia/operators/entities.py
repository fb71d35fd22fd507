"""Tagging texts with phrases and resolving names to known entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossia.functions.text import search_text, sequence_ratio, stem, tokens
from dossia.operators.compare import top_per_key


def tag_texts(texts: DataFrame, key: str, text: str, anchors: list[tuple[str, str]]) -> DataFrame:
    """key, code, pos: every place of every anchor phrase in lower-cased texts, by one automaton a task.

    anchors is a vocabulary of fixed size; texts are read once and not shuffled.
    """

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        phrases: dict[str, list[str]] = {}
        for code, phrase in anchors:
            if phrase:
                phrases.setdefault(phrase, []).append(code)
        a = ahocorasick.Automaton()
        for phrase, codes in phrases.items():
            a.add_word(phrase, (len(phrase), codes))
        if phrases:
            a.make_automaton()
        for b in batches:
            keys, codes, places = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and phrases:
                    for end, (n, cs) in a.iter(t.lower()):
                        for c in cs:
                            keys.append(k)
                            codes.append(c)
                            places.append(end - n + 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(codes, pa.string()), pa.array(places, pa.int64())], names=[key, "code", "pos"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, code string, pos long")


def resolve(drafts: DataFrame, known: DataFrame, least: float = 0.4, k: int = 5) -> DataFrame:
    """draft_id, entity_id, score, rank: up to k entities for each name.

    0.5 for an equal name, else 0.35 for a contained one, 0.25 times the likeness from 0.55 on, 0.1 for an equal
    kind; `least` lies above what likeness and kind can give alone, so only equal or (at word bounds) contained
    names are candidates.  A contained name has all its stems in the other: the one fewest names have is its key,
    so frequent words join nothing but names made of them alone.
    """
    if least <= 0.35:
        raise ValueError("below this score names without a common word would be candidates")
    d = drafts.select("draft_id", search_text(F.col("name")).alias("name"), "kind")
    e = known.select("entity_id", search_text(F.col("name")).alias("ename"), F.col("kind").alias("ekind"))
    stems = lambda c: F.transform(tokens(F.col(c)), stem)
    ds = d.select("draft_id", "name", "kind", F.explode(stems("name")).alias("stem")).distinct()
    es = e.select("entity_id", "ename", "ekind", F.explode(stems("ename")).alias("stem")).distinct()
    df = ds.select("stem").unionByName(es.select("stem")).groupBy("stem").agg(F.count("*").alias("df"))

    def rarest(rows: DataFrame, key: str, *cols: str) -> DataFrame:
        r = rows.join(df, "stem").groupBy(key).agg(*[F.first(c).alias(c) for c in cols], F.min(F.struct("df", "stem")).alias("m"))
        return r.select(key, *cols, F.col("m.stem").alias("stem"))

    out = ["draft_id", "name", "kind", "entity_id", "ename", "ekind"]
    inside = rarest(ds, "draft_id", "name", "kind").join(es, "stem").select(*out)
    around = ds.join(rarest(es, "entity_id", "ename", "ekind"), "stem").select(*out)
    has = F.col("name").contains(F.col("ename")) | F.col("ename").contains(F.col("name"))
    pairs = inside.unionByName(around).filter(has).distinct().withColumn("ratio", sequence_ratio("name", "ename"))
    score = F.when(F.col("name") == F.col("ename"), 0.5).otherwise(0.35) + F.when(F.col("ratio") >= 0.55, 0.25 * F.col("ratio")).otherwise(0.0) + F.when(F.col("kind") == F.col("ekind"), 0.1).otherwise(0.0)
    scored = pairs.withColumn("score", F.round(F.least(score, F.lit(1.0)), 6)).filter(F.col("score") >= least)
    best = top_per_key(scored, ["draft_id"], [F.col("score").desc(), F.col("entity_id")], k)
    w = Window.partitionBy("draft_id").orderBy(F.col("score").desc(), "entity_id")
    return best.select("draft_id", "entity_id", "score", F.row_number().over(w).alias("rank"))
