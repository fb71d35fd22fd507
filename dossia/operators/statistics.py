"""Statistics over groups: intervals, outliers, confusion counts, term weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.functions.text import word_distance
from dossia.operators.ordered import ranks_by
from dossia.operators.units import small
from dossia.session import materialize

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The 95 % bounds of a share k of n; nulls where n is 0."""
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def mad_outliers(df: DataFrame, keys: list[str], value: str, least: int = 6, z: float = 4.5, spread: float = 0.5) -> DataFrame:
    """Rows of groups of `least` and more that are z robust deviations (1.4826 times the median distance) and `spread` of the median away from it; none where the median or that distance is 0 or less."""
    df = materialize(df)  # read several times
    med = materialize(medians(df, keys, value, "med").filter(F.col("n") >= least))
    dev = df.join(small(med), keys).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    mad = materialize(medians(dev.select(*keys, "dev"), keys, "dev", "mad").drop("n"))
    out = dev.join(small(mad), keys).withColumn("z", F.when(F.col("mad") > 0, F.col("dev") / (F.col("mad") * 1.4826)))
    return out.filter((F.col("z") >= z) & (F.col("med") > 0) & (F.col("dev") >= spread * F.col("med")))


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, n, name: the exact median of each group's values; ranked by ranges, so that no task holds a hot group."""
    v = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    n = materialize(v.groupBy(*keys).agg(F.count("*").alias("n")))
    ranked = ranks_by(v, keys, ["_v"], "_r").join(small(n), keys)
    middle = ranked.filter((F.col("_r") == F.floor((F.col("n") + 1) / 2)) | (F.col("_r") == F.ceil((F.col("n") + 1) / 2)))
    return middle.groupBy(*keys).agg(F.first("n").alias("n"), F.avg("_v").alias(name))


def reading_errors(df: DataFrame, by: str, reference: str, read: str) -> DataFrame:
    """by, edits, chars, cer, word_edits, words, wer: edits by characters (code points) and by words of the reference."""
    words = F.size(F.filter(F.split(F.col(reference), r"\s+"), lambda w: w != ""))
    g = df.select(by, F.levenshtein(F.col(read), F.col(reference)).alias("_e"), F.length(reference).alias("_c"), word_distance(F.col(reference), F.col(read)).alias("_we"), words.alias("_w")).groupBy(by).agg(F.sum("_e").alias("edits"), F.sum("_c").alias("chars"), F.sum("_we").alias("word_edits"), F.sum("_w").alias("words"))
    return g.select(by, "edits", "chars", F.round(F.col("edits") / F.nullif("chars", F.lit(0)), 6).alias("cer"), "word_edits", "words", F.round(F.col("word_edits") / F.nullif("words", F.lit(0)), 6).alias("wer"))


def confusion(df: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """Counts, precision, recall and F1 overall and by each value of `by`, in one pass with grouping sets; all is null in by where overall."""
    sets = [[], by]
    d = df.select(*by, predicted.alias("_p"), actual.alias("_a"))
    g = d.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by])
    out = g.agg(
        F.count_if(F.col("_p") & F.col("_a")).alias("tp"),
        F.count_if(F.col("_p") & ~F.col("_a")).alias("fp"),
        F.count_if(~F.col("_p") & F.col("_a")).alias("fn"),
        F.count_if(~F.col("_p") & ~F.col("_a")).alias("tn"),
    )
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return out.select(*by, "tp", "fp", "fn", "tn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def inverse_frequency(n_docs: Column, df: Column) -> Column:
    """ln((N + 1) / (df + 1)) + 0.1, half where no document has the term."""
    w = F.log((n_docs + 1) / (df + 1)) + 0.1
    return F.when(df == 0, w / 2).otherwise(w)


def hash_split(c: Column, parts: int = 3) -> Column:
    """A split by the first eight hex digits of the SHA-256 of a key, the same in any engine."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") % parts).cast("int")
