"""Text expressions: normalising, tokens, stems, keys, dates."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from dossia.functions.chars import plain

# Endings of the light stemmer.
RU_ENDINGS = [
    "иями", "ями", "ами", "его", "ого", "ему", "ому", "ими", "ыми", "ией", "ия", "ья", "ье", "ью",
    "ах", "ях", "ов", "ев", "ей", "ой", "ый", "ий", "ая", "яя", "ое", "ее", "ую", "юю", "ам", "ям",
    "ом", "ем", "ым", "им", "ых", "их", "ою", "ею", "ы", "и", "а", "я", "о", "е", "у", "ю",
]
# Words without content in questions.
STOPWORDS = [
    "и", "в", "во", "на", "по", "с", "со", "к", "ко", "у", "из", "за", "для", "о", "об", "от", "до", "под",
    "как", "что", "это", "ли", "или", "а", "но", "не", "над", "при", "про", "без", "стр", "страница",
    "где", "какой", "какая", "какие", "какое", "который", "которая", "которые", "есть", "нет", "нужно", "надо",
    "найди", "покажи", "скажи", "расскажи", "документ", "документы", "документация", "проект", "проектный",
    "the", "and", "for", "with", "from", "page", "file", "document", "project",
]


def search_text(c: Column) -> Column:
    """Lower case, ё as е, one kind of dash, blanks collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "ё–—‑", "е---"), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Distinct tokens of two characters and more in order, without stop words."""
    raw = F.regexp_extract_all(search_text(c), F.lit(r"[0-9a-zа-я]+(?:[-_/.][0-9a-zа-я]+)*"), F.lit(0))
    return F.filter(F.array_distinct(raw), lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))


def stem(c: Column) -> Column:
    """The longest ending taken off where a stem of four letters stays."""
    return F.regexp_replace(c, "^(.{4,}?)(?:" + "|".join(RU_ENDINGS) + ")$", "$1")


def token_weight(t: Column) -> Column:
    """1, plus 0.9 for digits, 0.6 for joiners, 0.2 from eight characters."""
    return F.lit(1.0) + F.when(t.rlike(r"\d"), 0.9).otherwise(0.0) + F.when(t.rlike("[-_/]"), 0.6).otherwise(0.0) + F.when(F.length(t) >= 8, 0.2).otherwise(0.0)


def ngrams(words: Column, longest: int = 4) -> Column:
    """Phrases of `longest` to two words, longer ones first."""

    def phrases(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    parts = [phrases(n) for n in range(longest, 1, -1)]
    return F.concat(*parts)


def key_form(c: Column) -> Column:
    """A key without prefix `Ст.`, decimal commas and leading zeros of its parts."""
    k = F.regexp_replace(F.lower(F.trim(c)), r"^ст\.?\s*", "")
    return F.regexp_replace(F.translate(k, ",", "."), r"(^|[.\-/])0+(?=\d)", "$1")


def natural_key(c: Column) -> Column:
    """A sort key in which numbers compare as numbers."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)), "")


def any_date(c: Column) -> Column:
    """A date in any of the forms 2024-05-31, 31.05.2024, 31.05.24, 31/05/24, 31/05/2024, or a serial day number; else null."""
    s = F.trim(c)
    forms = F.coalesce(
        F.when(s.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")),
        F.when(s.rlike(r"^\d\d\.\d\d\.\d{4}$"), F.try_to_date(s, "dd.MM.yyyy")),
        F.when(s.rlike(r"^\d\d/\d\d/\d{4}$"), F.try_to_date(s, "dd/MM/yyyy")),
        F.when(s.rlike(r"^\d\d\.\d\d\.\d\d$"), F.try_to_date(F.concat(F.substring(s, 1, 6), F.lit("20"), F.substring(s, 7, 2)), "dd.MM.yyyy")),
        F.when(s.rlike(r"^\d\d/\d\d/\d\d$"), F.try_to_date(F.concat(F.substring(s, 1, 6), F.lit("20"), F.substring(s, 7, 2)), "dd/MM/yyyy")),
        F.when(s.rlike(r"^\d{5}$"), F.date_add(F.lit("1899-12-30").cast("date"), s.try_cast("int"))),
    )
    return forms


def revision_number(c: Column) -> Column:
    """The number of a revision mark (изм. 2, кор.3, 2), letters A, B, ... as 1, 2, ...; -1 if there is none."""
    digits = F.regexp_extract(c, r"(\d+)", 1)
    letter = F.regexp_extract(F.lower(c), r"rev\s*\.?\s*([a-z])\b", 1)
    return F.coalesce(F.when(digits != "", digits.try_cast("int")), F.when(letter != "", F.ascii(letter) - 96), F.lit(-1))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def search_text_any(c: Column) -> Column:
    """search_text of any text: also full-width forms, all blanks and line ends, characters without ink, and accents apart from their letter."""
    return F.trim(F.regexp_replace(search_text(nfc(plain(c))), r"(?U)\s+", " "))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp likeness of two texts; null if one is null."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def word_error_parts(reference: list[str], read: list[str]) -> int:
    """Edit distance over words."""
    row = list(range(len(read) + 1))
    for i, w in enumerate(reference, 1):
        last, row[0] = row[0], i
        for j, r in enumerate(read, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != r))
    return row[-1]


@F.pandas_udf(LongType())
def word_distance(reference: pd.Series, read: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else word_error_parts(a.split(), b.split()) for a, b in zip(reference, read)], dtype="Int64")


def utc_naive(c: Column) -> Column:
    """A time text as UTC without a zone, whatever the zone of the session: 2024-05-31T10:00:00 with Z, an offset such as +03:00, or nothing; else null."""
    sign = F.when(F.regexp_extract(c, r"([+-])\d\d:?\d\d$", 1) == "-", -1).otherwise(1)
    part = lambda i: F.coalesce(F.regexp_extract(c, r"[+-](\d\d):?(\d\d)$", i).try_cast("int"), F.lit(0))
    day = F.replace(F.substring(c, 1, 19), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    zoned = F.length(c) > 19
    return day - F.make_dt_interval(F.lit(0), F.when(zoned, sign * part(1)).otherwise(0), F.when(zoned, sign * part(2)).otherwise(0), F.lit(0))


def clean_metadata(members: dict[str, Column], kinds: dict[str, str]) -> Column:
    """A map of texts: nulls and numbers that are NaN or infinite left out, lists, maps and structs as JSON text."""

    def one(name: str, c: Column) -> Column:
        kind = kinds.get(name, "string")
        if kind.startswith(("array", "map", "struct")):
            return F.to_json(c)
        if kind in ("double", "float"):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c.cast("string"))
        return c.cast("string")

    pairs = F.array(*[F.struct(F.lit(k).alias("key"), one(k, c).alias("value")) for k, c in members.items()])
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))
