"""Character classes and per-character folding as JVM-side column expressions.

The classes are made from rules over code points, so they hold for any text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width ASCII: U+FF01..U+FF5E stand for U+0021..U+007E.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
FULL_WIDTH_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
# Blanks other than the plain one; line ends and form feeds are no blanks here.
BLANKS = "\t\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u202f\u205f\u3000"
# Characters without ink.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e" + "".join(chr(c) for c in [*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070)]) + "\ufeff"

# Letters of Latin and Greek that look like a Cyrillic letter, in pairs.
LATIN_LOOKS = "ABCEHKMOPTXYaceopxyikm"
CYRILLIC_LOOKS = "АВСЕНКМОРТХУасеорхуікм"

SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺"
SUPERSCRIPT_ASCII = "0123456789-+"


def plain(c: Column) -> Column:
    """Full-width forms to ASCII, every blank to the plain one, invisible characters removed."""
    return F.translate(c, FULL_WIDTH + BLANKS + INVISIBLE, FULL_WIDTH_ASCII + " " * len(BLANKS))


def plain_py(s: str) -> str:
    return s.translate(_PLAIN)


_PLAIN = {ord(a): b for a, b in zip(FULL_WIDTH + BLANKS, FULL_WIDTH_ASCII + " " * len(BLANKS))} | {ord(c): None for c in INVISIBLE}

FOLD_FROM = LATIN_LOOKS + "ΑΒΕΗΚΜΟΡΤΧορ" + "²³"
FOLD_TO = CYRILLIC_LOOKS + "АВЕНКМОРТХор" + "23"


def fold_looks(c: Column) -> Column:
    """Lower case with look-alike letters of Latin and Greek as Cyrillic and raised 2, 3 as digits; for comparing keys only."""
    return F.lower(F.translate(c, FOLD_FROM, FOLD_TO))


def fold_looks_py(s: str) -> str:
    return s.translate(str.maketrans(FOLD_FROM, FOLD_TO)).lower()
