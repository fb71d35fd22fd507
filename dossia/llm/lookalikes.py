"""One form for text that looks the same.

Look-alikes are joined by union-find into transitive classes, over strings: a
full-width form and its plain one, a letter with a mark beside it and the composed
letter, letters of different alphabets that share a shape, blanks, and characters
without ink (alike to nothing).  The class of a word follows from the classes of its
characters: words with one skeleton look the same.  Of the spellings of a skeleton that
occur in the corpus the most frequent clean one stands for all; where none is clean,
a word takes the alphabet most of its unambiguous letters have, then the most frequent.
A multi-pattern automaton (Aho-Corasick over the spellings to be replaced) finds the
longest of them that begins first, and texts are rewritten from left to right.

Two passes over the texts: one counts words (per batch, then one shuffle of distinct
words), one rewrites.  The patterns are the rare spellings, not the vocabulary; up to
MAX_PATTERNS they go to the tasks as an automaton, beyond it words are joined to them.

Defined results: null stays null, empty text stays empty; the result has no full-width
form, blank but the plain one, invisible character or decomposed letter; line ends and
form feeds stay; case, digits and signs such as № ² ³ ° ‰, quotes and dashes stay.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.functions.chars import BLANKS, INVISIBLE
from dossia.session import materialize

MAX_PATTERNS = 200_000

# Letters that share a shape, Latin Cyrillic Greek; a dot where an alphabet has none.
SHAPES = (
    "AАΑ BВΒ CС. EЕΕ HНΗ IІΙ JЈ. KКΚ MМΜ N.Ν OОΟ PРΡ SЅ. TТΤ XХΧ YУΥ Z.Ζ "
    "aа. cс. eе. iі. jј. oоο pрρ sѕ. v.ν xх. yу. hһ. ËЁ. ëё. .ГΓ .ПΠ .ФΦ"
)


class UnionFind:
    """Disjoint sets over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.parent.get(root, root) != root:
            root = self.parent[root]
        while self.parent.get(x, x) != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        self.parent.setdefault(a, ra)
        self.parent.setdefault(b, rb)
        if ra != rb:
            lo, hi = sorted((ra, rb), key=lambda s: (len(s), s))
            self.parent[hi] = lo

    def classes(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), set()).add(x)
        return out


def script(ch: str) -> str:
    """L, C or G for letters of the three alphabets, else ''."""
    o = ord(ch)
    if o < 0x80:
        return "L" if ch.isalpha() else ""
    if 0xC0 <= o <= 0x24F and ch.isalpha() or 0x1E00 <= o <= 0x1EFF:
        return "L"
    if 0x400 <= o <= 0x52F and not 0x482 <= o <= 0x489:
        return "C"
    if 0x370 <= o <= 0x3FF and ch.isalpha() or 0x1F00 <= o <= 0x1FFF and ch.isalpha():
        return "G"
    return ""


@lru_cache(maxsize=1)
def _shape_sets() -> list[str]:
    return [t.replace(".", "") for t in SHAPES.split(" ") if len(t.replace(".", "")) > 1]


@lru_cache(maxsize=1)
def lookalike_classes() -> UnionFind:
    """All rules as one union-find over strings."""
    u = UnionFind()
    for group in _shape_sets():
        for a, b in zip(group, group[1:]):
            u.union(a, b)
    for c in range(0xFF01, 0xFF5F):
        u.union(chr(c), chr(c - 0xFEE0))
    for b in BLANKS:
        u.union(b, " ")
    for i in INVISIBLE:
        u.union(i, "")
    for c in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and unicodedata.normalize("NFC", d) == chr(c):
            u.union(d, chr(c))
    return u


@lru_cache(maxsize=1)
def _skeleton_map() -> dict[int, str | None]:
    """code point -> the first member of its class; composed letters stay composed."""
    u = lookalike_classes()
    table: dict[int, str | None] = {}
    for root, members in u.classes().items():
        for m in members:
            if len(m) == 1 and m != root:
                table[ord(m)] = root or None
    for c, r in list(table.items()):
        if r is not None and len(r) > 1:
            del table[c]
    return table


_SIMPLE = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {ord(b): " " for b in BLANKS} | {ord(i): None for i in INVISIBLE}
_MARKS = "\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
_ODD = re.compile(f"[{re.escape(''.join(chr(c) for c in range(0xFF01, 0xFF5F)) + BLANKS + INVISIBLE)}{_MARKS}]")
# \w takes numbers that are no decimal digits (² ½ Ⅳ) for letters, which they are not here
_NUMBERS = "".join(chr(c) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) in ("No", "Nl"))
_WORD = re.compile(f"[^\\W\\d_{_NUMBERS}]+")
_CYR, _LAT, _GRK = "Ѐ-ҁҊ-ԯ", "A-Za-z\u00aa\u00baÀ-ÖØ-öø-ɏḀ-ỿ", "Ͱ-ͳͶͷͻ-ͽͿΆΈ-Ͽἀ-\u1fff"
_FOREIGN_RUN = re.compile(f"[{_LAT}]+|[{_GRK}]+")
_FULL = re.compile("[\uff01-\uff60\uffe0-\uffe6]")
_BLANK = re.compile(f"[{re.escape(BLANKS)}]")
_UNSEEN = re.compile(f"[{re.escape(INVISIBLE)}]")
_MARK = re.compile(f"[{_MARKS}]")


def mixed(text: str) -> bool:
    """Whether letters of two alphabets stand side by side (every such place borders a run of Latin or Greek)."""
    n = len(text)
    for m in _FOREIGN_RUN.finditer(text):
        a, b = m.span()
        if (b < n and script(text[b])) or (a and script(text[a - 1])):
            return True
    return False


def simplify(text: str) -> str:
    """Plain forms, plain blanks, no invisible characters, composed letters."""
    if _ODD.search(text):
        text = text.translate(_SIMPLE)
        if _MARK.search(text):
            text = unicodedata.normalize("NFC", text)
    return text


def skeleton(word: str) -> str:
    """The same for all words that look the same."""
    return simplify(word).translate(_skeleton_map())


_MARK_RUN = re.compile(f"[^{_MARKS}][{_MARKS}]+")


def apart(text: str) -> bool:
    """Whether some mark stands apart from a letter it could be one character with."""
    return any(len(unicodedata.normalize("NFC", m[0])) < len(m[0]) for m in _MARK_RUN.finditer(text))


def faults(text: str) -> list[str]:
    """What makes the characters of a text differ from what they look like."""
    out = []
    if not text.isascii():
        if _FULL.search(text):
            out.append("full_width")
        if _UNSEEN.search(text):
            out.append("invisible")
        if _MARK.search(text) and apart(text):
            out.append("accent")
        if mixed(text):
            out.append("alphabets")
    if _BLANK.search(text):
        out.append("blank")
    return out


@lru_cache(maxsize=3)
def _twins(to: str) -> dict[int, str]:
    return {ord(a): b for g in _shape_sets() for a in g for b in g if script(b) == to and script(a) != to}


def to_script(word: str, to: str) -> str:
    """The word with every letter that has a twin in alphabet `to` replaced by it."""
    return word.translate(_twins(to))


def resolve(word: str, common: str = "C") -> str:
    """A mixed word in the alphabet its unambiguous letters have most, else most of its letters, else `common`."""
    sure, all_letters = {"C": 0, "L": 0, "G": 0}, {"C": 0, "L": 0, "G": 0}
    for c in word:
        if s := script(c):
            all_letters[s] += 1
            sure[s] += not any(c in g for g in _shape_sets())
    return to_script(word, max(sure, key=lambda s: (sure[s], all_letters[s], s == common, s)))


_ONE_ALPHABET = re.compile(f"(?:[{_LAT}]+|[{_CYR}]+|[{_GRK}]+)")


def _words(batches):
    """Distinct simplified words of each batch with their skeleton, count, whether they are of one alphabet, and what they are resolved to if not."""
    from collections import Counter

    import pyarrow as pa

    for b in batches:
        counts: Counter[str] = Counter()
        for text in b.column(0).to_pylist():
            if text:
                counts.update(_WORD.findall(simplify(text)))
        table = _skeleton_map()
        words = list(counts)
        clean = [_ONE_ALPHABET.fullmatch(w) is not None for w in words]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.translate(table) for w in words], pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array(clean, pa.bool_()), pa.array([None if c else resolve(w) for w, c in zip(words, clean)], pa.string())],
            names=["skeleton", "word", "n", "clean", "resolved"],
        )


def spellings(texts: DataFrame, column: str) -> DataFrame:
    """word, representative for every spelling that does not stand for its class, and for every one of several alphabets."""
    counted = texts.select(column).mapInArrow(_words, "skeleton string, word string, n long, clean boolean, resolved string")
    counted = counted.groupBy("skeleton", "word").agg(F.sum("n").alias("n"), F.first("clean").alias("clean"), F.first("resolved").alias("resolved"))
    groups = counted.groupBy("skeleton").agg(
        F.max(F.when(F.col("clean"), F.struct(F.col("n"), F.col("word")))).alias("best"),
        F.min_by("resolved", "word").alias("resolved"),
        F.collect_list(F.struct("word", "clean")).alias("words"),  # the spellings of one skeleton: at most a few letters' worth of twins
        F.count("*").alias("kinds"),
        F.min("clean").alias("all_clean"),
    )
    groups = groups.filter((F.col("kinds") > 1) | ~F.col("all_clean"))
    pairs = groups.select(F.explode("words").alias("w"), F.coalesce("best.word", "resolved").alias("representative"))
    return pairs.select("w.word", "representative", "w.clean").filter((F.col("word") != F.col("representative")) | ~F.col("clean")).drop("clean")


def _automaton(pairs: list[tuple[str, str]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, to in pairs:
        a.add_word(word, (len(word), to))
    if pairs:
        a.make_automaton()
    return a


def rewrite(text: str, automaton) -> str:
    """Patterns replaced greedily from left to right, the longest that begins first, where they are whole words."""
    return _replace(text, automaton)[0]


def _replace(text: str, automaton) -> tuple[str, bool]:
    """The rewritten text and whether any pattern stands in it."""
    if not len(automaton):
        return text, False
    hits: dict[int, tuple[int, str]] = {}
    for end, (n, to) in automaton.iter(text):
        s = end - n + 1
        if (s == 0 or not text[s - 1].isalpha()) and (end + 1 == len(text) or not text[end + 1].isalpha()):
            if s not in hits or hits[s][0] < n:
                hits[s] = (n, to)
    if not hits:
        return text, False
    out, at = [], 0
    for s in sorted(hits):
        if s >= at:
            out += [text[at:s], hits[s][1]]
            at = s + hits[s][0]
    return "".join(out) + text[at:], True


_AUTOMATA: dict[int, object] = {}


def _rewriter(shared, check: bool):
    def run(batches):
        import pyarrow as pa

        a = _AUTOMATA.get(shared.id) if hasattr(shared, "id") else None
        if a is None:
            a = _automaton(shared.value)
            if hasattr(shared, "id"):
                _AUTOMATA.clear()
                _AUTOMATA[shared.id] = a
        for b in batches:
            new, touched = [], []
            for t in b.column(2).to_pylist():
                if t is None:
                    new.append(None)
                    touched.append(False)
                    continue
                plain = simplify(t)
                text, hit = _replace(plain, a)
                new.append(text)
                touched.append(hit or text != t)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(new, pa.string()), pa.array(touched, pa.bool_())], names=["src", "row_id", "text", "canonical", "touched"])
            yield from _check([out]) if check else [out]

    return run


def _parts(batches):
    """Each text in order as words and what stands between them."""
    import pyarrow as pa

    for b in batches:
        ids, places, parts = [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            at, own = 0, []
            for m in _WORD.finditer(text or ""):
                own += [text[at : m.start()], m[0]]
                at = m.end()
            own.append((text or "")[at:])
            ids += [i] * len(own)
            places += range(len(own))
            parts += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(parts, pa.string())], names=["_id", "at", "word"])


def _join_rewrite(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same rewriting without an automaton: words joined to their representatives, texts put together again."""
    keyed = materialize(base.withColumn("_id", F.monotonically_increasing_id()))
    parts = keyed.select("_id", "canonical").mapInArrow(_parts, "_id long, at int, word string").join(pairs, "word", "left")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("representative", "word").alias("w")))), lambda x: x["w"]), "")
    parts = parts.groupBy("_id").agg(whole.alias("whole"), F.max(F.col("representative").isNotNull()).alias("hit"))
    return keyed.join(parts, "_id", "left").select("src", "row_id", "text", F.when(F.col("canonical").isNotNull(), F.col("whole")).alias("canonical"), (F.col("touched") | F.coalesce("hit", F.lit(False))).alias("touched"))


def _check(batches):
    """Exact check of the texts the classes have a say in: what in them differs from what it looks like."""
    import pyarrow as pa

    for b in batches:
        found = [faults(t) if touched and t else [] for t, touched in zip(b.column(2).to_pylist(), b.column(4).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(found, pa.list_(pa.string()))], names=["src", "row_id", "text", "canonical", "faults"])


FAULTS = "src string, row_id long, text string, canonical string, faults array<string>"


def canonical_texts(texts: DataFrame, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """src, row_id, text -> the same with canonical and faults (full_width, blank, invisible, accent, alphabets).

    Only texts the classes have a say in can have faults: those that are rewritten, and those with a word of several
    alphabets that stands for itself.
    """
    spark = texts.sparkSession
    pairs = materialize(spellings(texts, "text"))
    texts = texts.select("src", "row_id", "text")
    if pairs.count() <= max_patterns:
        shared = spark.sparkContext.broadcast(sorted((r.word, r.representative) for r in pairs.collect()))
        return texts.mapInArrow(_rewriter(shared, True), FAULTS)
    plain = texts.mapInArrow(_rewriter(spark.sparkContext.broadcast([]), False), "src string, row_id long, text string, canonical string, touched boolean")
    return _join_rewrite(plain, pairs).mapInArrow(_check, FAULTS)


# Section marks are Cyrillic: any other letter in them is read as the Cyrillic one it looks like.
ALPHABET_OF = {"doc_facts": "C"}


def dirty_rows(observations: DataFrame, chunks: DataFrame, facts: DataFrame, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """src, row_id of the rows that rewriting has a say in and that hold a fault; in section marks also any letter that is not Cyrillic."""
    texts = sources(observations, chunks, facts)
    own = F.col("src").isin(list(ALPHABET_OF))
    found = canonical_texts(texts.filter(~own), max_patterns).filter(F.size("faults") > 0).select("src", "row_id")
    marks = section_marks(texts.filter(own)).filter(F.col("canonical") != F.col("text")).select("src", "row_id")
    return found.unionByName(marks).distinct()


def _marks(batches):
    import pyarrow as pa

    other = re.compile(f"[^\\W\\d_{_NUMBERS}{_CYR}]")
    for b in batches:
        new = []
        for t in b.column(2).to_pylist():
            c = None if t is None else to_script(simplify(t), "C")
            new.append(None if c is None else other.sub("\ufffd", c))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(new, pa.string())], names=["src", "row_id", "text", "canonical"])


def section_marks(texts: DataFrame) -> DataFrame:
    """Texts that only have Cyrillic letters: each character becomes the Cyrillic member of its class, U+FFFD where the class has none."""
    return texts.select("src", "row_id", "text").mapInArrow(_marks, "src string, row_id long, text string, canonical string")


def sources(observations: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """The three text columns as src, row_id, text."""
    parts = [
        observations.select(F.lit("rule_observations").alias("src"), F.col("observation_id").cast("long").alias("row_id"), F.col("value").alias("text")),
        chunks.select(F.lit("chunks").alias("src"), F.col("chunk_id").cast("long").alias("row_id"), F.col("text").alias("text")),
        facts.select(F.lit("doc_facts").alias("src"), F.col("doc_id").cast("long").alias("row_id"), F.col("section_key").alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
