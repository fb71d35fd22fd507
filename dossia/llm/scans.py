"""Repairing the text of scanned pages.

1. One pass counts the words of all texts (whole words, compounds, the first parts of
   compounds, and words broken over a line end put together) - distinct words of a
   batch, then one shuffle.
2. A symmetric-delete index over that lexicon generates correction candidates: words
   that agree once any one character is left out of either or both, or two of those that
   scanning takes for another out of both, or two characters read for one are put together.
   A weighted edit distance with confusion pairs ranks the candidates; a candidate must be
   far more frequent than the misread word, and further still for an edit that is no known
   confusion.  Where two candidates come out alike the word before it decides, by bigram.
   Numbers are no lexicon: the one nearest to a misread number is that with the digits its
   letters stand for.
3. Running headers are lines that stand among the outer lines of three or more pages of
   a document, compared by a key that is the same for misread characters.
4. A last pass joins broken words, puts the corrections in, takes page furniture out and
   joins lines into paragraphs.

The corrections and compounds go to the tasks as a dictionary while they are at most
MAX_ENTRIES, and so do the bigrams; beyond it every row is joined to the entries of its
own words and to the bigrams its ties may ask for.

Defined results: null stays null and has no noise; empty text stays empty; lower case
decides, repairs keep the case of the word; marks of letters and digits (В25, W6) are
words like any other and only corrected into what is a word of the lexicon; a run of more
than LONGEST letters and digits is no word and stays; repeated rows of one page count as
one page.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossia.llm.lookalikes import mixed, resolve, simplify
from dossia.session import materialize

MAX_ENTRIES = 1_000_000
LETTER_RATIO = 10  # a word taken for a misreading of letters is so many times rarer
OTHER_RATIO = 50  # and so many times if the edit is none that scanning is known for
LONGEST = 40  # longer runs of letters and digits are no words: they stand in no lexicon and are left as they are
HEADER_PAGES = 3

# Characters (as printed, as read) that scanning takes for another.
CONFUSIONS = "о0 з3 в8 ч4 б6 нп лп пн ес ин тг кн o0 i1 l1 s5 ec rn tf b8 g9 z2 зэ шщ цд гт нк се пл ни лн"
COST = {(p[0], p[1]): 0.3 for p in CONFUSIONS.split(" ")[:18]} | {(p[0], p[1]): 0.6 for p in CONFUSIONS.split(" ")[18:]}
# Two characters (as read) that scanning makes of one.
PARTS = frozenset({("rn", "m"), ("cl", "d"), ("vv", "w"), ("ьі", "ы"), ("ь1", "ы")})
PART_COST = 0.6
READ_AS = frozenset(b for _, b in COST)
PRINTED = frozenset(a for a, _ in COST)

_WORD = r"[^\W_]+"
_TOKEN = re.compile(rf"{_WORD}(?:[\x01\x02-]{_WORD})*")
_PLAIN_WORD = re.compile(_WORD)
_BREAK = re.compile(r"[-\u2010\u00ac\u00ad\uff0d][ \t]*(?:\r\n|\n|\r)[ \t]*(?=[^\W_])")
_NUMBER = re.compile(r"(?=[^\W_]*\d)[\dозчб]+")
_HAS_DIGIT = re.compile(r"\d")
_DIGIT_OF = str.maketrans("озчбОЗЧБ", "03460346")

# One sign for all that scanning confuses.
_CLASS: dict[str, str] = {}
for _a, _b in ("о0", "o0", "з3", "в8", "ч4", "б6", "нп", "лп", "ин", "кн", "ес", "ec", "тг", "i1", "l1", "s5", "rn", "tf"):
    _ra, _rb = _CLASS.get(_a, _a), _CLASS.get(_b, _b)
    for _k in [_a, _b, *[k for k, v in _CLASS.items() if v in (_ra, _rb)]]:
        _CLASS[_k] = min(_ra, _rb)
_KEY = str.maketrans(_CLASS)


def line_key(line: str) -> str:
    """The same for lines that differ in case, blanks and misread characters only."""
    return re.sub(r"\s+", " ", simplify(line).lower().translate(_KEY)).strip()


_PAGE_WORDS = frozenset(line_key(w) for w in ("стр", "страница", "лист", "page", "с", "p"))
_OF_WORDS = frozenset(line_key(w) for w in ("из", "of"))
_PAGE_MARK = re.compile(r"(?:w\.? ?)?[-—–]? ?n ?[-—–]?(?: ?(?:/|o) ?n)?\.?")


def _mark_shape(m: re.Match) -> str:
    if _NUMBER.fullmatch(m[0]):
        return "n" if len(m[0]) <= 5 else "x"
    key = line_key(m[0])
    return "w" if key in _PAGE_WORDS else "o" if key in _OF_WORDS else "x"


def page_mark(line: str) -> bool:
    """Whether a line is only a page mark: 7, - 7 -, 7 / 12, стр. 7, Лист 7, Page 7 of 12 (digits may be misread)."""
    s = line.strip()
    if len(s) > 24 or not _HAS_DIGIT.search(s):
        return False
    return bool(_PAGE_MARK.fullmatch(_PLAIN_WORD.sub(_mark_shape, re.sub(r"\s+", " ", simplify(s).lower()))))


def _mark_break(m: re.Match) -> str:
    if not m.string[m.start() - 1 : m.start()].isalnum():
        return m[0]
    return "\x01" if m[0][0] in "-\uff0d" else "\x02"


def prepare(text: str) -> str:
    """Broken words marked (\\x01 where the mark may belong to the word, \\x02 where not), characters in one form."""
    if "\x01" in text or "\x02" in text:
        text = text.replace("\x01", " ").replace("\x02", " ")
    if "\n" in text or "\r" in text:
        text = _BREAK.sub(_mark_break, text)
    text = simplify(text)
    if mixed(text):
        text = _PLAIN_WORD.sub(lambda m: resolve(m[0]) if mixed(m[0]) else m[0], text)
    return text


def _counts(batches):
    import pyarrow as pa

    for b in batches:
        n: Counter[str] = Counter()
        broken: Counter[str] = Counter()
        for text in b.column(0).to_pylist():
            if text:
                n.update(_TOKEN.findall(prepare(text).lower()))
        for w in [w for w in n if not w.isalnum()]:
            k = n.pop(w)
            parts = w.split("-")
            for p in parts:
                if "\x01" in p or "\x02" in p:
                    broken[p.replace("\x01", "").replace("\x02", "")] += k
                else:
                    n[p] += k
            if len(parts) > 1 and "\x01" not in w and "\x02" not in w and not _HAS_DIGIT.search(w):
                n[w] += k
                n[parts[0] + "-"] += k
        words = [w for w in n.keys() | broken.keys() if not w.isdecimal() and not _NUMBER.fullmatch(w)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[w] for w in words], pa.int64()), pa.array([broken[w] for w in words], pa.int64())], names=["word", "n", "n_broken"])


def lexicon(texts: DataFrame) -> DataFrame:
    """word, n, n_broken: how often it stands whole, and put together from two lines."""
    return texts.select("text").mapInArrow(_counts, "word string, n long, n_broken long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_broken").alias("n_broken"))


def deletes(word: str, chars: frozenset[str]) -> set[str]:
    """The keys of a word in the symmetric-delete index: itself, what is left without any one character, and, in longer words, without two of the given ones.

    Words within one edit, or with two misread characters, have a key in common; a key is shared by no more words than
    one inserted letter makes of it, however large the lexicon.
    """
    out = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}
    if len(word) >= 6:
        at = [i for i, c in enumerate(word) if c in chars]
        out |= {f"{len(word)}:{word[:i]}{word[i + 1 : j]}{word[j + 1 :]}" for i, j in combinations(at, 2)}
    return out


def distance(read: str, printed: str) -> float:
    """Weighted edit distance: the cost of a pair that scanning confuses, PART_COST where it takes two characters for one, else 1 for each exchanged, lost, added or swapped character."""
    if len(read) == len(printed):  # mostly
        same = sum(COST.get((p, r), 1.0) for r, p in zip(read, printed) if r != p)
        if same < 1:
            return same
    far = len(read) + len(printed)
    two, one, now = [], [], [float(j) for j in range(len(printed) + 1)]
    for i, r in enumerate(read, 1):
        two, one, now = one, now, [float(i), *[float(far)] * len(printed)]
        for j, p in enumerate(printed, 1):
            best = one[j - 1] if r == p else min(one[j - 1] + COST.get((p, r), 1.0), one[j] + 1, now[j - 1] + 1)
            if i > 1:
                if j > 1 and r == printed[j - 2] and read[i - 2] == p:
                    best = min(best, two[j - 2] + 1)
                if (read[i - 2] + r, p) in PARTS:
                    best = min(best, two[j - 1] + PART_COST)
            now[j] = best
    return now[-1]


def likely(read: str, n: int, printed: str, m: int, d: float) -> bool:
    """Whether a word read n times is a misreading of one printed m times, d away from it."""
    if d > 1.2:
        return False
    if _HAS_DIGIT.search(read) and not read.isdecimal() and printed.isalpha() and d < 1:
        return m >= n
    if d < 1:
        return m >= LETTER_RATIO * n * (2 if d > 0.31 else 1)
    if len(read) == len(printed) and sum(r != p for r, p in zip(read, printed)) == 2 and all(r == p or (p, r) in COST for r, p in zip(read, printed)):
        return m >= LETTER_RATIO * n * 2
    # any other edit also parts words that are both right: not in short words, nor where they are inflected
    return min(len(read), len(printed)) >= 7 and m >= OTHER_RATIO * n and read[0] == printed[0] and read[-3:] == printed[-3:]


def _index(chars: frozenset[str], misread: bool):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys, words, ns = [], [], []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = deletes(w, chars)
                if misread:
                    for two, one in PARTS:
                        at = w.find(two)
                        while at >= 0:
                            own.add(w[:at] + one + w[at + 2 :])
                            at = w.find(two, at + 1)
                keys += own
                words += [w] * len(own)
                ns += [n] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], names=["key", "word", "n"])

    return run


def _ranked(batches):
    import pyarrow as pa

    for b in batches:
        out = []
        for w, n, c, m in zip(*(x.to_pylist() for x in b.columns)):
            d = distance(w, c)
            if likely(w, n, c, m, d):
                out.append((w, c, d, m))
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.int64()))], names=["word", "candidate", "cost", "n"])


def corrections(lex: DataFrame, min_known: int = 3) -> DataFrame:
    """word, choices: the candidates with the least cost, most frequent first (one where the lexicon alone decides)."""
    alone = lex.filter(~F.col("word").contains("-") & F.length("word").between(3, LONGEST))
    read = alone.select("word", (F.col("n") + F.col("n_broken")).alias("n")).mapInArrow(_index(READ_AS, True), "key string, word string, n long")
    known = alone.filter((F.col("n") >= min_known) & ~F.col("word").rlike(r"\d")).select("word", "n").mapInArrow(_index(PRINTED, False), "key string, word string, n long")
    # the index is many times its lexicon, so the planner's estimate of it must not make it a broadcast
    pairs = read.join(known.select("key", F.col("word").alias("candidate"), F.col("n").alias("m")).hint("merge"), "key").filter((F.col("word") != F.col("candidate")) & (F.col("m") >= F.col("n"))).select("word", "n", "candidate", "m").distinct()
    ranked = pairs.mapInArrow(_ranked, "word string, candidate string, cost double, n long")
    # a candidate that is a misreading itself only counts where there is no other
    ranked = ranked.join(ranked.select(F.col("word").alias("candidate"), F.lit(1).alias("also")).distinct(), "candidate", "left")
    rank = F.struct(F.coalesce("also", F.lit(0)).alias("also"), F.round("cost", 3).alias("cost"))
    best = ranked.groupBy("word").agg(F.min(rank).alias("least"), F.sort_array(F.collect_set(F.struct(rank.alias("rank"), (-F.col("n")).alias("minus"), "candidate"))).alias("all"))
    # as good by cost, and not ten times rarer than the most frequent of them
    top = F.filter("all", lambda x: x["rank"] == F.col("least"))
    close = F.filter(top, lambda x: x["minus"] * 10 <= F.array_min(F.transform(top, lambda y: y["minus"])))
    return best.select("word", F.transform(close, lambda x: x["candidate"]).alias("choices"))


def compounds(lex: DataFrame) -> DataFrame:
    """word, choices: compounds and their first parts (no choices), and whole words that also stand broken (themselves)."""
    known = lex.filter((F.col("n") >= 2) & F.col("word").contains("-")).select("word", F.array().cast("array<string>").alias("choices"))
    whole = lex.filter((F.col("n") >= 1) & (F.col("n_broken") >= 1) & ~F.col("word").contains("-")).select("word", F.array("word").alias("choices"))
    return known.unionByName(whole)


def _bigrams(choices: frozenset[str] | None):
    """Pairs of neighbouring words, the second of `choices` (null: any)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n: Counter[tuple[str, str]] = Counter()
            for text in b.column(0).to_pylist():
                if text:
                    words = _PLAIN_WORD.findall(prepare(text).lower())
                    n.update((a, c) for a, c in zip(words, words[1:]) if choices is None or c in choices)
            rows = list(n.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.int64())], names=["before", "word", "n"])

    return run


class Repair:
    """Repairs texts with a dictionary: word -> its correction choices; compounds and first parts -> []; whole words -> [themselves]."""

    def __init__(self, entries: dict[str, list[str]], bigrams: dict[tuple[str, str], int]) -> None:
        self.entries, self.bigrams = entries, bigrams
        self.bad = {w for w, c in entries.items() if c and c[0] != w}

    def fix(self, word: str, before: str = "") -> str | None:
        """The printed word for a misread one, in lower case; null if it is right."""
        if _NUMBER.fullmatch(word):
            digits = word.translate(_DIGIT_OF)
            return digits if digits != word else None
        c = self.entries.get(word)
        if not c or c[0] == word:
            return None
        return c[0] if len(c) == 1 else max(c, key=lambda x: (self.bigrams.get((before, x), 0), -c.index(x)))

    def broken(self, left: str, right: str, sure: bool) -> bool:
        """Whether the mark between two parts is only that of the line end."""
        if right.isdecimal() or left.isdecimal():
            return sure and not (right.isdecimal() and left.isdecimal())
        if sure:
            return True
        a, b = self.fix(left) or left, self.fix(right) or right
        e = self.entries
        if f"{left}-{right}" in e or f"{a}-{b}" in e:
            return False
        joined = left + right
        if joined in e:  # whole somewhere, or misread
            return True
        return not (f"{left}-" in e or f"{a}-" in e)

    def noise(self, prepared: str) -> set[str]:
        """hyphen and misread, as far as a prepared text has them."""
        out: set[str] = set()
        tokens = set(_TOKEN.findall(prepared.lower()))
        if not self.bad.isdisjoint(tokens):
            out.add("misread")
        for token in tokens:
            if not token.isalpha() and not token.isdecimal():
                for w in self._words(token, out):
                    if "misread" not in out and self.fix(w):
                        out.add("misread")
        return out

    def _words(self, token: str, out: set[str] | None = None) -> list[str]:
        words = [""]
        marks = re.split(r"([\x01\x02-])", token)
        words[0] = marks[0]
        for mark, part in zip(marks[1::2], marks[2::2]):
            if mark != "-" and self.broken(words[-1], part, mark == "\x02"):
                if out is not None:
                    out.add("hyphen")
                words[-1] += part
            else:
                words.append(part)
        return words

    def text(self, text: str, prepared: str, noise: set[str], headers: frozenset[str] | set[str] = frozenset(), pages: str = "") -> str:
        """The repaired text: furniture out, broken words whole, corrections in, lines joined into paragraphs."""
        s = prepared
        if "header" in noise or "page_number" in noise:
            s = prepare(without_furniture(text, headers, pages))
        if "misread" not in noise and "\x01" not in s and "\x02" not in s:
            return join_lines(s)
        before = [""]

        def word(m: re.Match) -> str:
            token = m[0]
            if token.isalpha() and token.lower() not in self.entries:
                before[0] = token.lower()
                return token
            marks = re.split(r"([\x01\x02-])", token)
            out = [marks[0]]
            for mark, part in zip(marks[1::2], marks[2::2]):
                if mark != "-" and self.broken(out[-1].lower(), part.lower(), mark == "\x02"):
                    out[-1] += part
                else:
                    out += ["-", part]
            for i, w in enumerate(out):
                if w != "-":
                    good = self.fix(w.lower(), before[0])
                    if good is not None:
                        out[i] = _cased(w, good)
                    before[0] = out[i].lower()
            return "".join(out)

        return join_lines(_TOKEN.sub(word, s))


class Ties(Repair):
    """Notes in `asked` the (word before, candidate) pairs whose counts the repair of a text may look up, whichever way its ties fall."""

    def __init__(self, entries: dict[str, list[str]]) -> None:
        super().__init__(entries, {})
        self.asked: set[tuple[str, str]] = set()
        self.others: dict[str, set[str]] = {}

    def fix(self, word: str, before: str = "") -> str | None:
        good = super().fix(word, before)
        c = self.entries.get(word) or []
        if good is not None and len(c) > 1 and not _NUMBER.fullmatch(word):
            if before:  # which may itself come of a tie
                self.asked.update((y, x) for y in {before} | self.others.get(before, set()) for x in c)
            self.others.setdefault(good, set()).update(c)
        return good


def _cased(like: str, word: str) -> str:
    if like[:1].isdecimal() and like[1:2].isupper() or like.isupper() and len(like) > 1:
        return word.upper() if like[1:].upper() == like[1:] and len(like) > 1 and any(c.isalpha() for c in like[1:]) else word
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


_LINE_END = re.compile(r"\r\n|\n|\r|")
_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:(?:\r\n|\n|\r)[ \t]*)+|\s*\f\s*")


def join_lines(text: str) -> str:
    """Lines of a paragraph become one; rows of tables, list items and what follows a closed short line stay apart."""
    out = []
    if "\n" not in text and "\r" not in text and "\f" not in text:
        return text.strip()
    for paragraph in _PARAGRAPH.split(text):
        lines = [x.strip() for x in re.split(r"\r\n|\n|\r", paragraph)]
        lines = [x for x in lines if x]
        if not lines:
            continue
        wide = max(map(len, lines))
        joined = lines[0]
        for last, line in zip(lines, lines[1:]):
            row = "|" in last or "|" in line or last.endswith(":") or line[:2] in ("- ", "• ", "* ") or line.startswith("[TABLE")
            closed = last[-1] in ".!?" and len(last) < 0.6 * wide and line[:1].isupper()
            joined += ("\n" if row else "\n\n" if closed else " ") + line
        out.append(joined)
    return "\n\n".join(out)


def outer_lines(text: str) -> list[tuple[int, int]]:
    """Spans of the first two and last two non-empty lines."""
    spans = [m.span() for m in re.finditer(r"[^\r\n\f]*[^\s][^\r\n\f]*", text)]
    return spans if len(spans) <= 4 else spans[:2] + spans[-2:]


def all_lines(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"[^\r\n\f]*[^\s][^\r\n\f]*", text)]


def page_marks(text: str, pages: str) -> list[tuple[int, int]]:
    """Lines that are only a page mark: of the outer lines, or (pages == 'any') of all; columns of bare numbers are none."""
    if pages == "outer":
        return [x for x in outer_lines(text) if page_mark(text[x[0] : x[1]])]
    lines = all_lines(text)
    if len(lines) < 2:
        return [x for x in lines if page_mark(text[x[0] : x[1]])]
    bare = [text[a:b].strip().isdecimal() for a, b in lines]
    return [x for i, x in enumerate(lines) if x[1] - x[0] <= 40 and page_mark(text[x[0] : x[1]]) and not (bare[i] and (i and bare[i - 1] or i + 1 < len(lines) and bare[i + 1]))]


def without_furniture(text: str, headers, pages: str) -> str:
    gone = set(page_marks(text, pages))
    if headers:
        gone |= {x for x in outer_lines(text) if line_key(text[x[0] : x[1]]) in headers}
    kept, at = [], 0
    for a, b in sorted(gone):
        kept.append(text[at:a])
        at = _LINE_END.match(text, b).end()
    return "".join(kept) + text[at:]


def _edge_keys(batches):
    import pyarrow as pa

    for b in batches:
        out = []
        for doc, page, text in zip(*(c.to_pylist() for c in b.columns)):
            if text:
                out += [(doc, page, k) for k in {line_key(text[x:y]) for x, y in outer_lines(text)}]
        cols = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], names=["doc", "page", "line"])


def running_headers(pages: DataFrame, least: int = HEADER_PAGES) -> DataFrame:
    """page_id, headers: the keys of those outer lines of a page that stand on `least` or more pages of its document (at most four)."""
    keys = pages.select(F.col("document_version_id").cast("long"), F.col("page_id").cast("long"), "text").mapInArrow(_edge_keys, "doc long, page long, line string").distinct()
    often = keys.groupBy("doc", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return keys.join(often.select("doc", "line"), ["doc", "line"], "left_semi").groupBy(F.col("page").alias("page_id")).agg(F.collect_set("line").alias("headers"))


def scan_sources(pages: DataFrame, chunks: DataFrame, observations: DataFrame) -> DataFrame:
    """src, row_id, text of the three text columns."""
    parts = [
        pages.select(F.lit("ocr_pages").alias("src"), F.col("page_id").cast("long").alias("row_id"), "text"),
        chunks.select(F.lit("chunks").alias("src"), F.col("chunk_id").cast("long").alias("row_id"), "text"),
        observations.select(F.lit("rule_observations").alias("src"), F.col("observation_id").cast("long").alias("row_id"), F.col("context").alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_REPAIRS: dict[int, Repair] = {}
PLACES = {"ocr_pages": "outer", "chunks": "any", "rule_observations": ""}


def _repair_batches(shared, whole: bool, own: bool):
    def run(batches):
        import pyarrow as pa

        r = None
        if not own:
            key = getattr(shared, "id", None)
            r = _REPAIRS.get(key)
            if r is None:
                entries, bigrams = shared.value
                r = Repair(dict(entries), {(a, b): n for a, b, n in bigrams})
                _REPAIRS.clear()
                _REPAIRS[key] = r
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            noises, texts = [], []
            for i, (src, text, headers) in enumerate(zip(cols[0], cols[2], cols[3])):
                if text is None:
                    noises.append([])
                    texts.append(None)
                    continue
                if own:
                    r = Repair({w: c for w, c in cols[4][i] or []}, {(x["before"], x["word"]): x["n"] for x in cols[5][i] or []} if whole else {})
                place = PLACES.get(src, "")
                prepared = prepare(text)
                found = r.noise(prepared)
                if headers:
                    found.add("header")
                if place and page_marks(text, place):
                    found.add("page_number")
                noises.append(sorted(found))
                if whole:
                    texts.append(r.text(text, prepared, found, set(headers or ()), place))
            out = [b.column(0), b.column(1), pa.array(noises, pa.list_(pa.string()))]
            names = ["src", "row_id", "noise"]
            if whole:
                out.append(pa.array(texts, pa.string()))
                names.append("repaired")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def repaired(pages: DataFrame, chunks: DataFrame, observations: DataFrame, whole: bool = True, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """src, row_id, noise (hyphen, misread, header, page_number) and, with whole, the repaired text of every row."""
    spark = pages.sparkSession
    texts = scan_sources(pages, chunks, observations)
    lex = materialize(lexicon(texts))
    wrong = materialize(corrections(lex))
    entries = materialize(wrong.unionByName(compounds(lex).join(wrong, "word", "left_anti")))
    # pages carry the keys of their headers, other texts have none
    heads = running_headers(pages).withColumn("src", F.lit("ocr_pages")).withColumnRenamed("page_id", "row_id")
    paged = texts.filter(F.col("src") == "ocr_pages").join(heads, ["src", "row_id"], "left").select("src", "row_id", "text", "headers")
    rest = texts.filter(F.col("src") != "ocr_pages").withColumn("headers", F.lit(None).cast("array<string>"))
    rows = paged.unionByName(rest)
    schema = "src string, row_id long, noise array<string>" + (", repaired string" if whole else "")
    if entries.count() <= max_entries:
        known = sorted((r.word, list(r.choices)) for r in entries.collect())
        unsure = frozenset(c for w, cs in known if len(cs) > 1 for c in cs)
        pairs = []
        if unsure and whole:  # ties do not change what is noise
            two = texts.select("text").mapInArrow(_bigrams(unsure), "before string, word string, n long").groupBy("before", "word").agg(F.sum("n").alias("n"))
            pairs = [tuple(r) for r in two.filter("n >= 2").limit(max_entries + 1).collect()]
        if len(pairs) <= max_entries:
            shared = spark.sparkContext.broadcast((known, pairs))
            return rows.mapInArrow(_repair_batches(shared, whole, False), schema)
    return _repair_by_join(rows, texts, entries, whole, schema)


def _tokens_of(batches):
    import pyarrow as pa

    for b in batches:
        out = []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words: set[str] = set()
            for t in _TOKEN.findall(prepare(text or "").lower()):
                parts = re.split(r"[\x01\x02-]", t)
                words.update(parts)
                words.update(f"{p}-" for p in parts[:-1])
                for a, c in zip(parts, parts[1:]):
                    words.update((f"{a}-{c}", a + c))
            out += [(i, w) for w in words if not w.isdecimal()]
        cols = list(zip(*out)) if out else [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.string())], names=["_id", "word"])


def _asked_pairs(batches):
    import pyarrow as pa

    for b in batches:
        out = []
        for i, src, text, headers, own in zip(*(c.to_pylist() for c in b.columns)):
            if text and any(len(c) > 1 for _, c in own or []):
                r, place, prepared = Ties(dict(own)), PLACES.get(src, ""), prepare(text)
                found = r.noise(prepared)
                if headers:
                    found.add("header")
                if place and page_marks(text, place):
                    found.add("page_number")
                r.text(text, prepared, found, set(headers or ()), place)
                out += [(i, *p) for p in r.asked]
        cols = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], names=["_id", "before", "word"])


def _repair_by_join(rows: DataFrame, texts: DataFrame, entries: DataFrame, whole: bool, schema: str) -> DataFrame:
    """The same without a dictionary on every task: each row gets the entries of its own words and the counts of its own pairs."""
    keyed = materialize(rows.withColumn("_id", F.monotonically_increasing_id()))
    words = keyed.select("_id", "text").mapInArrow(_tokens_of, "_id long, word string")
    own = words.join(entries, "word").groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "choices"))).alias("own"))
    joined = keyed.join(own, "_id", "left")
    if not whole:
        return joined.select("src", "row_id", "text", "headers", "own").mapInArrow(_repair_batches(None, whole, True), schema)
    joined = materialize(joined)
    asked = joined.filter("own is not null").select("_id", "src", "text", "headers", "own").mapInArrow(_asked_pairs, "_id long, before string, word string")
    tied = entries.filter(F.size("choices") > 1).select(F.explode("choices").alias("word")).distinct()
    two = texts.select("text").mapInArrow(_bigrams(None), "before string, word string, n long").join(tied, "word", "left_semi")
    two = two.groupBy("before", "word").agg(F.sum("n").alias("n")).filter("n >= 2")
    pairs = asked.join(two, ["before", "word"]).groupBy("_id").agg(F.collect_list(F.struct("before", "word", "n")).alias("pairs"))
    return joined.join(pairs, "_id", "left").select("src", "row_id", "text", "headers", "own", "pairs").mapInArrow(_repair_batches(None, whole, True), schema)


def noise_found(pages: DataFrame, chunks: DataFrame, observations: DataFrame) -> DataFrame:
    done = repaired(pages, chunks, observations, whole=False)
    return done.select("src", "row_id", F.explode("noise").alias("noise")).distinct()
