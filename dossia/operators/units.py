"""One unit for a quantity that sources record in several.

Every spelling of a unit is a *source* of readings.  The same entity read in two
sources (an observation's value and its normalised value) is a link; from the
links of a pair of sources a robust scale and offset are estimated, snapped to a
known conversion and propagated through the graph of sources.  Sizes: estimates
are one row per pair of unit spellings, bounded by the vocabulary squared, and
only these reach the driver; readings stay distributed and are never shuffled.

Defined results: null or empty text, and text without a number or with words
that are no unit, state no quantity (null number); a unit of another dimension
than asked for, or one no path of the graph reaches, converts to null; an empty
table gives an empty table and the known conversions alone.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.functions.chars import SUPERSCRIPT_ASCII, SUPERSCRIPTS, fold_looks, fold_looks_py, plain, plain_py
from dossia.session import materialize

# Unit spellings by dimension with their factor to the first unit of the dimension.
KNOWN_UNITS: dict[str, dict[str, float]] = {
    "length": {"м": 1, "m": 1, "метр": 1, "метра": 1, "метров": 1, "п.м": 1, "пог. м": 1, "мм": 1e-3, "mm": 1e-3, "миллиметр": 1e-3, "миллиметра": 1e-3, "миллиметров": 1e-3, "см": 1e-2, "cm": 1e-2, "сантиметров": 1e-2, "дм": 1e-1, "dm": 1e-1, "км": 1e3, "km": 1e3},
    "area": {"м2": 1, "м²": 1, "m2": 1, "кв. м": 1, "кв.м": 1, "тыс. м2": 1e3, "га": 1e4, "ha": 1e4, "мм2": 1e-6, "см2": 1e-4, "дм2": 1e-2, "км2": 1e6, "cm2": 1e-4, "km2": 1e6},
    "volume": {"м3": 1, "м³": 1, "m3": 1, "куб. м": 1, "куб.м": 1, "тыс. м3": 1e3, "л": 1e-3, "литр": 1e-3, "литра": 1e-3, "литров": 1e-3, "дм3": 1e-3, "см3": 1e-6, "мл": 1e-6},
    "flow": {"м3/ч": 1, "m3/h": 1, "куб.м/ч": 1, "м3/час": 1, "тыс. м3/ч": 1e3, "м3/с": 3600, "м3/мин": 60, "л/с": 3.6, "л/сек": 3.6, "л/мин": 0.06, "л/ч": 1e-3, "м3/сут": 1 / 24},
    "power": {"Вт": 1, "W": 1, "кВт": 1e3, "kW": 1e3, "МВт": 1e6, "MW": 1e6, "ГВт": 1e9, "ккал/ч": 1.163, "Мкал/ч": 1163, "Гкал/ч": 1.163e6},
    "pressure": {"Па": 1, "Pa": 1, "кПа": 1e3, "kPa": 1e3, "МПа": 1e6, "MPa": 1e6, "бар": 1e5, "bar": 1e5, "мбар": 100, "кгс/см2": 98066.5, "кгс/м2": 9.80665, "м вод. ст.": 9806.65, "мм вод. ст.": 9.80665, "атм": 101325},
    "mass": {"кг": 1, "kg": 1, "г": 1e-3, "g": 1e-3, "т": 1e3, "тонн": 1e3, "тонна": 1e3, "тонны": 1e3, "ц": 100, "тыс. т": 1e6},
    "ratio": {"доли ед.": 1, "%": 1e-2, "проц.": 1e-2, "процент": 1e-2, "процентов": 1e-2, "‰": 1e-3, "промилле": 1e-3},
    "time": {"с": 1, "сек": 1, "секунд": 1, "мин": 60, "минут": 60, "ч": 3600, "час": 3600, "часа": 3600, "часов": 3600, "сут": 86400, "суток": 86400},
    "count": {"шт": 1, "штук": 1, "штуки": 1, "штука": 1, "ед.": 1, "тыс. шт.": 1e3, "млн шт.": 1e6},
}
# Words before a number that only qualify it.
QUALIFIERS = ["не менее", "не более", "около", "примерно", "порядка", "более", "менее", "от", "до"]

NUMBER = r"[-−]?\d(?:[\d '’]*\d)?(?:[.,]\d+)?"
EXPONENT = rf"(?:\s*[·×*xх]\s*10([{SUPERSCRIPTS}]+)|[eEеЕ]([+-]?\d+))?"


def unit_key(text: str) -> str:
    """The spelling of a unit without what varies in writing: case, raised digits, look-alikes, blanks, points."""
    return re.sub(r"[\s.]", "", fold_looks_py(text))


def known_units() -> dict[str, tuple[str, float]]:
    """key -> (dimension, factor)."""
    return {unit_key(s): (d, float(f)) for d, group in KNOWN_UNITS.items() for s, f in group.items()}


def unit_key_col(c: Column) -> Column:
    return F.regexp_replace(fold_looks(plain(c)), r"[\s.]", "")


def unit_pattern(spellings: list[str]) -> str:
    """An alternation over folded spellings, longest first; blanks and points may vary."""
    parts = {re.escape(fold_looks_py(s)).replace(r"\ ", r"\s*").replace(r"\.", r"\.?") for s in spellings}
    return "(?:" + "|".join(sorted(parts, key=lambda x: (-len(x), x))) + ")"


class QuantityParser:
    """Reads quantities from short texts and the units contexts give to them."""

    # A number begins where no letter or digit stands directly before it, else the digit of a unit ('м3 5') would be read;
    # only a text without such a number is read from its first digit.
    _WHOLE = re.compile(rf"(?<![^\W_])(?<!\d[.,]){NUMBER}{EXPONENT}")
    _GLUED = re.compile(NUMBER + EXPONENT)
    _FILLER = re.compile(r"[\[\]():=≈~<>≤≥±]|" + "|".join(rf"(?<!\w){fold_looks_py(q)}(?!\w)" for q in QUALIFIERS))
    _RAISED = str.maketrans(SUPERSCRIPTS, SUPERSCRIPT_ASCII)
    _DIGITS = str.maketrans({",": ".", "−": "-", " ": None, "'": None, "’": None})
    _BROKEN = re.compile(r"[-¬‐\u00ad]\s*[\r\n]+\s*")

    _POWER = re.compile(r"([·×*xх]\s*10)([²³])")
    _KEEP = {"²": "\ue002", "³": "\ue003"}
    _BACK = {0xE002: "²", 0xE003: "³"}

    def __init__(self) -> None:
        u = unit_pattern([s for g in KNOWN_UNITS.values() for s in g])
        n = f"({NUMBER}){EXPONENT}"
        self.keys = frozenset(known_units())
        self.after = re.compile(rf"\s?[\[(]?({u})(?![а-яёa-z\d/])")
        self.before = re.compile(rf"[(,]\s?({u})\.?\s?\)?\s?:\s?{n}(?!\d)")
        self.number_at = re.compile(rf"(?<![\d.,]){n}")
        self.rests: dict[str, str] = {}

    def _value(self, digits: str, raised: str | None, exponent: str | None) -> float | None:
        power = raised.translate(self._RAISED) if raised else exponent
        try:
            return float(digits.translate(self._DIGITS) + (f"e{power}" if power else ""))
        except ValueError:
            return None

    def quantity(self, text: str | None) -> tuple[float | None, str | None]:
        """(number, unit key): no number gives nulls, no unit ''."""
        if text is None:
            return None, None
        t = text if text.isascii() else plain_py(text)
        m = self._WHOLE.search(t) or self._GLUED.search(t)
        if m is None or m.start() and self._bare(t):
            return None, None
        if m.end() - m.start() == len(t):
            return self._value(m[0] if m[1] is None and m[2] is None else self._mantissa(m), m[1], m[2]), ""
        rest = t[: m.start()] + " " + t[m.end() :]
        key = self.rests.get(rest)
        if key is None:
            key = re.sub(r"[\s.]", "", self._FILLER.sub(" ", fold_looks_py(rest)))
            if len(self.rests) < 100_000:
                self.rests[rest] = key
        return self._value(self._mantissa(m), m[1], m[2]), key

    def _bare(self, t: str) -> bool:
        """Whether a text whose number is not at its start is only the name of a unit, as 'м3'."""
        return t[-1:].isdecimal() and len(t) < 16 and unit_key(t) in self.keys

    @staticmethod
    def _mantissa(m: re.Match) -> str:
        if m[1] is not None:
            return re.split(r"[·×*xх]", m[0], maxsplit=1)[0].strip()
        return re.split(r"[eEеЕ]", m[0], maxsplit=1)[0] if m[2] is not None else m[0]

    def context(self, context: str | None, name: str | None, number: float) -> str | None:
        """The unit key the context gives to `number`: before it behind the parameter's name, or after it; else null."""
        if not context:
            return None
        t = context
        if "\n" in t or "\r" in t:
            t = self._BROKEN.sub("", t)
        t = self._POWER.sub(lambda m: m[1] + self._KEEP[m[2]], plain_py(t))  # folding makes digits of raised 2 and 3
        t = re.sub(r"\s+", " ", fold_looks_py(t)).translate(self._BACK)
        at = t.find(re.sub(r"\s+", " ", fold_looks_py(plain_py(name)))) if name else -1
        if at >= 0:
            for m in self.before.finditer(t, at):
                if self._value(m[2], m[3], m[4]) == number:
                    return re.sub(r"[\s.]", "", m[1])
        for m in self.number_at.finditer(t):
            if self._value(m[1], m[2], m[3]) == number and (u := self.after.match(t, m.end())):
                return re.sub(r"[\s.]", "", u[1])
        return None


READING = "observation_id long, parameter_code string, target_key string, number double, unit_key string, own boolean, norm_number double, norm_key string"


def _read_batches(batches):
    import pyarrow as pa

    p = QuantityParser()
    for b in batches:
        columns: list[list] = [[] for _ in range(8)]
        for oid, code, target, name, value, norm, context in zip(*(c.to_pylist() for c in b.columns)):
            number, own = p.quantity(value)
            if number is None:
                continue
            unit = own or p.context(context, name, number) or target
            n, nk = p.quantity(norm)
            nk = nk or (target if n is not None else None)
            for c, x in zip(columns, (oid, code, target, number, unit, bool(own), n if nk else None, nk)):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.float64(), pa.string()))], names=["observation_id", "parameter_code", "target_key", "number", "unit_key", "own", "norm_number", "norm_key"])


def estimate_links(links: DataFrame, min_links: int = 3) -> list[tuple[str, str, int, float, float, float]]:
    """Robust scale and offset of each pair of sources.

    links: source_a, source_b string; a, b double - one entity read in both.  The
    scale is ten to the median log ratio; the offset the median of what a line
    with the quantiles' slope leaves.  A pair with a spelling outside the table
    must have min_links links, half of which agree within 1 % with the scale, or
    else with the line; the offset of the former is 0.  Result: (source_a,
    source_b, n, scale, line_scale, line_offset) per pair, at most the vocabulary
    squared.
    """
    known = list(known_units())
    tabled = F.col("source_a").isin(known) & F.col("source_b").isin(known)
    ok = links.filter((F.col("a") > 0) & (F.col("b") > 0))
    qs = [0.1, 0.25, 0.5, 0.75, 0.9]
    g = ok.groupBy("source_a", "source_b").agg(
        F.count("*").alias("n"),
        F.percentile_approx(F.log10(F.col("b") / F.col("a")), 0.5, 1000).alias("log_scale"),
        F.percentile_approx("a", qs, 1000).alias("qa"),
        F.percentile_approx("b", qs, 1000).alias("qb"),
    )
    out = []
    for r in g.filter(tabled | (F.col("n") >= min_links)).collect():
        slopes = sorted((r.qb[j] - r.qb[i]) / (r.qa[j] - r.qa[i]) for i in range(len(qs)) for j in range(i) if r.qa[i] != r.qa[j])
        line = slopes[len(slopes) // 2] if slopes else 10**r.log_scale
        rest = sorted(y - line * x for x, y in zip(r.qa, r.qb))
        out.append((r.source_a, r.source_b, r.n, 10**r.log_scale, line, rest[len(rest) // 2]))
    unsure = [e for e in out if not (e[0] in known and e[1] in known)]
    if not unsure:
        return out
    e = links.sparkSession.createDataFrame(unsure, "source_a string, source_b string, n long, scale double, line double, rest double")
    fits = lambda y: F.avg((F.abs(F.col("b") - y) <= 0.01 * F.col("b")).cast("double"))
    kept = ok.join(F.broadcast(e), ["source_a", "source_b"]).groupBy("source_a", "source_b").agg(
        fits(F.col("scale") * F.col("a")).alias("by_scale"), fits(F.col("line") * F.col("a") + F.col("rest")).alias("by_line")
    )
    share = {(r.source_a, r.source_b): (r.by_scale, r.by_line) for r in kept.filter("by_scale >= 0.5 or by_line >= 0.5").collect()}
    sure = []
    for a, b, n, scale, line, rest in out:
        if a in known and b in known:
            sure.append((a, b, n, scale, line, rest))
        elif (a, b) in share:
            sure.append((a, b, n, scale, line, 0.0 if share[a, b][0] >= 0.5 else rest))
    return sure


def snap(scale: float, candidates: list[float], tolerance: float = 0.01) -> float | None:
    """The known factor nearest to an estimate, if within tolerance."""
    best = min(candidates, key=lambda c: abs(math.log(scale / c)))
    return best if abs(math.log(scale / best)) <= tolerance else None


Edge = tuple[str, float, float, int, str]


def conversion_graph(estimates: list[tuple[str, str, int, float, float, float]], min_links: int = 3) -> dict[str, list[Edge]]:
    """Edges source -> (source, factor, offset, links, basis) from snapped estimates; units of one known dimension that no link joins get the known factor.

    Spellings outside the table that links join are of one dimension, the one with nine tenths of their links to the
    table; else (words that are no unit) they are left out.
    """
    known = known_units()
    factors = sorted({f / g for group in KNOWN_UNITS.values() for f in group.values() for g in group.values()} | {10.0**k for k in range(-9, 10)})
    graph: dict[str, list[Edge]] = {}

    def edge(a: str, b: str, f: float, n: int, basis: str, offset: float = 0.0) -> None:
        graph.setdefault(a, []).append((b, f, offset, n, basis))
        graph.setdefault(b, []).append((a, 1 / f, -offset / f, n, basis))

    free: list[tuple[str, str, int, float, float, float]] = []
    for a, b, n, scale, line, offset in estimates:
        if a == b or n < min_links or not scale > 0:
            continue
        if a in known and b in known:
            if known[a][0] == known[b][0]:
                f = known[a][1] / known[b][1]
                if abs(math.log(scale / f)) <= 0.01:
                    edge(a, b, f, n, "snapped")
        elif not offset or line > 0:
            free.append((a, b, n, scale, line, offset))
    head: dict[str, str] = {}

    def root(x: str) -> str:
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b, *_ in free:
        if a not in known and b not in known:
            head[root(a)] = root(b)
    votes: dict[str, Counter[str]] = {}
    for a, b, n, *_ in free:
        if (a in known) != (b in known):
            votes.setdefault(root(b if a in known else a), Counter())[known[a if a in known else b][0]] += n
    for a, b, n, scale, line, offset in free:
        count = votes.get(root(b if a in known else a))
        if not count:
            continue
        (dim, most), *_ = count.most_common(1)
        if most < 0.9 * sum(count.values()) or any(x in known and known[x][0] != dim for x in (a, b)):
            continue
        f = None if offset else snap(scale, factors)
        edge(a, b, f or (line if offset else scale), n, "snapped" if f else "estimated", offset)
    for key, (dim, f) in known.items():
        base = unit_key(next(iter(KNOWN_UNITS[dim])))
        if key != base:
            edge(key, base, f / known[base][1], 0, "known")
    return graph


def propagate(graph: dict[str, list[Edge]], target: str) -> dict[str, tuple[float, str, float]]:
    """(factor, basis, offset) from every source the graph joins to target, over the path with the best supported edges."""
    known = known_units()
    best: dict[str, tuple[float, str, float]] = {}
    queue: list[tuple[float, str, float, str, float]] = [(0.0, target, 1.0, "same", 0.0)]
    while queue:
        cost, at, factor, basis, offset = heapq.heappop(queue)
        if at in best:
            continue
        if at in known and target in known:  # no rounding along the path
            factor, offset = known[at][1] / known[target][1], 0.0
        best[at] = (factor, basis, offset)
        for to, f, o, n, kind in graph.get(at, []):
            if to not in best:
                # at = (to - o) / f, and target = factor * at + offset
                heapq.heappush(queue, (cost + 1.0 / (1 + math.log1p(n)) + (2.0 if kind == "known" else 0.0), to, factor / f, kind if at == target else "propagated", offset - factor * o / f))
    return best


def conversion_map(graph: dict[str, list[Edge]], targets: list[str]) -> dict[str, tuple[float, float]]:
    """'from>to' -> factor, offset for every target; bounded by units times targets."""
    return {f"{a}>{t}": (f, o) for t in targets for a, (f, _, o) in propagate(graph, t).items()}


def lookup(values: dict[str, float], a: Column, b: Column) -> Column:
    if not values:
        return F.lit(None).cast("double")
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in values.items()))[F.concat(a, F.lit(">"), b)]


def convert(pairs: dict[str, tuple[float, float]], x: Column, a: Column, b: Column) -> Column:
    """x in unit a as a number in unit b; null where no conversion is known."""
    y = x * lookup({k: f for k, (f, _) in pairs.items()}, a, b)
    moved = {k: o for k, (_, o) in pairs.items() if o}
    return y + F.coalesce(lookup(moved, a, b), F.lit(0.0)) if moved else y


def sources(observations: DataFrame, params: DataFrame) -> DataFrame:
    """The observations with a number: its unit (of value, else context, else parameter) in whatever spelling, and the normalised value with its.

    The texts are read once in an Arrow map over the scan (no shuffle): the same rules as JVM regular expressions took four times the CPU.
    """
    p = params.select(F.col("code").alias("_code"), unit_key_col(F.coalesce("unit", F.lit(""))).alias("target_key"), F.col("parameter_name").alias("_name")).dropDuplicates(["_code"]).filter("target_key <> ''")
    j = observations.join(small(p), F.col("parameter_code") == F.col("_code"))
    j = j.select("observation_id", "parameter_code", "target_key", "_name", "value", "normalized_value", F.when(F.col("value").isNotNull(), F.col("context")).alias("context"))
    return j.filter(F.col("value").isNotNull()).mapInArrow(_read_batches, READING)


def readings(observations: DataFrame, params: DataFrame) -> DataFrame:
    """The sources whose unit and whose parameter's unit are in the table."""
    known = list(known_units())
    return sources(observations, params.filter(unit_key_col("unit").isin(known))).filter(F.col("unit_key").isin(known))


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Broadcast df if it has at most `limit` rows, else leave the join to the planner."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def few(values: DataFrame, limit: int) -> list:
    """The values of a column on the driver, in order; an error if there are more than `limit`."""
    rows = [r[0] for r in values.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} values of {values.columns[0]}")
    return sorted(rows, key=lambda x: (x is not None, x))


def learn_conversions(read: DataFrame, targets: list[str]) -> dict[str, tuple[float, float]]:
    """Links of the readings (value against normalised value) -> estimates -> graph -> conversions to those targets that are in the table or joined to it."""
    links = read.filter(F.col("own") & F.col("norm_key").isNotNull()).select(F.col("unit_key").alias("source_a"), F.col("norm_key").alias("source_b"), F.col("number").alias("a"), F.col("norm_number").alias("b"))
    graph, known = conversion_graph(estimate_links(links)), known_units()
    return conversion_map(graph, [t for t in targets if t in known or t in graph])


def to_parameter_units(observations: DataFrame, params: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """observation_id, parameter_code, unit, value_std, norm_std (both in the unit of the parameter); and the conversions used.

    Spellings outside the table that no link joins to it are no units: what they stand with states no quantity.
    """
    targets = [r[0] for r in params.select(unit_key_col(F.coalesce("unit", F.lit("")))).distinct().collect()]
    read = materialize(sources(observations, params))
    pairs = learn_conversions(read, [t for t in targets if t])
    units = {x for k in pairs for x in k.split(">")} | set(known_units())
    measured = {k.split(">")[1] for k in pairs}
    out = read.filter(F.col("target_key").isin(sorted(measured)) & F.col("unit_key").isin(sorted(units))).select(
        "observation_id",
        "parameter_code",
        F.col("target_key").alias("unit"),
        F.col("unit_key").alias("unit_read"),
        convert(pairs, F.col("number"), F.col("unit_key"), F.col("target_key")).alias("value_std"),
        convert(pairs, F.col("norm_number"), F.col("norm_key"), F.col("target_key")).alias("norm_std"),
    )
    return out, pairs


def _differs(a: Column, b: Column, share: float) -> Column:
    return F.abs(a - b) > share * F.abs(a) * (1 + 1e-9)


def unit_findings(observations: DataFrame, params: DataFrame, rules: DataFrame) -> DataFrame:
    """observation_id, case_kind: `normalized` where normalised value and value differ by over 1 %, `threshold` where the rule holds in a common unit."""
    std, pairs = to_parameter_units(observations, params)
    r = rules.filter(F.col("kind") == "ABS_THRESHOLD").select(F.col("code").alias("_rcode"), "op", "threshold", unit_key_col("threshold_unit").alias("_tkey")).dropDuplicates()
    j = std.join(small(r), std.parameter_code == r._rcode, "left")
    limit = convert(pairs, F.col("threshold"), F.coalesce(F.nullif(F.col("_tkey"), F.lit("")), F.col("unit")), F.col("unit"))
    v = F.col("value_std")
    same = F.abs(v - limit) <= 1e-9 * F.greatest(F.abs(v), F.abs(limit))
    holds = (
        F.when(F.col("op") == ">", (v > limit) & ~same)
        .when(F.col("op") == ">=", (v > limit) | same)
        .when(F.col("op") == "<", (v < limit) & ~same)
        .when(F.col("op") == "<=", (v < limit) | same)
        .when(F.col("op") == "=", same)
    )
    kinds = F.array_compact(F.array(F.when(_differs(v, F.col("norm_std"), 0.01), F.lit("normalized")), F.when(holds, F.lit("threshold"))))
    return j.select("observation_id", F.explode(kinds).alias("case_kind")).distinct()
