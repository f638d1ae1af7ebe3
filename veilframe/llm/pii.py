"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Generators of high recall propose spans that may overlap: four base kinds (e-mail, IP, card, phone), whose matches stay when
they pass their own test, and loose ones (numbers with any single separators, written-out e-mail addresses). A run of digit groups is offered as every window
of whole groups that has 7 to 19 digits, so lists and tables of numbers are taken apart. Boosted trees over format and context
features score the loose candidates; of those at or above their kind's calibrated threshold that no base span overlaps, the one of the
highest margin over it, then the longest, then the first, is added, and those that overlap it go. The trees are grown by the driver on a bounded, seeded set of labelled examples made from public number formats
(``examples``), the thresholds on a held-out half of it; they run on the executors as SQL CASE expressions.

There is no shuffle and no Python on the executors. Spans are found once per text: an ``inline`` generator keeps the optimiser
from copying the expressions. Patterns use possessive groups, so that no text, however long, makes Java's matcher recurse.
Results: a null text counts as empty; offsets are code points, end exclusive; repeated rows repeat their result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_and_texts, quoted, small_table

BASE = ("email", "ip", "card", "phone")
MORE = ("number", "written_email")

_LOCAL = "A-Za-z0-9._%+-"
#: kind: (cheap test of a text, pattern). A local part begins where a run of its characters does, or where the last match ended.
GENERATORS = {
    "email": ("instr(text, '@') > 0", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("digits", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("digits", r"[0-9]++(?:[\x20-][0-9]++)*+"),
    "phone": ("instr(text, '+') > 0", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "number": ("digits", r"(?:\((?=[0-9]))?[0-9]++(?:\)?[\x20.-]?\(?[0-9]++)*+"),
    "written_email": (r"text rlike '[(\\[]\\x20?at\\x20?[)\\]]'", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++\x20?[(\[]\x20?at\x20?[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]\x20?dot\x20?[)\]])\x20?[A-Za-z0-9-]++){{1,8}}+"),
}
#: What a match must pass, in terms of m, the match.
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = f"exists(array({_DIGITS}), d -> aggregate(sequence(1, length(d)), 0, (q, j) -> q + if(j % 2 = 1, int(substr(d, -j, 1)), int(substr('0246813579', int(substr(d, -j, 1)) + 1, 1)))) % 10 = 0)"
_OCTETS = r"forall(split(m, '\\.'), o -> length(regexp_replace(o, '^0+', '')) <= 3 AND coalesce(try_cast(regexp_replace(o, '^0+', '') AS INT), 0) <= 255)"
TESTS = {
    "email": "true",
    "ip": _OCTETS,
    "card": f"length(m) >= 14 AND length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "number": f"length(m) >= 9 AND length({_DIGITS}) >= 7",  # of a run; windows are tested by themselves
    "written_email": "true",
}
_SPAN = "STRUCT<start: INT, stop: INT, kind: STRING, m: STRING, b: STRING, a: STRING>"


_GROUP = r"'\\(?[0-9]+'"
#: The windows of a run r: its digit groups t, their ends e, for each first group i the text z around it (from l characters before
#: it; 19 digits and their separators have less than LONGEST), and the last groups j. Linear in the run.
LONGEST = 80
_WINDOWS = (
    "flatten(transform(array(named_struct("
    f"'t', regexp_extract_all(r.m, {_GROUP}, 0), 'g', split(r.m, {_GROUP}, -1))), x -> flatten(transform(array("
    "aggregate(sequence(0, size(x.t) - 1), CAST(array() AS ARRAY<INT>), (p, i) -> concat(p, array(coalesce(try_element_at(p, -1), 0) + length(x.g[i]) + length(x.t[i]))))"
    "), e -> flatten(transform(sequence(0, size(e) - 1), i -> flatten(transform(array(named_struct("
    f"'s', e[i] - length(x.t[i]), 'l', least(e[i] - length(x.t[i]), 24), 'z', substring(r.m, greatest(e[i] - length(x.t[i]) - 23, 1), {LONGEST} + 32))), y -> filter("
    f"transform(filter(sequence(i, least(i + 18, size(e) - 1)), j -> e[j] - y.s BETWEEN 9 AND {LONGEST}), j -> "
    "named_struct('start', r.start + y.s, 'stop', r.start + e[j], 'kind', r.kind, 'm', substring(y.z, y.l + 1, e[j] - y.s),"
    " 'b', right(concat(r.b, substring(y.z, 1, y.l)), 24), 'a', left(concat(substring(y.z, y.l + e[j] - y.s + 1, 8), r.a), 8))),"
    " w -> length(regexp_replace(w.m, '[^0-9]', '')) BETWEEN 7 AND 19)))))))))"
)


def windows(run: str) -> list[tuple[int, int]]:
    """The same for examples: (start, stop) of each window of a run."""
    groups = [m.span() for m in re.finditer(r"\(?[0-9]+", run)]
    made = [(i, j) for k, (i, _) in enumerate(groups) for _, j in groups[k : k + 19]]
    return [(i, j) for i, j in made if j - i >= 9 and 7 <= sum(map(str.isdigit, run[i:j])) <= 19]


def _literal(pattern: str) -> str:
    return quoted(pattern.replace("\\", "\\\\"))


def _found(kind: str) -> str:
    """Spans of one kind that pass its test, from the columns g_<kind> (gaps) and m_<kind> (matches)."""
    g, m, test = f"g_{kind}", f"m_{kind}", TESTS[kind].replace("(m", "(x.m")
    at = f"p.at + length({g}[i])"
    item = f"named_struct('start', {at}, 'stop', {at} + length({m}[i]), 'kind', '{kind}', 'm', {m}[i], 'b', right({g}[i], 24), 'a', left({g}[i + 1], 8))"
    fold = f"aggregate(sequence(0, size({m}) - 1), named_struct('at', 0, 'out', CAST(array() AS ARRAY<{_SPAN}>)), (p, i) -> named_struct('at', {at} + length({m}[i]), 'out', concat(p.out, filter(array({item}), x -> {test}))), p -> p.out)"
    spans = f"CASE WHEN size({m}) > 0 THEN {fold} ELSE CAST(array() AS ARRAY<{_SPAN}>) END"
    return f"flatten(transform({spans}, r -> {_WINDOWS}))" if kind == "number" else spans


def candidates(rows: DataFrame) -> DataFrame:
    """``rows`` with a non-null column ``text``: adds c_<kind>, the candidates of each kind."""
    kept = [f"`{c}`" for c in rows.columns]
    tested = rows.selectExpr(*kept, "inline(array(named_struct('digits', text rlike '[0-9]')))")
    parts = []
    for kind, (cheap, pattern) in GENERATORS.items():
        p = _literal(pattern)
        parts += [f"'m_{kind}', CASE WHEN {cheap} THEN regexp_extract_all(text, {p}, 0) END", f"'g_{kind}', CASE WHEN {cheap} THEN split(text, {p}, -1) END"]
    split = tested.selectExpr(*kept, f"inline(array(named_struct({', '.join(parts)})))")
    return split.selectExpr(*kept, "inline(array(named_struct(" + ", ".join(f"'c_{k}', {_found(k)}" for k in GENERATORS) + ")))")


# ---- features and trees --------------------------------------------------------------------------------------------------

_WORDS_FOR = {
    "for_phone": "phone|tel|call|mobile|fax|cell|contact",
    "for_card": "card|visa|credit|debit|payment",
    "for_id": "ssn|social|passport|tax",
    "against": "order|version|isbn|ref|invoice|page|date|item|serial|build|sku",
}
#: name: SQL in terms of a candidate's m, b, a.
FEATURES = {
    "n_digits": f"length({_DIGITS})",
    "n_spaces": "length(regexp_replace(m, '[^ ]', ''))",
    "n_dots": "length(regexp_replace(m, '[^.]', ''))",
    "n_hyphens": "length(regexp_replace(m, '[^-]', ''))",
    "n_parens": "length(regexp_replace(m, '[^()]', ''))",
    "n_groups": r"size(split(m, '[^0-9]+'))",
    "first_group": r"length(regexp_extract(m, '^[^0-9]*([0-9]+)', 1))",
    "second_group": r"length(regexp_extract(m, '^[^0-9]*[0-9]+[^0-9]+([0-9]+)', 1))",
    "last_group": r"length(regexp_extract(m, '([0-9]+)[^0-9]*$', 1))",
    "year_first": r"int(regexp_extract(m, '^[^0-9]*([0-9]+)', 1) rlike '^(19|20)[0-9]{2}$')",
    "luhn": f"int(length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN})",
    "plus_before": "int(right(b, 1) = '+')",
    "joined_before": "int(right(b, 1) rlike '[A-Za-z0-9_]')",
    "joined_after": "int(left(a, 1) rlike '[A-Za-z0-9_]')",
    "sign_before": "int(right(b, 1) rlike '[$#=/.:,-]')",
    "number_before": r"int(b rlike '[0-9][)]?[ .-]?$')",
    "number_after": r"int(a rlike '^[)]?[ .-]?[(]?[0-9]')",
    "written_at": r"int(m rlike '[(\\[]\\x20?at\\x20?[)\\]]')",
    **{name: f"int(lower(b) rlike '(^|[^a-z])({words})[^a-z]')" for name, words in _WORDS_FOR.items()},
}


@dataclass(frozen=True)
class Trees:
    """Boosted trees as (feature, cut, below, above) tuples with numbers as leaves; ``thresholds`` of the summed margin, by the kinds
    of MORE."""

    base: float
    trees: tuple
    thresholds: tuple[float, ...]

    def sql(self, names: list[str]) -> str:
        def node(t) -> str:
            return f"{t:.6f}D" if isinstance(t, float) else f"if({names[t[0]]} < {t[1]}D, {node(t[2])}, {node(t[3])})"

        return " + ".join([f"{self.base:.6f}D", *map(node, self.trees)])

    def margins(self, x: np.ndarray) -> np.ndarray:
        def value(t, row) -> float:
            while not isinstance(t, float):
                t = t[2] if row[t[0]] < t[1] else t[3]
            return t

        return np.array([self.base + sum(value(t, row) for t in self.trees) for row in x])


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3) -> tuple[float, tuple]:
    """Logistic gradient boosting with Newton leaves; cuts lie between neighbouring values."""
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, out = np.full(len(y), base), []
    cuts = [(np.unique(c)[1:] + np.unique(c)[:-1]) / 2 for c in x.T]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-3, None, None)
        for f in range(x.shape[1]) if left and len(rows) > 10 else ():
            column = x[rows, f]
            for cut in cuts[f]:
                low = rows[column < cut]
                if 5 <= len(low) <= len(rows) - 5:
                    gl, hl = g[low].sum(), h[low].sum()
                    gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    if gain > best[0]:
                        best = (gain, f, float(cut))
        if best[1] is None:
            leaf = float(rate * total_g / (total_h + 1))
            margin[rows] += leaf
            return leaf
        below = x[rows, best[1]] < best[2]
        return (best[1], best[2], grow(rows[below], g, h, left - 1), grow(rows[~below], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out.append(grow(np.arange(len(y)), y - p, p * (1 - p), depth))
    return base, tuple(out)


def examples(n: int = 3000, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(match, before, after, label): numbers and addresses in public formats, invented, with neutral surroundings."""
    rng = np.random.default_rng(seed)

    def digits(k: int, first: str = "") -> str:
        return first + "".join(map(str, rng.integers(0, 10, k - len(first))))

    def luhn(body: str, right: bool = True) -> str:
        s = sum(int(c) if i % 2 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(body)))
        check = (10 - s % 10) % 10
        return body + str(check if right else (check + int(rng.integers(1, 9))) % 10)

    def pick(*options: str) -> str:
        return options[int(rng.integers(0, len(options)))]

    def grouped(d: str, *sizes: int) -> str:
        sep, out, at = pick(" ", "-"), [], 0
        for k in sizes:
            out.append(d[at : at + k])
            at += k
        return sep.join(out)

    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(3, 9))))
    made: list[tuple[str, str, str, int]] = []
    for _ in range(n):
        hint = {"phone": pick("", "phone ", "tel ", "call "), "card": pick("", "card ", "visa "), "id": pick("ssn ", "social ", "ssn: "), "no": pick("", "order ", "ref ", "version ", "invoice ", "isbn ", "item ")}
        d10 = digits(10, pick("2", "4", "6", "7", "9"))
        good = [
            (f"({d10[:3]}) {d10[3:6]}-{d10[6:]}", hint["phone"]), (f"{d10[:3]}-{d10[3:6]}-{d10[6:]}", pick("phone ", "tel ", "call ")),
            (grouped(luhn(digits(15, "4")), 4, 4, 4, 4), hint["card"]), (f"{digits(3)}-{digits(2)}-{digits(4)}", hint["id"]),
            (f"{word()}.{word()} (at) {word()} (dot) {pick('org', 'net', 'com')}", ""), (f"{word()}[at]{word()}.{pick('org', 'net', 'com')}", ""),
        ]
        bad = [
            (digits(int(rng.integers(7, 20))), hint["no"]), (grouped(luhn(digits(15), right=False), 4, 4, 4, 4), hint["no"]), (luhn(digits(15), right=False), hint["card"]),
            (f"{pick('19', '20')}{digits(2)}-{digits(2)}-{digits(2)}", hint["no"]), (f"{digits(2)}.{digits(2)}.{pick('19', '20')}{digits(2)}", hint["no"]),
            (".".join(digits(int(rng.integers(1, 5))) for _ in range(4)), hint["no"]), (f"{digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", hint["no"]),
            (f"{digits(4)}-{digits(4)}", hint["no"]), (f"{digits(3)}-{digits(3)}-{digits(4)}", pick("order ", "ref ", "item ", "sku ")), (" ".join(digits(int(rng.integers(1, 4))) for _ in range(int(rng.integers(4, 7)))), hint["no"]),
            (f"{digits(3)} {digits(3)} {digits(3)}", hint["no"]), (f"{digits(3)}-{digits(2)}-{digits(4)}", pick("ref ", "item ", "order ", "")),
        ]
        label = int(rng.integers(0, 2))
        m, before = (good if label else bad)[int(rng.integers(0, len(good if label else bad)))]
        joined = not label and rng.random() < 0.15
        made.append((m, f"{word()} {before}" + pick("a", "x", "_", "$", "=") * joined, pick(" ", ".", ",", "") + word() * (rng.random() < 0.8), label))
        # runs of several numbers: each of their windows
        if rng.random() < 0.3:
            hint, run, good_spans = pick("", "", "phone ", "tel ", "numbers ", "room ", "order ", "ref ", "item "), "", []
            for _ in range(int(rng.integers(1, 4))):
                d10 = digits(10, pick("2", "4", "6", "7", "9"))
                kind = int(rng.integers(0, 5))
                part = (f"({d10[:3]}) {d10[3:6]}-{d10[6:]}", f"{d10[:3]}-{d10[3:6]}-{d10[6:]}", " ".join(digits(int(rng.integers(1, 5))) for _ in range(int(rng.integers(1, 7)))), digits(int(rng.integers(1, 9))), f"{pick('19', '20')}{digits(2)}-{digits(2)}-{digits(2)}")[kind]
                run += " " * bool(run)
                if kind == 0 or (kind == 1 and hint not in ("order ", "ref ", "item ")):
                    good_spans.append((len(run), len(run) + len(part)))
                run += part
            before, after = f"{word()} {hint}", pick(" ", ".", ",", "") + word() * (rng.random() < 0.8)
            made += [(run[i:j], (before + run[:i])[-24:], (run[j:] + after)[:8], int((i, j) in good_spans)) for i, j in windows(run)]
    return [x for x in made if len(x[0]) >= 9]


@cache
def _grown(rows: tuple, labels: tuple, precision: float) -> Trees:
    x, y = np.array(rows, dtype=float), np.array(labels, dtype=float)
    half = len(y) // 2
    base, trees = boost(x[:half], y[:half])
    written = x[half:, list(FEATURES).index("written_at")] > 0
    margins, truths = Trees(base, trees, ()).margins(x[half:]), y[half:]

    def threshold(own: np.ndarray) -> float:
        margin, truth = margins[own], truths[own]
        order = np.argsort(-margin, kind="stable")
        right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(right >= precision)
        if not len(enough):
            return np.inf
        last, rest = margin[order][enough[-1]], margin[order][enough[-1] + 1 :]
        return max(float(last + rest[0]) / 2, 0.0) if len(rest) else 0.0  # between the last one and the next, or that of even odds

    return Trees(base, trees, (threshold(~written), threshold(written)))


def train(spark: SparkSession, precision: float = 0.999, n: int = 3000) -> Trees:
    """Grows the trees by half of the examples and calibrates each kind's threshold by the other half: the lowest margin above
    which the share of right ones is at least ``precision``. The features are those of the SQL expressions themselves."""
    made = examples(n)
    schema = pa.schema([("m", pa.string()), ("b", pa.string()), ("a", pa.string()), ("label", pa.int32())])
    found = small_table(spark, made, schema).selectExpr("label", *(f"double({e}) AS {f}" for f, e in FEATURES.items())).collect()
    return _grown(tuple(tuple(r)[1:] for r in found), tuple(r[0] for r in found), precision)


# ---- selection -----------------------------------------------------------------------------------------------------------


def detect(rows: DataFrame, model: Trees) -> DataFrame:
    """``rows`` with ``text``: adds ``base`` and ``more``, arrays of (start, rank, stop, kind) in order."""
    kept = [f"`{c}`" for c in rows.columns]
    kinds = [*BASE, *MORE]
    light = "named_struct('start', s.start, 'rank', {rank}, 'stop', s.stop, 'kind', s.kind)"
    base = "concat(" + ", ".join(f"transform(c_{k}, s -> {light.format(rank=kinds.index(k))})" for k in BASE) + ")"
    first = candidates(rows).selectExpr(*kept, *(f"c_{k}" for k in MORE), f"inline(array(named_struct('base', array_sort({base}))))")
    scored = []
    for k, threshold in zip(MORE, model.thresholds):
        least = min(threshold, 1e9)
        named = ", ".join(f"'{f}', double({_of_candidate(e)})" for f, e in FEATURES.items())
        margin = model.sql([f"z.{f}" for f in FEATURES])
        margins = f"transform(c_{k}, s -> named_struct('margin', transform(array(named_struct({named})), z -> {margin})[0], 's', named_struct('start', s.start, 'stop', s.stop, 'kind', s.kind)))"
        chosen = f"transform(filter({margins}, y -> y.margin >= {least!r}D AND NOT exists(base, o -> o.start < y.s.stop AND y.s.start < o.stop)), y -> named_struct('order', {least!r}D - y.margin, 'size', y.s.start - y.s.stop, 'start', y.s.start, 'rank', {kinds.index(k)}, 'stop', y.s.stop, 'kind', y.s.kind))"
        scored.append(chosen)
    # of overlapping candidates the one of the highest margin
    resolved = "aggregate(array_sort(scored), CAST(array() AS ARRAY<STRUCT<start: INT, rank: INT, stop: INT, kind: STRING>>), (p, s) -> if(exists(p, o -> o.start < s.stop AND s.start < o.stop), p, concat(p, array(" + light.format(rank="s.rank") + "))))"
    first = first.selectExpr(*kept, "base", f"inline(array(named_struct('scored', concat({', '.join(scored)}))))")
    return first.selectExpr(*kept, "base", f"inline(array(named_struct('more', array_sort({resolved}))))")


def _of_candidate(sql: str) -> str:
    """A feature's SQL with m, b, a as fields of the candidate s."""
    return re.sub(r"(?<=\()([mba])(?=[,) ])", r"s.\1", sql)


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"


def report(docs: DataFrame, model: Trees) -> DataFrame:
    """The contract's columns, derived from the spans."""
    rows = ids_and_texts(docs).selectExpr("doc_id", "coalesce(text, '') AS text")
    counts = [f"CAST(size(filter(base, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in BASE]
    return detect(rows, model).selectExpr("doc_id", *counts, f"sha2({_joined('base')}, 256) AS base_sha256", f"{_joined('array_sort(concat(base, more))')} AS spans", "CAST(size(more) AS BIGINT) AS n_more", "CAST(size(base) + size(more) AS BIGINT) AS n_spans")


def redact(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; spans that overlap are replaced together by the
    first one's kind. Null texts stay null; n_chars, where there is one, becomes the new length."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    empty = "CAST(array() AS ARRAY<STRUCT<start: INT, stop: INT, kind: STRING>>)"
    last = "try_element_at(p, -1)"
    fold = (
        f"aggregate(array_sort(concat(base, more)), {empty}, (p, s) -> CASE WHEN size(p) > 0 AND s.start < {last}.stop"
        f" THEN concat(slice(p, 1, size(p) - 1), array(named_struct('start', {last}.start, 'stop', greatest({last}.stop, s.stop), 'kind', {last}.kind)))"
        " ELSE concat(p, array(named_struct('start', s.start, 'stop', s.stop, 'kind', s.kind))) END)"
    )
    before = "substring(text, if(i = 0, 0, u[i - 1].stop) + 1, u[i].start - if(i = 0, 0, u[i - 1].stop))"
    built = f"CASE WHEN size(u) = 0 THEN text ELSE concat(array_join(transform(sequence(0, size(u) - 1), i -> concat({before}, '[', upper(u[i].kind), ']')), ''), substring(text, u[size(u) - 1].stop + 1)) END"
    united = detect(rows, model).selectExpr("row", "text", f"inline(array(named_struct('u', {fold}, 'part', size(more) > 0)))")
    once = united.selectExpr("row", f"inline(array(named_struct('once', {built}, 'part', part)))")
    # where a number was taken out of a run, the rest may be a base span
    rest = detect(once.selectExpr("row", "once", "if(part, once, '') AS text"), model).selectExpr("row", "once", "text", f"inline(array(named_struct('u', {fold.replace('concat(base, more)', 'base')})))")
    done = rest.selectExpr("row", f"inline(array(named_struct('redacted', if(text = '', once, {built}))))")

    def column(name: str) -> Column:
        old = F.col("row")[name]
        if name == "text":
            return F.when(old.isNull(), old).otherwise(F.col("redacted")).alias(name)
        if name == "n_chars":
            return F.when(F.col("row")["text"].isNull(), old).otherwise(F.length("redacted").cast(docs.schema[name].dataType)).alias(name)
        return old.alias(name)

    return done.select(*map(column, docs.columns))
