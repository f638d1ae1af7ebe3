"""Finding spans by pattern, resolving overlaps, redacting and restoring, all as DataFrame expressions.

A span is STRUCT<start, stop, type, text, ord>: code points, stop exclusive; ``ord`` is the finder's place in its list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "STRUCT<start: INT, ord: INT, stop: INT, type: STRING, text: STRING>"
TOKEN = r"\[[A-Z_]+_[0-9]+\]"


@dataclass(frozen=True)
class Finder:
    """``test`` is SQL over m (the match), b and a (one character before and after, '' at an end or beside another match)."""

    type: str
    pattern: str
    test: str = "true"
    score: float = 1.0
    #: The same language without possessive groups and lookaround, for engines that lack them.
    plain: str = ""
    #: A cheap SQL test of the text (named text) that every match implies; texts that fail it are not searched.
    needs: str = "true"


def sql_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
LUHN = f"exists(array({_DIGITS}), d -> aggregate(sequence(1, length(d)), 0, (q, j) -> q + if(j % 2 = 1, int(substr(d, -j, 1)), int(substr('0246813579', int(substr(d, -j, 1)) + 1, 1)))) % 10 = 0)"
#: Letters count as 10 to 35; the first four characters go last; the number is 1 modulo 97.
MOD97 = "aggregate(split(concat(substr(m, 5), left(m, 4)), ''), 0, (r, c) -> CASE WHEN c = '' THEN r WHEN c BETWEEN '0' AND '9' THEN (r * 10 + int(c)) % 97 ELSE (r * 100 + ascii(c) - 55) % 97 END) = 1"
_WORD = "'[A-Za-z0-9_]'"
_DIGIT = "text rlike '[0-9]'"

EMAIL = Finder("EMAIL", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", plain=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", needs="instr(text, '@') > 0")
PHONE = Finder("PHONE", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15 AND (b = '' OR b rlike '[ \\t\\n\\r]')", 0.7, needs="instr(text, '+') > 0")
CREDIT_CARD = Finder("CREDIT_CARD", r"[0-9]++(?:[\x20-][0-9]++)*+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND NOT b rlike {_WORD} AND NOT a rlike {_WORD} AND {LUHN}", 1.0, r"[0-9]+(?:[\x20-][0-9]+)*", _DIGIT)
IBAN = Finder("IBAN", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", f"NOT b rlike {_WORD} AND NOT a rlike {_WORD} AND {MOD97}", needs=_DIGIT)
IGNORED_IPS = ("0.0.0.0", "127.0.0.1", "255.255.255.255", "localhost", "::1")
IP = Finder("IP_ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "forall(split(m, '[.]'), o -> int(o) <= 255) AND NOT b rlike '[0-9.]' AND NOT a rlike '[0-9]' AND NOT m IN ('" + "', '".join(IGNORED_IPS) + "')", 0.95, needs=_DIGIT)
US_SSN = Finder("SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT b rlike '[0-9A-Za-z-]' AND NOT a rlike '[0-9A-Za-z-]' AND NOT m rlike '^(000|666|9)' AND substr(m, 5, 2) <> '00' AND right(m, 4) <> '0000'", 0.5, needs=_DIGIT)
FR_NIR = Finder("SSN", r"[12]\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{3}\s?[0-9]{3}\s?[0-9]{2}", f"NOT b rlike {_WORD} AND NOT a rlike {_WORD}", 0.6, needs=_DIGIT)
STRUCTURED = (EMAIL, PHONE, CREDIT_CARD, IBAN, IP, US_SSN, FR_NIR)
MIN_SCORE = 0.4


def find(df: DataFrame, finders: tuple[Finder, ...] = STRUCTURED, text: str = "text") -> DataFrame:
    """Adds ``spans``: all matches that pass their test, finder by finder; a null text has none.

    Each pattern runs once a text: ``inline`` keeps the optimiser from copying its expression into later ones.
    """
    kept = [f"`{c}`" for c in df.columns]
    source = f"coalesce(`{text}`, '')"
    needs = list(dict.fromkeys(f.needs for f in finders))
    tested = df.selectExpr(*kept, "inline(array(named_struct(" + ", ".join(f"'n_{k}', {n.replace('text', source)}" for k, n in enumerate(needs)) + ")))")
    once = lambda f, call: f"CASE WHEN n_{needs.index(f.needs)} THEN {call}({source}, {sql_literal(f.pattern)}, {0 if call == 'regexp_extract_all' else -1}) END"
    cut = tested.selectExpr(*kept, "inline(array(named_struct(" + ", ".join(f"'m_{i}', {once(f, 'regexp_extract_all')}, 'g_{i}', {once(f, 'split')}" for i, f in enumerate(finders)) + ")))")
    parts = []
    for i, f in enumerate(finders):
        at = f"p.at + length(g_{i}[i])"
        item = f"named_struct('start', {at}, 'm', m_{i}[i], 'b', right(g_{i}[i], 1), 'a', left(g_{i}[i + 1], 1))"
        test = f.test.replace("(m", "(x.m").replace(" m ", " x.m ").replace("(b", "(x.b").replace("NOT b ", "NOT x.b ").replace("NOT a ", "NOT x.a ").replace("OR b ", "OR x.b ")
        fold = (
            f"aggregate(sequence(0, size(m_{i}) - 1), named_struct('at', 0, 'out', CAST(array() AS ARRAY<{SPAN}>)), (p, i) -> named_struct('at', {at} + length(m_{i}[i]), 'out',"
            f" concat(p.out, transform(filter(array({item}), x -> {test}), x -> named_struct('start', x.start, 'ord', {i}, 'stop', x.start + length(x.m), 'type', '{f.type}', 'text', x.m)))), p -> p.out)"
        )
        parts.append(f"CASE WHEN size(m_{i}) > 0 THEN {fold} ELSE CAST(array() AS ARRAY<{SPAN}>) END")
    return cut.selectExpr(*kept, f"inline(array(named_struct('spans', concat({', '.join(parts)}))))")


def entities(found: DataFrame, *keys: str) -> DataFrame:
    """One row a span: the keys, start, stop, type, text."""
    return found.select(*keys, F.explode("spans").alias("s")).select(*keys, F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"), F.col("s.type").alias("type"), F.col("s.text").alias("entity"))


def resolve(spans: Column) -> Column:
    """Leftmost spans without overlap: ordered by start, then finder, kept when they start at or after the last kept stop."""

    def step(kept: Column, s: Column) -> Column:
        return F.when((F.size(kept) == 0) | (s["start"] >= F.try_element_at(kept, F.lit(-1))["stop"]), F.concat(kept, F.array(s))).otherwise(kept)

    return F.aggregate(F.array_sort(spans), F.expr(f"CAST(array() AS ARRAY<{SPAN}>)"), step)


def replace_spans(text: Column, spans: Column, value) -> Column:
    """``text`` with each of the disjoint, ordered spans replaced by ``value(span)``."""
    built = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda p, s: F.struct(s["stop"].alias("at"), F.concat(p["out"], F.substring(text, p["at"] + 1, s["start"] - p["at"]), value(s)).alias("out")),
        lambda p: F.concat(p["out"], F.substring(text, p["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(built)


def typed(text: Column, spans: Column) -> Column:
    """Each span replaced by its type in brackets."""
    return replace_spans(text, spans, lambda s: F.concat(F.lit("["), s["type"], F.lit("]")))
