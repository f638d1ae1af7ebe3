"""Secret scan by a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams: every text that the expression matches must
satisfy it. Each block of documents gets an inverted index of the trigrams that the queries use (postings sorted by trigram,
then document). A rule's query is evaluated by intersecting and uniting postings, and only the documents that come out are
verified with the expression itself. Rules without mandatory trigrams scan every document.

The index is local to its block, so there is no shuffle, nothing grows with the corpus, and a lost executor only repeats its
own blocks. Results: a null text counts as empty; offsets are code points, end exclusive; each row is judged alone, so
repeated rows repeat their result and an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, ids_and_texts, in_slices, kinds_ordered, spark_schema


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` code points are asked of ``group``; a match that has fewer is dropped, without retry."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules; their patterns are ASCII only.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Rules for well-known public token formats, added to the base.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
)
RULES = BASE + MORE

# ---- Boolean trigram queries ---------------------------------------------------------------------------------------------

#: A query is True (anything may match), ("tri", bytes), ("and", queries) or ("or", queries).
Query = bool | tuple
#: Strings of a sub-expression are kept exactly up to so many; classes up to so many characters are spelt out.
EXACT, CLASS = 64, 8


def _and(queries: Iterable[Query]) -> Query:
    parts = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(queries: Iterable[Query]) -> Query:
    parts = list(dict.fromkeys(queries))
    if not parts or True in parts:
        return True
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _literal(strings: frozenset[bytes]) -> Query:
    """At least one of these strings occurs."""
    return _or(_and(("tri", s[i : i + 3]) for i in range(len(s) - 2)) for s in sorted(strings))


@dataclass(frozen=True)
class Info:
    """What all matches of a sub-expression have in common: ``exact`` lists them all, or they satisfy ``query``."""

    exact: frozenset[bytes] | None
    query: Query

    def settled(self) -> Query:
        return self.query if self.exact is None else _and((self.query, _literal(self.exact)))


def _sequence(items: list[Info]) -> Info:
    """Runs of neighbours with exact strings are multiplied out, so that trigrams may span several items."""
    queries, run, whole = [], frozenset({b""}), True
    for item in items:
        joined = None if item.exact is None else frozenset(a + b for a in run for b in item.exact)
        if joined is not None and len(joined) <= EXACT:
            run = joined
            queries.append(item.query)
            continue
        queries += [_literal(run), item.query]
        whole = False
        run = item.exact if item.exact is not None else frozenset({b""})
    return Info(run, _and(queries)) if whole else Info(None, _and([*queries, _literal(run)]))


def _class(members) -> Info:
    chars: set[int] = set()
    for op, value in members:
        if op is sre.LITERAL:
            chars.add(value)
        elif op is sre.RANGE and value[1] - value[0] < 64:
            chars.update(range(value[0], value[1] + 1))
        else:
            return Info(None, True)
    folded = frozenset(chr(c).lower().encode() if c < 128 else chr(c).encode() for c in chars)
    return Info(folded, True) if len(folded) <= CLASS else Info(None, True)


def _info(tree) -> Info:
    items: list[Info] = []
    for op, value in tree:
        if op is sre.LITERAL:
            items.append(_class([(op, value)]))
        elif op is sre.IN:
            items.append(_class(value))
        elif op is sre.SUBPATTERN:
            items.append(_info(value[-1]))
        elif op is sre.BRANCH:
            branches = [_info(b) for b in value[1]]
            known = [b.exact for b in branches]
            if None not in known and len(union := frozenset().union(*known)) <= EXACT:
                items.append(Info(union, _or(b.query for b in branches)))
            else:
                items.append(Info(None, _or(b.settled() for b in branches)))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = value
            inner = _info(body)
            if low == 0:
                once = high == 1 and inner.exact is not None
                items.append(Info(inner.exact | {b""}, True) if once else Info(None, True))
            else:
                items += [inner] * min(low, 3)
                if high > low or low > 3:  # more copies stand before what follows
                    items.append(Info(None, True))
        elif op is sre.AT:
            continue
        else:
            items.append(Info(None, True))
    return _sequence(items)


def trigram_query(pattern: str) -> Query:
    """A query over the trigrams of a text with A-Z lower-cased that every match of ``pattern`` satisfies."""
    return _info(parser.parse(pattern)).settled()


def trigrams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


# ---- the index of a block ------------------------------------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class BlockIndex:
    """Postings of the wanted trigrams over a block of UTF-8 texts, without trigrams that cross a border of texts."""

    def __init__(self, texts: list[bytes], wanted: set[bytes]) -> None:
        ends = np.cumsum([len(t) for t in texts])
        chars = _FOLD[np.frombuffer(b"".join(texts), dtype=np.uint8)].astype(np.uint32)
        self.postings: dict[bytes, np.ndarray] = {}
        if len(chars) < 3 or not wanted:
            return
        codes = chars[:-2] << 16 | chars[1:-1] << 8 | chars[2:]
        listed = np.zeros(1 << 24, dtype=bool) if len(codes) > 1 << 20 else None
        keys = np.array(sorted(int.from_bytes(t, "big") for t in wanted), dtype=np.uint32)
        if listed is None:
            at = np.flatnonzero(np.isin(codes, keys))
        else:
            listed[keys] = True
            at = np.flatnonzero(listed[codes])
        doc = np.searchsorted(ends, at, side="right")
        inside = at + 3 <= ends[doc]
        found = np.unique(codes[at[inside]].astype(np.uint64) << np.uint64(32) | doc[inside].astype(np.uint64))
        tri, doc = found >> np.uint64(32), (found & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for k in keys:
            lo, hi = np.searchsorted(tri, [k, k + 1])
            self.postings[int(k).to_bytes(3, "big")] = doc[lo:hi]

    def candidates(self, query: Query, n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if query[0] == "tri":
            return self.postings.get(query[1], np.zeros(0, dtype=np.int64))
        parts = [self.candidates(q, n) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def find(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches; those that are too short are dropped."""
    return [(rule.kind, *m.span()) for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scan_pattern(rule: Rule) -> str:
    """A whole match that is one repeated class and is asked for a least length can be searched at that length."""
    if rule.group == 0 and rule.least > 1 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return rule.pattern[:-1] + "{%d,}" % rule.least
    return rule.pattern


def scan_block(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """Spans of each text, in any order."""
    queries = [trigram_query(r.pattern) for r in rules]
    index = BlockIndex([t.encode("utf-8", "surrogatepass") for t in texts], set().union(*map(trigrams, queries)))
    spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for rule, query in zip(rules, queries):
        compiled = re.compile(_scan_pattern(rule))
        for i in index.candidates(query, len(texts)):
            spans[i] += find(rule, compiled, texts[i])
    return spans


OUT = pa.schema([("doc_id", pa.int64()), ("kinds", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and three parallel arrays kinds, starts, ends, ordered by start, then by the rules' order."""
    rank = {r.kind: i for i, r in enumerate(rules)}

    def run(batches):
        for b in in_slices(batches):
            found = [sorted(s, key=lambda x: (x[1], rank[x[0]], x[2])) for s in scan_block([t or "" for t in b.column("text").to_pylist()], rules)]
            yield batch(OUT, doc_id=b.column("doc_id"), kinds=[[x[0] for x in s] for s in found], starts=[[x[1] for x in s] for s in found], ends=[[x[2] for x in s] for s in found])

    return ids_and_texts(docs).mapInArrow(run, spark_schema(OUT))


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The contract's columns, derived from ``scan``'s spans."""
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")))
    kinds = [r.kind for r in base]
    own = F.filter(spans, lambda s: F.substring_index(s, ":", 1).isin(kinds))

    def count(kind: str):
        return F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, kinds),
        F.sha2(F.array_join(own, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(spans, ",").alias("spans"),
    )


def reference_spans(text: str | None, rules: tuple[Rule, ...]) -> tuple[str, str]:
    """Brute force for tests: every expression over the whole text; (joined spans, their sha256)."""
    spans = [s for r in rules for s in find(r, re.compile(r.pattern), text or "")]
    joined = kinds_ordered(spans, [r.kind for r in rules])
    return joined, hashlib.sha256(joined.encode()).hexdigest()
