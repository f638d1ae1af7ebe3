"""Rule files: JSON with // and /* */ comments, and the few path expressions that rules use."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

#: A string literal, or a comment; comment signs inside literals belong to them.
_PIECE = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.S)
SCHEMA = "kind STRING, ord INT, url_pattern STRING, all_fields BOOLEAN, fields ARRAY<STRING>, sse_fields ARRAY<STRING>"


def strip_comments(text: str) -> str:
    return _PIECE.sub(lambda m: m[1] or "", text)


def parse(text: str) -> list[tuple]:
    """Rows of SCHEMA, in file order within each kind; patterns that do not compile raise."""
    spec = json.loads(strip_comments(text))
    rows: list[tuple] = []

    def add(kind: str, ord_: int, pattern: str, fields=None, sse=None) -> None:
        re.compile(pattern)
        rows.append((kind, ord_, pattern, fields is True, list(fields) if isinstance(fields, list) else [], list(sse or [])))

    for kind, names in (("safe", spec.get("known_safe_routes")), ("leak_domain", spec.get("anxious_filter_domains"))):
        for i, p in enumerate(names or []):
            add(kind, i, p)
    for i, r in enumerate(spec.get("blocked_urls") or []):
        add("blocked", i, r["url_pattern"] if isinstance(r, dict) else r)
    for section, way in (("anonymise", "requests"), ("anonymise", "responses"), ("deanonymise", "responses")):
        for i, r in enumerate((spec.get(section) or {}).get(way) or []):
            add(f"{section}_{way[:-1]}", i, r["url_pattern"], r.get("sensitive_fields"), r.get("sse_fields"))
    return rows


def load(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse(text), SCHEMA)


# ---- path expressions ----------------------------------------------------------------------------------------------------

_STEP = re.compile(r"\.?\[(?:(\d*):(\d*)|(\d+))?\]|\.([A-Za-z_][A-Za-z0-9_]*)|\.(?=$|\[)")


def compile_path(expression: str) -> tuple[list[tuple], list[str], str | None]:
    """(steps, kept types, last key) of a path expression; others than the rules' subset raise.

    Steps: ("key", name), ("each", least, end) for [] and slices, ("index", n). A tail ``.. | strings`` or none keeps all
    strings below; ``select(.type != "x")`` excludes elements whose sibling ``type`` is x; ``select(.description != null) |
    .description`` keeps strings whose last key is description.
    """
    parts = [p.strip() for p in expression.split("|")]
    head, steps, excluded, last = parts[0], [], [], None
    at = 0
    if head not in (".", ".."):
        while at < len(head):
            m = _STEP.match(head, at)
            if not m:
                raise ValueError(f"unsupported path: {expression}")
            if m[4]:
                steps.append(("key", m[4]))
            elif m[3]:
                steps.append(("index", int(m[3])))
            elif "[" in m[0]:
                steps.append(("each", int(m[1] or 0), int(m[2]) if m[2] else None))
            at = m.end()
    for p in parts[1:]:
        if m := re.fullmatch(r'select\(\.type != "([^"]*)"\)', p):
            excluded.append(m[1])
        elif m := re.fullmatch(r"select\(\.([A-Za-z_]+) != null\)", p):
            last = m[1]
        elif p not in ("..", "strings", "objects", f".{last}"):
            raise ValueError(f"unsupported path: {expression}")
    return steps, excluded, last
