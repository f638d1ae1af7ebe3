"""Verdicts of a language model on extracted entities: parsing, validation, scores, prompts, labelled samples."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import text as T
from .ranks import numbered

ENTITY = "STRUCT<text: STRING, type: STRING>"
VERDICT = f"STRUCT<correct: BOOLEAN, false_positives: ARRAY<STRING>, missed_entities: ARRAY<{ENTITY}>, confidence: STRING>"
DEFAULT = '{"correct": false, "false_positives": [], "missed_entities": [], "confidence": "low"}'
NEEDED = ("correct", "false_positives", "missed_entities")


def objects(reply: str) -> list[str]:
    """Top-level brace-balanced pieces of a reply, left to right; an unclosed one runs to the end."""
    out, depth, since = [], 0, 0
    for i, ch in enumerate(reply):
        if ch == "{":
            since = since if depth else i
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if not depth:
                out.append(reply[since : i + 1])
    return out + [reply[since:]] * bool(depth)


def last_valid(reply: str | None) -> str:
    """The last object of a reply that parses and has every needed field, as JSON; a cautious default without one. Replies are
    untrusted: a field that should be a list and is none counts as an empty one."""
    listed = lambda x: x if isinstance(x, list) else []
    for piece in reversed(objects(reply or "")):
        try:
            found = json.loads(piece)
        except (ValueError, RecursionError):
            continue
        if all(k in found for k in NEEDED):
            names = [str(x.get("text", "")) if isinstance(x, dict) else str(x) for x in listed(found["false_positives"])]
            missed = [{"text": str(x.get("text", "")), "type": str(x.get("type", ""))} for x in listed(found["missed_entities"]) if isinstance(x, dict)]
            return json.dumps({"correct": bool(found["correct"]), "false_positives": names, "missed_entities": missed, "confidence": str(found.get("confidence", "low"))}, ensure_ascii=False)
    return DEFAULT


@pandas_udf(StringType())
def _last_valid(replies: pd.Series) -> pd.Series:
    return replies.map(last_valid)


def parse(reply: Column) -> Column:
    """VERDICT of a reply; finding balanced braces is beyond built-in functions, parsing is not."""
    return F.from_json(_last_valid(reply), VERDICT)


def validate(verdict: Column, text: Column) -> Column:
    """Keeps missed entities that stand in the text, have a name's type and look like a name; trusts false positives only at
    high confidence, and only where they stand in the text."""
    kind = lambda e: T.type_alias(e["type"], T.NAME_TYPES)
    missed = F.filter(verdict["missed_entities"], lambda e: kind(e).isNotNull() & T.is_name_like(e["text"], placeholders=True) & F.contains(text, e["text"]))
    return F.struct(
        F.coalesce(verdict["correct"], F.lit(True)).alias("correct"),
        F.when(verdict["confidence"] == "high", F.filter(verdict["false_positives"], lambda x: F.contains(text, x))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)")).alias("false_positives"),
        F.transform(missed, lambda e: F.struct(e["text"].alias("text"), kind(e).alias("type"))).alias("missed_entities"),
        F.coalesce(verdict["confidence"], F.lit("low")).alias("confidence"),
    )


def simple_score(verdict: Column) -> Column:
    return F.size(verdict["false_positives"]).cast("double")


def weighted_score(verdict: Column) -> Column:
    weight = F.when(verdict["confidence"] == "high", 1.0).when(verdict["confidence"] == "medium", 0.7).when(verdict["confidence"] == "low", 0.3).otherwise(0.7)
    return (F.size(verdict["false_positives"]) * 0.3 + F.size(verdict["missed_entities"]) * 0.7) * weight


def listed(entities: Column) -> Column:
    """The entities of a prompt: "x" as T, ... or a phrase for none."""
    return F.when(F.size(entities) > 0, F.array_join(F.transform(entities, lambda e: F.concat(F.lit('"'), e["text"], F.lit('" as '), e["type"])), ", ")).otherwise(F.lit("no entities"))


def prompt(text: Column, entities: Column) -> Column:
    return F.concat(F.lit("Text: "), T.preview(text), F.lit("\nEntities: "), listed(entities))


def true_entities(text: Column, entities: Column, verdict: Column) -> Column:
    """Entities in the text, of a known type, alike only once, without those judged false, and with those judged missed."""
    usable = F.filter(entities, lambda e: T.type_alias(e["type"]).isNotNull() & F.contains(text, e["text"]) & T.is_name_like(e["text"]))
    own = F.array_distinct(F.transform(usable, lambda e: F.struct(e["text"].alias("text"), T.type_alias(e["type"]).alias("type"))))
    kept = F.filter(own, lambda e: ~F.array_contains(verdict["false_positives"], e["text"]))
    missed = F.filter(verdict["missed_entities"], lambda e: T.type_alias(e["type"]).isNotNull() & (~T.type_alias(e["type"]).isin(*T.NAME_TYPES) | T.is_name_like(e["text"])) & F.contains(text, e["text"]))
    add = lambda done, e: F.when(F.exists(done, lambda d: d["text"] == e["text"]), done).otherwise(F.concat(done, F.array(F.struct(e["text"].alias("text"), T.type_alias(e["type"]).alias("type")))))
    return F.aggregate(missed, kept, add)


def up_to_limit(rows: DataFrame, order: str, score: str, limit: int, most: int = 500) -> DataFrame:
    """The disagreements (score above 0) that a scan in order would yield: it stops after ``limit`` of them or ``most`` rows.

    Only the first ``most`` rows by order can matter, so these alone meet in one task.
    """
    first = rows.orderBy(order).limit(most)
    running = Window.orderBy(order)
    hits = F.sum((F.col(score) > 0).cast("int")).over(running)
    return first.withColumn("__hits", hits).where((F.col(score) > 0) & (F.col("__hits") <= limit)).drop("__hits")


def ordered_split(rows: DataFrame, order: str, share: float = 0.8) -> DataFrame:
    """Adds ``part``: train for the first int(n * share) rows by the number ``order``, test for the rest."""
    ranked = numbered(rows, [order], "__rank")
    return ranked.withColumn("part", F.when(F.col("__rank") <= int(rows.count() * share), "train").otherwise("test")).drop("__rank")
