"""Seeded sentences from templates with slots, with or without entities, for training sets.

A template is a list of (kind, text): kind is empty for plain text, an entity type, or a word class for slots that are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTITIES = ("PERSON", "ORG", "LOC")
WORDS = {
    "PERSON": ("Ann Lee", "Bo Roy", "Carla Fox", "Dmitri Oak", "Eve", "Farid Moss", "Greta van Holt"),
    "ORG": ("Acme Works", "Globe Press", "Northwind Bank", "Initrode", "Blue Harbor Ltd"),
    "LOC": ("Riverton", "New Holm", "Port Aria", "Ostfeld", "Lake Senn"),
    "thing": ("printer", "invoice", "meeting room", "build", "ticket", "cache"),
    "verb": ("check", "restart", "archive", "review", "close"),
    "time": ("today", "on Monday", "after lunch", "next week"),
}


def template(text: str) -> list[tuple[str, str]]:
    """Slots are kinds in braces."""
    out = []
    for piece in text.replace("}", "{").split("{"):
        if piece:
            out.append((piece, "") if piece in WORDS else ("", piece))
    return out


NEGATIVE = tuple(map(template, ("Please {verb} the {thing} {time}.", "The {thing} is open", "{verb} it again {time}", "No {thing} found, see the {thing} below", "Who can {verb} this {thing}?", "def {verb}_all(items): return items")))
POSITIVE = tuple(
    map(template, ("Write to {PERSON} {time}", "{PERSON} from {ORG} will {verb} the {thing}", "{ORG} moves to {LOC} {time}.", "Ask {PERSON} or {PERSON} in {LOC}", "The {thing} of {ORG}", "{LOC}: {PERSON} ({ORG}) came {time}"))
)


def sentences(spark: SparkSession, templates: tuple, n: int) -> DataFrame:
    """id from 0 to n - 1, text, and entities (type:start:text, joined by |). A slot's word follows from the id and the slot's place."""
    pieces = spark.createDataFrame([(t, i, kind, text) for t, own in enumerate(templates) for i, (kind, text) in enumerate(own)], "t int, i int, kind string, piece string")
    words = F.create_map(*(x for kind, ws in WORDS.items() for x in (F.lit(kind), F.array(*map(F.lit, ws)))))
    rows = spark.range(n).withColumn("t", (F.col("id") % len(templates)).cast("int")).join(F.broadcast(pieces), "t")  # as many pieces as the templates have
    choice = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("-"), F.col("i").cast("string"))), 1, 6), 16, 10).cast("int")
    listed = F.try_element_at(words, F.col("kind"))
    each = rows.withColumn("piece", F.coalesce(F.get(listed, choice % F.size(listed)), F.col("piece")))
    before = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    own = F.when(F.col("kind").isin(*ENTITIES), F.concat_ws(":", "kind", F.col("start").cast("string"), "piece"))
    made = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "piece", own.alias("entity")))).alias("p"))
    return made.select("id", F.array_join("p.piece", "").alias("text"), F.array_join(F.array_compact(F.col("p.entity")), "|").alias("entities"))
