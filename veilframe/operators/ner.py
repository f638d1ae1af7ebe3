"""What surrounds a model of entities: provider tables, filters of its raw groups, duplicates from overlapping chunks."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SCORE, MIN_CHARS, MAX_CHARS = 0.60, 2, 50
# A model's groups and our types.
LABELS = {"PER": "PERSON", "ORG": "ORG", "LOC": "LOC"}


class SpanProvider(Protocol):
    """A finder outside the engine: rows of text_id, chunk_no, chunk_text, offset, entity_group, score, start, end."""

    def spans(self, texts: DataFrame) -> DataFrame: ...


class Gazetteer:
    """A provider from a list of names: every whole-word occurrence of a listed name, from the left and without overlap with
    itself, is a group of full score; no letter, digit or underscore stands beside it."""

    #: Up to so many names are broadcast; more are a matter of mappings.known_values.
    MOST = 10_000

    def __init__(self, names: DataFrame) -> None:
        """``names``: name, entity_group; a configured list, whose size is checked before it is broadcast."""
        self.names = names.where("length(name) > 0")

    def spans(self, texts: DataFrame) -> DataFrame:
        if self.names.limit(self.MOST + 1).count() > self.MOST:
            raise ValueError(f"a gazetteer holds at most {self.MOST} names")
        hits = texts.select("text_id", "text").join(F.broadcast(self.names), F.contains("text", F.col("name")))
        quoted = F.concat(F.lit(r"\Q"), F.replace("name", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        gaps = hits.withColumn("gaps", F.split("text", F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])")), -1))
        # a hit begins where the gaps and the names before it end
        before = F.aggregate(F.slice("gaps", F.lit(1), F.col("i") + 1), F.lit(0), lambda a, g: a + F.length(g))
        each = gaps.where("size(gaps) > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.size("gaps") - 2)))
        start = before + F.col("i") * F.length("name")
        words = each
        return words.select("text_id", F.lit(0).alias("chunk_no"), F.col("text").alias("chunk_text"), F.lit(0).alias("offset"), "entity_group", F.lit(1.0).alias("score"), start.alias("start"), (start + F.length("name")).alias("end"))


def post_filter(groups: DataFrame) -> DataFrame:
    """Groups worth keeping, with offsets in the whole text: text_id, chunk_no, entity, type, start, stop."""
    text, s, e = F.col("chunk_text"), F.col("start"), F.col("end")
    before, after = F.when(s > 0, F.substring(text, s, F.lit(1))).otherwise(""), F.substring(text, e + 1, F.lit(1))
    beside = r"^[\p{L}\p{N}_.]$"
    kind = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    span = F.trim(F.substring(text, s + 1, e - s))
    out = groups.select("text_id", "chunk_no", span.alias("entity"), F.try_element_at(kind, F.col("entity_group")).alias("type"), (s + F.col("offset")).alias("start"), (e + F.col("offset")).alias("stop"), "score", before.alias("b"), after.alias("a"))
    good = (F.col("score") >= MIN_SCORE) & F.col("type").isNotNull() & ~F.col("b").rlike(beside) & ~F.col("a").rlike(beside) & F.length("entity").between(MIN_CHARS, MAX_CHARS)
    return out.where(good & ~F.startswith("entity", F.concat("type", F.lit("_")))).drop("b", "a", "score")


def once(found: DataFrame) -> DataFrame:
    """Spans that several chunks give count once, from the first chunk."""
    rest = [c for c in found.columns if c not in ("text_id", "start", "stop")]
    return found.groupBy("text_id", "start", "stop").agg(F.min(F.struct("chunk_no", *(c for c in rest if c != "chunk_no"))).alias("f")).select("text_id", "start", "stop", "f.*")
