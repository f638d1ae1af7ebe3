"""Token labels: BIO encoding, alignment to sub-words, chunks, F1, distributions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType


# The label list, by id.
LABELS = ("O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC")


def io_to_bio(tags: Column) -> Column:
    """Inside tags (a type, or O) to BIO: a tag begins where the tag before it differs."""
    before = F.concat(F.array(F.lit(None).cast("string")), tags)  # one longer, so the last pair is cut off again
    made = F.zip_with(tags, before, lambda t, p: F.when(t == "O", t).when(t == p, F.concat(F.lit("I-"), t)).otherwise(F.concat(F.lit("B-"), t)))
    return F.slice(made, F.lit(1), F.size(tags))


_TOKEN = re.compile("[^ \t\n\r\f]+")


@pandas_udf(ArrayType(IntegerType()))
def token_starts(texts: pd.Series) -> pd.Series:
    """Where each whitespace token begins, in code points. An Arrow pass: built-in functions would add up all earlier tokens for
    each one."""
    return texts.map(lambda t: None if t is None else [m.start() for m in _TOKEN.finditer(t)])


def bio_encode(text: Column, entities: Column) -> Column:
    """Labels of whitespace tokens. Each of ``entities`` (text, type) marks its first occurrence, later ones over earlier ones;
    a token has the type of its first character, inside when the token before it is of that type."""
    marked = F.transform(entities, lambda e: F.struct((F.call_function("locate", e["text"], text) - 1).alias("at"), F.length(e["text"]).alias("n"), e["type"].alias("type")))
    kinds = F.transform(token_starts(text), lambda s: F.coalesce(F.try_element_at(F.filter(marked, lambda m: (m["at"] >= 0) & (m["at"] <= s) & (s < m["at"] + m["n"])), F.lit(-1))["type"], F.lit("O")))
    return io_to_bio(kinds)


def bio_eval(words: Column, entities: Column) -> Column:
    """B-type for each token that holds an entity's text, in any case; the last such entity counts."""
    hit = lambda w: F.try_element_at(F.filter(entities, lambda e: (F.length(e["text"]) > 0) & F.contains(F.lower(w), F.lower(e["text"]))), F.lit(-1))
    return F.transform(words, lambda w: F.coalesce(F.concat(F.lit("B-"), hit(w)["type"]), F.lit("O")))


def chunks(rows: DataFrame, labels: str, *keys: str) -> DataFrame:
    """Entity chunks of a label sequence: keys, type, first, last (token positions). A chunk begins at B, at a change of type,
    or at an inside label after O."""
    each = rows.select(*keys, F.posexplode(labels).alias("i", "label")).withColumn("type", F.when(F.col("label") != "O", F.substring("label", 3, 100)))
    order = Window.partitionBy(*keys).orderBy("i")
    begins = F.col("type").isNotNull() & (F.startswith("label", F.lit("B-")) | ~F.col("type").eqNullSafe(F.lag("type").over(order)))
    numbered = each.withColumn("chunk", F.sum(begins.cast("int")).over(order)).where("type IS NOT NULL")
    return numbered.groupBy(*keys, "chunk", "type").agg(F.min("i").alias("first"), F.max("i").alias("last")).drop("chunk")


def seq_f1(rows: DataFrame, true: str, predicted: str, *keys: str) -> DataFrame:
    """One row: n_true, n_predicted, n_right, precision, recall, f1, by whole chunks."""
    gold, found = chunks(rows, true, *keys).withColumn("g", F.lit(1)), chunks(rows, predicted, *keys).withColumn("p", F.lit(1))
    both = gold.join(found, [*keys, "type", "first", "last"], "full")
    n = both.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("n_true"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_predicted"), F.coalesce(F.sum(F.col("g") * F.col("p")), F.lit(0)).alias("n_right"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    p = n.withColumn("precision", share("n_right", "n_predicted")).withColumn("recall", share("n_right", "n_true"))
    return p.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))


def distribution(rows: DataFrame, labels: str, known: tuple[str, ...] = LABELS) -> DataFrame:
    """label, n, percent for every known label, zero where it is absent."""
    counted = rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    all_labels = rows.sparkSession.createDataFrame([(x,) for x in known], "label string")
    filled = all_labels.join(counted, "label", "left")
    filled = filled.withColumn("n", F.coalesce("n", F.lit(0)))
    total = filled.agg(F.sum("n").alias("total"))
    return filled.crossJoin(total).withColumn("percent", F.when(F.col("total") > 0, 100.0 * F.col("n") / F.col("total")).otherwise(F.lit(0.0)))  # total is one row


def label_ids(labels: Column, known: tuple[str, ...] = LABELS) -> Column:
    """Names to ids; unknown names and ids out of range become 0."""
    ids = F.create_map(*(F.lit(x) for i, name in enumerate(known) for x in (name, i)))
    return F.transform(labels, lambda x: F.coalesce(F.try_element_at(ids, x), F.lit(0)))


def clamp_ids(ids: Column, most: int = len(LABELS)) -> Column:
    return F.transform(ids, lambda i: F.when((i >= most) | (i < 0), F.lit(0)).otherwise(i))


def align(word_ids: Column, labels: Column) -> Column:
    """Label ids of sub-words: special ones (no word) -100; a word's first keeps its label; those that follow become inside, or
    -100 after O. Odd ids begin a type, even ids continue it."""

    def one(w: Column, i: Column) -> Column:
        label = F.get(labels, w)
        first = (i == 0) | ~F.get(word_ids, i - 1).eqNullSafe(w)
        return F.when(w.isNull(), F.lit(-100)).when(first, label).when(label == 0, F.lit(-100)).when(label % 2 == 1, label + 1).otherwise(label)

    return F.transform(word_ids, one)


def sample_predictions(words: Column, gold: Column, word_ids: Column, predicted: Column) -> Column:
    """word gold predicted, with * on a mismatch; the prediction is that of the word's first sub-word."""
    at = lambda i: F.coalesce(F.get(predicted, F.call_function("array_position", word_ids, i).cast("int") - 1), F.lit(0))
    return F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(gold, i).cast("string"), at(i).cast("string"), F.when(F.get(gold, i) != at(i), F.lit("*"))))
