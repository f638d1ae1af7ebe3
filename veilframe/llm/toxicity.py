"""Toxicity by class-conditional Kneser-Ney models.

One model of words for toxic and one for ordinary rows. A word's probability is its count in the class less a discount, plus what
the discounts leave times a probability that both classes share: a Kneser-Ney estimate by the number of different contexts (words
before it) in which the word stands, in either class, which in turn leaves a rest that all words share alike. So an expression
that one class has rarely or never is judged by the shared counts, and neither class gains from words that neither knows. The
discounts of counts 1, 2 and 3 or more are estimated from how many words occur once to four times.

A text is judged by the difference of its two log-likelihoods, normalised by its length, over all its words and over those alone
whose own difference is above a cut; a logistic curve of these two (of the square root of the second) is fitted on labelled
rows that the models have not seen, from folds 1 to 3 on fold 4, and the cut is that of the best likelihood there. The final counts are of
folds 1 to 4; fold 0 is held out.

Counts cover all labelled rows outside fold 0 and stay in written tables; the driver gets one row of sums. Contexts are counted by 64
hashed classes in a word of bits, which merges before the shuffle; the estimate is near exact for rare words. Only the curve has a
bounded sample: ``curve_rows`` ids of fold 4 (lowest hashes). Scoring is one scan of every whole text: the differences of the ``head`` most frequent
words are with the workers, all other words of a text meet theirs by a join on the word, so no size of vocabulary meets a bound.
Sums are of integers (millionths), so that no order of addition changes a result. Inputs are texts alone.

Results: a text without words (null, empty, blank) scores the share of toxic rows among those of the curve; without rows of both
classes every text scores that share, 0 without any; labels that disagree on an id count as toxic; each row of a repeated id is
counted, in the curve by its mean; a text is a row for each row of ``docs``, null ids included; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, fold, ids_and_texts, in_slices, spark_schema

#: ASCII characters that are neither letters nor digits end a word.
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Differences are kept in millionths.
UNIT = 1_000_000
#: Cuts among which the labelled rows choose.
CUTS = tuple(k * UNIT // 2 for k in range(1, 11))


def blanked(text: str | None) -> bytes:
    """Words and blanks (at least one) between them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK)


def tokens(text: str | None) -> list[bytes]:
    return blanked(text).split()


# ---- counts --------------------------------------------------------------------------------------------------------------

#: By word: occurrences by class, and the classes of contexts as bits; of folds 1 to 3, then of fold 4.
_COUNTS, _BITS = ("early0", "early1", "late0", "late1"), ("early_bits", "late_bits")
WORDS = pa.schema([("word", pa.binary()), *((c, pa.int64()) for c in _COUNTS + _BITS)])
#: Classes of contexts.
CONTEXTS = 64


def context_bit(before: bytes) -> int:
    """The class of a context, the word before it (empty at a text's start), as one bit of 64."""
    return 1 << (zlib.crc32(before) & (CONTEXTS - 1))


def count_words(rows: DataFrame) -> DataFrame:
    """``rows``: text, toxic, part (0: folds 1 to 3, 1: fold 4). The counts of each word."""

    def run(batches):
        for b in in_slices(batches, 1024):
            place: dict[bytes, int] = {b"": 0}  # what stands before a text's first word
            ids, kind = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for text, toxic, part in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "part"))):
                own = [0, *(place.setdefault(w, len(place)) for w in tokens(text))]
                ids.append(np.array(own, dtype=np.int64))
                kind.append(np.full(len(own), 2 * part + toxic, dtype=np.int64))
            at, of = np.concatenate(ids), np.concatenate(kind)
            words, n = list(place), len(place)
            counts = np.bincount(at * 4 + of, minlength=4 * n).reshape(n, 4)
            bit = np.array([context_bit(w) for w in words], dtype=np.uint64)
            bits = np.zeros((n, 2), dtype=np.uint64)
            spelt = np.flatnonzero(at > 0)
            np.bitwise_or.at(bits, (at[spelt], of[spelt] // 2), bit[at[spelt - 1]])
            bits = bits.view(np.int64)
            columns = {c: counts[1:, k] for k, c in enumerate(_COUNTS)} | {c: bits[1:, k] for k, c in enumerate(_BITS)}
            yield batch(WORDS, word=words[1:], **columns)

    found = rows.mapInArrow(run, spark_schema(WORDS)).groupBy("word")
    return found.agg(*(F.sum(c).alias(c) for c in _COUNTS), *(F.bit_or(c).alias(c) for c in _BITS))


# ---- probabilities -------------------------------------------------------------------------------------------------------


def contexts(bits: str) -> str:
    """SQL: how many different contexts set these bits, in millionths (linear counting)."""
    return f"CAST(round(-{CONTEXTS}e6D * ln(1 - least(bit_count({bits}), {CONTEXTS - 1}) / {CONTEXTS}D)) AS BIGINT)"


def discounts(once_to_four: list[int]) -> list[float]:
    """Of counts 1, 2 and 3 or more, from how many words have the counts 1 to 4; 0.75 where that tells nothing."""
    y = once_to_four
    if not y[0] or not y[1]:
        return [0.75] * 3
    share = y[0] / (y[0] + 2 * y[1])
    return [min(max(k - (k + 1) * share * y[k] / y[k - 1], 0.05), k - 0.05) if y[k] and y[k - 1] else 0.75 for k in (1, 2, 3)]


@dataclass(frozen=True)
class Level:
    """One estimate by counts: their sum, the discounts, and what these leave. Counts of 1, 2 and 3 or more end at 1.5 and 2.5."""

    total: float
    discount: list[float]
    rest: float

    @classmethod
    def of(cls, total: float, once_to_four: list[int], more: int) -> Level:
        d = discounts(once_to_four)
        return cls(total, d, (d[0] * once_to_four[0] + d[1] * once_to_four[1] + d[2] * more) / total)

    def sql(self, n: str) -> str:
        a, b, c = (f"{x!r}D" for x in self.discount)
        return f"(greatest({n} - CASE WHEN {n} < 1.5 THEN {a} WHEN {n} < 2.5 THEN {b} ELSE {c} END, 0D) / {self.total!r}D)"


@dataclass(frozen=True)
class Models:
    """Both classes' estimates over the shared one."""

    classes: tuple[Level, Level]
    shared: Level
    words: int

    def gain_sql(self, n: tuple[str, str], m: str) -> str:
        """The difference of a word's log-likelihoods (toxic less ordinary) in millionths; n: its counts, m: its contexts in
        millionths."""
        shared = f"({self.shared.sql(f'({m} / 1e6D)')} + {self.shared.rest / (self.words + 1)!r}D)"
        p = [f"({level.sql(c)} + {level.rest!r}D * {shared})" for level, c in zip(self.classes, n)]
        return f"CAST(round({UNIT}D * ln({p[1]} / {p[0]})) AS BIGINT)"

    @property
    def unseen(self) -> int:
        return round(UNIT * float(np.log(self.classes[1].rest / self.classes[0].rest)))


def estimate(words: DataFrame) -> Models | None:
    """``words``: n0, n1, m. None unless both classes have words. One row of sums goes to the driver."""
    sums = ["coalesce(sum(m), 0) AS m", "count_if(m > 0) AS words"]
    for c, n in (("n0", "n0"), ("n1", "n1"), ("m", "round(m / 1e6)")):
        sums += [f"count_if({n} = {k}) AS {c}_{k}" for k in range(1, 5)] + [f"count_if({n} >= 3) AS {c}_more"]
    r = words.selectExpr("coalesce(sum(n0), 0) AS n0", "coalesce(sum(n1), 0) AS n1", *sums).first()
    if not r.n0 or not r.n1:
        return None
    level = lambda c, total: Level.of(float(total), [r[f"{c}_{k}"] for k in range(1, 5)], r[f"{c}_more"])
    return Models((level("n0", r.n0), level("n1", r.n1)), level("m", r.m / 1e6), r.words)


# ---- texts ---------------------------------------------------------------------------------------------------------------


@dataclass
class Gains:
    """Differences by word: a written table (word, gain), those of the most frequent words, and that of unknown words."""

    table: DataFrame
    head: dict[bytes, int]
    unseen: int


def sums(rows: DataFrame, gains: Gains, cuts: tuple[int, ...], scratch: Scratch, name: str) -> DataFrame:
    """``rows``: doc_id, held_out, text. A row for each: doc_id, held_out, n (words), total, and clear0, ... by cut: the sum of the
    differences, and of those above the cut."""
    clear = [f"clear{k}" for k in range(len(cuts))]
    schema = pa.schema(
        [("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("total", pa.int64()), *((c, pa.int64()) for c in clear), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))]
    )
    head = gains.head

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40  # rows keep their order within a task, so a repeated task names them alike
        for b in in_slices(batches):
            columns: dict[str, list] = {f: [] for f in schema.names}
            for text in b.column("text").to_pylist():
                ws = tokens(text)
                near = np.array([head[w] for w in ws if w in head], dtype=np.int64)
                far: dict[bytes, int] = {}
                if len(near) < len(ws):
                    for w in ws:
                        if w not in head:
                            far[w] = far.get(w, 0) + 1
                row = (uid, len(ws), int(near.sum()), *(int(near[near > c].sum()) for c in cuts), list(far), list(far.values()))
                for f, value in zip(("uid", "n", "total", *clear, "words", "counts"), row):
                    columns[f].append(value)
                uid += 1
            columns["doc_id"], columns["held_out"] = b.column("doc_id"), b.column("held_out")
            yield batch(schema, **columns)

    parts = scratch.save(rows.select("doc_id", "held_out", "text").mapInArrow(run, spark_schema(schema)), name)
    far = parts.selectExpr("uid", "inline(arrays_zip(words, counts))").withColumnsRenamed({"words": "word", "counts": "times"})
    met = far.join(gains.table, "word", "left").select("uid", "times", F.coalesce("gain", F.lit(gains.unseen)).alias("gain"))
    product = F.col("times") * F.col("gain")
    more = met.select("uid", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n"), product.alias("total"), *(F.when(F.col("gain") > c, product).otherwise(0).alias(k) for k, c in zip(clear, cuts)))
    each = parts.select("uid", "doc_id", "held_out", "n", "total", *clear).unionByName(more).groupBy("uid")
    return each.agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n", "total", *clear))).drop("uid")


def features(clear: str) -> tuple[Column, Column]:
    """The two length-normalised differences of a text with words."""
    return F.col("total") / F.col("n") / UNIT, F.sqrt(F.col(clear) / F.col("n") / UNIT)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Newton's method; intercept first; and the mean log-likelihood."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (y - p) - ridge * b
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b)), grad)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ b, -30, 30))), 1e-12, 1 - 1e-12)
    return b, float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


@dataclass
class Model:
    share: float
    gains: Gains | None = None
    cut: int = 0
    slope: np.ndarray = field(default_factory=lambda: np.zeros(3))


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, curve_rows: int = 3_000, head: int = 100_000) -> Model:
    """``labels``: doc_id, toxic. The tables of the model lie in ``scratch``."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("part", (fold(F.col("doc_id")) == 4).cast("int"))
    )
    light = ids_and_texts(docs)
    side = F.broadcast(known) if known.count() <= 1_000_000 else known  # checked; beyond it, by shuffle
    counted = scratch.save(count_words(light.join(side, "doc_id").select("text", "toxic", "part")), "counted")
    early = counted.selectExpr("early0 AS n0", "early1 AS n1", f"{contexts('early_bits')} AS m")
    last = counted.selectExpr("early0 + late0 AS n0", "early1 + late1 AS n1", f"{contexts('early_bits | late_bits')} AS m")

    def lowest(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", "toxic")

    final = estimate(last)
    chosen = lowest(known.where("part = 1"), curve_rows)
    seen = chosen.agg(F.min("toxic"), F.max("toxic")).first()
    if seen[0] == seen[1]:  # no row, or rows of one class
        chosen = lowest(known.where("toxic = 1"), curve_rows // 2).unionAll(lowest(known.where("toxic = 0"), curve_rows // 2))
    if final is None:
        return Model(float(chosen.agg(F.avg("toxic")).first()[0] or 0.0))
    first = estimate(early) or final
    gain = last_gain = final.gain_sql(("(early0 + late0)", "(early1 + late1)"), contexts("early_bits | late_bits"))
    if first is not final:
        gain = first.gain_sql(("early0", "early1"), contexts("early_bits"))
    table = scratch.save(counted.selectExpr("word", f"{gain} AS early", f"{last_gain} AS late", "early0 + early1 + late0 + late1 AS often"), "gains")
    scratch.drop("counted")
    # the most frequent words by eighths of a power of e, as many as ``head`` has room for
    step = F.floor(F.ln("often") * 8).cast("int")
    least, left = 1 << 30, head
    for r in table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():  # at most 350 rows
        left -= r.n
        if left < 0:
            break
        least = r.step
    top = table.where(step >= least).select("word", "early", "late").toPandas()
    names = [bytes(w) for w in top["word"]]

    def gains(column: str, models: Models) -> Gains:
        return Gains(table.select("word", F.col(column).alias("gain")), dict(zip(names, top[column].tolist())), models.unseen)

    sample = light.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.lit(False).alias("held_out"))  # at most curve_rows ids
    made = sums(sample, gains("early", first), CUTS, scratch, "curve").where("n > 0")
    columns = [f.alias(f"f{k}_{i}") for k in range(len(CUTS)) for i, f in enumerate(features(f"clear{k}"))]
    means = made.select("doc_id", *columns).groupBy("doc_id").agg(*(F.avg(c).alias(c) for k in range(len(CUTS)) for c in (f"f{k}_0", f"f{k}_1")))
    rows = chosen.join(means, "doc_id", "left").orderBy("doc_id").toPandas()
    scratch.drop("curve")
    model = Model(float(rows["toxic"].mean()), gains("late", final))
    rows = rows.dropna()
    if len(rows):
        y = rows["toxic"].to_numpy(dtype=float)
        fits = [fit_logistic(rows[[f"f{k}_0", f"f{k}_1"]].to_numpy(dtype=float), y) for k in range(len(CUTS))]
        best = int(np.argmax([likelihood for _, likelihood in fits]))
        model.cut, model.slope = CUTS[best], fits[best][0]
    return model


def score(docs: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    rows = ids_and_texts(docs, (fold(F.col("doc_id")) == 0).alias("held_out"))
    share = F.lit(model.share)
    if model.gains is None:
        judged = rows.select("doc_id", "held_out", share.alias("score"))
    else:
        mean, clear = features("clear0")
        b = model.slope
        curve = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), b[0] + b[1] * mean + b[2] * clear))))
        judged = sums(rows, model.gains, (model.cut,), scratch, "scored").select("doc_id", "held_out", F.when(F.col("n") > 0, curve).otherwise(share).alias("score"))
    return judged.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
