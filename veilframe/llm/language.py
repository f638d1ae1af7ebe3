"""Language identification with language-bitmask n-gram filters.

The filters of all languages lie side by side in one bit-sliced Bloom filter: slot i holds a bit for each language, and a lookup
of an n-gram ANDs its slots, which gives the mask of all languages that contain it. A text's popcounts per language, less the
hits that the filter's fill makes by chance, decide.

Learning: at most ``per_language`` different rows of each language (a documented bound: lowest hashes of id and text), outside
fold 0; an n-gram enters a language's filter when it occurs in at least ``least_share`` of that language's sampled texts, and in two of them if there
are FEW or more. Rows are first thinned by a threshold on their hash from the languages' counts, so that a
language with a third of all rows sends no more to one task than any other. The filter has a fixed size and is
what is sent to the workers; the driver gets its bits. Prediction is one scan of every whole text, without a shuffle. Inputs are texts alone. Results:
``und`` with score 0 for a null text or one without a letter (str.isalpha), or when nothing was learned; ties go to the language whose name is
first; equal rows are learned once, and repeated rows repeat their result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batch, fold, ids_and_texts, in_slices, spark_schema

BITS = 20  # slots are 2^BITS
HASHES = 2
SIZES = (3, 4)
UND = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def ngrams(text: str) -> np.ndarray:
    """Hashes of the n-grams of SIZES code points of the lower-cased text, with runs of ASCII characters that are no
    letters as one border."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(code):
        return np.zeros(0, dtype=np.uint64)
    border = (code < 65) | ((code > 90) & (code < 97)) | ((code > 122) & (code < 170))
    code = np.where(border, np.uint32(32), code)
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = ~(border[1:] & border[:-1])
    code, border = code[keep].astype(np.uint64), border[keep]
    out = []
    with np.errstate(over="ignore"):
        h = code + np.uint64(1)
        for n in range(2, max(SIZES) + 1):
            h = h[:-1] * _ODD + code[n - 1 :] + np.uint64(1)
            if n in SIZES and len(h):
                mixed = (h ^ (h >> np.uint64(31))) * _MIX
                out.append(mixed ^ (mixed >> np.uint64(29)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << BITS) - 1)
    return [((hashes >> np.uint64(BITS * i)) & mask).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # words x 2^BITS of unsigned integers; bit j of word w is language width * w + j
    width: int
    chance: np.ndarray  # by language: how often an n-gram hits by chance

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Hits per language, less those expected by chance."""
        found = np.zeros(len(self.languages))
        at = slots(hashes)
        for w, words in enumerate(self.table):
            mask = words[at[0]]
            for more in at[1:]:
                mask = mask & words[more]
            for j in range(min(self.width, len(self.languages) - self.width * w)):
                found[self.width * w + j] = np.count_nonzero(mask & mask.dtype.type(1 << j))
        return (found - len(hashes) * self.chance) / (1 - self.chance)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UND, 0.0
        counts = np.maximum(self.counts(ngrams(text)), 0)
        total = counts.sum()
        if total <= 0:
            return self.languages[0], 0.0
        best = int(np.argmax(counts))
        return self.languages[best], float(min(1.0, counts[best] / total))


COUNTED = pa.schema([("lang", pa.string()), ("hash", pa.int64())])


FEW = 20
#: How many times ``per_language`` rows the threshold lets through, on average, to be ranked.
MARGIN = 4


def learn(docs: DataFrame, per_language: int = 1_000, least_share: float = 0.005) -> Filters:
    """``docs``: doc_id, text, lang. Learns from texts outside fold 0 with a language, at most ``per_language`` of each."""
    rows = ids_and_texts(docs, F.col("lang").cast("string").alias("lang")).where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    # one row a language; there are few, as each has 2^BITS bits on the driver
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    # the lowest MARGIN * per_language / rows of all hashes
    near = F.col("h") / 2.0**64 + 0.5 <= F.lit(float(MARGIN * per_language)) / F.col("rows")
    thinned = rows.join(F.broadcast(counts), "lang").where(near)
    each = thinned.groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text"))
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= per_language)
    scratch = Scratch(docs.sparkSession, "languages")
    chosen = scratch.save(ranked.select("lang", "text"), "chosen")
    sampled = chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("sampled"))

    def run(batches):
        for b in in_slices(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                found = np.unique(ngrams(text)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found)], schema=COUNTED)

    grams = chosen.mapInArrow(run, spark_schema(COUNTED)).groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("texts"))
    least = F.when(F.col("sampled") < FEW, 1).otherwise(F.greatest(F.lit(2), F.ceil(F.col("sampled") * least_share)))
    kept = grams.join(F.broadcast(sampled), "lang").where(F.col("texts") >= least)
    mask = (1 << BITS) - 1
    slot = F.explode(F.array(*(F.shiftrightunsigned("hash", BITS * i).bitwiseAND(mask) for i in range(HASHES))))
    bits = kept.select("lang", slot.alias("slot")).groupBy("lang", F.shiftright("slot", 6).alias("word"))
    found = bits.agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toPandas()  # at most 2^BITS / 64 rows a language
    scratch.drop("chosen")
    names = sorted(found["lang"].unique().tolist())
    width = 8 if len(names) <= 8 else 64
    table = np.zeros((max(1, -(-len(names) // width)), 1 << BITS), dtype=f"u{width // 8}")
    chance = np.zeros(len(names))
    for i, name in enumerate(names):
        own = np.zeros(1 << BITS - 6, dtype=np.int64)
        mine = found[found["lang"] == name]
        own[mine["word"].to_numpy()] = mine["bits"].to_numpy()
        own = np.unpackbits(own.view(np.uint8), bitorder="little").astype(bool)
        table[i // width][own] |= table.dtype.type(1 << (i % width))
        chance[i] = min(0.999, float(own.mean()) ** HASHES)
    return Filters(names, table, width, chance)


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""

    def run(batches):
        for b in in_slices(batches):
            found = [filters.predict(t) for t in b.column("text").to_pylist()]
            yield batch(OUT, doc_id=b.column("doc_id"), held_out=b.column("held_out"), lang_pred=[x for x, _ in found], score=[x for _, x in found])

    return ids_and_texts(docs, (fold(F.col("doc_id")) == 0).alias("held_out")).mapInArrow(run, spark_schema(OUT))
