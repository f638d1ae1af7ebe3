"""Toxicity by class-conditional Kneser-Ney models of word pairs, with spelling backoff.

One model for toxic and one for ordinary rows, each of three levels, each interpolated with the next by what its discounts leave:

1. a word after the word before it (or a text's start): its count in the class;
2. a word alone: the number of different words before it in the class, then, for words of the labelled rows, a discounted share
   alike for all (without it, a number met once would tell as much as a word that a class uses again and again);
3. its spelling: a Kneser-Ney model of up to ORDER bytes over the different words of the class, whose lower orders use continuation
   counts and whose lowest one both classes share. So a new form of a known stem is judged by its parts.

All numbers of different words before are exact. A text is judged by the mean over its words of the difference of the two
log-likelihoods, and by the root of the mean over those words whose own difference (levels 2 and 3) is above a cut; curve, cut,
folds, ties, nulls and the results without words or without both classes are those of ``toxicity``.

Everything is counted over all labelled rows outside fold 0. Nothing travels as a row of one word or pair: a slice of texts (about
SLICE characters) makes sorted, compressed arrays, a row for each bucket (of the first word) or group (of hashes of words). Words have
numbers: the ``head`` most frequent ones their place, which compresses well, all others 63 bits of a hash; the second word of a pair
has 40 of them where texts are looked up. The number of buckets follows the bytes of all texts, so a bucket's pairs fit a worker, which
reads the slices' rows one after the other.

Each text is split once when it is scored. The texts go in PASSES queries, shared out by a hash of the row, so that one share's
shuffle is on disk at a time; sums come back as one array a slice and task. The texts of the curve are looked up in the early
models' tables as these are made; only the final ones are written. The driver gets rows of sums, the ``head`` most frequent words and the
byte n-grams, whose number follows the alphabets and not the rows. A spelling alone tells at most SPELT.
"""

from __future__ import annotations

import itertools
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, fold, ids_and_texts, in_slices, spark_schema
from .toxicity import CUTS, UNIT, Level, blanked, discounts, features, fit_logistic

DISCOUNT = 0.75
ORDER = 4
#: Bytes that stand before and after a word.
_BEFORE, _AFTER = 1, 2
#: Most that a spelling tells of a word that no count knows (difference of logarithms).
SPELT = 10.0
PASSES, TASKS = 3, 24
#: Bytes of text for each bucket and for each group of words, and characters of a slice.
BUCKET_BYTES, GROUP_BYTES, SLICE = 12 << 20, 512 << 20, 4 << 20
#: Most labelled rows that are broadcast. Beyond that, texts meet their labels by a shuffle, once, and are saved.
LABELS = 1_000_000


# ---- spelling ------------------------------------------------------------------------------------------------------------


def _grams(words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Packed byte n-grams of spelt words: by order 0 to ORDER, one number for each spelt byte (and the end of the word), made
    of that byte and those before it; and where each word begins. Order 0 is the empty context, always 0."""
    raw = np.frombuffer(b"".join(bytes([_BEFORE]) * ORDER + w + bytes([_AFTER]) for w in words), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    ends = np.cumsum(sizes + ORDER)
    spelt = np.ones(len(raw), dtype=bool)
    spelt[((ends - sizes - ORDER)[:, None] + np.arange(ORDER)).ravel()] = False
    at = np.flatnonzero(spelt)
    out, code = [np.zeros(len(at), dtype=np.uint64)], np.zeros(len(at), dtype=np.uint64)
    for k in range(ORDER):
        code = code | raw[at - k] << np.uint64(8 * k)
        out.append(code)
    return out, np.cumsum(sizes) - sizes


class Spelling:
    """Interpolated Kneser-Ney models of both classes over the bytes of words."""

    def __init__(self, keys: np.ndarray, total: np.ndarray) -> None:
        """``keys``: the n-grams of ORDER bytes, ascending; ``total``: 2 x keys, their counts."""
        self.keys: list[np.ndarray] = []
        self.p: list[np.ndarray] = []  # by order: 2 x grams, discounted
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []  # by order: contexts, and 2 x contexts weight of the order below
        levels = [(keys, total)]
        for k in range(ORDER - 1, 0, -1):  # how many different bytes come before
            above, above_n = levels[-1]
            keys, inverse = np.unique(above & np.uint64((1 << 8 * k) - 1), return_inverse=True)
            levels.append((keys, np.stack([np.bincount(inverse, weights=x > 0, minlength=len(keys)) for x in above_n])))
        for keys, total in reversed(levels):
            contexts, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
            after = np.stack([np.bincount(inverse, weights=x, minlength=len(contexts)) for x in total])
            kinds = np.stack([np.bincount(inverse, weights=x > 0, minlength=len(contexts)) for x in total])
            self.keys.append(keys)
            self.p.append(np.maximum(total - DISCOUNT, 0) / np.maximum(after, 1)[:, inverse])
            self.rest.append((contexts, np.where(after > 0, DISCOUNT * kinds / np.maximum(after, 1), 1.0)))
        _, total = levels[-1]
        shared = np.full(256, 0.5)
        shared[levels[-1][0].astype(np.int64)] += total.sum(axis=0)
        self.shared = shared / shared.sum()

    def logs(self, words: list[bytes]) -> np.ndarray:
        """2 x words: log probabilities."""
        grams, starts = _grams(words)
        p = np.tile(self.shared[(grams[1] & np.uint64(255)).astype(np.int64)], (2, 1))
        for k in range(ORDER):
            gram, (contexts, rest) = grams[k + 1], self.rest[k]
            at = np.minimum(np.searchsorted(contexts, gram >> np.uint64(8)), len(contexts) - 1)
            p = np.where(contexts[at] == gram >> np.uint64(8), rest[:, at] * p, p)
            keys = self.keys[k]
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            p += np.where(keys[at] == gram, self.p[k][:, at], 0)
        return np.add.reduceat(np.log(p), starts, axis=1) if words else np.zeros((2, 0))


def models_of(n: np.ndarray) -> np.ndarray:
    """Counts of folds 1 to 3 and of fold 4 by class (4 x any) as those of the early and the late models."""
    return np.concatenate([n[:2], n[:2] + n[2:]])


# ---- arrays and slices ---------------------------------------------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Compressed by planes of bytes, so that what neighbours have in common takes little."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(b: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(b[8:], n * size, "zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


def split(raw: bytes) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words between blanks, and where each begins."""
    letters = np.frombuffer(raw, dtype=np.uint8)
    spelt = letters != 32
    edges = np.flatnonzero(np.diff(spelt, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters[spelt])]), starts


def pack_words(words) -> bytes:
    raw = b" ".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack_words(b: bytes) -> pa.LargeBinaryArray:
    return split(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True))[0]


#: Set in the numbers of all words but the most frequent ones.
_FAR = np.uint64(1 << 63)


def hashes(words: list[bytes]) -> np.ndarray:
    """63 bits of SipHash, and _FAR."""
    return hash_array(np.array(words, dtype=object), categorize=False) | _FAR if words else np.zeros(0, dtype=np.uint64)


class Names:
    """Numbers of words: 0 of a text's start, small ones of the most frequent words, in order, and hashes of all others."""

    def __init__(self, head: list[bytes], groups: int) -> None:
        self.head, self.groups = [b"", *head], groups

    @cached_property
    def places(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.head)}

    @cached_property
    def head_groups(self) -> np.ndarray:
        return (hashes(self.head) % np.uint64(self.groups)).astype(np.int64)

    def ids(self, words: list[bytes]) -> np.ndarray:
        near = np.array([self.places.get(w, -1) for w in words], dtype=np.int64)
        return np.where(near < 0, hashes(words), near.astype(np.uint64))

    def group(self, ids: np.ndarray) -> np.ndarray:
        """That of the words' hashes."""
        out, near = (ids % np.uint64(self.groups)).astype(np.int64), ids < _FAR
        out[near] = self.head_groups[ids[near].astype(np.int64)]
        return out


def short(ids: np.ndarray) -> np.ndarray:
    """What is left of the second word's name in a pair: the place of a frequent word, or 40 bits, and which of both."""
    return ids & np.uint64((1 << 40) - 1) | ids >> np.uint64(63) << np.uint64(40)


def slices(batches):
    """Batches (one or more) of about SLICE characters of text."""
    held, size = [], 0
    for b in batches:
        for part in in_slices([b]):
            held.append(part)
            size += part.column("text").nbytes
            if size >= SLICE:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def places(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The words met (the empty one, a text's start, first); by occurrence the word, the word before, and the text."""
    raws = [blanked(t) for t in texts]
    found, starts = split(b" ".join(raws))
    met = found.dictionary_encode()
    at = met.indices.to_numpy().astype(np.int64) + 1
    firsts = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in raws)]))
    sizes = np.diff(firsts)
    before = np.concatenate([[0], at])[:-1]
    before[firsts[:-1][sizes > 0]] = 0
    return [b"", *met.dictionary.to_pylist()], at, before, np.repeat(np.arange(len(texts)), sizes)


def ranks(order: np.ndarray) -> np.ndarray:
    """The inverse of an order."""
    out = np.empty_like(order)
    out[order] = np.arange(len(order))
    return out


def tally(*columns: np.ndarray) -> list[np.ndarray]:
    """Different rows of numbers from 0, ascending, and last how often each is there."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 63:
        order = np.lexsort(columns[::-1])
        rows = np.stack([c[order] for c in columns])
        first = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)]))
        return [*rows[:, first], np.diff(np.append(first, len(order)))]
    key = np.zeros(len(columns[0]), dtype=np.int64)
    for c, n in zip(columns, bits):
        key = key << n | c
    key.sort()
    first, times = runs(key)
    key, out = key[first], [times]
    for n in reversed(bits):
        out.insert(0, key & ((1 << n) - 1))
        key = key >> n
    return out


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal neighbours begin, and their lengths."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)
    return starts, np.diff(np.append(starts, len(x)))


def spans(x: np.ndarray):
    """Of ascending numbers: each, and the slice where it stands."""
    starts, sizes = runs(x)
    for k, s, n in zip(x[starts].tolist(), starts.tolist(), sizes.tolist()):
        yield k, slice(s, s + n)


def groups_of(batches, by: str = "bucket"):
    """Rows sorted by bucket: (bucket, its rows, read as they are asked for)."""
    return itertools.groupby((r for part in in_slices(batches, 8) for r in part.to_pylist()), key=lambda r: r[by])


def by_bucket(rows: DataFrame, *then: str) -> DataFrame:
    """In a fixed number of tasks, as a slice gets a row of sums from each."""
    return rows.repartition(TASKS, "bucket").sortWithinPartitions("bucket", *then)


def rows_of(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], type=f.type) for f in schema], schema=schema)


@contextmanager
def swept(spark: SparkSession):
    """Shuffle files go when the query that made them has ended; what later steps read is saved."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


# ---- counts of words -----------------------------------------------------------------------------------------------------

#: ``words`` and ``n`` (4 x words: folds 1 to 3, then fold 4, by class) of a group; ``sums``: of all, by class; ``steps``: how many
#: words there are by eighths of the logarithm of how often.
COUNTED = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("n", pa.binary()), ("sums", pa.list_(pa.int64())), ("steps", pa.list_(pa.int64()))])


def kinds(t: pa.Table) -> np.ndarray:
    return 2 * t.column("part").to_numpy().astype(np.int64) + t.column("toxic").to_numpy()


def steps(often: np.ndarray) -> np.ndarray:
    return np.floor(8 * np.log(often)).astype(np.int64)


def count_words(rows: DataFrame, groups: int) -> DataFrame:
    """``rows``: text, toxic, part. A row for each group (of hashes): its words and their counts."""

    def scan(batches):
        for t in slices(batches):
            words, at, _, of = places(t.column("text").to_pylist())
            n = np.bincount(kinds(t)[of] * len(words) + at, minlength=4 * len(words)).reshape(4, -1).astype(np.uint32)
            group = (hashes(words) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group[1:], kind="stable") + 1
            yield rows_of(COUNTED, [{"bucket": g, "words": pack_words(words[k] for k in order[s].tolist()), "n": pack(n[:, order[s]].ravel())} for g, s in spans(group[order])])

    def merge(batches):
        for g, rows in groups_of(batches):
            words, n = zip(*((unpack_words(r["words"]), unpack(r["n"], np.uint32).reshape(4, -1)) for r in rows))
            met, n = pa.chunked_array(words).combine_chunks().dictionary_encode(), np.concatenate(n, axis=1)
            total = np.stack([np.bincount(met.indices, weights=x, minlength=len(met.dictionary)) for x in n]).astype(np.int64)
            yield rows_of(COUNTED, [{"bucket": g, "words": pack_words(met.dictionary.to_pylist()), "n": pack(total.ravel()), "sums": total.sum(axis=1), "steps": np.bincount(steps(total.sum(axis=0)))}])

    return by_bucket(rows.mapInArrow(scan, spark_schema(COUNTED))).mapInArrow(merge, spark_schema(COUNTED))


def frequent(counted: DataFrame, head: int) -> list[bytes]:
    """The most frequent words by steps, as many as ``head`` has room for, in order."""
    found = [np.array(r.steps) for r in counted.select("steps").collect()]  # at most 350 numbers a group
    n = np.zeros(max(len(x) for x in found), dtype=np.int64)
    for x in found:
        n[: len(x)] += x
    fits = np.flatnonzero(np.cumsum(n[::-1])[::-1] <= head)
    least = fits[0] if len(fits) else len(n)

    def run(batches):
        for b in batches:
            for words, x in zip(b.column("words").to_pylist(), b.column("n").to_pylist()):
                often = unpack(x, np.int64).reshape(4, -1).sum(axis=0)
                top = steps(often) >= least
                yield pa.RecordBatch.from_arrays([unpack_words(words).filter(pa.array(top)).cast(pa.binary()), pa.array(often[top])], names=["word", "often"])

    top = counted.select("words", "n").mapInArrow(run, "word binary, often long").toPandas()
    return [w for _, w in sorted(zip((-top["often"]).tolist(), map(bytes, top["word"])))]


#: By models (early, late) and class.
_BEFORES = ("m0", "m1", "m2", "m3")
GRAMS = pa.schema([("gram", pa.int64()), *((c, pa.int64()) for c in _BEFORES)])


def count_grams(counted: DataFrame) -> DataFrame:
    """How often each n-gram of ORDER bytes is in the different words of a model."""

    def run(batches):
        for b in batches:
            for words, n in zip(b.column("words").to_pylist(), b.column("n").to_pylist()):
                words, has = unpack_words(words), models_of(unpack(n, np.int64).reshape(4, -1)) > 0
                for s in range(0, len(words), 50_000):
                    grams, starts = _grams(words[s : s + 50_000].to_pylist())
                    keys, inverse = np.unique(grams[ORDER], return_inverse=True)
                    sizes = np.diff(np.append(starts, len(inverse)))
                    yield batch(GRAMS, gram=keys.view(np.int64), **{c: np.bincount(inverse, weights=np.repeat(x[s : s + 50_000], sizes)).astype(np.int64) for c, x in zip(_BEFORES, has)})

    return counted.select("words", "n").mapInArrow(run, spark_schema(GRAMS)).groupBy("gram").agg(*(F.sum(c).alias(c) for c in _BEFORES))


# ---- counts of pairs -----------------------------------------------------------------------------------------------------

_SLICE = {"v": np.uint64, "follow": np.uint32, "w": np.uint64, "kind": np.uint8, "n": np.uint32}
SLICES = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in _SLICE)])
#: Of a bucket: its first words, how many pairs each has, the second words, and by pair the place of its own and counts (4 x pairs).
_PAIRS = {"v": np.uint64, "follow": np.uint32, "w": np.uint64, "place": np.uint32, "n": np.uint32}
LEARNED = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("stats", pa.list_(pa.int64())), *((c, pa.binary()) for c in (*_PAIRS, "ids", "m"))])
#: Pairs that are held before they are merged.
HELD = 4_000_000


def pair_slices(rows: DataFrame, buckets: int, names: Names) -> DataFrame:
    """``rows``: text, toxic, part. A row for each slice and bucket: its pairs by first word, with class, part and count."""

    def run(batches):
        for t in slices(batches):
            words, at, before, of = places(t.column("text").to_pylist())
            ids = names.ids(words)
            bucket = (ids % np.uint64(buckets)).astype(np.int64)
            firsts, seconds = np.lexsort((ids, bucket)), np.argsort(ids)
            v, w, kind, n = tally(ranks(firsts)[before], ranks(seconds)[at], kinds(t)[of])
            out = []
            for b, s in spans(bucket[firsts][v]):
                first, follow = runs(v[s])
                arrays = (ids[firsts][v[s][first]], follow, ids[seconds][w[s]], kind[s], n[s])
                out.append({"bucket": b} | {c: pack(x.astype(d)) for (c, d), x in zip(_SLICE.items(), arrays)})
            yield rows_of(SLICES, out)

    return rows.mapInArrow(run, spark_schema(SLICES))


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Different pairs by first and second word, and their counts (4 x pairs)."""
    v, w = (np.concatenate(x) for x in list(zip(*parts))[:2])
    n = np.concatenate([x[2] for x in parts], axis=1)
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
    return v[new], w[new], np.add.reduceat(n[:, order], new, axis=1)


def count_pairs(rows: DataFrame, buckets: int, names: Names) -> DataFrame:
    """A row for each bucket: its pairs, by first and second word, and their counts; ``stats`` has how many have the counts 1 to 4,
    by models and class. And a row for each bucket and group of words: the group's words that are second in the bucket (``ids``), and
    before each how many different words of the bucket stand (``m``: 4 x words)."""

    def run(batches):
        for bucket, rows in groups_of(batches):
            parts, size, most = [], 0, HELD
            for r in rows:
                v, follow, w, kind, n = (unpack(r[c], d) for c, d in _SLICE.items())
                counts = np.zeros((4, len(w)), dtype=np.uint32)
                counts[kind, np.arange(len(w))] = n
                parts.append((np.repeat(v, follow), w, counts))
                size += len(w)
                if size > most:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    most = max(HELD, 2 * size)
            v, w, counts = merged(parts)
            both = models_of(counts.astype(np.int64))
            first, follow = runs(v)
            second, place = np.unique(w, return_inverse=True)
            befores = np.stack([np.bincount(place, weights=x > 0, minlength=len(second)).astype(np.uint32) for x in both])
            arrays = (v[first], follow, second, place, counts.ravel())
            stats = [int((x == k).sum()) for x in both for k in range(1, 5)]
            out = [{"bucket": bucket, "stats": stats} | {c: pack(x.astype(d)) for (c, d), x in zip(_PAIRS.items(), arrays)}]
            group = names.group(second)
            order = np.argsort(group, kind="stable")
            for g, s in spans(group[order]):
                out.append({"bucket": bucket, "grp": g, "ids": pack(second[order[s]]), "m": pack(befores[:, order[s]].ravel())})
            yield rows_of(LEARNED, out)

    return by_bucket(pair_slices(rows, buckets, names)).mapInArrow(run, spark_schema(LEARNED))


# ---- probabilities of words ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Words:
    """Levels 2 and 3 of both classes; ``known``: how many words have counts."""

    classes: tuple[Level, Level]
    known: int
    spelling: Spelling

    def p(self, words: list[bytes], m: np.ndarray) -> np.ndarray:
        """2 x words; ``m``: 2 x words, how many different words stand before. Of a word without counts only the ratio tells."""
        low = (1 - DISCOUNT) / self.known + DISCOUNT * np.exp(np.maximum(logs := self.spelling.logs(words), -600))
        off = [np.array([0.0, *level.discount])[np.minimum(n, 3)] for level, n in zip(self.classes, m)]
        p = np.stack([np.maximum(n - d, 0) / level.total + level.rest * x for level, n, d, x in zip(self.classes, m, off, low)])
        return np.where(m.any(axis=0), p, np.exp([np.zeros(len(words)), self.spelt(logs)]))

    def spelt(self, logs: np.ndarray) -> np.ndarray:
        return np.clip(np.log(self.classes[1].rest / self.classes[0].rest) + logs[1] - logs[0], -SPELT, SPELT)

    def unseen(self, words: list[bytes]) -> np.ndarray:
        """The differences, in millionths, of words without counts."""
        return millionths(self.spelt(self.spelling.logs(words)))


def millionths(x: np.ndarray) -> np.ndarray:
    return np.round(UNIT * x).astype(np.int64)


#: Of a group: its words by number, ``m`` (4 x words), and ``stats``: by models and class the sum of ``m`` and how many are 1 to 4 and
#: 3 or more, then how many words the models know.
VOCABULARY = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("m", pa.binary()), ("stats", pa.list_(pa.int64()))])


def vocabulary_of(counted: DataFrame, learned: DataFrame, names: Names) -> DataFrame:
    """How many different words stand before each."""
    rows = counted.select("bucket", "words").unionByName(learned.where("grp IS NOT NULL").selectExpr("grp AS bucket", "ids", "m"), allowMissingColumns=True)

    def run(batches):
        for g, rows in groups_of(batches):
            words = unpack_words(next(rows)["words"]).to_pylist()
            ids = names.ids(words)
            order = np.argsort(ids)
            ids, m = ids[order], np.zeros((4, len(ids)), dtype=np.int64)
            for r in rows:
                m[:, np.searchsorted(ids, unpack(r["ids"], np.uint64))] += unpack(r["m"], np.uint32).reshape(4, -1)
            stats = [int(x) for y in m for x in (y.sum(), *((y == k).sum() for k in range(1, 5)), (y >= 3).sum())]
            yield rows_of(VOCABULARY, [{"bucket": g, "words": pack_words(words[k] for k in order.tolist()), "m": pack(m.ravel()), "stats": [*stats, int(m[:2].any(axis=0).sum()), len(ids)]}])

    return by_bucket(rows, F.expr("words IS NULL")).mapInArrow(run, spark_schema(VOCABULARY))


#: For a bucket: the probabilities (2 for each models x words) of the second words of group ``grp``; or what the ``ids`` tell by
#: themselves (models x words), which stand without a bucket for the most frequent words.
KNOWN = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("p", pa.binary()), ("ids", pa.binary()), ("own", pa.binary())])


def known_words(vocabulary: DataFrame, learned: DataFrame, models: list[Words], late: int, names: Names, buckets: int) -> DataFrame:
    """``models``: early and late ones, or (``late`` 0) late ones alone."""
    rows = vocabulary.select("bucket", "words", "m").unionByName(learned.where("grp IS NOT NULL").selectExpr("grp AS bucket", "bucket AS origin", "ids"), allowMissingColumns=True)

    def run(batches):
        for g, rows in groups_of(batches):
            own = next(rows)
            words, m = unpack_words(own["words"]).to_pylist(), unpack(own["m"], np.int64).reshape(4, -1)
            ids, p = names.ids(words), np.empty((2 * len(models), len(words)), dtype=np.float32)
            for s in (slice(k, k + 20_000) for k in range(0, len(words), 20_000)):
                for k, x in enumerate(models):
                    first = 2 * (k + 1 - late)
                    p[2 * k : 2 * k + 2, s] = x.p(words[s], m[first : first + 2, s])
            own = millionths(np.log(p[1::2].astype(float) / p[::2])).astype(np.int32)
            out = []
            for r in rows:
                out.append({"bucket": r["origin"], "grp": g, "p": pack(p[:, np.searchsorted(ids, unpack(r["ids"], np.uint64))].ravel())})
            near = np.searchsorted(ids, _FAR)
            out.append({"ids": pack(ids[:near]), "own": pack(own[:, :near].ravel())})
            bucket = (ids % np.uint64(buckets)).astype(np.int64)
            order = near + np.argsort(bucket[near:], kind="stable")
            out += [{"bucket": b, "ids": pack(ids[order[s]]), "own": pack(own[:, order[s]].ravel())} for b, s in spans(bucket[order])]
            yield rows_of(KNOWN, out)

    return by_bucket(rows, F.expr("words IS NULL")).mapInArrow(run, spark_schema(KNOWN))


# ---- texts ---------------------------------------------------------------------------------------------------------------

#: A bucket's numbers of words; the differences of these words (0 of the most frequent ones), what each tells of any word after it,
#: and by pair (place of the first word and 41 bits of the second) what is to be added to both.
_TABLE = {"ids": np.uint64, "own": np.int32, "after": np.int32, "keys": np.uint64, "pairs": np.int32}
_LOOK = {"wruns": np.uint32, "wtexts": np.uint32, "wtimes": np.uint32, "v": np.uint64, "follow": np.uint32, "seconds": np.uint64, "pruns": np.uint32, "ptexts": np.uint32, "ptimes": np.uint32}
#: Of a slice of texts (``uid``): the sums by cut and text, and once what the texts are.
TOLD = pa.schema([("uid", pa.int64()), ("docs", pa.int64()), ("sums", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n", pa.list_(pa.int64()))])
LOOKUPS = pa.schema([("bucket", pa.int32()), *TOLD, *((c, pa.binary()) for c in ("words", *_LOOK))])
TABLE = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in _TABLE)])


def lookups(rows: DataFrame, own: np.ndarray, names: Names, buckets: int, cuts: tuple[int, ...]) -> DataFrame:
    """``rows``: doc_id, held_out, text. For each slice, a row of the texts with the sums of the most frequent words' ``own``
    differences, and for each bucket a row of what is to be looked up there: other words and pairs, in how many texts each is, in
    which, and how often."""

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40  # rows keep their order within a task, so a repeated task names them alike
        for t in slices(batches):
            words, at, before, of = places(t.column("text").to_pylist())
            docs, ids = t.num_rows, names.ids(words)
            near = ids < _FAR
            gain = np.zeros(len(words), dtype=np.int64)
            gain[near] = own[ids[near].astype(np.int64)]
            gain = gain[at]
            sums = [np.bincount(of, weights=x, minlength=docs) for x in (gain, *(np.where(gain > k, gain, 0) for k in cuts))]
            about = {c: [t.column(c).to_pylist()] for c in ("doc_id", "held_out")} | {"n": [np.bincount(of, minlength=docs)]}
            out = {-1: {"bucket": hash(uid) % buckets, "sums": pack(np.concatenate(sums).astype(np.int64))} | {c: x[0] for c, x in about.items()}}
            bucket = (ids % np.uint64(buckets)).astype(np.int64)
            firsts, seconds = np.lexsort((ids, bucket)), np.argsort(ids)
            place, bucket = ranks(firsts), bucket[firsts]
            far = ~near[at]
            w, texts, times = tally(place[at[far]], of[far])
            for b, s in spans(bucket[w]):
                first, many = runs(w[s])
                arrays = (many, texts[s], times[s])
                out.setdefault(b, {}).update({"words": pack_words(words[k] for k in firsts[w[s][first]].tolist())} | {c: pack(x.astype(np.uint32)) for c, x in zip(_LOOK, arrays)})
            v, w, texts, times = tally(place[before], ranks(seconds)[at], of)
            for b, s in spans(bucket[v]):
                x, y = v[s], w[s]
                pair = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
                first, follow = runs(x[pair])
                arrays = (ids[firsts[x[pair][first]]], follow, short(ids[seconds[y[pair]]]), np.diff(np.append(pair, len(x))), texts[s], times[s])
                out.setdefault(b, {}).update({c: pack(a.astype(_LOOK[c])) for c, a in zip(list(_LOOK)[3:], arrays)})
            yield rows_of(LOOKUPS, [{"bucket": b, "uid": uid, "docs": docs} | x for b, x in out.items()])
            uid += 1

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, spark_schema(LOOKUPS))


class Sums:
    """Sums by slice of texts, from one bucket's table after the other."""

    def __init__(self, models: Words, cuts: tuple[int, ...]) -> None:
        self.models, self.cuts, self.held = models, cuts, {}

    def add(self, r: dict, table: list[np.ndarray]) -> None:
        ids, own, after, keys, pairs = table
        if r["uid"] not in self.held:
            self.held[r["uid"]] = np.zeros((1 + len(self.cuts), r["docs"]))
        to, docs = self.held[r["uid"]], r["docs"]

        def find(where, x):
            at = np.minimum(np.searchsorted(where, x), max(len(where) - 1, 0))
            return at, (where[at] == x if len(where) else np.zeros(len(x), dtype=bool))

        if r["words"] is not None:
            words = unpack_words(r["words"]).to_pylist()
            many, texts, times = (unpack(r[c], _LOOK[c]) for c in ("wruns", "wtexts", "wtimes"))
            at, known = find(ids, hashes(words))
            gain = np.zeros(len(words), dtype=np.int64)
            gain[known] = own[at[known]]
            new = np.flatnonzero(~known)
            gain[new] = self.models.unseen([words[k] for k in new.tolist()])
            gain = np.repeat(gain, many)
            for x, cut in zip(to, (None, *self.cuts)):
                x += np.bincount(texts, weights=(gain if cut is None else np.where(gain > cut, gain, 0)) * times, minlength=docs)
        if r["v"] is not None:
            v, follow, second, many, texts, times = (unpack(r[c], _LOOK[c]) for c in ("v", "follow", "seconds", "pruns", "ptexts", "ptimes"))
            at, known = find(ids, v)
            at, known = np.repeat(at, follow), np.repeat(known, follow)
            gain = np.zeros(len(second), dtype=np.int64)
            gain[known] = after[at[known]]
            place, met = find(keys, at.astype(np.uint64) << np.uint64(41) | second)
            met &= known
            gain[met] += pairs[place[met]]
            to[0] += np.bincount(texts, weights=np.repeat(gain, many) * times, minlength=docs)

    def told(self, least: int = 0) -> list[dict]:
        """What is held, if that are ``least`` numbers."""
        if sum(x.size for x in self.held.values()) < least:
            return []
        out = [{"uid": uid, "docs": x.shape[1], "sums": pack(x.astype(np.int64).ravel())} for uid, x in self.held.items()]
        self.held = {}
        return out


def gather(told: DataFrame, adds: list[str]) -> DataFrame:
    """A row for each text: doc_id, held_out, n, and the sums."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n", *adds))])

    def run(batches):
        for _, rows in groups_of(batches, "uid"):
            total, about = 0, None
            for r in rows:
                total = total + unpack(r["sums"], np.int64).reshape(len(adds), -1)
                about = about if r["doc_id"] is None else r
            yield batch(schema, **{c: about[c] for c in ("doc_id", "held_out", "n")} | dict(zip(adds, total)))

    return told.select(*TOLD.names).repartition(TASKS, "uid").sortWithinPartitions("uid").mapInArrow(run, spark_schema(schema))


# ---- differences by bucket -----------------------------------------------------------------------------------------------

JUDGED = pa.schema([*TABLE, *TOLD])


def differences(learned: DataFrame, known: DataFrame, asked: DataFrame, models: list[Words], off: list[list[float]], late: int, names: Names) -> DataFrame:
    """The late models' tables by bucket, and what the first of ``models`` tell of the texts ``asked``, with all CUTS. ``off``: the
    discounts of pairs by models and class."""
    rows = learned.where("v IS NOT NULL").select("bucket", *_PAIRS).unionByName(known.where("bucket IS NOT NULL").withColumnsRenamed({"ids": "known", "own": "known_own"}), allowMissingColumns=True)
    rows = rows.unionByName(asked.withColumnsRenamed({"v": "look_v", "follow": "look_follow", "n": "look_n"}), allowMissingColumns=True)
    renamed = {"v": "look_v", "follow": "look_follow", "n": "look_n"}

    def run(batches):
        sums = Sums(models[0], CUTS)
        for bucket, rows in groups_of(batches):
            held, ps, mine, gains, look = None, [], [np.zeros(0, dtype=np.uint64)], [np.zeros((len(models), 0), dtype=np.int32)], []
            for r in rows:
                if r["v"] is not None:
                    held = r
                elif r["p"] is not None:
                    ps.append(r)
                elif r["known"] is not None:
                    mine.append(unpack(r["known"], np.uint64))
                    gains.append(unpack(r["known_own"], np.int32).reshape(len(models), -1))
                else:
                    look.append({c: r[renamed.get(c, c)] for c in LOOKUPS.names})
            v, follow, w, place, n = (unpack(held[c], d) if held else np.zeros(0, dtype=d) for c, d in _PAIRS.items())
            p, group = np.empty((2 * len(models), len(w))), names.group(w)
            order = np.argsort(group, kind="stable")
            where = dict(spans(group[order]))
            for r in ps:
                p[:, order[where[r["grp"]]]] = unpack(r["p"], np.float32).reshape(2 * len(models), -1)
            mine, gains = np.concatenate(mine), np.concatenate(gains, axis=1)
            all_ids = np.union1d(mine, v)
            of, mine, firsts = np.repeat(np.arange(len(v)), follow), np.searchsorted(all_ids, mine), np.searchsorted(all_ids, v)
            keys = firsts[of].astype(np.uint64) << np.uint64(41) | short(w)[place]
            order = np.argsort(keys, kind="stable")
            counts = models_of(n.reshape(4, -1).astype(np.int64))
            out = []
            for k in range(len(models)):
                logs, rest, low = [], [], p[2 * k : 2 * k + 2, place]
                for c, one in enumerate(low, 2 * (k + 1 - late)):
                    x, total = counts[c], np.bincount(of, weights=counts[c], minlength=len(v))
                    less = np.array([0.0, *off[c]])[np.minimum(x, 3)]
                    rest.append(np.where(total > 0, np.bincount(of, weights=less, minlength=len(v)) / np.maximum(total, 1), 1.0))
                    logs.append(np.log((x - less) / np.maximum(total, 1)[of] + rest[-1][of] * one))
                lead = np.log(rest[1] / rest[0])
                add = millionths(logs[1] - logs[0] - lead[of] - np.log(low[1] / low[0])).astype(np.int32)
                told = np.zeros((2, len(all_ids)), dtype=np.int32)
                told[0, mine], told[1, firsts] = gains[k], millionths(lead)
                table = [all_ids, *told, keys[order], add[order]]
                if k == 0:
                    for r in look:
                        if r["doc_id"] is not None:
                            out.append({c: r[c] for c in TOLD.names})
                        else:
                            sums.add(r, table)
                if k == late:
                    out.append({"bucket": bucket} | {c: pack(x) for c, x in zip(_TABLE, table)})
            yield rows_of(JUDGED, out + sums.told(2_000_000))
        yield rows_of(JUDGED, sums.told())

    return by_bucket(rows).mapInArrow(run, spark_schema(JUDGED))


@dataclass
class Gains:
    """Differences: a written table by bucket, those of the most frequent words by number, and the models of words."""

    table: DataFrame
    own: np.ndarray
    names: Names
    words: Words
    buckets: int


def sums(rows: DataFrame, gains: Gains, cuts: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """``rows``: doc_id, held_out, text. A row for each: doc_id, held_out, n (words), total, and clear0, ... by cut: the sum of the
    differences, and of the words' own ones above the cut."""
    models = gains.words

    def look(batches):
        sums = Sums(models, cuts)
        for _, rows in groups_of(batches):
            table = [np.zeros(0, dtype=d) for d in _TABLE.values()]
            for r in rows:
                if r["uid"] is None:  # sorts first
                    table = [unpack(r[c], d) for c, d in _TABLE.items()]
                elif r["doc_id"] is not None:
                    yield rows_of(TOLD, [r])
                else:
                    sums.add(r, table)
                    if found := sums.told(2_000_000):
                        yield rows_of(TOLD, found)
        yield rows_of(TOLD, sums.told())

    adds, out = ["total", *(f"clear{k}" for k in range(len(cuts)))], []
    for share in range(PASSES):
        part = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(PASSES)) == share)
        found = lookups(part, gains.own, gains.names, gains.buckets, cuts).unionByName(gains.table, allowMissingColumns=True)
        told = by_bucket(found, "uid").mapInArrow(look, spark_schema(TOLD))
        with swept(rows.sparkSession):
            out.append(scratch.save(gather(told, adds), f"scored{share}"))
    return reduce(DataFrame.unionAll, out)


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

    def lowest(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", "toxic")

    spark, light = docs.sparkSession, ids_and_texts(docs)
    chosen = lowest(known.where("part = 1"), curve_rows)
    seen = chosen.agg(F.min("toxic"), F.max("toxic")).first()
    if seen[0] == seen[1]:  # no row, or rows of one class
        chosen = lowest(known.where("toxic = 1"), curve_rows // 2).unionAll(lowest(known.where("toxic = 0"), curve_rows // 2))

    size = light.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = 96 + size // BUCKET_BYTES, 96 + size // GROUP_BYTES
    few = known.count() <= LABELS
    rows = light.join(F.broadcast(known) if few else known, "doc_id").select("text", "toxic", "part")
    with swept(spark):
        if not few:
            rows = scratch.save(rows, "labelled")
        counted = scratch.save(count_words(rows, groups), "counted")
        totals = [sum(x) for x in zip(*(r.sums for r in counted.select("sums").collect()))] or [0] * 4  # 4 numbers a group
        if not totals[0] + totals[2] or not totals[1] + totals[3]:
            scratch.drop("counted", "labelled")
            return Model(float(chosen.agg(F.avg("toxic")).first()[0] or 0.0))
        names = Names(frequent(counted, head), groups)
        learned = scratch.save(count_pairs(rows, buckets, names), "learned")
        vocabulary = scratch.save(vocabulary_of(counted, learned, names), "vocabulary")
        grams = count_grams(counted).orderBy("gram").toPandas()
        scratch.drop("counted", "labelled")
        added = lambda table: [sum(x) for x in zip(*(r.stats for r in table.where("stats IS NOT NULL").select("stats").collect()))]
        off, r = added(learned), added(vocabulary)  # 16 numbers a bucket and 26 a group
        off = [discounts(off[4 * c : 4 * c + 4]) for c in range(4)]
        level = [Level.of(float(y[0]), y[1:5], y[5]) if y[0] else None for y in (r[6 * c : 6 * c + 6] for c in range(4))]
        keys, n = grams["gram"].to_numpy(dtype=np.int64).view(np.uint64), grams[list(_BEFORES)].to_numpy(dtype=float).T
        order = np.argsort(keys)
        models = [Words((level[2], level[3]), r[25], Spelling(keys[order], n[2:][:, order]))]
        late = int(bool(level[0] and level[1]))  # else the curve sees the final models
        if late:
            models.insert(0, Words((level[0], level[1]), r[24], Spelling(keys[order], n[:2][:, order])))
        words = scratch.save(known_words(vocabulary, learned, models, late, names, buckets), "words")
        own = np.zeros((len(models), len(names.head)), dtype=np.int64)
        for x in words.where("bucket IS NULL").select("ids", "own").collect():  # at most ``head`` words
            own[:, unpack(x.ids, np.uint64).astype(np.int64)] = unpack(x.own, np.int32).reshape(len(models), -1)
        scratch.drop("vocabulary")
        sample = light.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.lit(False).alias("held_out"))  # at most curve_rows ids
        judged = scratch.save(differences(learned, words, lookups(sample, own[0], names, buckets, CUTS), models, off, late, names), "gains")
        scratch.drop("learned", "words")
        judge = Gains(judged.where("keys IS NOT NULL").select("bucket", *_TABLE), own[-1], names, models[-1], buckets)
        made = gather(judged.where("uid IS NOT NULL"), ["total", *(f"clear{k}" for k in range(len(CUTS)))]).where("n > 0")
        columns = [f.alias(f"f{k}_{i}") for k in range(len(CUTS)) for i, f in enumerate(features(f"clear{k}"))]
        means = made.select("doc_id", *columns).groupBy("doc_id").agg(*(F.avg(c).alias(c) for k in range(len(CUTS)) for c in (f"f{k}_0", f"f{k}_1")))
        shown = chosen.join(means, "doc_id", "left").orderBy("doc_id").toPandas()
    model = Model(float(shown["toxic"].mean()), judge)
    shown = shown.dropna()
    if len(shown):
        y = shown["toxic"].to_numpy(dtype=float)
        fits = [fit_logistic(shown[[f"f{k}_0", f"f{k}_1"]].to_numpy(dtype=float), y) for k in range(len(CUTS))]
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
        judged = sums(rows, model.gains, (model.cut,), scratch).select("doc_id", "held_out", F.when(F.col("n") > 0, curve).otherwise(share).alias("score"))
    return judged.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
