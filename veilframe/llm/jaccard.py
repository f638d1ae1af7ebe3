"""Exact n-gram Jaccard self-join by signature trees, and its connected components.

Documents are classes of equal shingle sets (5 words, A-Z lower-cased); two classes link when 100 * intersection >= 80 * union.

1. Each class has a bitmap over its shingles, wider for larger sets, and a prefix: its n - ceil(0.8 n) + 1 first shingles in one global
   order. Two classes that link share a prefix shingle, whatever the order is. Shingles that are common in a bounded sample of
   documents come last in it, so passages that many documents share seldom make classes meet; the sample decides cost, not results.
2. Prefix entries of shingles that only one class has are dropped.
3. Star round: each class is compared with the most central of the classes that it meets, and links are merged into components.
4. For each shingle whose classes are not all of one component, a signature tree is built over its classes: nodes hold the OR
   and the AND of their bitmaps, the range of sizes, and the component if it is one. A dual traversal of the tree with itself
   drops node pairs whose largest possible overlap is too small, or that are of one component; what reaches the leaves is
   compared exactly, shingle by shingle. Shingles with more than BLOCK classes are cut into blocks of classes of like size, and pairs of blocks
   whose sizes allow a link are traversed by different tasks.
5. Components by alternating large-star and small-star steps over written tables.

Nothing is capped: the tree only drops pairs that cannot link, or whose link changes no component. Equal sets are classes, told apart
by 128-bit hashes of their sets: a class is named by 64 bits of it, and by others as well where two classes would have one name
(see ``named_apart``). Shingles are 64-bit hashes of their words; that two of one document, or of a pair compared, fall together
has odds of their number squared / 2^65.
Copies of a class are dropped in each block before the shuffle. Results: null, empty and blank texts have no shingle, size 0,
and link with nothing; fewer than five words make one shingle; rows of equal id are one document's rows and get the component
of each row's text; null ids count as the largest id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, ids_and_texts, in_slices, only, spark_schema

WIDTH = 5
#: Similarity as a fraction: 4 / 5.
NUM, DEN = 4, 5
#: Least bits of a bitmap; a larger set has the power of two of at least four times its size.
LEAST_BITS = 1024
#: Most bits of a bitmap in the nodes of a tree; pairs that leave a tree are compared by their whole bitmaps.
MOST_BITS = 2048
BLOCK = 512
LEAF = 8

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; remembers the hashes of words."""

    KEEP = 100_000

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        ws = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not ws:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > self.KEEP:
            self.known.clear()
        known = self.known
        for w in set(ws).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, ws), dtype=np.uint64, count=len(ws))
        n = min(WIDTH, len(ws))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                out = _mix(out * _A + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def class_of(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set; of the first, only so many bits."""
    raw = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True) >> (64 - bits), int.from_bytes(raw[8:], "little", signed=True)


def bitmap(shingles: np.ndarray) -> bytes:
    width = max(LEAST_BITS, 1 << (4 * len(shingles) - 1).bit_length())
    bits = np.zeros(width, dtype=bool)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bitmaps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of ``width`` bits: wider ones are halved, ORing the halves, which is the bitmap of that width."""
    out = np.zeros((len(bitmaps), width // 64), dtype=np.uint64)
    for i, b in enumerate(bitmaps):
        words = np.frombuffer(b, dtype=np.uint64)
        out[i] = words if len(words) == width // 64 else np.bitwise_or.reduce(words.reshape(-1, width // 64), axis=0)
    return out


def signature(wide: bytes) -> bytes:
    """A bitmap as the trees hold it: of at most MOST_BITS bits."""
    return wide if len(wide) * 8 <= MOST_BITS else folded([wide], MOST_BITS).tobytes()


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def least_overlap(total: np.ndarray) -> np.ndarray:
    """The least intersection of two sets of ``total`` elements together that link: i >= NUM / (NUM + DEN) * total."""
    return -(-NUM * total // (NUM + DEN))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


# ---- signature trees -----------------------------------------------------------------------------------------------------


class SignatureTree:
    """Levels of nodes over classes ordered by size, then bitmap; level 0 holds the classes themselves."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, parts: np.ndarray) -> None:
        """bits: classes x words of uint64; parts: component of each class."""
        self.order = np.lexsort((bits[:, 0], sizes))
        n, b, p = sizes[self.order], bits[self.order], parts[self.order]
        self.levels = [(n, n, b, b, p)]  # least and greatest size, OR, AND, component or 0 with the flag below
        self.single = [np.ones(len(n), dtype=bool)]
        while len(self.levels[-1][0]) > 1:
            low, high, any_, all_, part = self.levels[-1]
            starts = np.arange(0, len(low), LEAF)
            one = np.minimum.reduceat(part, starts) == np.maximum.reduceat(part, starts)
            one &= np.logical_and.reduceat(self.single[-1], starts)
            self.levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.bitwise_or.reduceat(any_, starts, axis=0), np.bitwise_and.reduceat(all_, starts, axis=0), np.minimum.reduceat(part, starts)))
            self.single.append(one)

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray, other: SignatureTree) -> np.ndarray:
        """Whether some class below node i and some class below the other tree's node j, of different components, may link."""
        low_i, high_i, any_i, all_i, part_i = (x[i] for x in self.levels[level])
        low_j, high_j, any_j, all_j, part_j = (x[j] for x in other.levels[level])
        ok = ~(self.single[level][i] & other.single[level][j] & (part_i == part_j))
        ok &= (DEN * high_i >= NUM * low_j) & (DEN * high_j >= NUM * low_i)
        at = np.flatnonzero(ok)
        # shingles of a class whose bits no class of the other node has cannot be shared
        most = np.minimum(high_i[at] - popcount(all_i[at] & ~any_j[at]), high_j[at] - popcount(all_j[at] & ~any_i[at]))
        ok[at] = most >= least_overlap(low_i[at] + low_j[at])
        return ok

    def pairs(self, other: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
        """Indices of classes of both trees that may link; with itself, each pair once."""
        same = other is self
        depth = max(len(self.levels), len(other.levels))
        for tree in (self, other):
            while len(tree.levels) < depth:
                tree.levels.append(tree.levels[-1])
                tree.single.append(tree.single[-1])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(depth - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > 1 << 14:  # bounded memory
                stack += [(level, i[k : k + (1 << 14)], j[k : k + (1 << 14)]) for k in range(0, len(i), 1 << 14)]
                continue
            ok = self._possible(level, i, j, other)
            if level == 0 and same:
                ok &= i != j
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level == 0:
                found.append((i, j))
                continue
            below_i, below_j = len(self.levels[level - 1][0]), len(other.levels[level - 1][0])
            flat_i, flat_j = below_i == len(self.levels[level][0]), below_j == len(other.levels[level][0])
            kids_i = i[:, None] if flat_i else i[:, None] * LEAF + np.arange(LEAF)
            kids_j = j[:, None] if flat_j else j[:, None] * LEAF + np.arange(LEAF)
            a = np.repeat(kids_i, kids_j.shape[1], axis=1).ravel()
            b = np.tile(kids_j, (1, kids_i.shape[1])).ravel()
            ok = (a < below_i) & (b < below_j)
            if same:
                ok &= a <= b
            stack.append((level - 1, a[ok], b[ok]))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        i, j = (np.concatenate(x) for x in zip(*found))
        return self.order[i], other.order[j]


# ---- classes and prefixes ------------------------------------------------------------------------------------------------

SETS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("cls2", pa.int64()), ("bits", pa.binary()), ("sign", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def common_shingles(docs: DataFrame, scratch: Scratch, sample_docs: int = 20_000, most: int = 150_000) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most ``most`` and of at least two documents, of a sample of about ``sample_docs``: their
    hashes, ascending, and how many documents have each. They only order the prefixes, so no bound changes any result."""
    light = ids_and_texts(docs)
    total = light.select("doc_id").count()
    sample = light.sample(min(1.0, sample_docs / total), seed=3) if total else light
    out = pa.schema([("shingle", pa.int64())])

    def run(batches):
        shingler = only("shingler", Shingler)
        for b in in_slices(batches):
            for t in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingler(t).view(np.int64))], schema=out)

    counts = scratch.save(sample.mapInArrow(run, spark_schema(out)).groupBy("shingle").count().where("count >= 2"), "sampled")
    least, left = 2, most
    for r in counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).collect():  # a row for each frequency
        left -= r["n"]
        if left < 0:
            least = r["count"] + 1
            break
    found = counts.where(F.col("count") >= least).toPandas()
    shingles, n = found["shingle"].to_numpy(dtype=np.int64).view(np.uint64), found["count"].to_numpy(dtype=np.int64)
    order = np.argsort(shingles)
    return shingles[order], n[order]


def mark_of(docs: DataFrame) -> Column:
    """A 64-bit hash of a row's text; with the id it tells rows of different texts apart."""
    return F.xxhash64(docs["text"].cast("string")).alias("mark")


def shingle_sets(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], name_bits: int = 64) -> DataFrame:
    """A row for each row of ``docs``: doc_id, mark (a hash of its text), n, both hashes of its class (null without words), and bitmap
    and prefix where the block meets the class first."""

    known, often = common

    def run(batches):
        shingler = only("shingler", Shingler)
        for b in in_slices(batches):
            rows: dict[str, list] = {f: [] for f in SETS.names}
            met: set[tuple] = set()
            for doc_id, mark, text in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), b.column("text").to_pylist()):
                s = shingler(text)
                cls, cls2 = class_of(s, name_bits) if len(s) else (None, None)
                first = cls is not None and (cls, cls2) not in met
                if first:
                    met.add((cls, cls2))
                    wide = bitmap(s)
                    prefix = s
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        # rare ones first, then by how common they are, each by hash
                        prefix = s[np.argsort(np.where(known[at] == s, often[at], 0), kind="stable")]
                    prefix = prefix[: prefix_length(len(s))].view(np.int64)
                else:
                    wide = None
                for name, value in zip(SETS.names, (doc_id, mark, len(s), cls, cls2, wide, signature(wide) if first else None, prefix if first else None)):
                    rows[name].append(value)
            yield batch(SETS, **rows)

    return ids_and_texts(docs, mark_of(docs)).mapInArrow(run, spark_schema(SETS))


def named_apart(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``sets`` with one name, cls, for each class: where classes share the first hash, it is both hashes exclusive-or."""
    hashes = sets.where("cls IS NOT NULL").groupBy("cls").agg(F.min("cls2").alias("lo"), F.max("cls2").alias("hi"))
    shared = scratch.save(hashes.where("lo < hi").select(F.col("cls").alias("shared")), "shared")
    n = shared.count()  # among 5 * 10^10 classes, 70 to be expected
    if not n:
        return sets.drop("cls2")
    joined = sets.join(F.broadcast(shared) if n <= 1_000_000 else shared, F.col("cls") == F.col("shared"), "left")
    name = F.when(F.col("shared").isNull(), F.col("cls")).otherwise(F.col("cls").bitwiseXOR(F.col("cls2")))
    return joined.withColumn("cls", name).drop("cls2", "shared")


PAYLOAD = pa.schema([("cls", pa.int64()), ("shingles", pa.binary())])


def payloads(docs: DataFrame, representatives: DataFrame, name_bits: int = 64) -> DataFrame:
    """The whole sets of classes; ``representatives``: cls, rep (an id whose rows include the class's text)."""

    def run(batches):
        shingler = only("shingler", Shingler)
        for b in in_slices(batches):
            rows = []
            for cls, text in zip(b.column("cls").to_pylist(), b.column("text").to_pylist()):
                s = shingler(text)
                if len(s):
                    one, two = class_of(s, name_bits)
                    if cls in (one, one ^ two):
                        rows.append((cls, s.tobytes()))
            yield batch(PAYLOAD, cls=[r[0] for r in rows], shingles=[r[1] for r in rows])

    n = representatives.count()
    side = F.broadcast(representatives) if n <= 1_000_000 else representatives  # checked; beyond it, by shuffle
    light = ids_and_texts(docs).withColumn("rep", F.coalesce("doc_id", F.lit(NO_ID)))
    return light.join(side, "rep").select("cls", "text").mapInArrow(run, spark_schema(PAYLOAD)).dropDuplicates(["cls"])


NO_ID = (1 << 63) - 1

LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that link, by comparing whole sets (``sets``: cls, shingles)."""

    def run(batches):
        for whole in batches:
            for b in in_slices([whole], 128):
                kept = []
                for k, (x, y) in enumerate(zip(b.column("left").to_pylist(), b.column("right").to_pylist())):
                    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if DEN * both >= NUM * (len(x) + len(y) - both):
                        kept.append(k)
                yield b.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, spark_schema(LINKS))


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``links``: a, b. The smallest class reachable from each class that has a link: cls, comp."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), f"{name}-0")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("cls"), F.col("v").alias("comp"))
    step, last = 0, None
    while True:
        # large star: every larger neighbour of u to u's smallest neighbour
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        step += 1
        after = scratch.save(new, f"{name}-{step}")
        # done when no step changes the edges, which are distinct on both sides
        print_of = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        scratch.drop(f"{name}-{step - 1}")
        edges, same, last = after, print_of == last, print_of
        if same:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("comp"))


def leaf_pairs(members: DataFrame) -> DataFrame:
    """``members``: key, cls, comp, n of shingles with at most LEAF classes, each key in one partition, in order. The pairs
    (a, b) that sizes and components allow: a whole tree of one leaf."""

    def pairs(key, cls, comp, n):
        out = []
        for k in range(1, LEAF):
            if len(key) <= k:
                break
            ok = (key[k:] == key[:-k]) & (comp[k:] != comp[:-k])
            ok &= (DEN * n[k:] >= NUM * n[:-k]) & (DEN * n[:-k] >= NUM * n[k:])
            at = np.flatnonzero(ok)
            out.append(np.stack([np.minimum(cls[at], cls[at + k]), np.maximum(cls[at], cls[at + k])], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.int64)

    def run(batches):
        rest = None
        for b in batches:
            columns = [b.column(c).to_numpy() for c in ("key", "cls", "comp", "n")]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns)]
            whole = columns[0] != columns[0][-1]  # the last key may go on in the next batch
            rest = [c[~whole] for c in columns]
            found = pairs(*(c[whole] for c in columns))
            yield batch(LINKS, a=found[:, 0], b=found[:, 1])
        if rest is not None:
            found = pairs(*rest)
            yield batch(LINKS, a=found[:, 0], b=found[:, 1])

    return members.mapInArrow(run, spark_schema(LINKS))


def tree_pairs(members: DataFrame) -> DataFrame:
    """``members``: key, bi, bj, blk, cls, comp, n, bits, in order of key, bi, bj. Pairs (a, b) that may link."""

    def traverse(blk, cls, comp, n, bits, found: set[tuple[int, int]]) -> None:
        _, part = np.unique(comp, return_inverse=True)
        width = np.array([8 * len(x) for x in bits])
        for w in np.unique(width).tolist():  # sets that link differ at most by one width
            own = np.flatnonzero((width == w) | (width == 2 * w))
            rows = folded([bits[i] for i in own], w)
            trees = []
            for x in np.unique(blk):
                at = np.flatnonzero(blk[own] == x)
                if len(at):
                    trees.append((own[at], SignatureTree(n[own][at], rows[at], part[own][at])))
            if len(trees) == 1 and blk.min() != blk.max():
                continue
            i, j = trees[0][1].pairs(trees[-1][1])
            a, b = cls[trees[0][0][i]], cls[trees[-1][0][j]]
            found.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))

    def run(batches):
        key, held, found = None, [], set()

        def close():
            if held and sum(len(h[1]) for h in held) > 1:
                traverse(*(np.concatenate([h[k] for h in held]) for k in range(4)), [x for h in held for x in h[4]], found)
            held.clear()

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("key", "bi", "bj"))))
            columns = [b.column(c).to_numpy() for c in ("blk", "cls", "comp", "n")]
            bits, at = b.column("bits").to_pylist(), 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != key:
                    close()
                    key = keys[at]
                held.append((*(c[at:end] for c in columns), bits[at:end]))
                at = end
            if len(found) > 50_000:
                yield batch(LINKS, a=[p[0] for p in found], b=[p[1] for p in found])
                found.clear()
        close()
        if found:
            yield batch(LINKS, a=[p[0] for p in found], b=[p[1] for p in found])

    return members.mapInArrow(run, spark_schema(LINKS))


#: Sizes of one band differ by less than this factor. Sizes that link differ by 1.25 at most, so they are of one band or of neighbours.
BAND = 1.3


def paired_blocks(members: DataFrame) -> DataFrame:
    """``members``: key, cls, comp, n, m. A row for each pair of blocks of a shingle that a class belongs to: key, bi, bj, blk, cls,
    comp, n. Shingles of at most BLOCK classes are one block; of others each band of sizes is cut into blocks by hash."""
    one = F.lit(0).cast("long")
    small = members.where(F.col("m") <= BLOCK).select("key", one.alias("bi"), one.alias("bj"), one.alias("blk"), "cls", "comp", "n")
    banded = members.where(F.col("m") > BLOCK).withColumn("band", F.floor(F.ln("n") / float(np.log(BAND))).cast("long"))
    counts = banded.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    # how many blocks the band below, the band itself and the band above have
    near = counts.select("key", F.explode(F.array(*(F.struct((F.col("band") + d).alias("band"), F.lit(-d).alias("side"), "blocks") for d in (-1, 0, 1)))).alias("x"))
    near = near.groupBy("key", "x.band").agg(*(F.coalesce(F.max(F.when(F.col("x.side") == d, F.col("x.blocks"))), F.lit(0)).alias(f"n{d + 1}") for d in (-1, 0, 1)))
    met = banded.join(near, ["key", "band"])
    code = lambda band, k: F.shiftleft(band, 32) + k

    def blocks_of(d: int) -> Column:
        listed = F.transform(F.sequence(F.lit(0), F.col(f"n{d + 1}") - 1), lambda k: code(F.col("band") + d, k))
        return F.when(F.col(f"n{d + 1}") > 0, listed).otherwise(F.array().cast("array<bigint>"))

    partners = F.flatten(F.array(*map(blocks_of, (-1, 0, 1))))
    own = code(F.col("band"), F.pmod(F.xxhash64("cls"), F.col("n1")))
    dealt = met.withColumn("blk", own).withColumn("other", F.explode(partners))
    return small.unionByName(dealt.select("key", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "cls", "comp", "n"))


def join(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles and component_id, a row for each row of ``docs``."""
    return placed_rows(docs, scratch).select("doc_id", "n_shingles", "component_id")


def placed_rows(docs: DataFrame, scratch: Scratch, name_bits: int = 64) -> DataFrame:
    """A row for each row of ``docs``: doc_id, mark, n_shingles, component_id, and comp, which names the component even where
    components share ids; null without words. ``name_bits``: of the first hash, for tests."""
    sets = named_apart(scratch.save(shingle_sets(docs, common_shingles(docs, scratch), name_bits), "sets"), scratch)

    # entries of prefixes that meet another class. What is known of a shingle is written down before it is joined to its entries:
    # both sides are plain exchanges then, and Spark can split a shingle that very many classes hold
    entries = sets.where("prefix IS NOT NULL").select(F.explode("prefix").alias("key"), "cls")
    met = scratch.save(entries.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key"), "met")
    entered = scratch.save(entries.join(met, "key", "left_semi").distinct(), "entered")
    sets_only = scratch.save(sets.drop("prefix"), "sets-only")
    scratch.drop("sets", "met")
    sets = sets_only
    many = scratch.save(entered.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "many")
    live = scratch.save(entered.join(many, "key"), "live")
    scratch.drop("entered", "many")

    named = sets.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("rep"))
    central = scratch.save(live.groupBy("cls").agg(F.sum("m").alias("degree")), "central")
    info = scratch.save(sets.where("bits IS NOT NULL").join(central.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.max("n").alias("n"), F.max("bits").alias("bits"), F.max("sign").alias("sign")), "info")

    # star round
    ranked = live.join(central, "cls").select("key", "cls", F.struct("degree", "cls").alias("r"))
    centre = scratch.save(ranked.groupBy("key").agg(F.max("r").alias("top")), "centre")
    stars = ranked.join(centre, "key").where("top.cls <> cls").groupBy("cls").agg(F.max("top").alias("top")).select(F.least("cls", "top.cls").alias("a"), F.greatest("cls", "top.cls").alias("b")).distinct()
    star_links = verified(scratch.save(plausible(stars, info), "star-pairs"), docs, named, scratch, "stars", name_bits)
    comp = scratch.save(components(star_links, scratch, "c1"), "comp1")

    # signature trees over what is left
    parted = live.join(comp, "cls", "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"))
    mixed = scratch.save(parted.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("key", "m"), "mixed")
    members = parted.join(mixed, "key").join(info.select("cls", "n"), "cls")
    leaves = members.where(F.col("m") <= LEAF).select("key", "cls", "comp", "n").repartition("key").sortWithinPartitions("key")
    from_leaves = scratch.save(leaf_pairs(leaves).distinct(), "leaf-pairs")
    larger = paired_blocks(members.where(F.col("m") > LEAF))
    grouped = larger.join(info.select("cls", F.col("sign").alias("bits")), "cls").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    from_trees = scratch.save(tree_pairs(grouped).distinct(), "tree-pairs")
    candidates = scratch.save(plausible(from_leaves.unionAll(from_trees).distinct(), info), "candidates")
    links = verified(candidates, docs, named, scratch, "links", name_bits).unionAll(star_links)
    comp = scratch.save(components(links, scratch, "c2"), "comp2")

    # the smallest id of each component, back to the rows; written, so that joins by a large component or class can be split
    classes = scratch.save(named.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "classes")
    smallest = scratch.save(classes.groupBy("comp").agg(F.min("rep").alias("component_id")), "smallest")
    placed = scratch.save(classes.join(smallest, "comp").select(F.col("cls").alias("c"), "comp", "component_id"), "placed")
    scratch.drop("sampled", "live", "centre", "mixed", "central", "info", "star-pairs", "stars", "leaf-pairs", "tree-pairs", "candidates", "links", "classes", "smallest")
    rows = sets.select("doc_id", "mark", F.col("n").alias("n_shingles"), "cls")
    joined = rows.where("cls IS NOT NULL").join(placed, F.col("cls") == F.col("c")).select("doc_id", "mark", "n_shingles", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"), "comp")
    return joined.unionAll(rows.where("cls IS NULL").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("comp")))


def plausible(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and bitmaps do not exclude; ``info``: cls, n, bits."""

    def run(batches):
        for b in in_slices(batches, 2048):
            n, m = (b.column(c).to_numpy() for c in ("na", "nb"))
            most = np.minimum(n, m)
            xs, ys = b.column("xa").to_pylist(), b.column("xb").to_pylist()
            widths = np.array([8 * min(len(x), len(y)) for x, y in zip(xs, ys)])
            for w in np.unique(widths).tolist():
                at = np.flatnonzero(widths == w)
                x, y = (folded([z[i] for i in at], w) for z in (xs, ys))
                most[at] = np.minimum(n[at] - popcount(x & ~y), m[at] - popcount(y & ~x))
            yield b.select(["a", "b"]).filter(pa.array(most >= least_overlap(n + m)))

    left = info.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = info.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    sized = pairs.join(left, "a").join(right, "b").where(f"{DEN} * least(na, nb) >= {NUM} * greatest(na, nb)")
    return sized.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, spark_schema(LINKS))


def verified(pairs: DataFrame, docs: DataFrame, named: DataFrame, scratch: Scratch, name: str, name_bits: int = 64) -> DataFrame:
    """Links among ``pairs`` (a written table); only the sets of their classes are made again, from the whole texts."""
    wanted = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct()
    whole = scratch.save(payloads(docs, scratch.save(named.join(wanted, "cls", "left_semi").select("rep", "cls"), f"{name}-rep"), name_bits), f"{name}-sets")
    links = scratch.save(verify(pairs, whole), name)
    scratch.drop(f"{name}-sets", f"{name}-rep")
    return links


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with exactly one row of each component: that of the smallest id, null counting as the largest, then of the
    smallest hash of its text. Rows are told apart by id and text, so rows that only share an id, or have none, are judged each by
    its own text. Rows of equal id and equal text are copies, of which one stays; other texts without words are no copies of
    each other."""
    found = scratch.save(placed_rows(docs, scratch).select("doc_id", "mark", "comp"), "components")
    scratch.drop("sets-only", "placed")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("mark"))
    first = found.where("comp IS NOT NULL").groupBy("comp").agg(F.min(row).alias("first"), F.max(row).alias("last")).where("first <> last")
    others = found.join(scratch.save(first.select("comp", "first"), "first"), "comp").where(row != F.col("first"))

    def fresh(name: str) -> str:
        """A name that no column of ``docs`` has."""
        while name in docs.columns:
            name += "_"
        return name

    gone_id, gone_mark, twice_id, twice_mark = map(fresh, ("gone_id", "gone_mark", "twice_id", "twice_mark"))
    dropped = scratch.save(others.select(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark)).distinct(), "dropped")
    side = F.broadcast(dropped) if dropped.count() <= 1_000_000 else dropped  # checked; beyond it, by shuffle
    kept = docs.join(side, docs["doc_id"].cast("long").eqNullSafe(F.col(gone_id)) & (mark_of(docs) == F.col(gone_mark)), "left_anti")
    twice = scratch.save(found.groupBy("doc_id", "mark").count().where("count > 1").select(F.col("doc_id").alias(twice_id), F.col("mark").alias(twice_mark)), "twice")
    scratch.drop("components", "first")
    if twice.isEmpty():
        return kept
    repeated = kept["doc_id"].cast("long").eqNullSafe(F.col(twice_id)) & (mark_of(kept) == F.col(twice_mark))
    again = kept.join(twice, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, repeated, "left_anti").unionByName(again)
