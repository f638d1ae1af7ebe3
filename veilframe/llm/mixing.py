"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources, ordered by code point with null last, weigh 5, 2, 1, repeating, and share all words. A target stops at three times its
source's size; the excess is shared again by weight until none is above. Targets are counted in blocks of equal numbers of
words; blocks are allotted to sources by highest quotients target / (2 seats + 1), and a source's words to its shards by the
same rule, with three times a shard's size as its ceiling; so a source gets its target less one block at most, whatever its
size. Within a shard documents are laid end to end in a seeded order and cut into blocks of as many words. What the quota exceeds whole
rounds of the shard is taken from blocks in a seeded order of their own, the last of them in part, so each document is taken
at most three times over, whole or in those of its words that lie in chosen blocks.

Scale: word counts are made once and written; a shard holds a bounded number of documents of one source, so a source with a
third of all rows only has more shards; the driver sees one row per shard. Nothing depends on the partitioning: shards and order
come from hashes of the id and the text. Results: a null text has size 0 and is never taken; equal rows share a place in the
order and are told apart by their position there; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD, Scratch, small_table

WEIGHTS = (5, 2, 1)
CEILING = 3


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> dict[str | None, float]:
    """Each source's target in words."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(ch) for ch in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = float(sum(sizes.values()))
    out: dict[str | None, float] = {}
    free = list(names)
    left = total
    while free:
        shared = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / shared > ceiling * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / shared for s in free}
        for s in above:
            out[s] = float(ceiling * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def sainte_lague(votes: list[float], seats: int, ceilings: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), none above its ceiling; ties go to the first.

    A quotient just under the final one is found by bisection, and only the last seats are dealt one by one, so the time does
    not grow with the number of seats.
    """
    n = len(votes)
    seats = min(seats, sum(c for c, v in zip(ceilings, votes) if v > 0))

    def at(q: float) -> list[int]:
        return [min(c, max(0, math.floor((v / q + 1) / 2))) if v > 0 else 0 for v, c in zip(votes, ceilings)]

    low, high = 0.0, 2 * max(votes, default=0.0) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= 0 or sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    got = at(high)
    heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(n) if votes[i] > 0 and got[i] < ceilings[i]]
    heapq.heapify(heap)
    while sum(got) < seats and heap:
        for _ in range(seats - sum(got)):
            if not heap:
                break
            _, i = heapq.heappop(heap)
            got[i] += 1
            if got[i] < ceilings[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def measure(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size (words of the whole text) and a fingerprint of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("print"), *more,
    )


def block_order(seed: int, source: str | None, shard: int, blocks: int) -> tuple[int, int]:
    """(a, b): block j of a shard is the one numbered (a j + b) mod blocks in its seeded order; a and blocks have no common factor."""
    a, b = (int.from_bytes(hashlib.blake2b(f"{seed} {k} {shard} {source!r}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") % blocks for k in "ab")
    while math.gcd(a, blocks) != 1:
        a += 1
    return a, b


def shard_quotas(shards: dict[str | None, list[tuple[int, int]]], target: dict[str | None, float], block: int, seed: int) -> list[tuple]:
    """``shards``: by source, (shard, words) in order. A row a shard: source, shard, ``full`` whole rounds, and for the rest the
    blocks of the shard, their seeded order (a, b), how many are taken whole, and how many words of the next."""
    names = list(target)
    seats = sainte_lague([target[s] for s in names], round(sum(target.values()) / block), [CEILING * sum(w for _, w in shards[s]) // block for s in names])
    out = []
    for s, n in zip(names, seats):
        own = shards[s]
        got = sainte_lague([float(w) for _, w in own], n * block, [CEILING * w for _, w in own])
        for (shard, words), quota in zip(own, got):
            full, rest = divmod(quota, words) if words else (0, 0)
            blocks = max(1, -(-words // block))
            a, b = block_order(seed, s, shard, blocks)
            lacking = blocks * block - words  # of the last block
            short = (a * (blocks - 1) + b) % blocks
            after = rest >= (short + 1) * block - lacking  # the last block is taken whole
            whole = (rest + lacking * after) // block
            out.append((s, shard, full, blocks, a, b, whole, rest + lacking * after - whole * block))
    return out


def mix(measured: DataFrame, seed: int = 7, shard_rows: int = 4096, most_shards: int = 200_000, most_block: int = 1_024, blocks_per_source: int = 2_000) -> DataFrame:
    """``measured``: rows of doc_id, source, size, print (and others, which are kept), in a written table.

    Adds source_size, target, taken, ``full`` (how many times the whole document is taken) and ``parts``, the ranges of its words
    (at, n) that are taken once more.
    """
    spark = measured.sparkSession
    per_source = measured.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    known = {r["source"]: (r["words"] or 0, r["n"]) for r in per_source.collect()}  # one row per source
    sizes = {s: w for s, (w, _) in known.items()}
    shard_rows = max(shard_rows, -(-sum(n for _, n in known.values()) // most_shards))
    target = targets(sizes)
    by_source = small_table(
        spark, [(s, -(-n // shard_rows), sizes[s], target[s]) for s, (_, n) in known.items()],
        pa.schema([("key", pa.string()), ("shards", pa.int32()), ("source_size", pa.int64()), ("target", pa.float64())]),
    )
    # one row per source, as counted above: sources are few beside documents, and a larger list is joined by shuffle
    side = F.broadcast(by_source) if len(known) <= 10_000 else by_source
    placed = measured.join(side, F.col("source").eqNullSafe(F.col("key")), "left").drop("key")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "print"), F.col("shards")).cast("int"))
    shard_sizes = placed.groupBy("source", "shard").agg(F.sum("size").alias("words")).collect()  # one row per shard_rows documents

    wanted = [t for t in target.values() if t > 0]
    block = max(1, min(most_block, math.floor(min(wanted) / blocks_per_source))) if wanted else 1
    by_name: dict[str | None, list[tuple[int, int]]] = {s: [] for s in target}
    for r in shard_sizes:
        by_name[r["source"]].append((r["shard"], r["words"]))
    quota = shard_quotas({s: sorted(own) for s, own in by_name.items()}, target, block, seed)
    numbers = ("full", "blocks", "order_a", "order_b", "whole", "rest")
    quotas = small_table(spark, quota, pa.schema([("q_source", pa.string()), ("q_shard", pa.int32()), *((c, pa.int64()) for c in numbers)]))
    side = F.broadcast(quotas) if len(quota) <= 100_000 else quotas
    placed = placed.join(side, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")), "left").drop("q_source", "q_shard")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "print"), "doc_id", "print").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("stop", F.sum("size").over(order)).withColumn("start", F.col("stop") - F.col("size"))
    # the ranges that chosen blocks have of the document; those of neighbouring blocks are one
    number = "(order_a * j + order_b) % blocks"
    upto = f"least(stop, j * {block}L + CASE WHEN {number} < whole THEN {block}L WHEN {number} = whole THEN rest ELSE 0L END)"
    ranges = f"filter(transform(sequence(start div {block}, (stop - 1) div {block}), j -> named_struct('low', greatest(start, j * {block}L), 'high', {upto})), x -> x.high > x.low)"
    joined = (
        f"aggregate({ranges}, CAST(array() AS ARRAY<STRUCT<low: BIGINT, high: BIGINT>>), (p, x) -> if(size(p) > 0 AND element_at(p, -1).high = x.low,"
        " concat(slice(p, 1, size(p) - 1), array(named_struct('low', element_at(p, -1).low, 'high', x.high))), concat(p, array(x))),"
        " p -> transform(p, x -> named_struct('at', x.low - start, 'n', x.high - x.low)))"
    )
    placed = placed.withColumn("parts", F.expr(f"CASE WHEN size > 0 THEN {joined} ELSE CAST(array() AS ARRAY<STRUCT<at: BIGINT, n: BIGINT>>) END"))
    return placed.withColumn("taken", F.expr("full * size + aggregate(parts, 0L, (p, x) -> p + x.n)"))


def plan(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, size, source_size, target and taken, a row for each row of ``docs``."""
    mixed = mix(scratch.save(measure(docs), "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def materialise(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken; where blocks end inside a document, a
    row holds those of its words that lie in neighbouring chosen blocks, joined by single spaces, and n_chars is theirs."""
    columns = docs.columns
    # a source may be repeated in the rows of an id and text, so it tells rows apart as well
    key = ("doc_id", "print", "source")
    measured = measure(docs, F.struct(*columns).alias("row"))
    light = scratch.save(measured.drop("row"), "sizes")
    mixed = scratch.save(mix(light).where("taken > 0").select(*(F.col(c).alias(f"m_{c}") for c in key), "start", "full", "parts"), "mix")
    met = reduce(and_, (F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in key))
    # equal rows are numbered on both sides, so that each meets its own place; all others need no number
    equal = scratch.save(light.where("size > 0").groupBy(*key).count().where("count > 1").select(*(F.col(c).alias(f"e_{c}") for c in key)), "equal")
    few = equal.count()
    side = F.broadcast(equal) if few <= 1_000_000 else equal  # checked; beyond it, by shuffle
    again = lambda prefix: reduce(and_, (F.col(f"{prefix}{c}").eqNullSafe(F.col(f"e_{c}")) for c in key))
    taken_rows = measured.where("size > 0")
    if few:
        joined = taken_rows.join(side, again(""), "left_anti").join(mixed.join(side, again("m_"), "left_anti"), met)
        twin = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(order))
        there = taken_rows.join(side, again(""), "left_semi").withColumn("twin", twin(key, F.lit(1)))
        places = mixed.join(side, again("m_"), "left_semi").withColumn("m_twin", twin([f"m_{c}" for c in key], "start"))
        joined = joined.unionByName(there.join(places, met & (F.col("twin") == F.col("m_twin"))).drop("twin", "m_twin"))
    else:
        joined = taken_rows.join(mixed, met)
    pieces = F.concat(F.array_repeat(F.struct(F.lit(0).cast("long").alias("at"), F.col("size").alias("n")), F.col("full").cast("int")), F.col("parts"))
    each = joined.select("row", "size", F.explode(pieces).alias("piece"))
    inside = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), F.col("piece.at").cast("int") + 1, F.col("piece.n").cast("int")), " ")
    text = F.when(F.col("piece.n") == F.col("size"), F.col("row.text")).otherwise(inside)
    taken = each.select("row", text.alias("new_text"))
    replaced = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return taken.select(*(replaced.get(c, F.col("row")[c]).alias(c) for c in columns))


def words_of(text: str | None) -> int:
    """For tests: words by hand."""
    n, inside = 0, False
    for ch in text or "":
        if ch in SPACES:
            inside = False
        elif not inside:
            n, inside = n + 1, True
    return n
