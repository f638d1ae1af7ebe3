"""Hierarchical residual packing of token sequences.

Documents are encoded, ended with an id of their own, and only those longer than a sequence are cut. Groups of pieces, dealt by
a hash, are packed best-fit in descending order of length. Nearly full bins are final; underfull bins go up a tree as items,
sixteen groups to one, and are packed best-fit again, until one group is left. No piece is ever left out.

Every group of the tree stays small, and nothing is lost by it. After a best-fit round at most one bin of a group is at most half
full (two would be one), and two others never fit together. So a round has at most FAN_IN light bins to place, and fills at
most as many others. Of these others FAN_IN * (levels + 1) go up, the emptiest; any bin that stays behind has, at every later
level, at least FAN_IN unfilled ones in the tree that are as empty as it is, so a light bin that fits one left behind
fits one that went up.

Encoding is a narrow scan; what is shuffled is a few numbers a piece. Results: a null text counts as empty and still has its end
id; repeated rows are packed each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, ids_and_texts, in_slices, spark_schema
from .tokens import encoder

CAPACITY = 2048
GROUP_ROWS = 50_000
FAN_IN = 16
NEARLY_FULL = 16  # tokens of free space that a final bin may have
INDEX_BITS = 24

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep: int | None = None) -> DataFrame:
    """A row for each piece of a document. ``keep``: pre-tokens that a worker remembers; it costs memory or time, and changes no row."""

    def run(batches):
        encode = encoder(tokenizer, keep).encode
        end = end_id.to_bytes(4, "little")
        for b in in_slices(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
            if rows:
                yield batch(PIECES, **dict(zip(PIECES.names, map(list, zip(*rows)))))

    return ids_and_texts(docs).mapInArrow(run, spark_schema(PIECES))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each item. Bins by free space; the bits of ``open_`` tell which occur."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    with_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = open_ >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = with_free[free].pop()
            if not with_free[free]:
                open_ &= ~(1 << free)
        else:
            b, free, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - free
        free -= size
        if free:
            with_free[free].append(b)
            open_ |= 1 << free
    return bins, offsets


def _merger(capacity: int, level: int, carry: int):
    """One round of the tree: which bins of a group go up, and where each lies in its new bin."""

    def merge(key, pdf):
        half = pdf["load"] * 2 <= capacity
        emptiest = pdf[~half].sort_values(["load", "bin"]).groupby("level_group").head(carry)
        up = pd.concat([pdf[half], emptiest]).sort_values(["load", "bin"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins, offsets = best_fit(up["load"].to_numpy(), capacity)
        return up.assign(parent=(level << 56) + (int(key[0]) << INDEX_BITS) + bins, shift=offsets)[["bin", "load", "parent", "shift"]]

    return merge


def pack(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``items``: a written table with doc_id, piece, length, ids_crc32 (and others). Adds sequence_id and offset."""
    groups = max(1, -(-items.count() // group_rows))
    levels, left = 0, groups
    while left > 1:
        left, levels = -(-left // FAN_IN), levels + 1
    carry = FAN_IN * (levels + 1)
    own = items.schema

    def first(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="grp").assign(bin=(key[0] << INDEX_BITS) + bins, place=offsets)

    dealt = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    packed = scratch.save(dealt.groupBy("grp").applyInPandas(first, f"{columns}, bin long, place long"), "packed")

    loads = packed.groupBy("bin").agg(F.sum("length").alias("load")).withColumn("level_group", F.shiftright("bin", INDEX_BITS))
    level = 0
    while groups > 1:
        groups, level = -(-groups // FAN_IN), level + 1
        candidates = loads.where(F.col("load") <= capacity - NEARLY_FULL)
        merged = scratch.save(
            candidates.withColumn("up", F.floor(F.col("level_group") / FAN_IN).cast("long")).groupBy("up").applyInPandas(_merger(capacity, level, carry), "bin long, load long, parent long, shift long"), f"level{level}"
        )
        moved = merged.select(F.col("bin").alias("child"), "parent", "shift")
        packed = (
            packed.join(moved, packed["bin"] == moved["child"], "left")
            .withColumn("bin", F.coalesce("parent", "bin"))
            .withColumn("place", F.col("place") + F.coalesce("shift", F.lit(0)))
            .drop("child", "parent", "shift")
        )
        loads = merged.groupBy(F.col("parent").alias("bin")).agg(F.sum("load").alias("load")).withColumn("level_group", F.shiftright(F.col("bin").bitwiseAND((1 << 56) - 1), INDEX_BITS))
    return packed.withColumnsRenamed({"bin": "sequence_id", "place": "offset"})
