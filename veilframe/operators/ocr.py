"""Geometry of recognised words on images: lines, offsets, boxes. Recognition and drawing are outside the engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from ..functions.spans import Finder

# Fixed values of the format.
CACHE_VERSION = 5
#: Words are of one line when their middles are as near, or they overlap as much, as these say, in pixels or shares of a height.
NEAR_PIXELS, NEAR_SHARE, OVERLAP_PIXELS, OVERLAP_SHARE = 8, 0.7, 3, 0.4
#: A word that may end an address: a dot or none, two to six letters, at most one closing mark.
ADDRESS_END = r"^\.?[a-zA-Z]{2,6}[)>.,;:!?\s]?$"
#: Marks beside which recognised spaces are dropped; around . and _ only next to word characters.
TIGHT = "@/:,-<>()[]{}"


def regions_of(results: DataFrame, id: str) -> DataFrame:
    """``results``: id, words (array), boxes (array of arrays of x, y points), lines, line_boxes. One region a word; where words
    and boxes differ in number or there are none, one a line."""
    usable = (F.size("words") > 0) & (F.size("words") == F.size("boxes"))
    texts, boxes = F.when(usable, F.col("words")).otherwise(F.col("lines")), F.when(usable, F.col("boxes")).otherwise(F.col("line_boxes"))
    each = results.select(id, F.posexplode(F.arrays_zip(texts.alias("t"), boxes.alias("b"))).alias("seq", "r"))
    xs, ys = F.transform("r.b", lambda p: p["x"]), F.transform("r.b", lambda p: p["y"])
    return each.select(id, "seq", F.col("r.t").alias("text"), F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom")).where("text IS NOT NULL AND text <> ''")


def group_lines(regions: DataFrame, id: str) -> DataFrame:
    """Adds line_no: regions in order of their centres join the first line whose centre is near or which they overlap enough.

    The fold depends on its own order, so it runs per image, one image's regions at a time.
    """
    key_type = regions.schema[id].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(c=(pdf["top"] + pdf["bottom"]) / 2).sort_values(["c", "left", "text"], kind="stable").reset_index(drop=True)
        lines: list[list[int]] = []  # top, bottom, members
        extents: list[tuple[int, int]] = []
        for i, r in pdf.iterrows():
            for k, (top, bottom) in enumerate(extents):
                height = min(r["bottom"] - r["top"], bottom - top)
                overlap = min(r["bottom"], bottom) - max(r["top"], top)
                if abs(r["c"] - (top + bottom) / 2) <= max(NEAR_PIXELS, NEAR_SHARE * height) or overlap >= max(OVERLAP_PIXELS, OVERLAP_SHARE * height):
                    lines[k].append(i)
                    extents[k] = (min(top, r["top"]), max(bottom, r["bottom"]))
                    break
            else:
                lines.append([i])
                extents.append((r["top"], r["bottom"]))
        number = pd.Series(0, index=pdf.index)
        for n, k in enumerate(sorted(range(len(lines)), key=lambda k: extents[k][0])):
            number[lines[k]] = n
        return pdf.assign(line_no=number)[[id, "line_no", "text", "left", "top", "right", "bottom"]]

    return regions.groupBy(id).applyInPandas(one, f"`{id}` {key_type}, line_no int, text string, left int, top int, right int, bottom int")


def offsets(lines: DataFrame, id: str) -> DataFrame:
    """Adds start and stop of each word in its line's text, words in order of left, one space between."""
    order = Window.partitionBy(id, "line_no").orderBy("left", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.length("text") + 1).over(order) - 1
    return lines.withColumn("stop", stop.cast("int")).withColumn("start", F.col("stop") - F.length("text"))


def line_texts(placed: DataFrame, id: str) -> DataFrame:
    return placed.groupBy(id, "line_no").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("w")).select(id, "line_no", F.array_join("w.text", " ").alias("text"))


def page_text(placed: DataFrame, id: str) -> DataFrame:
    """All lines of an image, top to bottom."""
    return line_texts(placed, id).groupBy(id).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


def _tight(text: str) -> tuple[str, list[int]]:
    word = lambda c: c.isalnum() or c == "_"
    keep = [True] * len(text)
    i = 0
    while i < len(text):
        if text[i] != " ":
            i += 1
            continue
        j = i
        while j < len(text) and text[j] == " ":
            j += 1
        before, after = text[i - 1] if i else "", text[j] if j < len(text) else ""
        solid = lambda c: bool(c) and not c.isspace()
        drop = (solid(before) and after in TIGHT and after != "") or (before in TIGHT and before != "" and solid(after))
        drop |= bool(before and after) and ((word(before) and after in "._") or (before in "._" and word(after)))
        if drop:
            keep[i:j] = [False] * (j - i)
        i = j
    kept = [i for i, k in enumerate(keep) if k]
    return "".join(text[i] for i in kept), kept


def tighten(text: Column) -> Column:
    """STRUCT<text, at>: a line without the spaces that recognition puts around marks, and where each character came from.
    Look-behind at what earlier rules leave has no built-in form, hence an Arrow function over short lines."""

    @pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType()))]))
    def run(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_tight(x or "") for x in lines], columns=["text", "at"])

    return run(text)


def original(at: Column, start: Column, stop: Column) -> Column:
    """A span of the tightened text in the original's offsets, clamped."""
    last = F.size(at) - 1
    return F.struct(F.get(at, F.least(start, last)).alias("start"), (F.get(at, F.least(stop - 1, last)) + 1).alias("stop"))


def boxes(entities: DataFrame, placed: DataFrame, id: str) -> DataFrame:
    """The box of each entity (id, line_no, e_start, e_stop, entity): words that overlap it, clipped by share of characters."""
    near = entities.join(placed, [id, "line_no"]).where("start < e_stop AND stop > e_start")
    n, w = F.col("stop") - F.col("start"), F.col("right") - F.col("left")
    clip = lambda at: F.col("left") + ((at - F.col("start")) / n * w).cast("int")
    from_x = F.when(n == 0, F.col("left")).otherwise(clip(F.greatest("e_start", "start")))
    to_x = F.when(n == 0, F.col("right")).otherwise(F.greatest(clip(F.least("e_stop", "stop")), from_x + 1))
    keys = [id, "line_no", "e_start", "e_stop", "entity"]
    return near.withColumn("l", from_x).withColumn("r", to_x).groupBy(*keys).agg(F.min("l").alias("left"), F.min("top").alias("top"), F.max("r").alias("right"), F.max("bottom").alias("bottom"))


def extend_over_tld(boxed: DataFrame, placed: DataFrame, id: str, gap: int = 15) -> DataFrame:
    """Boxes of addresses cut off before their last part grow over the next word where that is such a part, at most ``gap``
    pixels away; the first word behind the entity that is further off, or a match, ends the search."""
    words = placed.groupBy(id, "line_no").agg(F.sort_array(F.collect_list(F.struct("left", "start", "text", "right", "top", "bottom"))).alias("ws"))
    joined = boxed.join(words, [id, "line_no"], "left")
    open_ = F.contains("entity", F.lit("@")) & ~F.col("entity").rlike(r"\.\s*[a-zA-Z]{2,}$")
    state = F.struct(*(F.col(c) for c in ("right", "top", "bottom")), F.lit(False).alias("done"))

    def step(s, x):
        ended = s["done"] | (x["start"] < F.col("e_stop"))
        far = x["left"] - s["right"] > gap
        hit = x["text"].rlike(ADDRESS_END)
        grown = F.struct(F.greatest(s["right"], x["right"]).alias("right"), F.least(s["top"], x["top"]).alias("top"), F.greatest(s["bottom"], x["bottom"]).alias("bottom"), F.lit(True).alias("done"))
        stopped = F.struct(s["right"].alias("right"), s["top"].alias("top"), s["bottom"].alias("bottom"), F.lit(True).alias("done"))
        return F.when(ended, s).when(far, stopped).when(hit, grown).otherwise(s)

    grown = F.when(open_ & F.col("ws").isNotNull(), F.aggregate("ws", state, step)).otherwise(state)
    return joined.withColumn("g", grown).select(id, "line_no", "e_start", "e_stop", "entity", "left", F.col("g.top").alias("top"), F.col("g.right").alias("right"), F.col("g.bottom").alias("bottom"))


def outside(lax: DataFrame, standard: DataFrame, *keys: str) -> DataFrame:
    """Lax spans that no standard span equals or contains: keys, start, stop."""
    s = standard.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("start").alias("__a"), F.col("stop").alias("__b"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return lax.join(s, on & (F.col("__a") <= F.col("start")) & (F.col("stop") <= F.col("__b")), "left_anti")


def cached(cache: DataFrame, version: int = CACHE_VERSION) -> DataFrame:
    return cache.where(F.col("version") == version)


_LOCAL = r"\p{L}\p{N}_.%+-"
_PART = r"[\s().-]?[0-9]{2,4}"
# What counts as an address or a number in recognised text.
#: Shapes for recognised text, looser than the standard finders': addresses that lost their dots; numbers with a country's prefix,
#: with a leading zero, with an area in brackets, or in three groups; no digit stands beside a number.
LAX = (
    Finder("EMAIL", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[\p{{L}}\p{{N}}_.-]{{2,}}+", needs="instr(text, '@') > 0"),
    Finder(
        "PHONE",
        rf"(?<![0-9])(?:\+[0-9]{{1,3}}(?:[0-9]{{6,12}}|[\s.-]?\(?[0-9]{{1,4}}\)?(?:{_PART}){{1,3}})|0[0-9]{{1,4}}(?:[0-9]{{6,10}}|(?:{_PART}){{2,4}})"
        r"|\([0-9]{2,4}\)[\s.-]?[0-9]{3,4}[\s.-]?[0-9]{4}|[0-9]{2,4}[\s-][0-9]{3,4}[\s-][0-9]{3,4})(?![0-9])",
        needs="text rlike '[0-9]'",
    ),
)
