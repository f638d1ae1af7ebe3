"""Windows over the tokens of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import sql_literal


def sliding(rows: DataFrame, size: int, stride: int, least: int, text: str = "text") -> DataFrame:
    """Token windows that start every ``stride`` tokens while more than ``least`` are left: adds first, window; drops the text."""
    kept = [c for c in rows.columns if c != text]
    cut = rows.where(F.col(text).isNotNull()).select(*kept, F.explode(F.array(T.tokens(F.col(text)))).alias("__w"))
    starts = F.when(F.size("__w") > least, F.sequence(F.lit(0), F.size("__w") - least - 1, F.lit(stride)))
    each = cut.select(*kept, "__w", F.explode(starts).alias("first"))
    return each.select(*kept, "first", F.slice("__w", F.col("first") + 1, F.lit(size)).alias("window")).where(F.size("window") >= least)


def model_chunks(rows: DataFrame, size: int = 450, overlap: int = 50, text: str = "text") -> DataFrame:
    """Overlapping token windows for a model: adds chunk_no, char_offset (of the first token), chunk; drops the text."""
    kept, stride = [c for c in rows.columns if c != text], size - overlap
    cut = rows.where(F.col(text).isNotNull()).selectExpr(*(f"`{c}`" for c in kept), f"inline(array(named_struct('__w', regexp_extract_all(`{text}`, {sql_literal(T.TOKEN)}, 0), '__g', transform(split(`{text}`, {sql_literal(T.TOKEN)}, -1), g -> length(g)))))")
    many = F.ceil(F.greatest(F.size("__w") - size, F.lit(0)) / F.lit(stride)).cast("int")
    each = cut.where("size(__w) > 0").select(*kept, "__w", "__g", F.explode(F.sequence(F.lit(0), many)).alias("c"))
    total = lambda lengths: F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    offset = total(F.slice("__g", F.lit(1), F.col("c") * stride + 1)) + total(F.transform(F.slice("__w", F.lit(1), F.col("c") * stride), lambda w: F.length(w)))
    return each.select(*kept, F.col("c").cast("long").alias("chunk_no"), offset.alias("char_offset"), F.slice("__w", F.col("c") * stride + 1, F.lit(size)).alias("chunk"))
