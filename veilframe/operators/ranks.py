"""Numbering rows in one global order without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.records import scratch_path

#: Up to so many rows one task numbers them; beyond it, buckets of about so many each.
BUCKET_ROWS = 500_000


def numbered(rows: DataFrame, order: list[str], out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``out``: 1, 2, ... in ``order``; ``rows`` is read twice, so it should be a written table.

    Buckets are ranges of the whole order, of whatever types, so they are even unless rows equal in all of it are very frequent.
    They are written down with their number; the driver sees one count a bucket.
    """
    n = rows.count()
    if n <= bucket_rows:
        return rows.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "ranges")
    dealt = rows.repartitionByRange(-(-n // bucket_rows), *order).withColumn("__bucket", F.spark_partition_id())
    dealt.write.parquet(path)
    placed = spark.read.schema(dealt.schema).parquet(path)
    before, at = [], 0
    for r in placed.groupBy("__bucket").count().orderBy("__bucket").collect():
        before.append((r["__bucket"], at))
        at += r["count"]
    offsets = spark.createDataFrame(before, "__bucket int, __before long")  # a row a bucket
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return placed.join(F.broadcast(offsets), "__bucket").withColumn(out, F.col("__before") + inside).drop("__bucket", "__before")
