"""Record files: request logs, entity logs, training sets, caches, and the sinks that write them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = "ARRAY<STRUCT<text: STRING, type: STRING, start: INT, `end`: INT>>"
ENTITY_LOG = f"request_url STRING, field_path STRING, text STRING, entities {ENTITIES}"
REQUEST = "url STRING, method STRING, headers MAP<STRING, STRING>, body STRING"
TRAINING = "text STRING, entities ARRAY<STRUCT<text: STRING, type: STRING>>, source STRING"
DEFAULT_URL = "https://localhost/"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which a cluster shares; a local session without one uses a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="veilframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_and_read(rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Appends JSON lines to a new folder and reads them back with the same schema."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.mode(mode).json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def load_requests(spark: SparkSession, path: str, default_url: str = DEFAULT_URL) -> DataFrame:
    """A JSON-lines request log: url, method, headers, body (raw JSON text). Lines that are no objects are dropped; an object
    without a url is a bare body, sent to ``default_url``."""
    parsed = spark.read.text(path).select(F.try_parse_json("value").alias("v"), "value").where("schema_of_variant(v) LIKE 'OBJECT%'")
    bare = F.expr("try_variant_get(v, '$.url', 'string') IS NULL")
    return parsed.select(
        F.when(bare, F.lit(default_url)).otherwise(F.expr("try_variant_get(v, '$.url', 'string')")).alias("url"),
        F.coalesce(F.expr("try_variant_get(v, '$.method', 'string')"), F.lit("POST")).alias("method"),
        F.expr("from_json(to_json(try_variant_get(v, '$.headers', 'variant')), 'MAP<STRING, STRING>')").alias("headers"),
        F.when(bare, F.col("value")).otherwise(F.expr("coalesce(try_variant_get(v, '$.body', 'string'), to_json(try_variant_get(v, '$.body', 'variant')))")).alias("body"),
    )


def request_parts(requests: DataFrame) -> DataFrame:
    """url, headers with a content type, body bytes."""
    typed = F.map_zip_with(F.coalesce("headers", F.expr("CAST(map() AS MAP<STRING, STRING>)")), F.create_map(F.lit("content-type"), F.lit("application/json")), lambda k, own, default: F.coalesce(own, default))
    return requests.select("url", typed.alias("headers"), F.encode(F.coalesce("body", F.lit("")), "UTF-8").alias("body"))


def log_requests(requests: DataFrame, path: str) -> None:
    """Appends envelopes; the body is spliced in as the raw JSON it is, not parsed."""
    head = F.to_json(F.struct("url", "method", "headers"))
    line = F.concat(F.expr("left(j, length(j) - 1)"), F.lit(',"body":'), F.coalesce("body", F.lit("null")), F.lit("}"))
    requests.withColumn("j", head).select(line.alias("value")).write.mode("append").text(path)


def load_entity_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTITY_LOG).json(path)


def log_entities(rows: DataFrame, path: str) -> None:
    """Appends rows that have a url and entities."""
    rows.where("request_url IS NOT NULL AND request_url <> '' AND size(entities) > 0").select("request_url", "field_path", "text", "entities").write.mode("append").json(path)


def load_training(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING).json(path).where("text IS NOT NULL")


def per_language(rows: DataFrame, lang: str, order: str, n: int) -> DataFrame:
    """The first n rows of each language (a bounded corpus sample, by design)."""
    from pyspark.sql import Window

    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(lang).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def quarantine(rows: DataFrame, path: str) -> None:
    """Appends rows that failed to a dead-letter table."""
    rows.write.mode("append").json(path)
