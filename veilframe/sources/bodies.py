"""Binary bodies: multipart parts and base64 images inside JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from ..functions.jsonpath import set_texts

PART = T.StructType([T.StructField("headers", T.StringType()), T.StructField("name", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("content", T.BinaryType())])
IMAGE = T.StructType([T.StructField("path", T.StringType()), T.StructField("steps", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("idx", T.IntegerType())]))), T.StructField("media_type", T.StringType()), T.StructField("data", T.StringType())])


def parts_of(body: bytes, boundary: str) -> list[dict]:
    out = []
    for piece in (body or b"").split(b"--" + boundary.encode())[1:]:
        if piece.startswith(b"--"):
            break
        head, _, content = piece.removeprefix(b"\r\n").partition(b"\r\n\r\n")
        named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))}
        disposition = dict(x.strip().partition("=")[::2] for x in named.get("content-disposition", "").split(";")[1:])
        out.append({"headers": head.decode("utf-8", "replace"), "name": disposition.get("name", "").strip('"'), "content_type": named.get("content-type", "text/plain"), "content": content.removesuffix(b"\r\n")})
    return out


def split_multipart(rows: DataFrame, *keys: str, body: str = "body", boundary: str = "boundary") -> DataFrame:
    """A row a part: keys, seq, headers, name, content_type, content."""

    @pandas_udf(T.ArrayType(PART))
    def run(bodies: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([parts_of(b, m) for b, m in zip(bodies, marks)], dtype=object)

    each = rows.select(*keys, F.posexplode(run(F.col(body), F.col(boundary))).alias("seq", "p"))
    return each.select(*keys, "seq", "p.headers", "p.name", "p.content_type", "p.content")


def join_multipart(parts: DataFrame, *keys: str) -> DataFrame:
    """The inverse: keys (with boundary), body."""
    grouped = parts.groupBy(*keys, "boundary").agg(F.sort_array(F.collect_list(F.struct("seq", "headers", "content"))).alias("ps"))
    text = lambda s: F.encode(s, "UTF-8")
    mark = F.concat(F.lit("--"), F.col("boundary"))
    body = F.aggregate("ps", text(F.lit("")), lambda out, p: F.concat(out, text(F.concat(mark, F.lit("\r\n"), p["headers"], F.lit("\r\n\r\n"))), p["content"], text(F.lit("\r\n"))))
    return grouped.select(*keys, "boundary", F.concat(body, text(F.concat(mark, F.lit("--\r\n")))).alias("body"))


def redact_parts(parts: DataFrame, images: DataFrame, *keys: str, text: Column | None = None) -> DataFrame:
    """Replaces the content of image parts by ``images`` (keys, seq, new_content), of text parts by ``text``; the rest passes."""
    joined = parts.join(images, [*keys, "seq"], "left")
    own = F.when(F.startswith("content_type", F.lit("image/")), F.coalesce("new_content", "content"))
    if text is not None:
        own = own.when(F.startswith("content_type", F.lit("text/")), F.encode(text, "UTF-8"))
    return joined.withColumn("content", own.otherwise(F.col("content"))).drop("new_content")


def _images(body: str | None) -> list[dict]:
    out: list[dict] = []

    def walk(node, path: str, steps: list) -> None:
        if isinstance(node, dict):
            source = node.get("source")
            if node.get("type") == "image" and isinstance(source, dict) and source.get("type") == "base64" and isinstance(source.get("data"), str):
                steps = [*steps, ("source", None), ("data", None)]
                out.append({"path": f"{path}.source.data", "steps": [{"key": k, "idx": i} for k, i in steps], "media_type": source.get("media_type"), "data": source["data"]})
                return
            for k, v in node.items():
                walk(v, f"{path}.{k}", [*steps, (k, None)])
        elif isinstance(node, list):
            for i, v in enumerate(node):
                walk(v, f"{path}[{i}]", [*steps, (None, i)])

    try:
        walk(json.loads(body), "$", [])
    except (TypeError, ValueError, RecursionError):
        return []
    return out


def base64_images(rows: DataFrame, *keys: str, body: str = "body") -> DataFrame:
    """A row for each base64 image object anywhere in a body: keys, path, steps, media_type, image (bytes)."""

    @pandas_udf(T.ArrayType(IMAGE))
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(_images)

    each = rows.select(*keys, F.explode(run(F.col(body))).alias("i"))
    return each.select(*keys, "i.path", "i.steps", "i.media_type", F.unbase64("i.data").alias("image"))


def put_images(rows: DataFrame, images: DataFrame, *keys: str, body: str = "body") -> DataFrame:
    """Writes redacted images (keys, steps, image) back in place."""
    updates = images.groupBy(*keys).agg(F.collect_list(F.struct("steps", F.base64("image").alias("text"))).alias("__u"))
    return rows.join(updates, list(keys), "left").withColumn(body, set_texts(F.col(body), F.col("__u"))).drop("__u")
