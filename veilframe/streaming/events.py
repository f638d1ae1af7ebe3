"""Streams: restoring event streams, pseudonymising requests batch by batch, pruning a cache twice a day."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from ..functions import spans as S
from ..operators import mappings as M
from ..operators.ranks import numbered
from ..sources.records import scratch_path

LINE = "data: "


def _restore_lines(chunk: str, values: dict[str, str], fields: list[list]) -> str:
    token = re.compile(S.TOKEN)
    back = lambda t: token.sub(lambda m: values.get(m[0].upper(), f"<SECRET_NOT_FOUND-{m[0]}>"), t)
    out = []
    for line in chunk.split("\n"):
        payload = line[len(LINE) :].strip() if line.startswith(LINE) else ""
        if payload not in ("", "[DONE]"):
            try:
                tree = json.loads(payload)
                if fields:
                    for path in fields:
                        node = tree
                        for k in path[:-1]:
                            node = node.get(k) if isinstance(node, dict) else None
                        if isinstance(node, dict) and isinstance(node.get(path[-1]), str):
                            node[path[-1]] = back(node[path[-1]])
                    line = LINE + json.dumps(tree, ensure_ascii=False)
                else:
                    line = LINE + back(json.dumps(tree, ensure_ascii=False))
            except ValueError:
                line = back(line)
        out.append(line)
    return "\n".join(out)


def restore_chunk(data: Column, values: Column, fields: tuple[str, ...] = ()) -> Column:
    """Event-stream text with placeholders restored in ``data: `` lines: in the fields named (.a.b), or in the whole object;
    a line that is no JSON is restored as text. Other lines, empty payloads and [DONE] pass. ``values``: a map a row."""
    paths = [f.strip(".").split(".") for f in fields]

    @pandas_udf(T.StringType())
    def run(chunks: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else _restore_lines(c, dict(m) if m is not None else {}, paths) for c, m in zip(chunks, maps)], dtype=object)

    return run(data, values)


def restore_stream(chunks: DataFrame, known: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """``chunks`` (a stream or a table with data): adds restored. A mapping snapshot of checked size is one row, a map; against a
    larger one each chunk of a table looks up its own placeholders by a join. A stream of chunks needs foreachBatch for that."""
    if known.count() > M.BROADCAST_VALUES:
        if chunks.isStreaming:
            raise ValueError("take the stream by foreachBatch: batches are tables, which can be joined to a mapping of any size")
        held = chunks.withColumn("__row", F.xxhash64("data"))
        tokens = held.select("__row", F.explode(F.array_distinct(F.regexp_extract_all("data", F.lit(S.TOKEN), F.lit(0)))).alias("token")).distinct()
        maps = M.look_up(tokens, known).where("value <> concat('<SECRET_NOT_FOUND-', token, '>')").groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct(F.upper("token"), "value"))).alias("__m"))
        return held.join(maps, "__row", "left").withColumn("restored", restore_chunk(F.col("data"), F.col("__m"), fields)).drop("__row", "__m")
    snapshot = known.agg(F.coalesce(F.map_from_entries(F.collect_list(F.struct("placeholder", "sensitive"))), F.expr("CAST(map() AS MAP<STRING, STRING>)")).alias("__m"))
    return chunks.crossJoin(F.broadcast(snapshot)).withColumn("restored", restore_chunk(F.col("data"), F.col("__m"), fields)).drop("__m")  # one row on that side


#: The end of a text that may be the beginning of a placeholder.
OPEN = re.compile(r"\[(?:[A-Z_]+(?:[0-9]+)?)?$")


def _rejoined(chunks: list[str], path: list[str]) -> list[str]:
    """The chunks of one stream, in order, with beginnings of placeholders moved on to where they end: in the field at ``path`` of
    each ``data: `` line; what is open at the end stays in the last line that has the field."""
    out, carry, last = [], "", None
    for chunk in chunks:
        lines = chunk.split("\n")
        for i, line in enumerate(lines):
            try:
                tree = json.loads(line[len(LINE) :]) if line.startswith(LINE) else None
            except ValueError:
                tree = None
            node = tree
            for k in path[:-1]:
                node = node.get(k) if isinstance(node, dict) else None
            if isinstance(node, dict) and isinstance(node.get(path[-1]), str):
                text = carry + node[path[-1]]
                cut = OPEN.search(text)
                carry = cut[0] if cut else ""
                node[path[-1]] = text[: len(text) - len(carry)]
                lines[i] = LINE + json.dumps(tree, ensure_ascii=False)
                last = (len(out), i, tree, node)
        out.append("\n".join(lines))
    if carry and last is not None:
        at, i, tree, node = last
        node[path[-1]] += carry
        lines = out[at].split("\n")
        lines[i] = LINE + json.dumps(tree, ensure_ascii=False)
        out[at] = "\n".join(lines)
    return out


def rejoin(chunks: DataFrame, field: str, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """``chunks`` (stream, seq, data) with placeholders that two or more chunks of a stream cut put together in the chunk where
    they end, for ``restore_stream``. A stream is one reply, so its chunks fit a task; streams are dealt to tasks by id."""
    path = field.strip(".").split(".")
    columns = chunks.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq, kind="stable")
        return pdf.assign(data=_rejoined([x if isinstance(x, str) else "" for x in pdf["data"]], path))[columns]

    return chunks.groupBy(stream).applyInPandas(run, chunks.schema)


class Pseudonymiser:
    """Takes requests batch by batch (``stream.writeStream.foreachBatch(p)``): new values get the next ids, in order of request
    and place, and none is ever given anew. A batch that is repeated after a failure finds its own output and is skipped.

    The mapping is a table of one folder a batch under ``path``; outputs go to ``path``/out.
    """

    def __init__(self, path: str, finders: tuple[S.Finder, ...] = S.STRUCTURED, id: str = "request_id") -> None:
        self.path, self.finders, self.id = path.rstrip("/"), finders, id

    def mapping(self, spark) -> DataFrame:
        schema = "key STRING, sensitive STRING, type STRING, first_seen LONG, id LONG, placeholder STRING, batch LONG"
        if not self._exists(spark, f"{self.path}/mapping"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/mapping")

    @staticmethod
    def _exists(spark, path: str) -> bool:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        out = f"{self.path}/out/batch={batch_id}"
        if self._exists(spark, f"{out}/_SUCCESS"):
            return
        before = self.mapping(spark).where(F.col("batch") < batch_id)
        found = S.find(batch.select(F.col(self.id), "text"), self.finders).withColumn("spans", S.resolve(F.col("spans")))
        new = M.assign(S.entities(found, self.id), order=[self.id, "start"]).join(before.select("key"), "key", "left_anti")
        taken = before.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
        path = scratch_path(spark, "new-values")
        new.write.parquet(path)
        ranked = numbered(spark.read.schema(new.schema).parquet(path), ["id"], "__rank")
        given = ranked.withColumn("id", F.col("__rank") - 1 + F.lit(taken)).withColumn("placeholder", F.concat(F.lit("["), "type", F.lit("_"), F.col("id").cast("string"), F.lit("]")))
        columns = ["key", "sensitive", "type", F.col("first_seen").cast("long").alias("first_seen"), F.col("id").cast("long").alias("id"), "placeholder"]
        given.select(*columns).write.mode("overwrite").parquet(f"{self.path}/mapping/batch={batch_id}")
        known = self.mapping(spark).where(F.col("batch") <= batch_id)
        M.redact(found, known, self.id).write.mode("overwrite").parquet(out)


def prune(hits: DataFrame, key: str, ts: str = "ts", hours: int = 12, least: int = 3) -> DataFrame:
    """Cache keys by half day (aligned to 00:00 and 12:00 of the session's zone): window start, key, hits, kept. A key hit at
    least once but less than ``least`` times in a window is dropped at its end; keys without hits are left alone."""
    grouped = hits.groupBy(F.window(ts, f"{hours} hours").alias("w"), key).agg(F.count(F.lit(1)).alias("hits"))
    return grouped.select(F.col("w.start").alias("since"), key, "hits", (F.col("hits") >= least).alias("kept"))


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Takes what is there now, batch by batch, and ends; for schedulers outside."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
