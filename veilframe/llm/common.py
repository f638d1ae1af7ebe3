"""What the operators of this subpackage share: inputs, the shared scratch folder, words, folds."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a Java / RE2 / Python character class of word characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Most bytes of an Arrow batch between the JVM and a worker; rows here hold whole texts and sets.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of batches in the session, unless it has a lower bound already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"[^0-9-]", "", spark.conf.get(name)) or 0)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A few rows of the driver's as a table. They go to the JVM as Arrow; rows as Python objects would go through workers of
    their own, which stay with each executor beside those of the operators."""
    columns = list(zip(*rows)) or [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="veilframe-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables written to a folder of its own under the shared root, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def ids_and_texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long and ``text`` as string, and nothing else unless named: other columns never meet ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as empty text. Fold 0 is held out from learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def words(text: str) -> list[bytes]:
    """The words of a text as UTF-8. ``bytes.split`` splits at exactly the six characters of SPACES."""
    return text.encode("utf-8", "surrogatepass").split()


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def spark_schema(schema: pa.Schema) -> str:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


_held: dict[str, object] = {}


def give_back() -> None:
    """Free memory of this process goes back to the system; glibc and Arrow keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def only(name: str, make):
    """What a worker keeps between tasks, made at first use. It keeps one thing at a time: a worker that goes on to another
    operator's tasks lets go of the last one's memory, and gives it back."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
        give_back()
    return _held[name]


def in_slices(batches, rows: int = 512):
    """Arrow batches cut to a few rows, so that what is derived from long texts stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def kinds_ordered(spans: list[tuple[str, int, int]], kinds: list[str]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))

