"""The mapping of sensitive values to placeholders: allocation, lookup, redaction, restoration, known values, leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..sources.records import scratch_path
from .ranks import numbered

# What may stay in a text although it is known.
WHITELIST = ("CLAUDE", "CLAUDE CODE", "CLAUDE COWORK", "ANTHROPIC")
#: Up to so many values are sent to every task at once.
BROADCAST_VALUES = 50_000
#: Up to so many values are joined by containment.
BY_JOIN = 64


def assign(found: DataFrame, order: list[str], scope: list[str] | None = None, allow_tokens: bool = False) -> DataFrame:
    """``found``: rows with type, entity and the columns of ``order``. One row a value, by upper case: key, sensitive (first
    casing), type (first), first_seen (first column of ``order``), id from 0 by first appearance, placeholder.

    Ids are global, or dense within each ``scope`` (its columns are kept). Values are first reduced to one row each, map-side;
    only these rows, not their occurrences, are numbered, in a written table (see ranks.numbered).
    """
    scope = scope or []
    rows = found if allow_tokens else found.where(~F.col("entity").rlike(S.TOKEN))
    place = F.struct(*order)
    first = rows.groupBy(*scope, F.upper("entity").alias("key")).agg(F.min(F.struct(place.alias("place"), F.col("entity"), F.col("type"))).alias("f"))
    if scope:
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy("f.place")))
    else:
        path = scratch_path(found.sparkSession, "values")
        first.write.parquet(path)
        ranked = numbered(found.sparkSession.read.schema(first.schema).parquet(path), ["f.place"], "rank")
    return ranked.withColumn("id", (F.col("rank") - 1).cast("long")).select(
        *scope, "key", F.col("f.entity").alias("sensitive"), F.col("f.type").alias("type"), F.col("f.place")[order[0]].alias("first_seen"), "id",
        F.concat(F.lit("["), F.col("f.type"), F.lit("_"), F.col("id").cast("string"), F.lit("]")).alias("placeholder"),
    )


def reset(known: DataFrame) -> DataFrame:
    """A mapping that knows nothing, for the next request of a replay."""
    return known.limit(0)


def dump(known: DataFrame) -> DataFrame:
    return known.select("key", "placeholder")


def with_type(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds known_type, read off the placeholder of the row's ``key``; rows whose key is unknown go."""
    return rows.join(known.select("key", F.regexp_extract("placeholder", r"^\[([A-Z_]+)_[0-9]+\]$", 1).alias("known_type")), "key")


def look_up(rows: DataFrame, known: DataFrame, token: str = "token") -> DataFrame:
    """Adds ``value``: what the token stands for, or <SECRET_NOT_FOUND-token>."""
    side = known.select(F.col("placeholder").alias("__p"), "sensitive")
    joined = rows.join(side, F.upper(F.col(token)) == F.col("__p"), "left")
    return joined.withColumn("value", F.coalesce("sensitive", F.concat(F.lit("<SECRET_NOT_FOUND-"), F.col(token), F.lit(">")))).drop("__p", "sensitive")


def redact(resolved: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``resolved``: key, text, spans (disjoint, ordered). Adds ``redacted``.

    Only the spans are shuffled to meet their placeholders; they come back as a small map a text.
    """
    rows = resolved.withColumn("__row", F.struct(F.col(key), F.xxhash64("text")))
    spans = rows.select("__row", F.explode("spans").alias("s")).select("__row", F.upper("s.text").alias("key")).distinct()
    mapped = spans.join(known.select("key", "placeholder"), "key")
    maps = mapped.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("key", "placeholder"))).alias("__map"))
    joined = rows.join(maps, "__row", "left")
    value = lambda s: F.coalesce(F.try_element_at(F.col("__map"), F.upper(s["text"])), s["text"])
    return joined.withColumn("redacted", F.when(F.col("__map").isNull(), F.col("text")).otherwise(S.replace_spans(F.col("text"), F.col("spans"), value))).drop("__row", "__map", "spans")


def restore(rows: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows``: key, text. Adds ``restored``: every placeholder replaced by its value."""
    held = rows.withColumn("__row", F.struct(F.col(key), F.xxhash64("text")))
    tokens = held.select("__row", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(S.TOKEN), F.lit(0)))).alias("token"))
    maps = look_up(tokens.distinct(), known).groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("__map"))
    joined = held.join(maps, "__row", "left")
    return joined.withColumn("restored", F.when(F.col("__map").isNull(), F.col("text")).otherwise(put_back(F.col("text"), F.col("__map")))).drop("__row", "__map")


def put_back(text: Column, values: Column) -> Column:
    """``text`` with its placeholders replaced by those values (a map); unknown ones become <SECRET_NOT_FOUND-token>."""
    gaps, tokens = F.split(text, S.TOKEN, -1), F.regexp_extract_all(text, F.lit(S.TOKEN), F.lit(0))
    parts = F.zip_with(gaps, tokens, lambda g, t: F.concat(g, F.when(t.isNull(), F.lit("")).otherwise(F.coalesce(F.try_element_at(values, F.upper(t)), F.concat(F.lit("<SECRET_NOT_FOUND-"), t, F.lit(">"))))))
    return F.array_join(parts, "")


def known_values(rows: DataFrame, known: DataFrame, key: str, earlier_than: str | None = None, by_join: int = BY_JOIN) -> DataFrame:
    """``rows``: key, text. A row for each place where a known value occurs in a text, in any case, from the left and without
    overlap with itself: key column, key, type, occurrence (from 1). With ``earlier_than`` (the key column) a value counts
    only where it was first seen before.

    Up to ``by_join`` values meet the texts in a broadcast join by containment. More are searched at once, in one pass over each
    text, by an automaton built in each task from a broadcast list of checked size. Beyond BROADCAST_VALUES, texts and values
    meet in a join on the values' first characters, and what meets is verified.
    """
    values = known.where("length(key) > 0").select("key", "type", "first_seen")
    n = values.count()
    upper = rows.select(F.col(key).alias("__id"), F.upper("text").alias("__up"))
    if n <= by_join:
        hits = upper.join(F.broadcast(values), F.contains("__up", F.col("key")))
        found = hits.select("__id", "key", "type", "first_seen", F.explode(_places()).alias("occurrence"))
    elif n <= BROADCAST_VALUES:
        found = _searched(upper, values).join(values, "key")
    else:
        texts = upper.withColumn("__row", F.struct("__id", F.xxhash64("__up")))
        pairs = _met(texts, values).join(values, "key")
        found = texts.join(pairs, "__row").where(F.contains("__up", F.col("key"))).select("__id", "key", "type", "first_seen", F.explode(_places()).alias("occurrence"))
    if earlier_than:
        found = found.where(F.col("first_seen") < F.col("__id"))
    return found.select(F.col("__id").alias(key), "key", "type", "occurrence")


#: Most characters of a value that its join with the texts goes by.
ANCHOR = 12


def _places() -> Column:
    """Occurrences are the gaps between them, less one; the value is quoted as a pattern."""
    return F.expr("sequence(1, size(split(__up, concat('\\\\Q', replace(key, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E'), -1)) - 1)")


def _met(texts: DataFrame, values: DataFrame) -> DataFrame:
    """``texts``: __row, __up. Pairs (__row, key) of texts that hold a value's first ANCHOR characters, or all of a shorter one.
    Each different run of as many characters of a text is a row of the join, for the lengths that values have (12 at most)."""
    anchored = values.select("key", F.substring("key", 1, ANCHOR).alias("__gram"))
    lengths = [r[0] for r in anchored.select(F.length("__gram")).distinct().collect()]
    runs = lambda k: F.when(F.length("__up") >= k, F.transform(F.sequence(F.lit(1), F.length("__up") - (k - 1)), lambda i: F.substring(F.col("__up"), i, F.lit(k))))
    grams = F.array_distinct(F.flatten(F.array_compact(F.array(*map(runs, sorted(lengths))))))
    return texts.select("__row", F.explode(grams).alias("__gram")).join(anchored, "__gram").select("__row", "key").distinct()


def _searched(upper: DataFrame, values: DataFrame) -> DataFrame:
    """All places of the values (at most BROADCAST_VALUES) in ``__up``: __id, key, occurrence."""
    words = [r["key"] for r in values.select("key").collect()]
    schema = upper.select("__id").schema.add("key", "string").add("occurrence", "integer")

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            automaton.add_word(w, i)
        automaton.make_automaton()
        for b in batches:
            at, keys, numbers = [], [], []
            for k, text in enumerate(b.column("__up").to_pylist()):
                last: dict[int, tuple[int, int]] = {}
                for end, i in automaton.iter(text or ""):
                    until, n = last.get(i, (-1, 0))
                    if end - len(words[i]) >= until:
                        last[i] = (end, n + 1)
                        at.append(k)
                        keys.append(words[i])
                        numbers.append(n + 1)
            yield pa.RecordBatch.from_arrays([b.column("__id").take(pa.array(at, pa.int64())), pa.array(keys, pa.string()), pa.array(numbers, pa.int32())], names=["__id", "key", "occurrence"])

    return upper.mapInArrow(run, schema)


def leaks(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows``: key, text. Adds ``leaked``: the known values that the text still holds outside {{exempt}} braces.

    Rows are told apart by key and text, whatever these are: a row whose key is null or repeated is judged by its own text. A
    null text holds nothing.
    """
    own = rows.withColumn("__judged", F.struct(F.col(key), F.xxhash64("text")))
    bare = own.select("__judged", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)\{\{.*?\}\}", "").alias("text"))
    found = known_values(bare, known.where(~F.col("key").isin(*WHITELIST) & ~F.col("key").rlike(f"^{S.TOKEN}$")), "__judged")
    hits = found.groupBy("__judged").agg(F.collect_set("key").alias("leaked"))
    return own.join(hits, "__judged", "left").drop("__judged").withColumn("leaked", F.coalesce("leaked", F.expr("CAST(array() AS ARRAY<STRING>)")))


def gate(rows: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rows held back: a row passes only when its own text was judged and holds no known value. The judgement
    is written down once, so that no row can be on both sides or on none."""
    judged, path = leaks(rows, known, key), scratch_path(rows.sparkSession, "judged")
    judged.write.parquet(path)
    judged = rows.sparkSession.read.schema(judged.schema).parquet(path)
    return judged.where("size(leaked) = 0").drop("leaked"), judged.where("size(leaked) <> 0")
