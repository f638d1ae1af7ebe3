"""The queries opN_<name> over whole tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard, kneser, language, media, mixing, packing, pii, quality, secrets, sstable
from .common import Scratch, quoted, read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read_table(spark, sf_dir, "documents")))


def _op1_sql() -> str:
    """Offsets from the gaps between matches: RE2 splits a text at the same matches as it extracts."""
    parts = []
    for rank, r in enumerate(secrets.RULES):
        p = quoted(r.pattern)
        parts.append(
            f"SELECT k, '{r.kind}' AS kind, {rank} AS rank, unnest(regexp_extract_all(t, {p})) AS m, unnest(regexp_extract_all(t, {p}, {r.group})) AS part,"
            f" unnest(list_slice(string_split_regex(t, {p}), 1, len(regexp_extract_all(t, {p})))) AS g, generate_subscripts(regexp_extract_all(t, {p}), 1) AS n FROM docs"
        )
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in secrets.RULES)
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in secrets.BASE)
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY k, kind ORDER BY n) AS stop FROM found),
spans AS (SELECT k, kind, rank, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE length(part) >= CASE kind {least} END),
per_doc AS (SELECT k, {counts},
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE kind IN ({base})) AS own FROM spans GROUP BY k)
SELECT doc_id, {zero}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per_doc USING (k)"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op3_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read_table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def tokenizer_path(name: str) -> str:
    from public_tokenizers import path

    return path(name)


def op4_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sstable.read_shards(sstable.write_shards(docs, Scratch(spark, "op4"), tokenizer_path("byte_bpe_50k.json"), end_id=2))


def op5_toxicity_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "op5")
    return kneser.score(docs, kneser.learn(docs, read_table(spark, sf_dir, "labels"), scratch), scratch)


def op6_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op6")
    items = scratch.save(packing.pieces(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=0), "pieces")
    return packing.pack(items, scratch)


def op7_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"), pii.train(spark))


def op8_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op9_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(read_table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read_table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_secret_scan, op2_quality_rules, op3_jaccard_components, op4_token_sstable, op5_toxicity_models, op6_residual_packing, op7_pii_boosting, op8_language_filters, op9_media_sequences, op10_source_mix, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _op1_sql()}
