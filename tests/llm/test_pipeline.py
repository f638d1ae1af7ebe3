"""The pipeline stage by stage."""

import pyarrow as pa
import pytest

import corpus_pipeline
from veilframe.llm import common, jaccard, mixing, packing, pii, quality, tokens
from veilframe.llm.common import Scratch
from veilframe.llm.queries import tokenizer_path

from .test_operators import SF, base_spans, brute_components, brute_repeats


def kept_by_walk(forest, text):
    """The base rules by hand, and the forest tree by tree."""
    ws = (text or "").encode().split()
    if len(ws) < 20 or 100 * brute_repeats(ws) > 30 * len(ws):
        return False
    x, total = quality.statistics(text)[1], 0.0
    for feature, cut, length in zip(forest.feature, forest.cut, forest.length):
        at = 0
        while feature[at] >= 0:
            at = 2 * at + 1 + int(x[feature[at]] >= cut[at])
        total += length[at]
    return 2 ** (-total / len(forest.feature) / forest.norm) <= forest.threshold


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark, "stages")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    good = scratch.save(stages["quality_rules"](spark, docs, SF), "1")
    assert good.columns == columns and 0.8 * docs.count() < good.count() < docs.count()
    forest = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect() if kept_by_walk(forest, r.text)}

    once = scratch.save(stages["near_duplicates"](spark, good, SF), "2")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    found = jaccard.join(good, Scratch(spark, "c")).collect()
    assert once.columns == columns and {r.doc_id for r in once.collect()} == {r.doc_id for r in found if r.doc_id == r.component_id}
    few = rows[:150]
    parts = brute_components(few)
    small = jaccard.join(spark.createDataFrame(few, "doc_id long, text string"), Scratch(spark, "d")).collect()
    assert {r.doc_id: r.component_id for r in small} == {i: c for i, (_, c) in parts.items()}

    clean = scratch.save(stages["personal_data"](spark, once, SF), "3")
    assert clean.columns == columns and clean.count() == once.count() and not any(base_spans(r.text) for r in clean.collect())

    mixed = scratch.save(stages["source_mix"](spark, clean, SF), "4")
    words = lambda df: sum(mixing.words_of(r.text) for r in df.collect())
    assert mixed.columns == columns and abs(words(mixed) - words(clean)) <= 0.01 * words(clean)

    packed = stages["sequence_packing"](spark, mixed, SF).toPandas()
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all() and len(packed[packed.piece == 0]) == mixed.count()


def test_rows_of_the_driver_start_no_workers(spark, monkeypatch):
    """Rows as Python objects are sent by ``parallelize`` and pass workers of their own on each executor."""
    docs = Scratch(spark, "w").save(spark.createDataFrame([(1, "a", "x y z"), (2, None, "x"), (3, "b", None)], "doc_id long, source string, text string"), "docs")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    pii.train(spark, n=200)
    assert [(r.doc_id, r.size) for r in mixing.plan(docs, Scratch(spark, "p")).orderBy("doc_id").collect()] == [(1, 3), (2, 1), (3, 0)]
    schema = pa.schema([("s", pa.string()), ("n", pa.int32())])
    assert [tuple(r) for r in common.small_table(spark, [("a", 1), (None, None)], schema).collect()] == [("a", 1), (None, None)]
    empty = common.small_table(spark, [], schema)
    assert empty.collect() == [] and empty.dtypes == [("s", "string"), ("n", "int")]


def test_packing_remembers_no_more_than_it_is_told(spark, monkeypatch):
    told = []
    monkeypatch.setattr(packing, "pieces", lambda docs, *a, keep=None, f=packing.pieces, **b: told.append(keep) or f(docs, *a, keep=keep, **b))
    docs = spark.createDataFrame([(i, f"w{i} " * 40) for i in range(20)], "doc_id long, text string")
    corpus_pipeline.sequence_packing(spark, docs, SF)
    assert told[0] and told[0] < tokens.KEEP
    path = tokenizer_path("word_bpe_49k.json")
    few, many, letters = tokens.Encoder(path, 300), tokens.Encoder(path), "abcdefghij"
    for i in range(0, 3000, 50):
        text = " ".join("".join(letters[int(d)] for d in str(j)) for j in range(i, i + 50))
        assert few.encode(text) == many.encode(text) == many.encode_whole(text)
        assert len(few.known) <= 350 and len(few.old) <= 350
    assert len(many.known) == 3000


def test_workers_give_back_what_they_let_go(monkeypatch):
    given, held = [], {}
    monkeypatch.setattr(common, "_held", held)
    monkeypatch.setattr(common, "give_back", lambda: given.append(list(held)))
    assert common.only("one", list) is common.only("one", list) and common.only("two", dict) == {}
    assert given == [["one"], ["two"]]
    monkeypatch.undo()
    common.give_back()


@pytest.mark.parametrize("before, after", [("64MB", 2 << 20), ("1MB", None)])
def test_batches_are_small(spark, before, after):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, str(int(before[:-2]) << 20))
        common.small_batches(spark)
        assert int(spark.conf.get(name).rstrip("b")) == (after or 1 << 20)
    finally:
        spark.conf.set(name, old)
