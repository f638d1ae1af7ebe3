"""Rule files, JSON bodies, verdicts and streams."""

import json

import pytest
from pyspark.sql import functions as F

from veilframe.functions import jsonpath as J
from veilframe.operators import verdicts as V
from veilframe.sources import bodies as B
from veilframe.sources import records
from veilframe.sources import rules as R
from veilframe.streaming import events as E


def test_comments_inside_strings_stay():
    assert json.loads(R.strip_comments('{"a": "https://x/*y*/", // c\n "b": /* d */ 1}')) == {"a": "https://x/*y*/", "b": 1}


def test_bad_pattern_raises():
    with pytest.raises(Exception):
        R.parse('{"known_safe_routes": ["("]}')


def test_unsupported_path_raises():
    with pytest.raises(ValueError):
        R.compile_path(".a | map(.b)")


def test_set_texts_leaves_the_rest(spark):
    body = '{"a":  {"b": ["x", 1]},  "c": "y"}'
    rows = spark.createDataFrame([(body,), (None,), ("broken",)], "body string")
    steps = "array(named_struct('steps', array(named_struct('key', 'a', 'idx', cast(null as int)), named_struct('key', 'b', 'idx', null), named_struct('key', null, 'idx', 0)), 'text', 'new'), named_struct('steps', array(named_struct('key', 'zz', 'idx', cast(null as int))), 'text', 'no'))"
    got = [r.b for r in rows.select(J.set_texts(F.col("body"), F.expr(steps)).alias("b")).collect()]
    assert json.loads(got[0]) == {"a": {"b": ["new", 1]}, "c": "y"} and got[1:] == [None, "broken"]
    same = rows.select(J.set_texts(F.col("body"), F.expr("filter(" + steps + ", x -> false)")).alias("b")).first().b
    assert same == body


@pytest.mark.parametrize("reply,correct", [('{"correct": true, "false_positives": [], "missed_entities": []}', True), ("no json", False), ('x {"correct": true} {"correct": 1, "false_positives": ["a"], "missed_entities": []} {bad', True)])
def test_last_valid(reply, correct):
    assert json.loads(V.last_valid(reply))["correct"] is correct


def test_low_confidence_drops_false_positives(spark):
    row = spark.sql(f"SELECT 'Ann' AS text, from_json('{{\"correct\": false, \"false_positives\": [\"Ann\"], \"missed_entities\": [], \"confidence\": \"low\"}}', '{V.VERDICT}') AS v")
    assert row.select(V.validate(F.col("v"), F.col("text")).alias("x")).first().x.false_positives == []


def test_multipart_round_trip():
    body = b'--B\r\nContent-Disposition: form-data; name="t"\r\n\r\nhi\r\n--B--\r\n'
    assert [(p["name"], p["content"]) for p in B.parts_of(body, "B")] == [("t", b"hi")] and B.parts_of(b"", "B") == []


def test_batches_are_idempotent_and_ids_dense(spark):
    path = records.scratch_path(spark, "batches")
    sink = E.Pseudonymiser(path)
    one = spark.createDataFrame([(1, "a@b.c and d@e.f"), (2, "A@B.C")], "request_id long, text string")
    two = spark.createDataFrame([(3, "g@h.i a@b.c")], "request_id long, text string")
    for batch, n in ((one, 0), (two, 1), (two, 1)):
        sink(batch, n)
    known = {r.key: r.id for r in sink.mapping(spark).collect()}
    assert known == {"A@B.C": 0, "D@E.F": 1, "G@H.I": 2}
    out = {r.request_id: r.redacted for r in spark.read.parquet(f"{path}/out").collect()}
    assert out == {1: "[EMAIL_0] and [EMAIL_1]", 2: "[EMAIL_0]", 3: "[EMAIL_2] [EMAIL_0]"}


def test_prune_windows_start_at_noon_and_midnight(spark):
    hits = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-01 11:59:00', 'k'), (TIMESTAMP '2024-01-01 12:00:00', 'k'), (TIMESTAMP '2024-01-01 13:00:00', 'k'), (TIMESTAMP '2024-01-01 14:00:00', 'k') AS t(ts, k)")
    assert [(r.since.hour, r.hits, r.kept) for r in E.prune(hits, "k").orderBy("since").collect()] == [(0, 1, False), (12, 3, True)]
