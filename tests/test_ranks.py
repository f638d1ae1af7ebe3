import random

from veilframe.operators.ranks import numbered


def test_buckets_number_like_one_task(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), i) for i in range(500)] + [(7, 1000 + i) for i in range(200)]
    frame = spark.createDataFrame(rows, "lead long, tie long").repartition(5)
    got = {(r.lead, r.tie): r.n for r in numbered(frame, ["lead", "tie"], "n", bucket_rows=60).collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(rows))}


def test_buckets_take_text_and_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "é"]), rng.randrange(10**6)) for _ in range(400)]
    rows = list({x: None for x in rows})
    got = {(r.lead, r.tie): r.n for r in numbered(spark.createDataFrame(rows, "lead string, tie long"), ["lead", "tie"], "n", bucket_rows=50).collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1])))}
