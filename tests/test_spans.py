"""Spans, placeholders and leaks against plain Python."""

import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.operators import mappings as M

WORDS = st.lists(st.sampled_from(["a@b.c", "A@B.C", "1.2.3.4", "999.1.1.1", "+1 (643) 555-2043", "4111 1111 1111 1111", "é", "ß", "😀", "x", "[PERSON_0]", "\n", "GB82WEST12345698765432"]), max_size=8)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@FEW
@given(st.lists(WORDS.map(" ".join), min_size=1, max_size=6))
def test_offsets_are_code_points(spark, texts):
    for r in S.entities(S.find(frame(spark, texts)), "doc_id").collect():
        assert texts[r.doc_id][r.start : r.stop] == r.entity


@FEW
@given(st.lists(WORDS.map(" ".join), min_size=1, max_size=6))
def test_emails_equal_re(spark, texts):
    found = {(r.doc_id, r.start, r.stop) for r in S.entities(S.find(frame(spark, texts), (S.EMAIL,)), "doc_id").collect()}
    assert found == {(i, *m.span()) for i, t in enumerate(texts) for m in re.finditer(S.EMAIL.plain, t)}


@FEW
@given(st.lists(WORDS.map(" ".join), min_size=1, max_size=6))
def test_round_trip(spark, texts):
    texts = [t.replace("[PERSON_0]", "p").lower() for t in texts]
    found = S.find(frame(spark, texts)).withColumn("spans", S.resolve(F.col("spans")))
    known = M.assign(S.entities(found, "doc_id"), ["doc_id", "start"])
    ids = [r.id for r in known.orderBy("id").collect()]
    assert ids == list(range(len(ids)))
    done = M.redact(found, known, "doc_id")
    back = {r.doc_id: r.restored for r in M.restore(done.select("doc_id", F.col("redacted").alias("text")), known).collect()}
    assert [back[i] for i in range(len(texts))] == texts


def test_resolve_keeps_leftmost(spark):
    rows = spark.sql(f"SELECT array(named_struct('start', 5, 'ord', 0, 'stop', 9, 'type', 'B', 'text', ''), named_struct('start', 0, 'ord', 1, 'stop', 6, 'type', 'A', 'text', ''), named_struct('start', 6, 'ord', 2, 'stop', 7, 'type', 'C', 'text', '')) AS spans")
    assert [x.type for x in rows.select(S.resolve(F.col("spans")).alias("s")).first().s] == ["A", "C"]


def test_long_runs_do_not_overflow(spark):
    texts = ["1" * 50_000, "1 " * 30_000, "1." * 30_000, "a@b" + ".c" * 30_000, "a" * 50_000 + "@", None, ""]
    assert S.find(frame(spark, texts)).count() == len(texts)


def test_first_casing_and_type_win(spark):
    found = spark.createDataFrame([(1, 0, "PERSON", "Ann"), (2, 0, "ORG", "ANN"), (3, 0, "X", "has [PERSON_0]")], "doc_id long, start int, type string, entity string")
    known = M.assign(found, ["doc_id", "start"]).collect()
    assert [(k.key, k.sensitive, k.placeholder) for k in known] == [("ANN", "Ann", "[PERSON_0]")]


def test_request_scope_counts_from_zero(spark):
    found = spark.createDataFrame([(1, 0, "P", "a"), (1, 5, "P", "b"), (2, 0, "P", "b")], "doc_id long, start int, type string, entity string")
    known = M.assign(found, ["start"], scope=["doc_id"]).collect()
    assert sorted((k.doc_id, k.key, k.id) for k in known) == [(1, "A", 0), (1, "B", 1), (2, "B", 0)]


def test_known_values_both_ways(spark):
    rows = frame(spark, ["Ann and ann, BOB", "aaa", "", None, "x.y xzy", "ann" * 50])
    known = spark.createDataFrame([("ANN", "P", 0), ("BOB", "P", 1), ("AA", "P", 2), ("X.Y", "P", 3)], "key string, type string, first_seen long")
    joined, searched = (sorted(map(tuple, M.known_values(rows, known, "doc_id", by_join=n).collect())) for n in (64, 0))
    assert joined == searched
    early, late = (sorted(map(tuple, M.known_values(rows, known, "doc_id", earlier_than="doc_id", by_join=n).collect())) for n in (64, 0))
    assert early == late


def test_leaks_exempt_and_whitelist(spark):
    rows = frame(spark, ["mail Ann", "mail {{Ann}}", "claude", "nothing"])
    known = spark.createDataFrame([("ANN", "P", 0, "[P_0]"), ("CLAUDE", "P", 1, "[P_1]")], "key string, type string, first_seen long, placeholder string")
    passed, held = M.gate(rows, known, "doc_id")
    assert sorted(r.doc_id for r in passed.collect()) == [1, 2, 3]
    assert [r.doc_id for r in held.collect()] == [0]


def test_unknown_placeholder(spark):
    known = spark.createDataFrame([("ANN", "Ann", "[PERSON_0]")], "key string, sensitive string, placeholder string")
    got = M.restore(frame(spark, ["[PERSON_0] [ORG_9]"]), known).first().restored
    assert got == "Ann <SECRET_NOT_FOUND-[ORG_9]>"


def test_gate_judges_each_row_by_its_own_text(spark):
    from veilframe.operators import mappings as M

    known = spark.createDataFrame([("ANN LEE", "Ann Lee", "PERSON", 1, 0, "[PERSON_0]")], "key string, sensitive string, type string, first_seen long, id long, placeholder string")
    rows = spark.createDataFrame([(1, "hi ann lee"), (None, "hi ann lee"), (None, "none of it"), (1, "hi"), (1, None), (2, "{{ann lee}}")], "k long, text string")
    passed, held = M.gate(rows, known, "k")
    assert {(r.k, r.text) for r in held.collect()} == {(1, "hi ann lee"), (None, "hi ann lee")}
    assert {(r.k, r.text) for r in passed.collect()} == {(None, "none of it"), (1, "hi"), (1, None), (2, "{{ann lee}}")}
    assert M.reset(known).count() == 0 and M.reset(known).columns == known.columns


def test_known_values_alike_by_every_way(spark, monkeypatch):
    from veilframe.operators import mappings as M

    values = [("ANN LEE", "PERSON", 1), ("X\\EY", "ORG", 1), ("A", "ORG", 9), ("A LONG VALUE OF MANY WORDS", "MISC", 2), ("", "MISC", 1)]
    known = spark.createDataFrame(values, "key string, type string, first_seen long")
    rows = spark.createDataFrame([(1, "hi ann lee"), (None, "ANN LEEANN LEE"), (3, "xx x\\ey x\\ey"), (3, "a long value of many words, a long value of"), (4, None), (5, "")], "k long, text string")
    found = []
    for by_join, most in ((64, 50_000), (0, 50_000), (0, 0)):
        monkeypatch.setattr(M, "BROADCAST_VALUES", most)
        found.append(sorted((str(r.k), r.key, r.type, r.occurrence) for r in M.known_values(rows, known, "k", by_join=by_join).collect()))
    assert found[0] == found[1] == found[2] and ("None", "ANN LEE", "PERSON", 2) in found[0]


def test_gazetteer_finds_every_whole_word(spark):
    from veilframe.operators.ner import Gazetteer, post_filter

    names = spark.createDataFrame([("Ann", "PER"), ("a+b", "ORG"), ("", "LOC")], "name string, entity_group string")
    texts = spark.createDataFrame([(1, "Annual Ann Ann, Ann_ (Ann) a+b xa+b"), (2, None)], "text_id long, text string")
    groups = Gazetteer(names).spans(texts)
    assert sorted((r.start, r.end, r.entity_group) for r in groups.collect()) == [(7, 10, "PER"), (11, 14, "PER"), (22, 25, "PER"), (27, 30, "ORG")]
    assert post_filter(groups).count() == 4


def test_streams_are_restored_by_a_mapping_of_any_size(spark, monkeypatch):
    from veilframe.operators import mappings as M
    from veilframe.streaming import events as E

    known = spark.createDataFrame([("ANN", "Ann", "PERSON", 1, 0, "[PERSON_0]"), ("A@B.C", "a@b.c", "EMAIL", 1, 1, "[EMAIL_1]")], "key string, sensitive string, type string, first_seen long, id long, placeholder string")
    data = ['data: {"t": "hi [PERSON_0] [person_0]"}', "data: broken [EMAIL_1] [ORG_9]", "data: [DONE]", ": [EMAIL_1]", None]
    chunks = spark.createDataFrame([("s", i, d) for i, d in enumerate(data)], "stream_id string, seq int, data string")
    both = []
    for most in (50_000, 0):
        monkeypatch.setattr(M, "BROADCAST_VALUES", most)
        both.append({r.seq: r.restored for r in E.restore_stream(chunks, known).collect()})
    assert both[0] == both[1] and both[0][1] == "data: broken a@b.c <SECRET_NOT_FOUND-[ORG_9]>" and both[0][0].startswith('data: {"t": "hi Ann')


def test_cut_placeholders_are_put_together(spark):
    from veilframe.streaming import events as E

    texts = ["hi [PER", "SON", "_0] and [", "EMAIL_1", "] then [x", " end ["]
    rows = [(s, i, f'data: {{"d": {{"t": "{t}"}}}}') for s in ("a", "b") for i, t in enumerate(texts)] + [("a", 9, "data: [DONE]")]
    known = spark.createDataFrame([("ANN", "Ann", "PERSON", 1, 0, "[PERSON_0]"), ("A@B.C", "a@b.c", "EMAIL", 1, 1, "[EMAIL_1]")], "key string, sensitive string, type string, first_seen long, id long, placeholder string")
    joined = E.rejoin(spark.createDataFrame(rows, "stream_id string, seq int, data string"), ".d.t")
    got = E.restore_stream(joined, known, (".d.t",)).orderBy("stream_id", "seq").collect()
    text = {s: "".join(json.loads(r.restored[6:])["d"]["t"] for r in got if r.stream_id == s and r.seq < 9) for s in "ab"}
    assert text == {s: "hi Ann and a@b.c then [x end [" for s in "ab"}
