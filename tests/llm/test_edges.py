"""Every query over awkward rows and over empty tables."""

import hashlib
import random

import pandas as pd
import pytest

from veilframe.llm import queries

from .fixtures import TEXTS, write_tables

OPS = list(queries.queries())


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("awkward")))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("empty")), [], [])


@pytest.mark.parametrize("name", OPS)
def test_awkward_rows(spark, awkward, name):
    got = queries.queries()[name](spark, awkward).toPandas()
    if name == "op6_residual_packing":
        assert len(got[got["piece"] == 0]) == len(TEXTS)
    elif name == "pipeline":
        assert len(got) == 0  # every text is short or repeats itself
    else:
        assert len(got) == len(TEXTS)
        assert sorted(map(str, got["doc_id"].astype("float"))) == sorted(str(float("nan") if t[0] is None else float(t[0])) for t in TEXTS)


NOTHING = hashlib.sha256(b"").hexdigest()
ZEROS = hashlib.sha256(bytes(64)).hexdigest()
#: What a null text (3), an empty one (4), a blank one (5), the repeated rows (6) and the row without id give.
VALUES = {
    "op1_secret_scan": ({"n_assign": 0, "base_sha256": NOTHING, "spans": ""}, {}, {}, {"spans": ""}, {"spans": ""}),
    "op2_quality_rules": ({"n_words": 0, "n_dup_lines": 0, "base_failed": True, "kept": False}, {"word_chars": 0}, {"n_words": 0}, {"n_words": 2, "kept": False}, {"n_words": 8}),
    "op3_jaccard_components": ({"n_shingles": 0, "component_id": 3}, {"n_shingles": 0, "component_id": 4}, {"n_shingles": 0, "component_id": 5}, {"n_shingles": 1, "component_id": 6}, {"n_shingles": 4, "component_id": None}),
    "op4_token_sstable": ({"n_tokens": 1}, {"n_tokens": 1}, {}, {}, {"start": 0}),
    "op5_toxicity_models": ({}, {}, {}, {}, {}),
    "op7_pii_boosting": ({"n_email": 0, "base_sha256": NOTHING, "spans": ""}, {"spans": ""}, {"spans": ""}, {"spans": ""}, {"spans": ""}),
    "op8_language_filters": ({"lang_pred": "und", "score": 0.0}, {"lang_pred": "und"}, {"lang_pred": "und"}, {"lang_pred": "en"}, {}),
    "op9_media_sequences": ({"n_bytes": 0, "payload_bytes": 64, "payload_sha256": ZEROS}, {"payload_sha256": ZEROS}, {"n_bytes": 4, "payload_bytes": 64}, {"n_bytes": 7}, {"payload_bytes": 64}),
    "op10_source_mix": ({"size": 0, "taken": 0}, {"size": 0, "taken": 0}, {"size": 0, "taken": 0}, {"size": 2}, {"size": 8}),
}


@pytest.mark.parametrize("name", VALUES)
def test_awkward_values(spark, awkward, name):
    got = queries.queries()[name](spark, awkward).toPandas()
    for doc_id, expected in zip((3, 4, 5, 6, None), VALUES[name]):
        own = got[got["doc_id"].isna() if doc_id is None else got["doc_id"] == doc_id]
        assert len(own) == (2 if doc_id == 6 else 1)
        for column, value in expected.items():
            assert all(pd.isna(x) if value is None else x == value for x in own[column]), (doc_id, column)
    if name == "op5_toxicity_models":
        assert got[got["doc_id"].isin([3, 4, 5])]["score"].nunique() == 1  # the share of toxic rows
    same = got[got["doc_id"] == 6].drop(columns=[c for c in ("start", "taken") if c in got]).astype(str)
    assert len(same.drop_duplicates()) == 1  # repeated rows repeat their result


def test_pipeline_keeps_rows_of_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(12)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(60))
    near = text()
    equal = text()
    unique = [(None, text()), (None, text()), (7, text()), (7, text()), (None, text()), (20, text())]
    rows = [*unique, *[(8, equal)] * 3, (None, equal), (9, near), (11, near.rsplit(" ", 1)[0] + " other"), (12, None), (13, "too short")]
    folder = write_tables(spark, str(tmp_path), [(i, t, "en", "one source") for i, t in rows], [])
    got = queries.queries()["pipeline"](spark, folder).toPandas()
    from veilframe.llm import tokens

    encode = tokens.Encoder(queries.tokenizer_path("word_bpe_49k.json")).encode
    expected = sorted((str(i), len(encode(t)) // 4 + 1) for i, t in [*unique, (8, equal), (9, near)])
    assert sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), int(r.length)) for r in got.itertuples()) == expected
    assert (got["piece"] == 0).all() and got.groupby("sequence_id")["length"].sum().max() <= 2048


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0
