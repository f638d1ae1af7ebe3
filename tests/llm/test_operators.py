"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import jaccard, kneser, language, media, mixing, packing, pii, quality, queries, secrets, sstable, tokens, toxicity
from veilframe.llm.common import Scratch, WORD

from .fixtures import TEXTS, documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def both(texts):
    return list(texts.items()) + [(t[0], t[1]) for t in TEXTS]


# ---- secrets


def test_trigram_queries_are_necessary():
    samples = {"assign": "X API_KEY: 'abcdef'", "access": "AKIA" + "A" * 16, "private_key": "-----BEGIN RSA PRIVATE KEY-----", "forge_token": "ghp_" + "a" * 36, "chat_token": "xoxb-" + "1" * 16, "cloud_key": "AIza" + "a" * 35}
    for rule in secrets.RULES:
        q = secrets.trigram_query(rule.pattern)
        if rule.kind in samples:
            index = secrets.BlockIndex([samples[rule.kind].encode(), b"nothing of the kind"], secrets.trigrams(q))
            assert index.candidates(q, 2).tolist() == [0]
    assert secrets.trigram_query("[0-9a-f]+") is True


def test_fixed_repeats_are_no_exact_runs():
    for pattern, text in ((r"x[ab]{4}y", "xabbay"), (r"k(ab){5}z", "kababababab" + "z"), (r"[0-9]{3}-q", "123-q"), (r"a{7}b{2}", "aaaaaaabb")):
        assert re.fullmatch(pattern, text)
        q = secrets.trigram_query(pattern)
        assert 0 in secrets.BlockIndex([text.encode(), b"nothing"], secrets.trigrams(q)).candidates(q, 2).tolist()


def test_secrets_equal_brute_force(texts):
    rows = [t or "" for _, t in both(texts)] + ["password=secret=abcdefgh TOKEN:12345 token: 123456", "İpassword: ſecret=abcdefg"]
    for text, spans in zip(rows, secrets.scan_block(rows)):
        assert secrets.kinds_ordered(spans, [r.kind for r in secrets.RULES]) == secrets.reference_spans(text, secrets.RULES)[0]


# ---- quality


def brute_repeats(ws):
    seen, hit = {}, set()
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(8)}
    return len(hit)


def test_statistics_equal_brute_force(texts):
    rng = random.Random(3)
    made = [" ".join(rng.choice("ab") for _ in range(n)) for n in (7, 8, 9, 15, 16, 40)]
    for text in [t for _, t in both(texts)] + made:
        ws = re.findall(WORD, text or "")
        lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
        expected = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), brute_repeats(ws))
        assert quality.statistics(text)[0] == expected


def test_forest_rejects_odd_rows_and_keeps_good(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.judge(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("NOT base_failed").toPandas()
    good, bad = judged[judged.quality == 1], judged[judged.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.7
    assert bad.anomaly.median() > good.anomaly.quantile(0.99)


def test_path_lengths_equal_a_walk():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(300, 4))
    forest = quality.grow(rows, rows.min(axis=0), rows.max(axis=0), trees=7, subsample=64, seed=1)
    new = rng.normal(size=(50, 4)) * 2
    harmonic = lambda n: sum(1 / k for k in range(1, n))
    for x, score in zip(new, forest.scores(new)):
        total = 0.0
        for feature, cut, length in zip(forest.feature, forest.cut, forest.length):
            at, steps = 0, 0
            while feature[at] >= 0:
                at, steps = 2 * at + 1 + int(x[feature[at]] >= cut[at]), steps + 1
            assert length[at] >= steps  # and what a search among the rows left there would need
            total += length[at]
        assert score == pytest.approx(2 ** (-total / 7 / forest.norm))
    assert forest.norm == pytest.approx(2 * harmonic(64) - 2 * 63 / 64, rel=0.01)


def test_threshold_comes_from_both_labels():
    class Given:
        scores = staticmethod(lambda x: x)

    good = np.linspace(0.2, 0.4, 1000)
    for bad, caught in ((np.linspace(0.398, 0.6, 100), 0.98), (np.linspace(0.5, 0.6, 100), 1.0)):
        threshold = quality.calibrate(Given, good, bad, 0.02)
        assert (good > threshold).mean() <= 0.02 and (bad > threshold).mean() >= caught
    assert (good > threshold).sum() == 0  # no good row goes where none need
    assert quality.calibrate(Given, good, bad[:0], 0.02) == np.inf


def test_most_unseen_bad_rows_are_caught(spark):
    from veilframe.llm.common import fold

    folder = "/root/testdata/sf0.1"
    rows, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = fold(F.col("doc_id")) == 0
    judged = quality.judge(rows.where(held), quality.fit(rows, labels.where(~held))).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert judged[judged.quality == 1].kept.mean() > 0.97 and judged[judged.quality == 0].kept.mean() < 0.1


# ---- near duplicates


def shingles(text):
    ws = (text or "").encode().translate(jaccard._LOWER).split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)]) if ws else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, z in sets[:k]:
            if s and z and 100 * len(s & z) >= 80 * len(s | z):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(n):
        own = list(base) if i % 3 else [rng.choice(words) for _ in range(rng.choice((3, 5, 30, 120)))] + base[:40]
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    return rows + [(100 + i, rows[i][1]) for i in range(10)] + [(200, ""), (201, None), (202, " ")]


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 4)])
def test_components_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(seed)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "j")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_classes_of_one_name_are_told_apart(spark):
    rows = near_copies(3)
    got = jaccard.placed_rows(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "j"), name_bits=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rng = random.Random(6)
    rows = [(k, c, c, rng.choice((5, 8, 9, 10, 40, 49, 50, 51, 64, 600))) for k in (1, 2) for c in range(25)] + [(3, 1, 1, 5), (3, 2, 2, 5)]
    sizes = {(k, c): n for k, c, _, n in rows}
    frame = spark.createDataFrame([(*r, 25 if r[0] < 3 else 2) for r in rows], "key long, cls long, comp long, n long, m long")
    groups = {}
    for r in jaccard.paired_blocks(frame).collect():
        assert r.blk in (r.bi, r.bj)
        groups.setdefault((r.key, r.bi, r.bj), []).append((r.blk, r.cls))
    met = [(k, *sorted((x, y))) for (k, i, j), own in groups.items() for a, x in own for b, y in own if x < y and (a != b or i == j)]
    allowed = {(k, x, y) for (k, x) in sizes for (z, y) in sizes if k == z and x < y and 5 * min(sizes[k, x], sizes[k, y]) >= 4 * max(sizes[k, x], sizes[k, y])}
    assert len(met) == len(set(met)) and allowed <= set(met)
    assert not any((k, *sorted((x, y))) in met for k in (1, 2) for (a, x), n in sizes.items() for (b, y), m in sizes.items() if a == b == k and n == 5 and m == 600)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, rng.integers(5, 300)).astype(np.uint64)) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[3:], rng.integers(0, 400, 2).astype(np.uint64)])) for s in sets[:60]]
    bits = jaccard.folded([jaccard.bitmap(s) for s in sets], 1024)
    tree = jaccard.SignatureTree(np.array([len(s) for s in sets]), bits, np.arange(len(sets)))
    i, j = tree.pairs(tree)
    found = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    for x in range(len(sets)):
        for y in range(x):
            both_ = len(np.intersect1d(sets[x], sets[y]))
            if 5 * both_ >= 4 * (len(sets[x]) + len(sets[y]) - both_):
                assert (y, x) in found


def test_one_of_each_group_stays(spark):
    rows = near_copies(5)
    parts = brute_components(rows)
    kept = {r.doc_id for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "k")).collect()}
    assert kept == {i for i, (_, c) in parts.items() if i == c}


def test_repeated_rows_leave_one(spark):
    kept = jaccard.keep_one(documents(spark), Scratch(spark, "k")).collect()
    ids = [r.doc_id for r in kept]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 9, 10, None, -5]))


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    rng = random.Random(8)
    unique = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
    a, b, c = ([*unique[k].split()] for k in range(3))
    near = lambda ws, k: " ".join([*ws[:-k], *(f"x{i}" for i in range(k))])
    rows = [(5, unique[0]), (None, near(a, 2)), *((None, t) for t in unique[3:])]  # one copy among unique rows without id
    rows += [(7, unique[1]), (7, "B " + unique[3][::-1]), (3, near(b, 2))]  # (7, B) is no copy of 3
    rows += [(9, unique[2]), (9, near(c, 1)), (9, near(c, 2))]  # near copies of one id
    d = [f"d{i}" for i in range(60)]
    rows += [(None, " ".join(d)), (None, near(d, 1)), (None, "")]  # near copies without id
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "k")).collect()]
    groups = [[rows[-3], rows[-2]], [r for r in rows if r[0] == 9]]
    assert all(sum(r in kept for r in g) == 1 for g in groups)
    single = [r for r in rows if not any(r in g for g in groups)]
    assert sorted(map(str, (r for r in kept if r in single))) == sorted(map(str, (r for r in single if r not in [(None, near(a, 2)), (7, unique[1])])))


# ---- tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_pieces_equal_whole_texts(texts, name, monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 500)
    encoder = tokens.Encoder(queries.tokenizer_path(name))
    odd = ["don't I'LL  x\n\n\ty ", "a1²½b", "<|endoftext|> __x__", "İstanbul", "ſtraße", "é", " x", "\x1cx", "日本"]
    for text in odd + [t or "" for _, t in both(texts)][:400]:
        assert encoder.encode(text) == encoder.encode_whole(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_get_the_ids_of_the_library(texts, name):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    encoder, library = tokens.Encoder(path), Tokenizer.from_file(path)
    odd = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "a <|ENDOFTEXT|> b", "é<|endoftext|>日本", "a <|endof text|>", "plain words"]
    for text in odd + [t or "" for t in texts.values()][:200]:
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_shards_round_trip_and_look_up(spark, docs, texts):
    scratch = Scratch(spark, "s")
    path = queries.tokenizer_path("byte_bpe_50k.json")
    manifest = sstable.write_shards(docs, scratch, path, end_id=2, docs_per_shard=300)
    got = {r.doc_id: r for r in sstable.read_shards(manifest).collect()}
    encoder, at = tokens.Encoder(path), 0
    for i in sorted(texts):
        ids = encoder.encode_whole(texts[i] or "") + (2).to_bytes(4, "little")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    for row in manifest.collect():
        fs, place = sstable._filesystem(row.uri)
        reader = sstable.ShardReader(fs.open_input_file(place))
        assert reader.get(row.first_id)[0][-1] == 2 and reader.get(10**9) == []


def test_a_damaged_block_is_noticed():
    out = io.BytesIO()
    writer = sstable.ShardWriter(out, 2)
    for i in range(50):
        writer.add(sstable.key_of(i), np.arange(i + 1, dtype="<u4").tobytes())
    writer.finish()
    data = bytearray(out.getvalue())
    assert [d for d, _ in sstable.ShardReader(io.BytesIO(data))] == list(range(50))
    data[40] ^= 1
    with pytest.raises(ValueError):
        list(sstable.ShardReader(io.BytesIO(data)))


# ---- packing


@pytest.mark.parametrize("group_rows", [10_000, 40])
def test_packing_is_whole_and_tight(spark, docs, group_rows):
    scratch = Scratch(spark, "p")
    items = scratch.save(packing.pieces(docs, queries.tokenizer_path("word_bpe_49k.json"), 0), "pieces")
    got = packing.pack(items, scratch, group_rows=group_rows).toPandas()
    before = items.toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[key].to_numpy().tolist())) == sorted(map(tuple, before[key].to_numpy().tolist()))
    for _, one in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        ends = (one.offset + one.length).tolist()
        assert one.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= packing.CAPACITY
    assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // packing.CAPACITY) + 2


def test_bins_left_behind_lose_nothing(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, 0, 0, rng.choice((2048, 1500, 1300, 1100, 1030, 600, 300, 90, 40)), 0) for i in range(3000)]
    scratch = Scratch(spark, "p")
    items = scratch.save(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), "items")
    count = lambda: packing.pack(items, Scratch(spark, "q"), group_rows=5).select("sequence_id").distinct().count()
    some, plain = count(), packing._merger
    monkeypatch.setattr(packing, "_merger", lambda capacity, level, carry: plain(capacity, level, 10**9))
    assert some <= 1.01 * count() + 1


# ---- personal data


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for rank, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


PII = [
    (1001, "a@b.c_d@e.f x@y. 1.2.3.4.5.6.7.8 300.1.1.1 0001.255.00.9 +1 (643) 555-2043 4111 1111 1111 1111"), (1002, "call (643) 555-2043 or joe.doe (at) mail (dot) org; ssn 123-45-6789"),
    (1003, "order 123-456-7890 on 2024-01-02, version 1.2.3, ref 4111 1111 1111 1112, 12345678"), (1004, "1 " * 4000 + "9" * 4000), (1005, "1" * 30_000 + "." * 5), (1006, "😀 é a@b.co " * 3),
]


def test_personal_data_base_equals_brute_force(spark, texts):
    rows = both(texts) + PII
    model = pii.train(spark)
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(frame, model).collect()}
    for k, (i, text) in enumerate(rows):
        assert got[k].base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest(), i
    at = {i: k for k, (i, _) in enumerate(rows)}
    assert got[at[1002]].n_more == 3 and got[at[1003]].n_more == 0
    assert all(r.n_spans == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_more for r in got.values())


def test_loose_data_is_found_and_look_alikes_are_not(spark):
    """Invented data of other seeds than those that the trees have seen, each in a text of its own."""
    made = [(k, b + m + a, len(b), len(b) + len(m), label) for k, (m, b, a, label) in enumerate(pii.examples(700, seed=77))]
    spans = {r.doc_id: set(r.spans.split(",")) for r in pii.report(spark.createDataFrame(made, "doc_id long, text string, i int, j int, label int").select("doc_id", "text"), pii.train(spark)).collect()}
    kinds = ("number", "written_email", "card", "email")
    ranges = {k: [tuple(map(int, x.split(":")[1:])) for x in own if x.split(":")[0] in kinds] for k, own in spans.items()}
    good, bad = [x for x in made if x[4]], [x for x in made if not x[4]]
    written = [x for x in good if "at" in x[1][x[2] : x[3]]]
    covered = lambda rows: sum(any(p <= i and j <= q for p, q in ranges[k]) for k, _, i, j, _ in rows)  # noqa: E731  letters that follow belong to an address
    wrong = sum((i, j) in ranges[k] for k, _, i, j, _ in bad)
    assert covered(good) / len(good) > 0.95 and wrong / (covered(good) + wrong) < 0.02
    assert len(written) > 50 and covered(written) / len(written) > 0.95


def test_trees_in_sql_equal_a_walk(spark):
    model = pii.train(spark)
    made = spark.createDataFrame(pii.examples(60, seed=3), "m string, b string, a string, label int")
    rows = made.selectExpr(*(f"double({e}) AS {f}" for f, e in pii.FEATURES.items())).selectExpr("*", f"{model.sql(list(pii.FEATURES))} AS margin").toPandas()
    assert np.allclose(rows["margin"], model.margins(rows[list(pii.FEATURES)].to_numpy()), atol=1e-4)
    x, y = np.arange(40.0).reshape(-1, 1), (np.arange(40) >= 20).astype(float)
    base, trees = pii.boost(x, y, trees=1, depth=1)
    (feature, cut, low, high), p = trees[0], 0.5
    assert (feature, cut) == (0, 19.5) and low == pytest.approx(0.3 * -20 * p / (20 * p * p + 1)) and high == pytest.approx(-low) and abs(base) < 1e-5


def test_redaction_leaves_no_base_span(spark):
    frame = spark.createDataFrame(PII, "doc_id long, text string").withColumn("row", F.lit(1))
    done = pii.redact(frame, pii.train(spark))
    assert done.columns == frame.columns
    assert all(base_spans(r.text) == "" for r in done.collect())


LISTS = [
    ("643-555-2043 644-555-2044", ["643-555-2043", "644-555-2044"]), ("643-555-2043 10 20 30 40 50", ["643-555-2043"]), ("room 42 (643) 555-2043", ["(643) 555-2043"]),
    ("call (643) 555-2043 (644) 555-2044 (645) 555-2045 now", ["(643) 555-2043", "(644) 555-2044", "(645) 555-2045"]), ("table 10 20 30 40 50 60 70 80 90 100", []), ("on 2024-01-02 2024-01-03", []),
]


def test_numbers_in_lists_are_found(spark):
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(LISTS)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(frame, pii.train(spark)).collect()}
    for k, (text, expected) in enumerate(LISTS):
        assert [text[int(i) : int(j)] for _, i, j in (x.split(":") for x in got[k].split(",") if x)] == expected
    run = "12 (643) 555-2043 10 4111 1111 1111 1112 9"
    candidates = pii.candidates(spark.createDataFrame([(run,)], "text string")).selectExpr("transform(c_number, s -> struct(s.start, s.stop, s.m, s.b, s.a)) AS c").first().c
    assert [(c.start, c.stop) for c in candidates] == pii.windows(run)
    assert all((c.m, c.b, c.a) == (run[c.start : c.stop], run[max(0, c.start - 24) : c.start], run[c.stop : c.stop + 8]) for c in candidates)


# ---- languages, toxicity


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_languages_held_out(spark, docs):
    got = language.identify(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id) for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in own) / len(own) > 0.97


def test_no_letters_is_und(spark):
    filters = language.learn(spark.createDataFrame([(i, "some words here", "en") for i in range(50)], "doc_id long, text string, lang string"))
    assert [filters.predict(t)[0] for t in (None, "", "12 34 !", "\u00bd \u00b2 \u2462", "\u3007", "\u2160", "words")] == ["und"] * 6 + ["en"]


@pytest.mark.parametrize("per_language", [1000, 20])
def test_filters_equal_brute_force(spark, docs, texts, per_language):
    rows = docs.selectExpr("doc_id", "lang", "xxhash64(doc_id, text) AS h").collect()
    mine = {}
    for r in rows:
        if r.lang is not None and texts[r.doc_id] is not None and not held_out(r.doc_id):
            mine.setdefault(r.lang, []).append((r.h, r.doc_id))
    got = language.learn(docs, per_language)
    assert got.languages == sorted(mine)
    tables = {}
    for lang, own in mine.items():
        most = [x for x in sorted(own) if x[0] / 2.0**64 + 0.5 <= 4 * per_language / len(own)][:per_language]
        counts = {}
        for _, i in most:
            for h in set(language.ngrams(texts[i]).tolist()):
                counts[h] = counts.get(h, 0) + 1
        least = 1 if len(most) < 20 else max(2, -(-len(most) * 5 // 1000))
        tables[lang] = {s % (1 << 20) for h, n in counts.items() if n >= least for s in (h, h >> 20)}
        k = got.languages.index(lang)
        assert set(np.flatnonzero(got.table[0] >> np.uint8(k) & np.uint8(1)).tolist()) == tables[lang]
        assert abs(got.chance[k] - (len(tables[lang]) / (1 << 20)) ** 2) < 1e-9
    for i in sorted(texts)[:150]:
        grams = language.ngrams(texts[i] or "").tolist()
        hits = [sum(h % (1 << 20) in t and (h >> 20) % (1 << 20) in t for h in grams) for t in map(tables.get, got.languages)]
        each = [max(0, (n - len(grams) * c) / (1 - c)) for n, c in zip(hits, got.chance)]
        if any(map(str.isalpha, texts[i] or "")) and sum(each):
            assert got.predict(texts[i]) == (got.languages[int(np.argmax(each))], pytest.approx(max(each) / sum(each)))


def test_a_language_of_one_text_is_learned(spark):
    rows = [(i, f"common english words {i}", "en") for i in range(60)] + [(101, "ganz anders klingt dies", "de"), *((1, "equal rows", "xx") for _ in range(5))]
    filters = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.predict("dies klingt anders")[0] == "de" and filters.predict("equal rows")[0] == ("xx" if not held_out(1) else "en")


def test_more_than_eight_languages():
    table = np.zeros((2, 1 << language.BITS), dtype=np.uint64)
    for s in language.slots(language.ngrams("palavra")):
        table[1][s] |= np.uint64(2)
    many = language.Filters([f"l{i:02}" for i in range(70)], table, 64, np.zeros(70))
    assert many.predict("palavra")[0] == "l65"


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    rows, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scratch = Scratch(spark, "t")
    got = toxicity.score(rows, toxicity.learn(rows, labels, scratch), scratch).where("held_out").join(labels, "doc_id").toPandas()
    toxic, clean = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert (toxic[:, None] > clean[None, :]).mean() > 0.97
    assert (toxic >= 0.5).mean() > 0.9 and (clean >= 0.5).mean() < 0.01


def brute_gains(rows):
    """(word tokens, toxic) by row: the difference of each word's log-likelihoods, and that of an unknown word."""
    n, held = ({}, {}), {}
    for ws, toxic in rows:
        for before, w in zip([b"", *ws], ws):
            n[toxic][w] = n[toxic].get(w, 0) + 1
            held.setdefault(w, set()).add(zlib.crc32(before) % 64)
    m = {w: round(-64e6 * np.log(1 - min(len(x), 63) / 64)) / 1e6 for w, x in held.items()}

    def level(counts):
        y = [sum(round(x) == k for x in counts.values()) for k in (1, 2, 3, 4)]
        share = y[0] / (y[0] + 2 * y[1])
        d = [min(max(k - (k + 1) * share * y[k] / y[k - 1], 0.05), k - 0.05) if y[k] and y[k - 1] else 0.75 for k in (1, 2, 3)]
        off = {w: d[min(max(round(x), 1), 3) - 1] for w, x in counts.items()}
        total = sum(counts.values())
        return {w: max(x - off[w], 0) / total for w, x in counts.items()}, sum(off.values()) / total

    shared, rest = level(m)
    (p0, rest0), (p1, rest1) = map(level, n)
    both_ = {w: shared[w] + rest / (len(m) + 1) for w in m}
    return {w: np.log((p1.get(w, 0) + rest1 * q) / (p0.get(w, 0) + rest0 * q)) for w, q in both_.items()}, np.log(rest1 / rest0)


def test_toxicity_equals_brute_force(spark, docs, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id: int(r.toxic > 0) for r in labels.collect()}
    scratch = Scratch(spark, "t")
    model = toxicity.learn(docs, labels, scratch, head=50)  # most words meet theirs by the join
    split = lambda t: re.sub(r"[\x00-\x7f]", lambda c: c[0] if c[0].isalnum() else " ", (t or "").lower()).encode().split(b" ")
    ws = {i: [w for w in split(t) if w] for i, t in texts.items()}
    gains, unseen = brute_gains([(ws[i], x) for i, x in toxic.items() if not held_out(i)])
    got = {bytes(r.word): r.gain / 1e6 for r in model.gains.table.collect()}
    assert set(got) == set(gains) and max(abs(got[w] - g) for w, g in gains.items()) < 2e-6 and abs(model.gains.unseen / 1e6 - unseen) < 2e-6
    b = model.slope
    for r in toxicity.score(docs, model, scratch).collect():
        g = np.array([gains.get(w, unseen) for w in ws[r.doc_id]])
        x = b[0] + b[1] * g.mean() + b[2] * np.sqrt(g[g > model.cut / 1e6].sum() / len(g)) if len(g) else 0
        assert abs(r.score - (1 / (1 + np.exp(-x)) if len(g) else model.share)) < 1e-3 and r.held_out == held_out(r.doc_id)


def test_toxicity_counts_every_labelled_row(spark):
    rows = [(i, f"common words rare{i} rare{i}", "en", "a") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.learn(documents(spark, rows), labels, Scratch(spark, "t"), curve_rows=10, head=3)
    learned = [i for i in range(400) if not held_out(i)]
    got = {bytes(r.word): r.gain for r in model.gains.table.collect()}
    assert {f"rare{i}".encode() for i in learned} | {b"common", b"words"} == set(got)
    assert all((got[f"rare{i}".encode()] > 0) == (i % 2 == 1) for i in learned)


def test_toxicity_without_both_classes(spark):
    rows, scratch = documents(spark), Scratch(spark, "t")
    for labels, share in (([], 0.0), ([(2, 0), (7, 0)], 0.0), ([(1, 1), (8, 1), (7, 1)], 1.0)):
        model = toxicity.learn(rows, spark.createDataFrame(labels, "doc_id long, toxic int"), scratch)
        got = toxicity.score(rows, model, scratch).collect()
        assert len(got) == len(TEXTS) and {r.score for r in got} == {share}


def test_toxicity_knows_order_and_spelling(spark, tmp_path):
    """Both classes have the same words as often, in other orders; and some words of other stems. Judged are held-out texts."""
    a, b = "one two three four five six", "six five four three two one"
    rows = [(i, f"{(a, b)[i % 2]} {('mel', 'grox')[i % 2]}{'abcdefghij'[i // 2 % 10]}{'klmnopqrst'[i // 20 % 10]}") for i in range(400)]
    free = [i for i in range(1000, 1100) if held_out(i)]
    more = list(zip(free, [a, b, "groxyy zzz", "melyy zzz", "grxoyy zzz"]))
    spark.createDataFrame(rows + more, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.score for r in queries.queries()["op5_toxicity_models"](spark, str(tmp_path)).collect()}
    order0, order1, stem1, stem0, turned = (got[i] for i, _ in more)
    assert order1 > 0.6 > 0.4 > order0 and stem1 > stem0 and stem1 > turned


def brute_spelling(classes):
    """Log probabilities by spelling, by class: from the different words of each, by recursion."""
    tables = []
    for own in classes:
        top = {}
        for w in own:
            x = b"\1\1\1\1" + w + b"\2"
            for i in range(4, len(x)):
                top[x[i - 3 : i + 1]] = top.get(x[i - 3 : i + 1], 0) + 1
        levels = {4: top}
        for k in (3, 2, 1):
            levels[k] = {}
            for g in levels[k + 1]:
                levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1
        after = {}
        for table in levels.values():
            for g, n in table.items():
                total, kinds = after.get(g[:-1], (0, 0)) if len(g) > 1 else after.get(b"", (0, 0))
                after[g[:-1]] = total + n, kinds + 1
        tables.append((levels, after))
    lowest = {c: 0.5 + sum(levels[1].get(bytes([c]), 0) for levels, _ in tables) for c in range(256)}

    def p(c, g):
        if not g:
            return None
        low = p(c, g[1:]) if len(g) > 1 else lowest[g[0]] / sum(lowest.values())
        levels, after = tables[c]
        total, kinds = after.get(g[:-1], (0, 0))
        return low if not total else max(levels[len(g)].get(g, 0) - 0.75, 0) / total + 0.75 * kinds / total * low

    return lambda c, w: sum(np.log(p(c, (b"\1\1\1\1" + w + b"\2")[i - 3 : i + 1])) for i in range(4, len(w) + 5))


def test_pair_models_equal_brute_force(spark, docs, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id: int(r.toxic > 0) for r in labels.collect()}
    scratch = Scratch(spark, "t")
    model = kneser.learn(docs, labels, scratch, head=50)
    ws = {i: toxicity.tokens(t) for i, t in texts.items()}
    pairs, before, words = ({}, {}), ({}, {}), (set(), set())
    for i, c in toxic.items():
        if not held_out(i):
            for v, w in zip([b"", *ws[i]], ws[i]):
                pairs[c][v, w] = pairs[c].get((v, w), 0) + 1
                before[c].setdefault(w, set()).add(v)
                words[c].add(w)

    def off(counts):
        y = [sum(x == k for x in counts) for k in (1, 2, 3, 4)]
        share = y[0] / (y[0] + 2 * y[1])
        return [0, *(min(max(k - (k + 1) * share * y[k] / y[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))]

    spelt, known, one, two, left, after = brute_spelling(words), len(words[0] | words[1]), [], [], [], []
    for c in (0, 1):
        n = {w: len(x) for w, x in before[c].items()}
        d, total = off(n.values()), sum(n.values())
        rest = sum(d[min(x, 3)] for x in n.values()) / total
        one.append(lambda w, n=n, d=d, total=total, rest=rest, c=c: max(n.get(w, 0) - d[min(n.get(w, 0), 3)], 0) / total + rest * (0.25 / known + 0.75 * np.exp(spelt(c, w))))
        left.append(rest)
        two.append(off(pairs[c].values()))
        sums = {}
        for (v, _), x in pairs[c].items():
            total, less = sums.get(v, (0, 0))
            sums[v] = total + x, less + two[c][min(x, 3)]
        after.append(sums)
    alone = {}

    def own(w):
        if w not in alone:
            p = [one[c](w) for c in (0, 1)]
            unknown = w not in words[0] and w not in words[1]
            alone[w] = (p, np.clip(np.log(left[1] / left[0]) + spelt(1, w) - spelt(0, w), -10, 10) if unknown else np.log(p[1] / p[0]))
        return alone[w]

    def gain(v, w):
        p, g = own(w)
        lead = [after[c][v][1] / after[c][v][0] if v in after[c] else 1.0 for c in (0, 1)]
        if (v, w) not in pairs[0] and (v, w) not in pairs[1]:
            return np.log(lead[1] / lead[0]) + g
        q = [(pairs[c].get((v, w), 0) - two[c][min(pairs[c].get((v, w), 0), 3)]) / (after[c][v][0] if v in after[c] else 1) + lead[c] * p[c] for c in (0, 1)]
        return np.log(q[1] / q[0])

    b, some = model.slope, set(sorted(texts)[:400:2]) | {i for i in texts if held_out(i)}
    for r in kneser.score(docs, model, scratch).collect():
        if r.doc_id in some:
            x = ws[r.doc_id]
            g = np.array([own(w)[1] for w in x])
            all_ = np.array([gain(v, w) for v, w in zip([b"", *x], x)])
            z = b[0] + b[1] * all_.mean() + b[2] * np.sqrt(g[g > model.cut / 1e6].sum() / len(g)) if len(g) else 0
            assert abs(r.score - (1 / (1 + np.exp(-z)) if len(g) else model.share)) < 1e-3 and r.held_out == held_out(r.doc_id)


def test_pair_models_held_out(spark):
    folder = "/root/testdata/sf0.1"
    rows, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scratch = Scratch(spark, "t")
    got = kneser.score(rows, kneser.learn(rows, labels, scratch), scratch).where("held_out").join(labels, "doc_id").toPandas()
    toxic, clean = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert (toxic[:, None] > clean[None, :]).mean() > 0.97
    assert (toxic >= 0.5).mean() > 0.9 and (clean >= 0.5).mean() < 0.01


def test_pair_models_shuffle_little(spark):
    """Bytes for each byte of text. Before, with rows of single words and pairs' words named by hashes alone, 4.3."""
    folder, scratch = "/root/testdata/sf0.1", Scratch(spark, "t")
    rows, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert kneser.score(rows, kneser.learn(rows, labels, scratch), scratch).where("score IS NOT NULL").count() == rows.count()
    assert written() - before < 3 * sum(len((r.text or "").encode()) for r in rows.select("text").collect())


def test_pair_models_by_broadcast_or_shuffle(spark, docs, monkeypatch):
    labels, scratch = spark.read.parquet(f"{SF}/labels.parquet"), Scratch(spark, "t")
    scores = lambda: sorted((r.doc_id, r.score) for r in kneser.score(docs, kneser.learn(docs, labels, scratch), scratch).collect())
    few = scores()
    monkeypatch.setattr(kneser, "LABELS", 0)
    assert scores() == few


def test_pair_models_words_and_counts():
    texts = ["A b, a-B é", None, "", " . ", "b", "é\xa0x a"]
    words, at, before, of = kneser.places(texts)
    assert [[words[k] for k in at[of == i]] for i in range(len(texts))] == [toxicity.tokens(t) for t in texts]
    assert [words[k] for k in before] == [w for t in texts for w in [b"", *toxicity.tokens(t)][:-1]]
    rng = np.random.default_rng(3)
    small = [rng.integers(0, 4, 500) for _ in range(3)]
    wide = [x << 40 for x in small]  # too wide for one number
    assert [x.tolist() for x in kneser.tally(*small)] == [(x if k == 3 else x >> 40).tolist() for k, x in enumerate(kneser.tally(*wide))]
    parts = [(rng.integers(0, 9, 200).astype(np.uint64), rng.integers(0, 9, 200).astype(np.uint64), rng.integers(0, 5, (4, 200))) for _ in range(3)]
    at_once, stepwise = kneser.merged(parts), kneser.merged([kneser.merged(parts[:2]), parts[2]])
    assert all((x == y).all() for x, y in zip(at_once, stepwise)) and at_once[2].sum() == sum(p[2].sum() for p in parts)
    names = kneser.Names([b"often", b"more"], 7)
    ids = names.ids([b"more", b"", b"rare", b"often"])
    assert ids.tolist()[:2] == [2, 0] and ids[3] == 1 and ids[2] >= 1 << 63
    assert names.group(ids).tolist() == (kneser.hashes([b"more", b"", b"rare", b"often"]) % 7).tolist()
    assert kneser.short(ids).tolist() == [2, 0, int(ids[2]) % 2**40 + 2**40, 1]


# ---- media


def test_media_equal_by_hand(spark, texts):
    rows = both(texts)
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in media.media_features(frame, Scratch(spark, "m")).collect()}
    for k, (_, text) in enumerate(rows):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert got[k].media_sha256 == hashlib.sha256(media.to_png(payload)).hexdigest()


def test_interleaving_keeps_order_and_captions():
    page = '<!DOCTYPE html><p>one</p><figure><img src="media:x" alt="alt"><figcaption>cap &amp; more</figcaption></figure>two<script>no<b></script><img src=y>'
    assert [(s["kind"], s["text"] or s["reference"], s["caption"]) for s in media.interleave(page)] == [("text", "one", None), ("media", "media:x", "cap & more"), ("text", "two", None), ("media", "y", None)]
    assert media.interleave(None) == []


def test_missing_payload_keeps_its_place(spark):
    pages = media.parse_pages(spark.createDataFrame([(1, '<img src="media:absent"><p>t</p>')], "page_id long, html string"))
    store = spark.createDataFrame([], "digest string, media binary")
    row = media.resolve(pages, media.read_back(store)).first()
    assert (row.position, row.payload_bytes) == (0, None)


def test_whole_sequences_of_pages(spark, texts):
    own = [texts[i] or "" for i in sorted(texts)[:20]]
    payloads = [media.padded(t.encode()) for t in own]
    digests = [hashlib.sha256(x).hexdigest() for x in payloads]
    store = spark.createDataFrame([(d, bytearray(media.to_png(x))) for d, x in zip(digests[1:], payloads[1:])], "digest string, media binary")
    rows = [(k, media.page_of(t, d) + f"<p>after {k}</p>") for k, (t, d) in enumerate(zip(own, digests))] + [(3, "other page of 3"), (3, "other page of 3"), (None, None)]
    features = Scratch(spark, "m").save(media.read_back(store), "f")
    got = {(r.page_id, r.n, len(r.sequence)): r.sequence for r in media.sequences_of(spark.createDataFrame(rows, "page_id long, html string"), features).collect()}
    assert got[3, 2, 1][0].text == "other page of 3" and got[None, 1, 0] == []
    for k, t in enumerate(own):
        text, image, after = got[k, 1, 3]
        assert (text.position, text.kind, text.text) == (0, "text", " ".join(t.split())) and (after.position, after.text) == (2, f"after {k}")
        assert (image.position, image.reference, image.caption) == (1, f"media:{digests[k]}", f"{len(t)} code points")
        assert image.payload_bytes == (len(payloads[k]) if digests[k] in digests[1:] else None)


def test_pages_are_parsed_whole(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = media.sequences_of(pages, spark.createDataFrame([], spark.createDataFrame([], "digest string, payload_bytes long").schema)).collect()
    assert len(got) == len(html)
    for r in got:
        seen = [s.text for s in r.sequence]
        assert [s.position for s in r.sequence] == list(range(len(seen))) and {s.kind for s in r.sequence} <= {"text"}
        plain = re.sub(r"<script.*?</script>|<style.*?</style>|<head.*?</head>|<!--.*?-->", "", html[r.page_id] or "", flags=re.S)
        words = media.html.unescape(re.sub(r"<[A-Za-z/!][^>]*>", " ", plain)).split()
        assert "".join(" ".join(seen).split()) == "".join(words)


def test_damaged_media_raises():
    png = bytearray(media.to_png(bytes(64)))
    png[-20] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(png))


# ---- mixing


def brute_targets(sizes):
    weight = dict(zip(sorted(s for s in sizes if s is not None), (5, 2, 1) * len(sizes)))
    if None in sizes:
        weight[None] = (5, 2, 1)[len(weight) % 3]
    fixed = {}
    while True:
        free = [s for s in weight if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        own = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if own[s] > 3 * sizes[s]]
        if not above:
            return own | fixed
        fixed |= {s: 3.0 * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"z": 3, None: 50, "b": 0}, {"a": 1}])
def test_targets(sizes):
    got, expected = mixing.targets(sizes), brute_targets(sizes)
    assert all(abs(got[s] - expected[s]) < 1e-6 for s in sizes)


def brute_seats(votes, seats, ceilings):
    got = [0] * len(votes)
    for _ in range(seats):
        free = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if got[i] < ceilings[i] and votes[i] > 0]
        if free:
            got[min(free)[1]] += 1
    return got


def test_seats_equal_the_slow_way():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 8)
        votes, ceilings = [float(rng.randrange(0, 50)) for _ in range(n)], [rng.randrange(0, 30) for _ in range(n)]
        seats = rng.randrange(0, 60)
        assert mixing.sainte_lague(votes, seats, ceilings) == brute_seats(votes, seats, ceilings)


def test_large_sources_get_their_words():
    """250 M documents of 400 words a source in shards of 4,096, and a source that is at its ceiling."""
    rows = 250_000_000
    for names, n in ((("a", "b", "c"), (rows, rows, rows)), (("a", "b", "c"), (20_000_000, 20_000_000, 400_000))):
        sizes = {s: 400 * k for s, k in zip(names, n)}
        per_shard = {s: max(4096, -(-k // 60_000)) for s, k in zip(names, n)}
        shards = {s: [(i, 400 * min(per_shard[s], k - at)) for i, at in enumerate(range(0, k, per_shard[s]))] for s, k in zip(names, n)}
        target = mixing.targets(sizes)
        quotas = mixing.shard_quotas(shards, target, 1024, 7)
        for s in names:
            words = dict(shards[s])
            got = sum(full * words[shard] + taken_of(words[shard], 1024, *order) for source, shard, full, *order in quotas if source == s)
            assert abs(got - target[s]) <= 1024 + 1 and got <= 3 * sizes[s]


def taken_of(words, block, blocks, a, b, whole, rest):
    """Words taken of a shard's blocks, one by one."""
    if blocks > 5000:  # all but the last are whole
        last = (a * (blocks - 1) + b) % blocks
        return whole * block - (blocks * block - words if last < whole else 0) + rest
    out, lengths = 0, [block] * (blocks - 1) + [words - block * (blocks - 1)]
    numbers = [(a * j + b) % blocks for j in range(blocks)]
    assert sorted(numbers) == list(range(blocks))
    for n, k in zip(numbers, lengths):
        out += k if n < whole else min(k, rest) if n == whole else 0
        assert n != whole or rest <= k
    return out


def brute_mix(rows, seed=7, shard_rows=4096, block=1024):
    """``rows``: doc_id, source, size and the hashes (shard, order). The words that the mix takes of each."""
    sizes = {}
    for _, source, size, *_ in rows:
        sizes[source] = sizes.get(source, 0) + size
    target = mixing.targets(sizes)
    block = max(1, min(block, int(min(t for t in target.values() if t > 0) / 2000)))
    shards = {}
    for i, source, size, shard, order in rows:
        shards.setdefault((source, shard), []).append((order, i, size))
    listed = {s: sorted((k, sum(x[2] for x in own)) for (z, k), own in shards.items() if z == s) for s in target}
    taken = {}
    for source, shard, full, blocks, a, b, whole, rest in mixing.shard_quotas(listed, target, block, seed):
        chosen, at = [], 0
        for j in range(blocks):
            n = (a * j + b) % blocks
            chosen += [n < whole or (n == whole and k < rest) for k in range(block)]
        for _, i, size in sorted(shards[source, shard]):
            taken[i] = full * size + sum(chosen[at : at + size])
            at += size
    return taken


@pytest.mark.parametrize("shard_rows", [4096, 100])
def test_mix_equals_word_by_word(spark, docs, shard_rows):
    measured = Scratch(spark, "x").save(mixing.measure(docs), "m")
    counts = {r.source: r["count"] for r in measured.groupBy("source").count().collect()}
    hashed = measured.selectExpr("doc_id", "source", "size", "xxhash64(7, doc_id, print) AS h", "xxhash64(8, doc_id, print) AS o").collect()
    rows = [(r.doc_id, r.source, r["size"], r.h % -(-counts[r.source] // shard_rows), r.o) for r in hashed]
    got = {r.doc_id: r.taken for r in mixing.mix(measured, shard_rows=shard_rows).collect()}
    assert got == brute_mix(rows, shard_rows=shard_rows)


def test_mix_is_near_its_targets_and_repeats_itself(spark, docs):
    one, two = (mixing.plan(docs.repartition(n), Scratch(spark, "x")).toPandas().sort_values("doc_id").reset_index(drop=True) for n in (2, 7))
    assert one.equals(two)
    one["source"] = one.merge(docs.select("doc_id", "source").toPandas(), on="doc_id")["source"]
    by = one.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 0.001 * by.target + 2).all()
    assert (one.taken <= 3 * one["size"]).all() and abs(one.target.groupby(one.source).first().sum() - one["size"].sum()) < 1


def test_equal_rows_of_the_mix_each_have_their_place(spark):
    rows = [(k % 3, f"w{k % 3} " * 40, "en", "a" if k % 2 else None) for k in range(60)] + [(None, "x y z", "en", "b")] * 4
    frame = documents(spark, rows)
    want = sum(r.taken for r in mixing.plan(frame, Scratch(spark, "x")).collect())
    made = mixing.materialise(frame, Scratch(spark, "y"))
    assert made.columns == frame.columns and sum(mixing.words_of(r.text) for r in made.collect()) == want > 0


def test_materialised_mix_has_the_taken_words(spark, docs):
    plan = {r.doc_id: r.taken for r in mixing.plan(docs, Scratch(spark, "x")).collect()}
    made = mixing.materialise(docs, Scratch(spark, "y"))
    assert made.columns == docs.columns
    got = {}
    for r in made.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + mixing.words_of(r.text)
        assert r.n_chars == len(r.text)
    assert got == {i: n for i, n in plan.items() if n}
