"""Labels, verdicts, samples and scalar functions, over conversations, documents and fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import labels as L
from ..operators import verdicts as V
from .registry import query, table

#: Judged texts: entities as text:type, joined by |; replies are raw model output.
JUDGED = """SELECT * FROM (VALUES
 (1, 'Ann Lee met Bob at Acme in Paris', 'Ann Lee:PER|Bob:PERSON|Acme:COMPANY|Paris:GPE', 'noise {"x": 1} {"correct": false, "false_positives": ["Bob"], "missed_entities": [{"text": "Paris", "type": "PLACE"}], "confidence": "high"} tail'),
 (2, 'Write to joe@example.org or Joe Doe', 'joe@example.org:PERSON|Joe Doe:PER|Joe Doe:PERSON', '{"correct": true, "false_positives": [], "missed_entities": [{"text": "joe@example.org", "type": "EMAIL"}, {"text": "Joe Doe", "type": "PER"}], "confidence": "medium"}'),
 (3, 'The server 10.0.0.1 of Globex is down', 'server:MISC|Globex:ORGANIZATION', 'broken {"correct": true'),
 (4, 'He said that Initech, not Umbrella...', 'He:PERSON|Initech:ORG|Umbrella:ORG', '{"correct": false, "false_positives": ["Umbrella", "Nowhere"], "missed_entities": [{"text": "Hal", "type": "PERSON"}], "confidence": "low"}'),
 (5, 'Rome and rome and Rome again', 'Rome:LOC|rome:LOC|Rome:LOC', '{"correct": false, "false_positives": ["rome", "absent"], "missed_entities": [{"text": "again", "type": "THING"}], "confidence": "high"} {"correct": 1}'),
 (6, 'nothing here', '', 'no json at all'),
 (7, 'Odd replies', '', '{"correct": true, "false_positives": 5, "missed_entities": "none", "confidence": 1}'),
 (8, 'Odder', '', '{"correct": 0, "false_positives": [{"text": 3}, null], "missed_entities": [1, {"type": "ORG"}]}')) AS f(id, text, ents, reply)"""
#: What parsing must give, stated by hand: the oracle cannot match braces.
VERDICTS = """SELECT * FROM (VALUES
 (1, false, 'Bob', 'Paris:PLACE', 'high'), (2, true, '', 'joe@example.org:EMAIL|Joe Doe:PER', 'medium'), (3, false, '', '', 'low'),
 (4, false, 'Umbrella|Nowhere', 'Hal:PERSON', 'low'), (5, false, 'rome|absent', 'again:THING', 'high'), (6, false, '', '', 'low'), (7, true, '', '', '1'), (8, false, '3|None', ':ORG', 'low')) AS v(id, correct, fps, missed, confidence)"""


def _pairs(column: str):
    return F.expr(f"transform(filter(split({column}, '[|]'), x -> x <> ''), x -> named_struct('text', substring_index(x, ':', 1), 'type', substring_index(x, ':', -1)))")


def judged(spark):
    rows = spark.sql(JUDGED).withColumn("ents", _pairs("ents"))
    return rows.withColumn("verdict", V.parse(F.col("reply"))).withColumn("valid", V.validate(F.col("verdict"), F.col("text")))


def _list(column: str) -> str:
    return f"list_filter(string_split({column}, '|'), lambda x: x <> '')"


_ALIAS = "CASE upper({t}) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.TYPE_ALIASES.items()) + " ELSE upper({t}) END"
_TEXT, _TYPE = "split_part({x}, ':', 1)", "split_part({x}, ':', -1)"
_NOT_NAME = "'" + T.NON_NAME + "'"
_FPS = f"CASE WHEN confidence = 'high' THEN list_filter({_list('fps')}, lambda x: contains(text, x)) ELSE [] END"
_M = _TYPE.format(x="x")
_MISSED = (
    f"list_transform(list_filter({_list('missed')}, lambda x: {_ALIAS.format(t=_M)} IN ('PERSON', 'ORG', 'LOC') AND NOT regexp_matches({_TEXT.format(x='x')}, '{T.NON_NAME}|^\\[') AND contains(text, {_TEXT.format(x='x')})),"
    f" lambda x: {_TEXT.format(x='x')} || ':' || {_ALIAS.format(t=_M)})"
)
_JOINED = f"({JUDGED.replace('SELECT *', 'SELECT id, text, ents', 1)})"
VALID = f"(SELECT j.id, text, ents, correct, confidence, {_FPS} AS fp, {_MISSED} AS ms FROM {_JOINED} j JOIN ({VERDICTS}) USING (id))"
_SHOW = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["text"], F.lit(":"), e["type"])), "|")


@query(f"SELECT id, correct, fps, missed, confidence FROM ({VERDICTS})")
def fn_last_valid_json(spark, sf_dir):
    v = F.col("verdict")
    return judged(spark).select("id", v["correct"].alias("correct"), F.array_join(v["false_positives"], "|").alias("fps"), _SHOW(v["missed_entities"]).alias("missed"), v["confidence"].alias("confidence"))


@query(f"SELECT id, array_to_string(fp, '|') AS fps, array_to_string(ms, '|') AS missed, correct, confidence FROM {VALID}")
def fn_validate_verdict(spark, sf_dir):
    v = F.col("valid")
    return judged(spark).select("id", F.array_join(v["false_positives"], "|").alias("fps"), _SHOW(v["missed_entities"]).alias("missed"), v["correct"].alias("correct"), v["confidence"].alias("confidence"))


@query(f"SELECT id, CAST(len(fp) AS DOUBLE) AS score FROM {VALID}")
def fn_disagreement_simple(spark, sf_dir):
    return judged(spark).select("id", V.simple_score(F.col("valid")).alias("score"))


@query(f"SELECT id, round((len(fp) * 0.3 + len(ms) * 0.7) * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.3 ELSE 0.7 END, 6)::DOUBLE AS score FROM {VALID}")
def fn_disagreement_weighted(spark, sf_dir):
    return judged(spark).select("id", F.round(V.weighted_score(F.col("valid")), 6).alias("score"))


@query("SELECT doc_id, length(p) AS n, md5(p) AS preview_md5 FROM (SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS p FROM documents)")
def fn_text_preview(spark, sf_dir):
    p = T.preview(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(p).cast("long").alias("n"), F.md5(p).alias("preview_md5"))


@query(f"SELECT id, 'Text: ' || text || chr(10) || 'Entities: ' || CASE WHEN len({_list('ents')}) = 0 THEN 'no entities' ELSE array_to_string(list_transform({_list('ents')}, lambda x: '\"' || split_part(x, ':', 1) || '\" as ' || split_part(x, ':', -1)), ', ') END AS prompt FROM ({JUDGED})")
def fn_build_prompt(spark, sf_dir):
    return judged(spark).select("id", V.prompt(F.col("text"), F.col("ents")).alias("prompt"))


_OWN = f"(SELECT id, text, t AS et, k, min(n) AS n FROM (SELECT id, text, split_part(x, ':', 1) AS t, {_ALIAS.format(t=_TYPE.format(x='x'))} AS k, n FROM (SELECT id, text, unnest({_list('ents')}) AS x, generate_subscripts({_list('ents')}, 1) AS n FROM ({JUDGED}))) WHERE k IN ('PERSON','ORG','LOC','EMAIL','PHONE','MISC') AND contains(text, t) AND NOT regexp_matches(t, {_NOT_NAME}) GROUP BY id, text, t, k)"


@query(f"SELECT id, et || ':' || k AS entity FROM {_OWN}")
def dst_entity(spark, sf_dir):
    rows = spark.sql(JUDGED).withColumn("ents", _pairs("ents"))
    empty = F.expr(f"named_struct('correct', true, 'false_positives', CAST(array() AS ARRAY<STRING>), 'missed_entities', CAST(array() AS ARRAY<{V.ENTITY}>), 'confidence', 'low')")
    own = rows.select("id", F.explode(V.true_entities(F.col("text"), F.col("ents"), empty)).alias("e"))
    return own.select("id", F.concat("e.text", F.lit(":"), "e.type").alias("entity"))


@query(f"SELECT o.id, et || ':' || k AS entity FROM {_OWN} o JOIN {VALID} v ON v.id = o.id WHERE NOT list_contains(fp, et)")
def join_fp_anti(spark, sf_dir):
    v = F.col("valid")
    none_missed = F.struct(v["correct"].alias("correct"), v["false_positives"].alias("false_positives"), F.expr(f"CAST(array() AS ARRAY<{V.ENTITY}>)").alias("missed_entities"), v["confidence"].alias("confidence"))
    kept = judged(spark).select("id", F.explode(V.true_entities(F.col("text"), F.col("ents"), none_missed)).alias("e"))
    return kept.select("id", F.concat("e.text", F.lit(":"), "e.type").alias("entity"))


_TRUE = f"""(WITH kept AS (SELECT o.id, et, k FROM {_OWN} o JOIN {VALID} v ON v.id = o.id WHERE NOT list_contains(fp, et)),
m AS (SELECT id, split_part(x, ':', 1) AS et, split_part(x, ':', -1) AS k FROM (SELECT id, unnest(ms) AS x FROM {VALID}))
SELECT id, et, k FROM kept UNION ALL SELECT m.id, m.et, min(m.k) FROM m ANTI JOIN kept ON kept.id = m.id AND kept.et = m.et GROUP BY ALL)"""


@query(f"SELECT id, et || ':' || k AS entity FROM {_TRUE}")
def join_missed_add(spark, sf_dir):
    kept = judged(spark).select("id", F.explode(V.true_entities(F.col("text"), F.col("ents"), F.col("valid"))).alias("e"))
    return kept.select("id", F.concat("e.text", F.lit(":"), "e.type").alias("entity"))


@query(f"SELECT id, text, 'llm-validated' AS source, coalesce((SELECT string_agg(et || ':' || k, '|' ORDER BY et, k) FROM {_TRUE} t WHERE t.id = j.id), '') AS entities FROM ({JUDGED}) j")
def snk_dataset(spark, sf_dir):
    from ..sources import records

    rows = judged(spark).select("id", "text", V.true_entities(F.col("text"), F.col("ents"), F.col("valid")).alias("entities"), F.lit("llm-validated").alias("source"))
    back = records.write_and_read(rows, "dataset")
    return back.select("id", "text", "source", F.array_join(F.array_sort(F.transform("entities", lambda e: F.concat(e["text"], F.lit(":"), e["type"]))), "|").alias("entities"))


@query(f"SELECT id, split_part(x, ':', -1) AS raw, CASE WHEN {_ALIAS.format(t=_M)} IN ('PERSON','ORG','LOC','EMAIL','PHONE','MISC') THEN {_ALIAS.format(t=_M)} END AS type FROM (SELECT id, unnest({_list('ents')}) AS x FROM ({JUDGED}))")
def fn_type_alias(spark, sf_dir):
    each = spark.sql(JUDGED).select("id", F.explode(_pairs("ents")).alias("e"))
    return each.select("id", F.col("e.type").alias("raw"), T.type_alias(F.col("e.type")).alias("type"))


@query(f"SELECT id, split_part(x, ':', 1) AS entity, NOT regexp_matches(split_part(x, ':', 1), {_NOT_NAME}) AS name_like FROM (SELECT id, unnest({_list('ents')}) AS x FROM ({JUDGED}))")
def fn_non_name(spark, sf_dir):
    each = spark.sql(JUDGED).select("id", F.explode(_pairs("ents")).alias("e"))
    return each.select("id", F.col("e.text").alias("entity"), T.is_name_like(F.col("e.text")).alias("name_like"))


@query(f"SELECT id, split_part(x, ':', 1) AS entity FROM (SELECT id, unnest({_list('ents')}) AS x FROM ({JUDGED})) WHERE NOT (lower(split_part(x, ':', 1)) IN ('i','you','he','she','it','we','they','the','a','an') OR length(split_part(x, ':', 1)) <= 2)")
def flt_pronoun(spark, sf_dir):
    each = spark.sql(JUDGED).select("id", F.explode(_pairs("ents")).alias("e")).select("id", F.col("e.text").alias("entity"))
    return each.where(~T.is_pronoun_or_short(F.col("entity")))


@query(f"SELECT id, CAST(len(fp) AS DOUBLE) AS score FROM (SELECT *, sum(CASE WHEN len(fp) > 0 THEN 1 ELSE 0 END) OVER (ORDER BY id) AS hits FROM {VALID} WHERE id <= 5) WHERE len(fp) > 0 AND hits <= 1")
def lim_disagreements(spark, sf_dir):
    return V.up_to_limit(judged(spark).select("id", V.simple_score(F.col("valid")).alias("score")), "id", "score", limit=1, most=5)


# ---- sequences -----------------------------------------------------------------------------------------------------------

_TOK = "regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')"
_IO = "CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'PER' WHEN contains(w, '.') THEN 'LOC' WHEN length(w) > 9 THEN 'ORG' ELSE 'O' END"
_IO2 = "CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'PER' WHEN contains(w, '.') THEN 'ORG' WHEN length(w) > 10 THEN 'ORG' ELSE 'O' END"
_TURNS = "(SELECT row_number() OVER (ORDER BY conv_id, turn) AS seq, conv_id, turn, text FROM conversations)"


def _bio_sql(rule: str) -> str:
    return f"(SELECT conv_id, turn, i, CASE WHEN t = 'O' THEN 'O' WHEN t = lag(t) OVER (PARTITION BY conv_id, turn ORDER BY i) THEN 'I-' || t ELSE 'B-' || t END AS label FROM (SELECT conv_id, turn, i, {rule} AS t FROM (SELECT conv_id, turn, unnest({_TOK}) AS w, generate_subscripts({_TOK}, 1) AS i FROM conversations)))"


def _tagged(spark, sf_dir):
    """Turns with rule-made inside tags: two taggers that differ."""
    words = T.tokens(F.col("text"))
    one = lambda w: F.when(w.rlike("^[A-Z]"), "PER").when(F.contains(w, F.lit(".")), "LOC").when(F.length(w) > 9, "ORG").otherwise("O")
    two = lambda w: F.when(w.rlike("^[A-Z]"), "PER").when(F.contains(w, F.lit(".")), "ORG").when(F.length(w) > 10, "ORG").otherwise("O")
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", L.io_to_bio(F.transform(words, one)).alias("gold"), L.io_to_bio(F.transform(words, two)).alias("found"))


@query(f"SELECT conv_id, turn, string_agg(label, ' ' ORDER BY i) AS labels FROM {_bio_sql(_IO)} GROUP BY conv_id, turn")
def win_io_to_bio(spark, sf_dir):
    return _tagged(spark, sf_dir).where("size(gold) > 0").select("conv_id", "turn", F.array_join("gold", " ").alias("labels"))


_KNOWN = ", ".join(f"('{x}')" for x in L.LABELS)


@query(f"WITH c AS (SELECT label, count(*) AS n FROM {_bio_sql(_IO)} GROUP BY label), f AS (SELECT k.label, coalesce(n, 0) AS n FROM (VALUES {_KNOWN}) k(label) LEFT JOIN c USING (label)) SELECT label, n, CAST(sum(n) OVER () AS BIGINT) AS total, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM f")
def agg_label_distribution(spark, sf_dir):
    return L.distribution(_tagged(spark, sf_dir), "gold").select("label", "n", "total", F.round("percent", 6).alias("percent"))


def _chunks_sql(rule: str) -> str:
    return f"(SELECT conv_id, turn, type, min(i) AS a, max(i) AS b FROM (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS c FROM (SELECT *, substr(label, 3) AS type, label LIKE 'B-%' OR (label <> 'O' AND substr(label, 3) IS DISTINCT FROM lag(CASE WHEN label <> 'O' THEN substr(label, 3) END) OVER (PARTITION BY conv_id, turn ORDER BY i)) AS starts FROM {_bio_sql(rule)})) WHERE label <> 'O' GROUP BY conv_id, turn, c, type)"


@query(f"""WITH g AS {_chunks_sql(_IO)}, p AS {_chunks_sql(_IO2)}, n AS (SELECT (SELECT count(*) FROM g) AS n_true, (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM g JOIN p USING (conv_id, turn, type, a, b)) AS n_right)
SELECT n_true, n_predicted, n_right, round(n_right / n_predicted, 9) AS precision, round(n_right / n_true, 9) AS recall, round(2.0 * n_right / (n_true + n_predicted), 9) AS f1 FROM n""")
def agg_seq_f1(spark, sf_dir):
    return L.seq_f1(_tagged(spark, sf_dir), "gold", "found", "conv_id", "turn").select("n_true", "n_predicted", "n_right", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


#: Whole answer by hand-checked SQL: character positions of first occurrences, later entities over earlier ones.
@query(
    f"""WITH tok AS (SELECT id, text, ents, w, i, CAST(coalesce(sum(length(w) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM (SELECT id, text, ents, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM ({JUDGED}))),
m AS (SELECT id, n, split_part(x, ':', -1) AS k, instr(text, split_part(x, ':', 1)) - 1 AS a, length(split_part(x, ':', 1)) AS len FROM (SELECT id, text, unnest({_list('ents')}) AS x, generate_subscripts({_list('ents')}, 1) AS n FROM ({JUDGED}))),
k AS (SELECT tok.id, i, coalesce(arg_max(m.k, m.n), 'O') AS k FROM tok LEFT JOIN m ON m.id = tok.id AND m.a >= 0 AND m.a <= s AND s < m.a + m.len GROUP BY tok.id, i)
SELECT id, string_agg(CASE WHEN k = 'O' THEN 'O' WHEN k = p OR (p <> 'O' AND suffix(p, k)) THEN 'I-' || k ELSE 'B-' || k END, ' ' ORDER BY i) AS labels FROM (SELECT *, coalesce(lag(k) OVER (PARTITION BY id ORDER BY i), 'O') AS p FROM k) GROUP BY id"""
)
def win_bio_encode(spark, sf_dir):
    rows = spark.sql(JUDGED).withColumn("ents", _pairs("ents"))
    return rows.select("id", F.array_join(L.bio_encode(F.col("text"), F.col("ents")), " ").alias("labels"))


@query(
    f"""WITH tok AS (SELECT id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM ({JUDGED})),
m AS (SELECT id, n, split_part(x, ':', 1) AS t, split_part(x, ':', -1) AS k FROM (SELECT id, unnest({_list('ents')}) AS x, generate_subscripts({_list('ents')}, 1) AS n FROM ({JUDGED})))
SELECT id, string_agg(l, ' ' ORDER BY i) AS labels FROM (SELECT tok.id, i, coalesce('B-' || arg_max(m.k, m.n), 'O') AS l FROM tok LEFT JOIN m ON m.id = tok.id AND length(t) > 0 AND contains(lower(w), lower(t)) GROUP BY tok.id, i) GROUP BY id"""
)
def win_bio_eval(spark, sf_dir):
    rows = spark.sql(JUDGED).withColumn("ents", _pairs("ents"))
    return rows.select("id", F.array_join(L.bio_eval(T.tokens(F.col("text")), F.col("ents")), " ").alias("labels"))


@query(f"SELECT doc_id, CAST(s AS BIGINT) AS first, CAST(least(15, n - s) AS BIGINT) AS n_tokens, md5(array_to_string(tok[s + 1 : s + 15], ' ')) AS window_md5 FROM (SELECT doc_id, tok, len(tok) AS n, unnest(range(0, len(tok) - 6, 10)) AS s FROM (SELECT doc_id, {_TOK} AS tok FROM documents)) WHERE n - s >= 6")
def win_sliding_tokens(spark, sf_dir):
    from ..operators import windows as W

    return W.sliding(table(spark, sf_dir, "documents").select("doc_id", "text"), 15, 10, 6).select("doc_id", F.col("first").cast("long").alias("first"), F.size("window").cast("long").alias("n_tokens"), F.md5(F.array_join("window", " ")).alias("window_md5"))


@query(f"""WITH t AS (SELECT doc_id, {_TOK} AS tok, string_split_regex(text, '[^ \\t\\n\\r\\f]+') AS gap FROM documents)
SELECT doc_id, CAST(c AS BIGINT) AS chunk_no, CAST(least(450, len(tok) - 400 * c) AS BIGINT) AS n_tokens, CAST(list_sum(list_transform(gap[1 : 400 * c + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(tok[1 : 400 * c], lambda g: length(g))), 0) AS BIGINT) AS char_offset, md5(array_to_string(tok[400 * c + 1 : 400 * c + 450], ' ')) AS chunk_md5
FROM (SELECT *, unnest(range(0, 1 + CAST(ceil(greatest(len(tok) - 450, 0) / 400.0) AS BIGINT))) AS c FROM t WHERE len(tok) > 0)""")
def ner_chunk(spark, sf_dir):
    from ..operators import windows as W

    made = W.model_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "chunk_no", F.size("chunk").cast("long").alias("n_tokens"), "char_offset", F.md5(F.array_join("chunk", " ")).alias("chunk_md5"))


# ---- label ids -----------------------------------------------------------------------------------------------------------

#: words, label names, sub-word owners ('-' is a special token), predicted ids by sub-word
ALIGNED = """SELECT * FROM (VALUES
 (1, 'Ann Lee lives in Paris', 'B-PER I-PER O O B-LOC', '- 0 0 1 2 2 3 4 4 -', '0 1 2 2 0 0 0 0 6 0'),
 (2, 'Acme Corp', 'B-ORG I-ORG', '- 0 1 1 -', '0 3 4 4 0'),
 (3, 'weird tags', 'B-XYZ O', '0 1 1', '0 0 0')) AS f(id, words, labels, owners, predicted)"""
_NAMES = "[" + ", ".join(f"'{x}'" for x in L.LABELS) + "]"
_IDS = f"list_transform(string_split(labels, ' '), lambda x: coalesce(list_position({_NAMES}, x) - 1, 0))"


def _aligned(spark):
    words = lambda c: F.split(c, " ")
    return spark.sql(ALIGNED).select(
        "id", words("words").alias("words"), L.label_ids(words("labels")).alias("ids"), F.transform(words("owners"), lambda o: F.when(o != "-", o.cast("int"))).alias("owners"), F.transform(words("predicted"), lambda p: p.cast("int")).alias("predicted"),
    )


@query(f"SELECT id, array_to_string({_IDS}, ' ') AS ids FROM ({ALIGNED})")
def fn_label_remap(spark, sf_dir):
    return _aligned(spark).select("id", F.array_join(F.transform(L.clamp_ids(F.col("ids")), lambda x: x.cast("string")), " ").alias("ids"))


@query(f"""WITH o AS (SELECT id, i, own, lag(own) OVER (PARTITION BY id ORDER BY i) AS prev, {_IDS}[CAST(nullif(own, '-') AS INT) + 1] AS l FROM (SELECT id, labels, unnest(string_split(owners, ' ')) AS own, generate_subscripts(string_split(owners, ' '), 1) AS i FROM ({ALIGNED})))
SELECT id, string_agg(CASE WHEN own = '-' THEN -100 WHEN prev IS DISTINCT FROM own THEN l WHEN l = 0 THEN -100 WHEN l % 2 = 1 THEN l + 1 ELSE l END, ' ' ORDER BY i) AS aligned FROM o GROUP BY id""")
def fn_tokenize_align(spark, sf_dir):
    return _aligned(spark).select("id", F.array_join(F.transform(L.align(F.col("owners"), F.col("ids")), lambda x: x.cast("string")), " ").alias("aligned"))


@query(f"""WITH o AS (SELECT id, i, own, lag(own) OVER (PARTITION BY id ORDER BY i) AS prev, {_IDS}[CAST(nullif(own, '-') AS INT) + 1] AS l FROM (SELECT id, labels, unnest(string_split(owners, ' ')) AS own, generate_subscripts(string_split(owners, ' '), 1) AS i FROM ({ALIGNED})))
SELECT id, count(*) FILTER (WHERE own <> '-' AND l > 0) AS n_entity_subwords, count(*) FILTER (WHERE own = '-' OR (prev IS NOT DISTINCT FROM own AND l = 0)) AS n_ignored FROM o GROUP BY id""")
def fn_trainer_align(spark, sf_dir):
    """The simpler aligner, in its corrected form: every sub-word keeps its own word's label."""
    a = L.align(F.col("owners"), F.col("ids"))
    return _aligned(spark).select("id", F.size(F.filter(a, lambda x: x > 0)).cast("long").alias("n_entity_subwords"), F.size(F.filter(a, lambda x: x == -100)).cast("long").alias("n_ignored"))


@query(f"""WITH w AS (SELECT id, i, w, {_IDS}[i] AS g, CAST(coalesce(string_split(predicted, ' ')[list_position(string_split(owners, ' '), CAST(i - 1 AS VARCHAR))], '0') AS INT) AS p FROM (SELECT *, unnest(string_split(words, ' ')) AS w, generate_subscripts(string_split(words, ' '), 1) AS i FROM ({ALIGNED})))
SELECT id, string_agg(w || ' ' || g || ' ' || p || CASE WHEN g <> p THEN ' *' ELSE '' END, '|' ORDER BY i) AS shown FROM w GROUP BY id""")
def fn_sample_predictions(spark, sf_dir):
    return _aligned(spark).select("id", F.array_join(L.sample_predictions(F.col("words"), F.col("ids"), F.col("owners"), F.col("predicted")), "|").alias("shown"))


@query(f"SELECT conv_id, turn, md5(lower(array_to_string({_TOK}, ' '))) AS words_md5 FROM conversations WHERE text IS NOT NULL")
def fn_lowercase_tokens(spark, sf_dir):
    low = F.transform(T.tokens(F.col("text")), lambda w: F.lower(w))
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.md5(F.array_join(low, " ")).alias("words_md5"))


@query(f"SELECT conv_id, turn, CAST(len({_TOK}) AS BIGINT) AS n, CAST(0 AS BIGINT) AS total FROM conversations WHERE text IS NOT NULL")
def fn_all_o(spark, sf_dir):
    zeros = F.transform(T.tokens(F.col("text")), lambda w: F.lit(0).cast("long"))
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.size(zeros).cast("long").alias("n"), F.aggregate(zeros, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"SELECT doc_id, array_to_string(ids[1:40], ' ') AS ids FROM (SELECT doc_id, list_filter({_TOK}, lambda w: regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]{{1,}}$')) AS ids FROM documents) WHERE len(ids) >= 6")
def fn_identifier_filter(spark, sf_dir):
    kept = table(spark, sf_dir, "documents").select("doc_id", T.identifiers(T.tokens(F.col("text"))).alias("ids"))
    return kept.where("ids IS NOT NULL").select("doc_id", F.array_join("ids", " ").alias("ids"))


_CODE = """SELECT * FROM (VALUES (1, 'x = 1  # note' || chr(10) || 'y = "a # b"'), (2, '/* c */ int a = 2; // d' || chr(10) || 'char *s = "e \\" f";'), (3, 'd = \"\"\"one' || chr(10) || 'two "x" \"\"\" + name'), (4, 's = ' || repeat(chr(39), 3) || 'a' || chr(10) || repeat(chr(39), 3) || ' z'), (5, 'open " end'), (6, '')) AS f(id, code)"""


@query("SELECT * FROM (VALUES (1, 'x = 1   ' || chr(10) || 'y =  '), (2, '  int a = 2;  ' || chr(10) || 'char *s =  ;'), (3, 'd =   + name'), (4, 's =   z'), (5, 'open \" end'), (6, '')) f(id, bare)")
def fn_strip_code(spark, sf_dir):
    return spark.sql(_CODE.replace("\\", "\\\\")).select("id", T.strip_code(F.col("code")).alias("bare"))


@query("SELECT part, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi FROM (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor((SELECT count(*) FROM documents) * 0.8) THEN 'train' ELSE 'test' END AS part FROM documents) GROUP BY part")
def split_80_20(spark, sf_dir):
    return V.ordered_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
