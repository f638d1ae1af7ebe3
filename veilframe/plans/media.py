"""Recognised words, provider tables, binary bodies, streams, and the remaining aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from ..operators import generators as G
from ..operators import mappings as M
from ..operators import ner as N
from ..operators import ocr as O
from ..sources import bodies as B
from ..sources import records
from ..streaming import events as E
from .detection import ASSIGNED, REDACTED, TESTS, TEXTS, found_sql, resolved, texts
from .registry import query, table

#: Words of two images with their boxes.
REGIONS = """SELECT * FROM (VALUES
 ('a', 'mail', 10, 10, 50, 30), ('a', 'joe@example', 60, 11, 170, 31), ('a', '.org', 176, 12, 210, 30), ('a', 'second', 12, 60, 80, 80), ('a', 'line', 90, 62, 130, 81),
 ('b', 'Ann', 5, 5, 35, 25), ('b', 'Lee', 40, 9, 70, 28), ('b', 'below', 5, 100, 60, 120)) AS r(image_id, text, left_, top_, right_, bottom_)"""


def regions(spark):
    return spark.sql(REGIONS).withColumnsRenamed({"left_": "left", "top_": "top", "right_": "right", "bottom_": "bottom"})


def placed(spark):
    return O.offsets(O.group_lines(regions(spark), "image_id"), "image_id")


#: Lines of the fixture, as its tops show them.
LINES = f"(SELECT *, CASE WHEN top_ < 50 THEN 0 ELSE 1 END AS line_no FROM ({REGIONS}))"
PLACED = f"(SELECT *, CAST(sum(length(text) + 1) OVER (PARTITION BY image_id, line_no ORDER BY left_) - 1 AS INT) AS stop, CAST(sum(length(text) + 1) OVER (PARTITION BY image_id, line_no ORDER BY left_) - 1 - length(text) AS INT) AS start FROM {LINES})"


@query(f"SELECT image_id, line_no, text FROM {LINES}")
def win_line_group(spark, sf_dir):
    return O.group_lines(regions(spark), "image_id").select("image_id", "line_no", "text")


@query(f"SELECT image_id, line_no, text, start, stop FROM {PLACED}")
def win_line_offsets(spark, sf_dir):
    return placed(spark).select("image_id", "line_no", "text", "start", "stop")


@query(f"SELECT image_id, string_agg(t, chr(10) ORDER BY line_no) AS text FROM (SELECT image_id, line_no, string_agg(text, ' ' ORDER BY left_) AS t FROM {LINES} GROUP BY ALL) GROUP BY image_id")
def ocr_text(spark, sf_dir):
    return O.page_text(placed(spark), "image_id")


@query(f"SELECT image_id, text, CAST(row_number() OVER (ORDER BY image_id, (top_ + bottom_) / 2, left_) AS BIGINT) AS place FROM ({REGIONS})")
def srt_regions(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.orderBy("image_id", (F.col("top") + F.col("bottom")) / 2, "left")
    return regions(spark).select("image_id", "text", F.row_number().over(order).cast("long").alias("place"))


_ENT = "(SELECT * FROM (VALUES ('a', 0, 5, 16, 'joe@example'), ('b', 0, 1, 5, 'nn L')) e(image_id, line_no, e_start, e_stop, entity))"


def _entities(spark):
    return spark.createDataFrame([("a", 0, 5, 16, "joe@example"), ("b", 0, 1, 5, "nn L")], "image_id string, line_no int, e_start int, e_stop int, entity string")


@query(f"SELECT image_id, line_no, entity, text FROM {_ENT} JOIN {PLACED} USING (image_id, line_no) WHERE start < e_stop AND stop > e_start")
def join_entity_regions(spark, sf_dir):
    return _entities(spark).join(placed(spark), ["image_id", "line_no"]).where("start < e_stop AND stop > e_start").select("image_id", "line_no", "entity", "text")


_CLIP = "left_ + CAST(trunc(({at} - start) / CAST(stop - start AS DOUBLE) * (right_ - left_)) AS INT)"
_BOX = f"(SELECT image_id, line_no, entity, min({_CLIP.format(at='greatest(e_start, start)')}) AS x0, min(top_) AS y0, max(greatest({_CLIP.format(at='least(e_stop, stop)')}, {_CLIP.format(at='greatest(e_start, start)')} + 1)) AS x1, max(bottom_) AS y1 FROM {_ENT} JOIN {PLACED} USING (image_id, line_no) WHERE start < e_stop AND stop > e_start GROUP BY ALL)"


@query(f"SELECT * FROM {_BOX}")
def fn_precise_bbox(spark, sf_dir):
    b = O.boxes(_entities(spark), placed(spark), "image_id")
    return b.select("image_id", "line_no", "entity", F.col("left").alias("x0"), F.col("top").alias("y0"), F.col("right").alias("x1"), F.col("bottom").alias("y1"))


_TLD = f"(SELECT image_id, line_no, entity, x0, y0, CASE WHEN contains(entity, '@') THEN 210 ELSE x1 END AS x1, y1 FROM {_BOX})"


@query(f"SELECT * FROM {_TLD}")
def fn_extend_tld(spark, sf_dir):
    p = placed(spark)
    b = O.extend_over_tld(O.boxes(_entities(spark), p, "image_id"), p, "image_id")
    return b.select("image_id", "line_no", "entity", F.col("left").alias("x0"), F.col("top").alias("y0"), F.col("right").alias("x1"), F.col("bottom").alias("y1"))


@query(f"SELECT image_id, line_no, x0, y0, x1, y1, '[X_' || (row_number() OVER (ORDER BY image_id, line_no, entity) - 1) || ']' AS placeholder FROM {_TLD}")
def redact_image(spark, sf_dir):
    """The boxes to draw, with placeholders in line order; drawing itself is outside."""
    p = placed(spark)
    b = O.extend_over_tld(O.boxes(_entities(spark), p, "image_id"), p, "image_id")
    known = M.assign(b.select("image_id", "line_no", F.col("e_start").alias("start"), F.lit("X").alias("type"), "entity"), ["image_id", "line_no", "start"])
    joined = b.withColumn("key", F.upper("entity")).join(known.select("key", "placeholder"), "key")
    return joined.select("image_id", "line_no", F.col("left").alias("x0"), F.col("top").alias("y0"), F.col("right").alias("x1"), F.col("bottom").alias("y1"), "placeholder")


_SPACED = "SELECT * FROM (VALUES (1, 'user @ host . tld'), (2, 'a - b ( c ) end. Next'), (3, 'x _ y / z : 1 , 2'), (4, ''), (5, 'no marks here')) AS f(id, text)"


@query("SELECT * FROM (VALUES (1, 'user@host.tld', 0, 17), (2, 'a-b(c)end.Next', 0, 21), (3, 'x_y/z:1,2', 0, 17), (4, '', -1, -1), (5, 'no marks here', 0, 13)) f(id, tight, start, stop)")
def fn_ocr_normalize(spark, sf_dir):
    t = spark.sql(_SPACED).select("id", O.tighten(F.col("text")).alias("t"))
    o = O.original(F.col("t.at"), F.lit(0), F.size("t.at"))
    return t.select("id", F.col("t.text").alias("tight"), F.coalesce(o["start"], F.lit(-1)).alias("start"), F.coalesce(o["stop"], F.lit(-1)).alias("stop"))


@query("SELECT * FROM (VALUES (1, 7, 11), (2, 2, 5)) f(id, start, stop)")
def fn_remap_offsets(spark, sf_dir):
    """host in the first line, -b in the second, back in the spaced text."""
    t = spark.sql(_SPACED).where("id <= 2").select("id", O.tighten(F.col("text")).alias("t"))
    o = O.original(F.col("t.at"), F.when(F.col("id") == 1, 5).otherwise(1), F.when(F.col("id") == 1, 9).otherwise(3))
    return t.select("id", o["start"].alias("start"), o["stop"].alias("stop"))


#: Recognised text: what the looser shapes find in it, stated by hand.
_READ = """SELECT * FROM (VALUES (1, 'mail finance@company or joe@examplecom, not a@b'), (2, 'tel 0612345678 and 06 12 34 56 78.'), (3, 'call +33 6 12 34 56 78 or (643) 555 2043'), (4, '643-555-2043 or 643 555-2043'),
 (5, 'ids 12345678 1643-555-20431 2024-01-02 1.234'), (6, 'é.ü@straße-a x'), (7, ''), (8, CAST(NULL AS VARCHAR(9))), (9, '+16435552043 +33(0)612345678')) AS f(id, text)"""


@query(
    """SELECT * FROM (VALUES (1, 5, 20, 'EMAIL', 'finance@company'), (1, 24, 38, 'EMAIL', 'joe@examplecom'), (2, 4, 14, 'PHONE', '0612345678'), (2, 19, 33, 'PHONE', '06 12 34 56 78'),
 (3, 5, 19, 'PHONE', '+33 6 12 34 56'), (3, 26, 40, 'PHONE', '(643) 555 2043'), (4, 0, 12, 'PHONE', '643-555-2043'), (4, 16, 28, 'PHONE', '643 555-2043'), (6, 0, 12, 'EMAIL', 'é.ü@straße-a'), (9, 0, 12, 'PHONE', '+16435552043'), (9, 13, 28, 'PHONE', '+33(0)612345678')) f(id, start, stop, type, entity)"""
)
def find_ocr_lax(spark, sf_dir):
    found = S.entities(S.find(spark.sql(_READ), O.LAX), "id")
    return found.select("id", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "type", "entity")


#: Runs of digits with separators, which addresses and cards are inside of, or are.
_RUNS = S.Finder("RUN", r"[0-9][0-9 .-]{5,}[0-9]")


@query(f"SELECT doc_id, l.start, l.stop FROM {found_sql([_RUNS])} l WHERE NOT EXISTS (SELECT 1 FROM {found_sql(list(TESTS))} s WHERE s.k = l.k AND s.start <= l.start AND l.stop <= s.stop)")
def join_span_containment(spark, sf_dir):
    """Loose spans that no standard one contains."""
    t = texts(spark, sf_dir)
    lax, standard = S.entities(S.find(t, (_RUNS,)), "doc_id"), S.entities(S.find(t), "doc_id")
    return O.outside(lax.select("doc_id", "start", "stop"), standard.select("doc_id", "start", "stop"), "doc_id")


@query("SELECT * FROM (VALUES ('i1', 'one', 0, 0, 9, 5), ('i1', 'two', 12, 0, 20, 6), ('i2', 'a line', 0, 0, 50, 8)) f(image_id, text, x0, y0, x1, y1)")
def src_ocr_result(spark, sf_dir):
    box = lambda *p: [{"x": p[i], "y": p[i + 1]} for i in range(0, len(p), 2)]
    rows = [("i1", ["one", "two"], [box(0, 0, 9, 5), box(12, 6, 20, 0)], ["one two"], [box(0, 0, 20, 6)]), ("i2", ["a"], [], ["a line"], [box(0, 0, 50, 8)])]
    points = "array<array<struct<x:int,y:int>>>"
    results = spark.createDataFrame(rows, f"image_id string, words array<string>, boxes {points}, lines array<string>, line_boxes {points}")
    return O.regions_of(results, "image_id").select("image_id", "text", F.col("left").alias("x0"), F.col("top").alias("y0"), F.col("right").alias("x1"), F.col("bottom").alias("y1"))


@query("SELECT page_id, sha256(html) AS sha, CASE WHEN kept THEN length(html) ELSE -1 END AS chars, CASE WHEN kept THEN md5(html) ELSE '' END AS lines_md5 FROM (SELECT *, bool_or(page_id % 2 = 1) OVER (PARTITION BY html) AS kept FROM pages)")
def src_image_cache(spark, sf_dir):
    """Recognised lines kept by digest: what the current version holds is restored, what an older one held is not."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.sha2(F.col("html").cast("binary"), 256).alias("sha"))
    version = F.when(F.col("page_id") % 2 == 1, O.CACHE_VERSION).otherwise(O.CACHE_VERSION - 1).alias("version")
    path = records.scratch_path(spark, "image-cache")
    pages.select("sha", version, F.split("html", "\n", -1).alias("lines")).write.json(path)
    kept = O.cached(spark.read.schema("sha string, version int, lines array<string>").json(path))
    lines = kept.groupBy("sha").agg(F.array_join(F.first("lines"), "\n").alias("text"))
    return pages.join(lines, "sha", "left").select("page_id", "sha", F.coalesce(F.length("text").cast("long"), F.lit(-1)).alias("chars"), F.coalesce(F.md5("text"), F.lit("")).alias("lines_md5"))


@query("SELECT page_id, sha256(html) AS sha FROM pages")
def fn_sha256(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha"))


@query("SELECT page_id, md5(to_base64(encode(html))) AS b64_md5, md5(html) AS back_md5 FROM pages")
def fn_base64(spark, sf_dir):
    b = F.base64(F.encode("html", "UTF-8"))
    plain = F.regexp_replace(b, "\r\n", "")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(plain).alias("b64_md5"), F.md5(F.decode(F.unbase64(b), "UTF-8")).alias("back_md5"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def fn_json_parse_dump(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json(F.to_json(v)), "$.k", "long").alias("k"))


@query("SELECT conv_id, turn, upper(role) AS key, lower(upper(role)) AS low FROM conversations")
def fn_upper_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.upper("role").alias("key"), F.lower(F.upper("role")).alias("low"))


@query("SELECT event_id, lower(event_type) AS low FROM events")
def fn_lower_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.lower("event_type").alias("low"))


@query(f"SELECT doc_id, t AS token, regexp_extract(t, '\\[([A-Z_]+)_[0-9]+\\]', 1) AS type FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\[[A-Z_]+_[0-9]+\\]')) AS t FROM ({TEXTS}))")
def fn_token_regex(spark, sf_dir):
    each = texts(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(S.TOKEN), F.lit(0))).alias("token"))
    return each.select("doc_id", "token", F.regexp_extract("token", r"\[([A-Z_]+)_[0-9]+\]", 1).alias("type"))


def _made_sql(templates, n: int) -> str:
    parts = ", ".join(f"({t}, {i}, '{kind}', '{text}')" for t, pieces in enumerate(templates) for i, (kind, text) in enumerate(pieces))
    words = ", ".join(f"('{kind}', {i}, '{w}')" for kind, ws in G.WORDS.items() for i, w in enumerate(ws))
    sizes = " ".join(f"WHEN '{kind}' THEN {len(ws)}" for kind, ws in G.WORDS.items())
    return f"""(WITH p AS (SELECT * FROM (VALUES {parts}) p(t, i, kind, piece)), w AS (SELECT * FROM (VALUES {words}) w(kind, k, word)),
each AS (SELECT id, i, p.kind, CASE p.kind WHEN '' THEN piece ELSE word END AS piece FROM range({n}) r(id) JOIN p ON p.t = id % {len(templates)}
 LEFT JOIN w ON w.kind = p.kind AND w.k = CAST('0x' || substr(md5(id || '-' || i), 1, 6) AS INT) % CASE p.kind {sizes} END),
placed AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY id ORDER BY i) AS BIGINT) - length(piece) AS start FROM each)
SELECT id, string_agg(piece, '' ORDER BY i) AS text, coalesce(string_agg(kind || ':' || start || ':' || piece, '|' ORDER BY i) FILTER (WHERE kind IN ('PERSON', 'ORG', 'LOC')), '') AS entities FROM placed GROUP BY id)"""


@query(f"SELECT * FROM {_made_sql(G.NEGATIVE, 2000)}")
def fn_synth_negative(spark, sf_dir):
    """Seeded sentences without entities."""
    return G.sentences(spark, G.NEGATIVE, 2000)


@query(f"SELECT * FROM {_made_sql(G.POSITIVE, 2000)}")
def fn_synth_positive(spark, sf_dir):
    """Seeded sentences with up to three entities of several types, and their places."""
    return G.sentences(spark, G.POSITIVE, 2000)


# ---- provider tables -----------------------------------------------------------------------------------------------------

GROUPS = """SELECT * FROM (VALUES
 (1, 0, 'Ann Lee met Bob.', 0, 'PER', 0.90, 0, 7), (1, 1, 'met Bob.', 8, 'PER', 0.95, 4, 7), (1, 0, 'Ann Lee met Bob.', 0, 'PER', 0.40, 12, 15),
 (2, 0, 'in Paris today', 0, 'LOC', 0.99, 3, 8), (2, 1, 'Paris today', 3, 'LOC', 0.70, 0, 5), (2, 0, 'in Paris today', 0, 'MISC', 0.99, 9, 14), (3, 0, 'xAcme Corp', 0, 'ORG', 0.99, 1, 10), (3, 0, 'A PERSON_9', 0, 'PER', 0.99, 2, 10)) AS g(text_id, chunk_no, chunk_text, off, entity_group, score, s, e)"""


def groups(spark):
    return spark.sql(GROUPS).withColumnsRenamed({"off": "offset", "s": "start", "e": "end"})


_KEPT = f"""(SELECT text_id, chunk_no, trim(substr(chunk_text, s + 1, e - s)) AS entity, CASE entity_group WHEN 'PER' THEN 'PERSON' ELSE entity_group END AS type, s + off AS start, e + off AS stop FROM ({GROUPS})
WHERE score >= 0.6 AND entity_group IN ('PER', 'ORG', 'LOC') AND NOT regexp_matches(CASE WHEN s > 0 THEN substr(chunk_text, s, 1) ELSE '' END, '[A-Za-z0-9_.]') AND NOT regexp_matches(substr(chunk_text, e + 1, 1), '[A-Za-z0-9_.]')
AND length(trim(substr(chunk_text, s + 1, e - s))) BETWEEN 2 AND 50 AND NOT starts_with(trim(substr(chunk_text, s + 1, e - s)), CASE entity_group WHEN 'PER' THEN 'PERSON_' ELSE entity_group || '_' END))"""


@query(f"SELECT * FROM {_KEPT}")
def ner_post_filter(spark, sf_dir):
    return N.post_filter(groups(spark))


@query(f"SELECT text_id, start, stop, arg_min(entity, chunk_no) AS entity, arg_min(type, chunk_no) AS type, min(chunk_no) AS chunk_no FROM {_KEPT} GROUP BY text_id, start, stop")
def ner_dedupe_overlap(spark, sf_dir):
    return N.once(N.post_filter(groups(spark))).select("text_id", "start", "stop", "entity", "type", "chunk_no")


@query(
    """WITH d AS (SELECT row_number() OVER () AS k, doc_id AS text_id, string_split(text, 'the') AS g FROM documents WHERE contains(text, 'the')),
e AS (SELECT k, text_id, unnest(g[:-2]) AS before, unnest(g[2:]) AS after, generate_subscripts(g[:-2], 1) AS n FROM d),
p AS (SELECT *, CAST(sum(length(before) + 3) OVER (PARTITION BY k ORDER BY n) - 3 AS INT) AS start, lead(after, 0) OVER (PARTITION BY k ORDER BY n) AS a FROM e)
SELECT text_id, start, 'ORG' AS entity_group FROM p WHERE NOT regexp_matches(before, '[\\p{L}\\p{N}_]$') AND NOT regexp_matches(after, '^[\\p{L}\\p{N}_]') AND (n = 1 OR before <> '')"""
)
def ner_infer(spark, sf_dir):
    """The default provider: a list of names, here one short word that also stands inside others."""
    names = spark.createDataFrame([("the", "ORG"), ("not in any text", "PER")], "name string, entity_group string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return N.Gazetteer(names).spans(docs).select("text_id", F.col("start").cast("int").alias("start"), "entity_group")


# ---- logs, caches, sets --------------------------------------------------------------------------------------------------


def entity_log(spark, sf_dir):
    """Texts with their spans, as log rows."""
    r = resolved(spark, sf_dir)
    ents = F.transform("spans", lambda s: F.struct(s["text"].alias("text"), s["type"].alias("type"), s["start"].alias("start"), s["stop"].alias("end")))
    return r.select(F.concat(F.lit("https://api.example/"), F.col("doc_id").cast("string")).alias("request_url"), F.lit("$.text").alias("field_path"), "text", ents.alias("entities"))


from .detection import RESOLVED  # noqa: E402


@query(f"SELECT 'https://api.example/' || doc_id AS request_url, count(*) AS n_entities FROM {RESOLVED} GROUP BY doc_id, k")
def snk_entity_log(spark, sf_dir):
    path = records.scratch_path(spark, "entities")
    records.log_entities(entity_log(spark, sf_dir), path)
    return records.load_entity_log(spark, path).select("request_url", F.size("entities").cast("long").alias("n_entities"))


@query(f"SELECT type, count(*) AS n FROM {RESOLVED} GROUP BY type")
def src_entity_log(spark, sf_dir):
    path = records.scratch_path(spark, "entities")
    records.log_entities(entity_log(spark, sf_dir), path)
    return records.load_entity_log(spark, path).select(F.explode("entities").alias("e")).groupBy(F.col("e.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE text IS NOT NULL")
def src_training_jsonl(spark, sf_dir):
    path = records.scratch_path(spark, "training")
    table(spark, sf_dir, "conversations").select("text", F.expr("CAST(array() AS ARRAY<STRUCT<text: STRING, type: STRING>>)").alias("entities"), F.lit("x").alias("source")).write.json(path)
    return records.load_training(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


_BARE_CODE = "regexp_replace(text, '" + T.STRIPPED.replace("'", "''") + "', ' ', 'g')"


@query(
    f"""WITH d AS (SELECT lang, doc_id, list_filter(regexp_extract_all({_BARE_CODE}, '[^ \t\n\r\f]+'), lambda w: regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]{{1,}}$')) AS ids FROM documents WHERE text IS NOT NULL)
SELECT lang, doc_id, array_to_string(ids[1:40], ' ') AS ids FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM d WHERE len(ids) >= 6) WHERE n <= 500"""
)
def src_code_corpus(spark, sf_dir):
    """Texts as code: strings and comments go, identifiers stay, and a language gives its first 500 files (a sampling operator)."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", T.identifiers(T.tokens(T.strip_code(F.col("text")))).alias("ids"))
    first = records.per_language(d.where("ids IS NOT NULL"), "lang", "doc_id", 500)
    return first.select("lang", "doc_id", F.array_join("ids", " ").alias("ids"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(min(len) AS BIGINT) AS least FROM (SELECT lang, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS len FROM documents) WHERE len > 0 GROUP BY lang")
def src_hf_datasets(spark, sf_dir):
    """Any table of tokens and tags stands in for remote corpora; here documents, all O."""
    d = table(spark, sf_dir, "documents").select("lang", T.tokens(F.col("text")).alias("tokens")).withColumn("ner_tags", F.transform("tokens", lambda x: F.lit(0)))
    return d.where("size(ner_tags) > 0").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("tokens")).cast("long").alias("least"))


@query(f"SELECT doc_id, n FROM (SELECT doc_id, k, count(*) AS n FROM {RESOLVED} GROUP BY doc_id, k)")
def join_entity_cache(spark, sf_dir):
    """Each distinct text is searched once; the spans are joined back to all of its rows."""
    t = texts(spark, sf_dir).where("text IS NOT NULL").withColumn("h", F.sha2("text", 256))
    distinct = t.select("h", "text").dropDuplicates(["h"])
    found = S.find(distinct).select("h", S.resolve(F.col("spans")).alias("spans")).where("size(spans) > 0")
    return t.select("doc_id", "h").join(found, "h").select("doc_id", F.size("spans").cast("long").alias("n"))


def _digest(text: str = "text"):
    """Texts meet by their sha256, so that no text is shuffled."""
    return F.unhex(F.sha2(text, 256)).alias("digest")


@query("SELECT d.doc_id, min(b.doc_id) AS first_line FROM documents d JOIN documents b ON d.text = b.text AND d.lang = b.lang AND d.source = b.source GROUP BY d.doc_id")
def join_entity_log(spark, sf_dir):
    """The first log line of equal source, language and text; the three keys stand for url, path and text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", _digest())
    first = d.groupBy("lang", "source", "digest").agg(F.min("doc_id").alias("first_line"))
    return d.join(first, ["lang", "source", "digest"]).select("doc_id", "first_line")


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def dst_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(_digest()).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).select("doc_id", "n")


@query("SELECT count(DISTINCT text) AS n FROM documents WHERE length(text) >= 10")
def dedupe_seen(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length("text") >= 10).select(_digest()).distinct().agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS processed, count(*) FILTER (WHERE length(text) < 10 OR r > 1) AS skipped, count(*) FILTER (WHERE length(text) >= 10 AND r = 1) AS evaluated FROM (SELECT text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents)")
def agg_cache_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h"), (F.length("text") >= 10).alias("long")).agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.sum("n").alias("processed"), F.sum(F.when(F.col("long"), F.col("n") - 1).otherwise(F.col("n"))).alias("skipped"), F.sum(F.when(F.col("long"), 1).otherwise(0)).alias("evaluated"))


@query("SELECT 'documents' AS origin, count(*) AS n FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'benchmark', count(*) FROM benchmark")
def set_union_all(spark, sf_dir):
    one = lambda name: table(spark, sf_dir, name).select("text", F.lit(name).alias("origin"), F.array(F.lit(0)).cast("array<int>").alias("ner_tags"))
    return one("documents").unionByName(one("conversations")).unionByName(one("benchmark")).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'fine_tuned' AS kept, 0.81::DOUBLE AS f1 UNION ALL SELECT 'baseline', 0.8")
def set_best_model(spark, sf_dir):
    """The new model stays only when its score is strictly greater."""
    rows = spark.createDataFrame([(0.80, 0.81), (0.80, 0.80)], "baseline double, tuned double")
    better = F.col("tuned") > F.col("baseline")
    return rows.select(F.when(better, "fine_tuned").otherwise("baseline").alias("kept"), F.greatest("tuned", "baseline").alias("f1"))


@query("SELECT 'promote' AS decision, 'm2' AS model UNION ALL SELECT 'drop', 'm1'")
def reg_promote(spark, sf_dir):
    """What becomes of each tuned model; moving files is outside."""
    rows = spark.createDataFrame([("m1", 0.80, 0.80), ("m2", 0.80, 0.90)], "model string, baseline double, tuned double")
    return rows.select(F.when(F.col("tuned") > F.col("baseline"), "promote").otherwise("drop").alias("decision"), "model")


@query("SELECT count(*) > 0 AS may_train FROM conversations")
def train_gate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").agg((F.count(F.lit(1)) > 0).alias("may_train"))


@query("SELECT arg_max(event_id, ts) AS newest FROM events")
def srt_latest(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.max_by("event_id", "ts").alias("newest"))


@query("SELECT doc_id FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 200")
def lim_cap_shuffle(spark, sf_dir):
    """A seeded shuffle, then a cap (a sampling operator): the lowest hashes."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("42-"), F.col("doc_id").cast("string"))), "doc_id").limit(200)


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3")
def lim_sample_index(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(3)


# ---- binary bodies -------------------------------------------------------------------------------------------------------


def _multipart(spark):
    body = b"--B\r\nContent-Disposition: form-data; name=\"t\"\r\n\r\nhello\r\n--B\r\nContent-Disposition: form-data; name=\"i\"\r\nContent-Type: image/png\r\n\r\n\x89PNG\r\n--B--\r\n"
    return spark.createDataFrame([(1, "B", bytearray(body))], "id int, boundary string, body binary")


@query("SELECT * FROM (VALUES (1, 0, 't', 'text/plain', 5), (1, 1, 'i', 'image/png', 4)) f(id, seq, name, content_type, n)")
def src_multipart(spark, sf_dir):
    return B.split_multipart(_multipart(spark), "id").select("id", "seq", "name", "content_type", F.length("content").alias("n"))


@query("SELECT 1 AS id, true AS same_without_change, 'BLACK' AS image")
def redact_multipart(spark, sf_dir):
    rows = _multipart(spark)
    parts = B.split_multipart(rows, "id", "boundary")
    new = parts.where("content_type LIKE 'image/%'").select("id", "boundary", "seq", F.encode(F.lit("BLACK"), "UTF-8").alias("new_content"))
    same = B.join_multipart(parts, "id").select("id", F.col("body").alias("again"))
    done = B.join_multipart(B.redact_parts(parts, new, "id", "boundary"), "id")
    image = B.split_multipart(done, "id").where("name = 'i'").select("id", F.decode("content", "UTF-8").alias("image"))
    return rows.join(same, "id").join(image, "id").select("id", (F.col("body") == F.col("again")).alias("same_without_change"), "image")


_IMG = '{"messages": [{"content": [{"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "aGVsbG8="}}, {"type": "image", "source": {"type": "url", "data": "x"}}]}]}'


@query("SELECT 1 AS id, '$.messages[0].content[0].source.data' AS path, 'image/png' AS media_type, 'hello' AS image")
def src_base64_image(spark, sf_dir):
    return B.base64_images(spark.createDataFrame([(1, _IMG)], "id int, body string"), "id").select("id", "path", "media_type", F.decode("image", "UTF-8").alias("image"))


@query("SELECT 1 AS id, 'HELLO' AS image")
def redact_image_json(spark, sf_dir):
    rows = spark.createDataFrame([(1, _IMG)], "id int, body string")
    images = B.base64_images(rows, "id").select("id", "steps", F.encode(F.upper(F.decode("image", "UTF-8")), "UTF-8").alias("image"))
    return B.base64_images(B.put_images(rows, images, "id"), "id").select("id", F.decode("image", "UTF-8").alias("image"))


@query(f"SELECT 'leak' AS reason, count(DISTINCT k) AS n, min(doc_id) AS first FROM {RESOLVED}")
def snk_error_dump(spark, sf_dir):
    """Texts with anything to hide go to the dead-letter table, with the reason."""
    path = records.scratch_path(spark, "quarantine")
    records.quarantine(resolved(spark, sf_dir).where("size(spans) > 0").select("doc_id", F.lit("leak").alias("reason")), path)
    return spark.read.schema("doc_id long, reason string").json(path).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


# ---- streams -------------------------------------------------------------------------------------------------------------

_KNOWN = [("ANN", "Ann", "PERSON", 1, 0, "[PERSON_0]"), ("A@B.C", "a@b.c", "EMAIL", 1, 1, "[EMAIL_1]")]
_CHUNKS = [
    ("s", 0, 'data: {"delta": {"text": "hi [PERSON_0]"}, "raw": "[EMAIL_1]"}'), ("s", 1, "data: [DONE]"), ("s", 2, ": keep-alive"), ("s", 3, "data: broken [EMAIL_1]"),
    ("s", 4, 'data: {"delta": {"text": "[ORG_7]"}}'),
]
_FIELDED = """(VALUES ('s', 0, 'data: {"delta": {"text": "hi Ann"}, "raw": "[EMAIL_1]"}'), ('s', 1, 'data: [DONE]'), ('s', 2, ': keep-alive'), ('s', 3, 'data: broken a@b.c'), ('s', 4, 'data: {"delta": {"text": "<SECRET_NOT_FOUND-[ORG_7]>"}}'))"""


def _known(spark):
    return spark.createDataFrame(_KNOWN, "key string, sensitive string, type string, first_seen long, id long, placeholder string")


@query(f"SELECT * FROM {_FIELDED} f(stream_id, seq, restored)")
def restore_sse(spark, sf_dir):
    chunks = spark.createDataFrame(_CHUNKS, "stream_id string, seq int, data string")
    return E.restore_stream(chunks, _known(spark), (".delta.text",)).select("stream_id", "seq", "restored")


@query(f"SELECT seq, restored FROM {_FIELDED} f(stream_id, seq, restored)")
def stream_restore(spark, sf_dir):
    """The same over a file stream, taken once."""
    src, out, at = (records.scratch_path(spark, x) for x in ("sse-in", "sse-out", "sse-state"))
    spark.createDataFrame(_CHUNKS, "stream_id string, seq int, data string").write.json(src)
    stream = spark.readStream.schema("stream_id string, seq int, data string").json(src)
    E.run_once(E.restore_stream(stream, _known(spark), (".delta.text",)).select("seq", "restored"), lambda df, i: df.write.mode("append").parquet(out), at)
    return spark.read.parquet(out)


def _pseudonymised(spark, sf_dir):
    path, state = records.scratch_path(spark, "pseudonyms"), records.scratch_path(spark, "pseudonym-state")
    src = records.scratch_path(spark, "requests-in")
    texts(spark, sf_dir).where("text IS NOT NULL").select(F.col("doc_id").alias("request_id"), "text").write.parquet(src)
    sink = E.Pseudonymiser(path)
    E.run_once(spark.readStream.schema("request_id long, text string").parquet(src), sink, state)
    return sink, path


@query(f"SELECT doc_id, md5(redacted) AS redacted_md5 FROM {REDACTED} WHERE redacted IS NOT NULL")
def stream_anonymize(spark, sf_dir):
    """One run over what is there: ids by request and place, as without a stream."""
    _, path = _pseudonymised(spark, sf_dir)
    return spark.read.parquet(f"{path}/out").select(F.col("request_id").alias("doc_id"), F.md5("redacted").alias("redacted_md5"))


@query(f"SELECT key, sensitive, type, id, '[' || type || '_' || id || ']' AS placeholder FROM {ASSIGNED}")
def state_mappings(spark, sf_dir):
    sink, _ = _pseudonymised(spark, sf_dir)
    return sink.mapping(spark).select("key", "sensitive", "type", "id", "placeholder")


@query("SELECT epoch(time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2000-01-01'))::BIGINT AS since, user_id, count(*) AS hits, count(*) >= 3 AS kept FROM events GROUP BY 1, 2")
def state_cache_prune(spark, sf_dir):
    found = E.prune(table(spark, sf_dir, "events").select("ts", "user_id"), "user_id")
    return found.select(F.unix_timestamp("since").alias("since"), "user_id", "hits", "kept")


@query("SELECT date_trunc('week', ts)::DATE::VARCHAR AS week, count(*) AS n FROM events GROUP BY 1")
def trig_cron(spark, sf_dir):
    """What a weekly job would take each week; the clock that starts it is outside."""
    return table(spark, sf_dir, "events").groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")).agg(F.count(F.lit(1)).alias("n"))
