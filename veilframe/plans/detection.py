"""Span detection, overlap resolution, placeholders, redaction and restoration over documents and fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..operators import mappings as M
from ..sources.records import scratch_path
from .registry import query, table

#: Texts with values that the tables lack; read by both engines.
FIXTURE = """SELECT * FROM (VALUES
 (-1, 'IBAN GB82WEST12345698765432 and bad GB82WEST12345698765433.'),
 (-2, 'ssn 123-45-6789, not 000-45-6789 nor 666-12-3456 nor 123-45-67890'),
 (-3, 'nir 1 84 12 76 451 089 46 and 184127645108946x'),
 (-4, 'hosts 127.0.0.1 0.0.0.0 255.255.255.255 203.0.113.9 1.2.3.4.5 300.1.1.1'),
 (-5, 'call +1 (643) 555-2043 not x+1 643 555 2043 nor -+1 643 555 2043'),
 (-6, 'card 4111 1111 1111 1111 and 4111-1111-1111-1112 mail Ann@Example.org, ann@example.org'),
 (-7, 'kept [PERSON_0] and [ORG_99] {{exempt me@example.org}} é ß ann@example.org'),
 (-8, ''),
 (-9, CAST(NULL AS VARCHAR(10)))) AS f(doc_id, text)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the fixture: doc_id, text."""
    fixture = spark.sql(FIXTURE).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(fixture)


TEXTS = f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents UNION ALL SELECT CAST(doc_id AS BIGINT), text FROM ({FIXTURE})"
_D = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_D}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(substr({_D}, length({_D}) - j + 1, 1) AS INT) ELSE CAST(substr('0246813579', CAST(substr({_D}, length({_D}) - j + 1, 1) AS INT) + 1, 1) AS INT) END)) % 10 = 0"
_DIGITS97 = "list_aggregate(list_transform(string_split(substr(m, 5) || left(m, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), 'string_agg', '')"
_W = "'[A-Za-z0-9_]'"
#: The tests of the finders, in DuckDB's words.
TESTS = {
    "EMAIL": "true",
    "PHONE": f"length({_D}) BETWEEN 8 AND 15 AND (b = '' OR regexp_matches(b, '[ \\t\\n\\r]'))",
    "CREDIT_CARD": f"length({_D}) BETWEEN 13 AND 19 AND NOT regexp_matches(b, {_W}) AND NOT regexp_matches(a, {_W}) AND {_LUHN}",
    "IBAN": f"NOT regexp_matches(b, {_W}) AND NOT regexp_matches(a, {_W}) AND list_reduce(list_prepend(0, list_transform(string_split({_DIGITS97}, ''), lambda c: CAST(c AS INT))), lambda r, d: (r * 10 + d) % 97) = 1",
    "IP_ADDRESS": "list_max(list_transform(string_split(m, '.'), lambda o: CAST(o AS INT))) <= 255 AND NOT regexp_matches(b, '[0-9.]') AND NOT regexp_matches(a, '[0-9]') AND m NOT IN ('" + "', '".join(S.IGNORED_IPS) + "')",
    "US_SSN": "NOT regexp_matches(b, '[0-9A-Za-z-]') AND NOT regexp_matches(a, '[0-9A-Za-z-]') AND NOT regexp_matches(m, '^(000|666|9)') AND substr(m, 5, 2) <> '00' AND right(m, 4) <> '0000'",
    "FR_NIR": f"NOT regexp_matches(b, {_W}) AND NOT regexp_matches(a, {_W})",
}
NAMED = dict(zip(TESTS, S.STRUCTURED))


def found_sql(names: list[str | S.Finder], source: str = TEXTS, key: str = "doc_id", text: str = "text") -> str:
    """Rows k (row), key, ord, type, start, stop, entity, from gaps and matches; a finder given as such has no test."""
    parts = []
    for i, name in enumerate(names):
        f = name if isinstance(name, S.Finder) else NAMED[name]
        p = "'" + (f.plain or f.pattern) + "'"
        parts.append(
            f"SELECT k, {key}, {i} AS ord, '{f.type}' AS type, n, m, g, coalesce(right(g, 1), '') AS b, coalesce(left(h, 1), '') AS a FROM (SELECT k, {key}, unnest(regexp_extract_all(t, {p})) AS m,"
            f" unnest(string_split_regex(t, {p})[:-2]) AS g, unnest(string_split_regex(t, {p})[2:]) AS h, generate_subscripts(regexp_extract_all(t, {p}), 1) AS n FROM src)"
        )
    tests = " ".join(f"WHEN {i} THEN {'true' if isinstance(name, S.Finder) else TESTS[name]}" for i, name in enumerate(names))
    return f"""(WITH src AS (SELECT row_number() OVER () AS k, {key}, coalesce({text}, '') AS t FROM ({source})),
raw AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY k, ord ORDER BY n) AS BIGINT) AS stop FROM raw)
SELECT k, {key}, ord, type, stop - length(m) AS start, stop, m AS entity FROM placed WHERE CASE ord {tests} END)"""


def _finder(name: str, ids: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.entities(S.find(texts(spark, sf_dir), tuple(NAMED[i] for i in ids)), "doc_id")

    run.__name__ = name
    query(f"SELECT doc_id, start, stop, type, entity FROM {found_sql(ids)}")(run)


_finder("find_regex", list(TESTS))
for _name, _id in (("find_email", "EMAIL"), ("find_phone", "PHONE"), ("find_credit_card", "CREDIT_CARD"), ("find_iban", "IBAN"), ("find_ip", "IP_ADDRESS"), ("find_us_ssn", "US_SSN"), ("find_fr_nir", "FR_NIR")):
    _finder(_name, [_id])

_SCORES = " ".join(f"WHEN {i} THEN {f.score}" for i, f in enumerate(S.STRUCTURED))


@query(f"SELECT doc_id, start, stop, type, entity, CAST(CASE ord {_SCORES} END AS DOUBLE) AS score FROM {found_sql(list(TESTS))} WHERE CASE ord {_SCORES} END >= 0.6")
def flt_score_type(spark, sf_dir):
    """Spans of a finder whose score is too low go; here the least score is 0.6, so that the filter has something to do."""
    found = S.find(texts(spark, sf_dir))
    each = found.select("doc_id", F.explode("spans").alias("s"))
    score = F.element_at(F.array(*(F.lit(f.score) for f in S.STRUCTURED)), F.col("s.ord") + 1)
    return each.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"), F.col("s.type").alias("type"), F.col("s.text").alias("entity"), score.alias("score")).where("score >= 0.6")


#: Kept spans by a recursive walk: the next kept span is the first, by start and finder, that starts at or after the last stop.
RESOLVED = f"""(WITH RECURSIVE all_spans AS MATERIALIZED (SELECT k, doc_id, type, start, stop, entity, row_number() OVER (PARTITION BY k ORDER BY start, ord) AS n FROM {found_sql(list(TESTS))}),
walk AS (SELECT k, n, stop FROM all_spans WHERE n = 1 UNION ALL
 SELECT w.k, s.n, s.stop FROM walk w JOIN all_spans s ON s.k = w.k AND s.n = (SELECT min(z.n) FROM all_spans z WHERE z.k = w.k AND z.n > w.n AND z.start >= w.stop))
SELECT s.* FROM all_spans s JOIN walk USING (k, n))"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.find(texts(spark, sf_dir)).withColumn("spans", S.resolve(F.col("spans")))


def resolved_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a written table, for queries that need the spans more than once: patterns run once over the texts."""
    rows, path = resolved(spark, sf_dir), scratch_path(spark, "spans")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query(f"SELECT doc_id, start, stop, type, entity FROM {RESOLVED}")
def span_resolve(spark, sf_dir):
    return S.entities(resolved(spark, sf_dir), "doc_id")


#: Placeholders by first appearance: document, then start; a value that holds a placeholder gets none.
ASSIGNED = f"""(SELECT key, entity AS sensitive, type, CAST(row_number() OVER (ORDER BY doc_id, start) - 1 AS BIGINT) AS id FROM (
 SELECT upper(entity) AS key, entity, type, doc_id, start, row_number() OVER (PARTITION BY upper(entity) ORDER BY doc_id, start) AS r FROM {RESOLVED} WHERE NOT regexp_matches(entity, '\\[[A-Z_]+_[0-9]+\\]')) WHERE r = 1)"""


def assigned(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return M.assign(S.entities(resolved(spark, sf_dir) if rows is None else rows, "doc_id"), order=["doc_id", "start"])


@query(f"SELECT key, sensitive, type, id, '[' || type || '_' || id || ']' AS placeholder FROM {ASSIGNED}")
def map_assign(spark, sf_dir):
    return assigned(spark, sf_dir).select("key", "sensitive", "type", "id", "placeholder")


@query(f"SELECT key, '[' || type || '_' || id || ']' AS placeholder FROM {ASSIGNED}")
def snk_mapping_dump(spark, sf_dir):
    return M.dump(assigned(spark, sf_dir))


@query(f"SELECT doc_id, start, upper(entity) AS key, regexp_extract('[' || a.type || '_' || id || ']', '^\\[([A-Z_]+)_[0-9]+\\]$', 1) AS known_type FROM {RESOLVED} r JOIN {ASSIGNED} a ON a.key = upper(r.entity)")
def map_type_of(spark, sf_dir):
    rows = resolved_once(spark, sf_dir)
    found = S.entities(rows, "doc_id").withColumn("key", F.upper("entity"))
    return M.with_type(found, assigned(spark, sf_dir, rows)).select("doc_id", "start", "key", "known_type")


#: Pieces between the spans, with each span replaced.
def _redacted_sql(value: str, join: str = "") -> str:
    return f"""(WITH s AS (SELECT r.k, r.start, r.stop, {value} AS v, coalesce(lag(r.stop) OVER (PARTITION BY r.k ORDER BY r.start), 0) AS since FROM {RESOLVED} r {join}),
t AS (SELECT row_number() OVER () AS k, doc_id, text FROM ({TEXTS})),
built AS (SELECT s.k, string_agg(substr(text, since + 1, start - since) || v, '' ORDER BY start) AS head, max(stop) AS last FROM s JOIN t USING (k) GROUP BY s.k)
SELECT t.doc_id, CASE WHEN built.k IS NULL THEN text ELSE head || substr(text, last + 1) END AS redacted FROM t LEFT JOIN built USING (k))"""


REDACTED = _redacted_sql("'[' || a.type || '_' || a.id || ']'", f"JOIN {ASSIGNED} a ON a.key = upper(r.entity)")


@query(f"SELECT doc_id, md5(redacted) AS redacted_md5 FROM {REDACTED}")
def redact(spark, sf_dir):
    rows = resolved_once(spark, sf_dir)
    done = M.redact(rows, assigned(spark, sf_dir, rows), "doc_id")
    return done.select("doc_id", F.md5("redacted").alias("redacted_md5"))


TYPED = _redacted_sql("'[' || r.type || ']'")


@query(f"SELECT doc_id, md5(redacted) AS redacted_md5 FROM {TYPED}")
def redact_typed(spark, sf_dir):
    return resolved(spark, sf_dir).select("doc_id", F.md5(S.typed(F.col("text"), F.col("spans"))).alias("redacted_md5"))


@query(
    f"""WITH red AS (SELECT row_number() OVER () AS k, doc_id, redacted FROM {REDACTED} WHERE redacted IS NOT NULL),
cut AS (SELECT k, unnest(regexp_extract_all(redacted, '\\[[A-Z_]+_[0-9]+\\]')) AS token, unnest(string_split_regex(redacted, '\\[[A-Z_]+_[0-9]+\\]')[:-2]) AS gap, generate_subscripts(regexp_extract_all(redacted, '\\[[A-Z_]+_[0-9]+\\]'), 1) AS n FROM red),
put AS (SELECT k, string_agg(gap || coalesce(sensitive, '<SECRET_NOT_FOUND-' || token || '>'), '' ORDER BY n) AS head FROM cut LEFT JOIN {ASSIGNED} a ON token = '[' || a.type || '_' || a.id || ']' GROUP BY k)
SELECT doc_id, md5(coalesce(head, '') || string_split_regex(redacted, '\\[[A-Z_]+_[0-9]+\\]')[-1]) AS restored_md5 FROM red LEFT JOIN put USING (k)"""
)
def restore_text(spark, sf_dir):
    rows = resolved_once(spark, sf_dir)
    known = assigned(spark, sf_dir, rows)
    done = M.redact(rows, known, "doc_id").where("redacted IS NOT NULL")
    return M.restore(done.select("doc_id", F.col("redacted").alias("text")), known).select("doc_id", F.md5("restored").alias("restored_md5"))


@query(f"SELECT type, count(*) AS n, count(DISTINCT doc_id) AS n_docs, count(DISTINCT upper(entity)) AS n_values FROM {RESOLVED} GROUP BY type")
def agg_entity_counts(spark, sf_dir):
    found = S.entities(resolved(spark, sf_dir), "doc_id")
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct(F.upper("entity")).alias("n_values"))


@query(
    f"""WITH red AS (SELECT doc_id, redacted FROM {REDACTED} WHERE redacted IS NOT NULL),
v AS (SELECT key FROM {ASSIGNED} WHERE key NOT IN ('CLAUDE', 'CLAUDE CODE', 'CLAUDE COWORK', 'ANTHROPIC'))
SELECT doc_id, count(v.key) AS n_leaks, count(v.key) > 0 AS blocked FROM red LEFT JOIN v ON contains(upper(regexp_replace(redacted, '(?s)\\{{\\{{.*?\\}}\\}}', '', 'g')), v.key) GROUP BY doc_id"""
)
def leak_check(spark, sf_dir):
    rows = resolved_once(spark, sf_dir)
    known = assigned(spark, sf_dir, rows)
    done = M.redact(rows, known, "doc_id").where("redacted IS NOT NULL").select("doc_id", F.col("redacted").alias("text"))
    return M.leaks(done, known, "doc_id").select("doc_id", F.size("leaked").cast("long").alias("n_leaks"), (F.size("leaked") > 0).alias("blocked"))


#: Rows whose id is null or repeated, of which some leak.
_GATED = "(SELECT * FROM (VALUES (CAST(NULL AS BIGINT), 'to ann@example.org'), (NULL, 'to nobody'), (-1, 'nothing here'), (-9, 'ANN@example.org')) AS g(doc_id, text))"


@query(
    f"""WITH v AS MATERIALIZED (SELECT key FROM {ASSIGNED} WHERE key NOT IN ('CLAUDE', 'CLAUDE CODE', 'CLAUDE COWORK', 'ANTHROPIC')), t AS (SELECT row_number() OVER () AS k, doc_id, text FROM ({TEXTS} UNION ALL SELECT doc_id, text FROM {_GATED})),
hit AS (SELECT DISTINCT k FROM t JOIN v ON contains(upper(regexp_replace(coalesce(text, ''), '(?s)\\{{\\{{.*?\\}}\\}}', '', 'g')), v.key))
SELECT coalesce(CAST(doc_id AS VARCHAR), 'none') AS doc, CASE WHEN hit.k IS NULL THEN 'pass' ELSE 'quarantine' END AS gate, count(*) AS n FROM t LEFT JOIN hit USING (k) GROUP BY 1, 2"""
)
def leak_gate(spark, sf_dir):
    """Raw texts against all known values: what leaks goes to quarantine."""
    rows = texts(spark, sf_dir).unionByName(spark.sql(f"SELECT doc_id, text FROM {_GATED}"))
    passed, held = M.gate(rows, assigned(spark, sf_dir), "doc_id")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("doc")
    both = passed.select(doc, F.lit("pass").alias("gate")).unionAll(held.select(doc, F.lit("quarantine").alias("gate")))
    return both.groupBy("doc", "gate").agg(F.count(F.lit(1)).alias("n"))


KNOWN = f"""SELECT t.doc_id, a.key, CAST((length(upper(t.text)) - length(replace(upper(t.text), a.key, ''))) / length(a.key) AS BIGINT) AS n FROM ({TEXTS}) t JOIN {ASSIGNED} a ON contains(upper(t.text), a.key)"""


@query(KNOWN)
def join_known_values(spark, sf_dir):
    """How often each known value occurs in each text, in any case, at any place."""
    return M.known_values(texts(spark, sf_dir), assigned(spark, sf_dir), "doc_id").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, key, type, n FROM ({KNOWN}) JOIN (SELECT key, type FROM {ASSIGNED}) USING (key)")
def find_known_values(spark, sf_dir):
    return M.known_values(texts(spark, sf_dir), assigned(spark, sf_dir), "doc_id").groupBy("doc_id", "key", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH m AS (SELECT upper(entity) AS key, min(doc_id) AS first_seen FROM {RESOLVED} GROUP BY 1)
SELECT t.doc_id, m.key FROM ({TEXTS}) t JOIN m ON m.first_seen < t.doc_id AND contains(upper(t.text), m.key)"""
)
def join_asof_mappings(spark, sf_dir):
    """A request sees only values that earlier requests brought: mappings first seen before the document's id."""
    known = M.assign(S.entities(resolved(spark, sf_dir), "doc_id"), order=["doc_id", "start"], allow_tokens=True)
    return M.known_values(texts(spark, sf_dir), known, "doc_id", earlier_than="doc_id").select("doc_id", "key").distinct()


@query(f"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(redacted, '\\[[A-Z_]+_[0-9]+\\]')) AS token FROM {REDACTED} WHERE redacted IS NOT NULL)
SELECT doc_id, token, coalesce(sensitive, '<SECRET_NOT_FOUND-' || token || '>') AS value, count(*) AS n FROM tok LEFT JOIN {ASSIGNED} a ON token = '[' || a.type || '_' || a.id || ']' GROUP BY ALL""")
def join_placeholder(spark, sf_dir):
    rows = resolved_once(spark, sf_dir)
    known = assigned(spark, sf_dir, rows)
    done = M.redact(rows, known, "doc_id").where("redacted IS NOT NULL")
    tokens = done.select("doc_id", F.explode(F.regexp_extract_all("redacted", F.lit(S.TOKEN), F.lit(0))).alias("token"))
    return M.look_up(tokens, known).groupBy("doc_id", "token", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT page_id, type FROM {found_sql(list(TESTS), 'SELECT page_id, html FROM pages', 'page_id', 'html')}")
def find_in_pages(spark, sf_dir):
    """Distinct types per page, in raw markup."""
    return S.entities(S.find(table(spark, sf_dir, "pages").select("page_id", "html"), text="html"), "page_id").select("page_id", "type").distinct()
