"""Requests, rules, routing and JSON bodies, over pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonpath as J
from ..functions import spans as S
from ..functions import text as T
from ..operators import mappings as M
from ..operators import routing as R
from ..sources import records
from ..sources import rules as rules_file
from . import detection as D
from .registry import query, table

#: An invented rule file with comments, among them signs inside strings.
RULES_TEXT = r"""{
  // routes without personal data: https://not.a/rule
  "known_safe_routes": ["https?://[a-z0-9.-]+/[a-z]+/1[0-9]*", "https?://[a-z0-9.-]+/"],
  "anxious_filter_domains": [".*"],
  /* denied, whatever else matches */
  "blocked_urls": [{"url_pattern": "https?://[a-z0-9.-]+/[a-z]+/[0-9]*7"}, {"url_pattern": "https://deny.example/en/17"}],
  "anonymise": {
    "requests": [
      {"url_pattern": "https?://[a-z0-9.-]+/[a-z]+/2[0-9]*", "sensitive_fields": [".messages[].content[].text"]},
      {"url_pattern": "https?://[a-z0-9.-]+/[a-z]+/[23][0-9]*", "sensitive_fields": true},
      {"url_pattern": "https?://[a-z0-9.-]+/[a-z]+/2[0-9]*", "sensitive_fields": true}
    ],
    "responses": [{"url_pattern": "https?://tools[.]example/.*", "sensitive_fields": true}]
  },
  "deanonymise": {"responses": [{"url_pattern": "https://api[.]example/stream", "sensitive_fields": [".delta.text"], "sse_fields": [".delta.text"]}]}
}"""
_P = {kind: [r[2] for r in rules_file.parse(RULES_TEXT) if r[0] == kind] for kind in ("safe", "blocked", "anonymise_request", "anonymise_response", "deanonymise_response")}
_LIST = "VALUES " + ", ".join(f"('{k}', {i}, '{p}')" for k, ps in _P.items() for i, p in enumerate(ps))
RULES_SQL = f"(SELECT * FROM ({_LIST}) r(kind, ord, url_pattern))"
_BARE = "split_part(url, '?', 1)"
_HIT = f"regexp_full_match({_BARE}, url_pattern)"


def rules(spark):
    return rules_file.load(spark, RULES_TEXT)


def urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("?q="), F.col("page_id").cast("string")).alias("url"))


_URLS = "(SELECT page_id, url || '?q=' || page_id AS url FROM pages)"


@query(f"SELECT kind, ord, url_pattern FROM {RULES_SQL} UNION ALL SELECT 'leak_domain', 0, '.*'")
def src_rules_jsonc(spark, sf_dir):
    return rules(spark).select("kind", "ord", "url_pattern")


@query(f"SELECT page_id, {_BARE} AS bare FROM {_URLS}")
def prj_strip_query(spark, sf_dir):
    return urls(spark, sf_dir).select("page_id", T.strip_query(F.col("url")).alias("bare"))


@query(f"SELECT DISTINCT page_id FROM {_URLS} JOIN {RULES_SQL} ON {_HIT} WHERE kind = 'blocked'")
def flt_blocked_url(spark, sf_dir):
    return R.matched(urls(spark, sf_dir), rules(spark)).where("kind = 'blocked'").select("page_id").distinct()


@query(f"SELECT page_id FROM {_URLS} u WHERE NOT EXISTS (SELECT 1 FROM {RULES_SQL} WHERE {_HIT})")
def flt_default_deny(spark, sf_dir):
    return R.decide(urls(spark, sf_dir), rules(spark), "page_id").where("decision = 'unknown'").select("page_id")


#: Requests to a tool and such with values that do not go, besides those of the pages.
_MORE = """(SELECT * FROM (VALUES (-1, 'https://api.test/en/25?x=1', 'call +1 643 555 2043 not x+1 643 555 2043'), (-2, 'https://api.test/en/25', CAST(NULL AS VARCHAR(9))), (-3, 'ftp://nowhere', 'ann@example.org'),
 (-4, 'https://api.test/en/25', 'mail ann@example.org {{ann@example.org}}'), (-5, 'https://tools.example/call', 'ann@example.org'), (-6, 'https://api.test/en/1', 'to ann@example.org'), (-7, 'https://api.test/en/1', 'to nobody')) AS r(page_id, url, body))"""
_SENT = f"(SELECT CAST(page_id AS BIGINT) AS page_id, url, html AS body FROM pages UNION ALL SELECT CAST(page_id AS BIGINT), url, body FROM {_MORE})"
_DECISION = f"""(SELECT page_id, url, body, CASE WHEN n IS NULL THEN 'unknown' WHEN b THEN 'blocked' WHEN t THEN 'deanonymise' WHEN a THEN 'anonymise' ELSE 'pass' END AS decision FROM {_SENT} LEFT JOIN
(SELECT page_id, count(*) AS n, bool_or(kind = 'blocked') AS b, bool_or(kind = 'anonymise_response') AS t, bool_or(kind = 'anonymise_request') AS a FROM {_SENT} JOIN {RULES_SQL} ON {_HIT} GROUP BY page_id) USING (page_id))"""
#: The queries over texts, over the requests' bodies.
_OF_BODIES = lambda sql: sql.replace(D.TEXTS, f"SELECT page_id AS doc_id, body AS text FROM {_SENT}")
_BARE_UP = "upper(regexp_replace(coalesce({}, ''), '(?s)\\{{\\{{.*?\\}}\\}}', '', 'g'))"


def sent(spark, sf_dir):
    """The pages' URLs and markup as requests, and the fixture: page_id, url, body."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").alias("body"))
    return pages.unionByName(spark.sql(f"SELECT CAST(page_id AS BIGINT) AS page_id, url, body FROM {_MORE}"))


@query(
    f"""WITH d AS MATERIALIZED (SELECT * FROM {_DECISION}), v AS MATERIALIZED (SELECT key FROM {_OF_BODIES(D.ASSIGNED)}), red AS MATERIALIZED (SELECT doc_id AS page_id, redacted FROM {_OF_BODIES(D.REDACTED)}),
out AS (SELECT page_id, decision, CASE decision WHEN 'anonymise' THEN redacted ELSE body END AS body FROM d LEFT JOIN red USING (page_id)),
leaking AS (SELECT DISTINCT page_id FROM out JOIN v ON contains({_BARE_UP.format('body')}, v.key) WHERE decision IN ('anonymise', 'pass'))
SELECT page_id, CASE WHEN l.page_id IS NOT NULL OR (decision = 'anonymise' AND body IS NULL) THEN 'refused' ELSE decision END AS decision FROM out LEFT JOIN leaking l USING (page_id)"""
)
def prj_route_decision(spark, sf_dir):
    """Every branch, to the last: what still holds a known value after anonymisation is refused."""
    requests = sent(spark, sf_dir)
    found = S.find(requests.select("page_id", F.col("body").alias("text"))).withColumn("spans", S.resolve(F.col("spans")))
    known = M.assign(S.entities(found, "page_id"), order=["page_id", "start"])
    redacted = M.redact(found, known, "page_id").select("page_id", "redacted")
    decided = requests.join(R.decide(requests, rules(spark), "page_id"), "page_id").join(redacted, "page_id")
    bodies_ = decided.withColumn("body", F.when(F.col("decision") == "anonymise", F.col("redacted")).otherwise(F.col("body")))
    return R.outcome(bodies_, rules(spark), known, "page_id")


_FIRST = f"SELECT page_id, min(ord) AS ord, arg_min(url_pattern, ord) AS url_pattern FROM {_URLS} JOIN {RULES_SQL} ON {_HIT} WHERE kind = 'anonymise_request' GROUP BY page_id"


@query(_FIRST)
def prj_first_rule(spark, sf_dir):
    return R.first_rule(urls(spark, sf_dir), rules(spark), "page_id", "anonymise_request")


@query(f"SELECT page_id, kind, ord FROM {_URLS} JOIN {RULES_SQL} ON {_HIT}")
def join_regex_rule(spark, sf_dir):
    return R.matched(urls(spark, sf_dir), rules(spark)).select("page_id", "kind", "ord")


@query(f"SELECT host FROM (SELECT DISTINCT regexp_extract(url, '^https?://([^/?]+)', 1) AS host FROM pages UNION SELECT 'api.example' UNION SELECT '' UNION SELECT 'other.example') h WHERE host = '' OR EXISTS (SELECT 1 FROM {RULES_SQL} WHERE url_pattern LIKE 'https://%' AND regexp_full_match(host, split_part(substr(url_pattern, 9), '/', 1)))")
def flt_host_allowlist(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/?]+)", 1).alias("host"))
    more = spark.createDataFrame([("api.example",), ("",), ("other.example",)], "host string")
    return R.allowed_hosts(hosts.unionAll(more).distinct(), rules(spark))


@query(f"SELECT l.kind, l.ord, e.ord AS shadowed_by FROM {RULES_SQL} l JOIN {RULES_SQL} e ON l.kind = e.kind AND e.ord < l.ord AND regexp_full_match(l.url_pattern, e.url_pattern)")
def lint_rules(spark, sf_dir):
    """Rules that a literal reading shows to be shadowed; here the second blocked URL."""
    return R.lint(rules(spark))


@query("SELECT page_id, (lower(t) LIKE 'text/%' OR lower(t) LIKE 'application/json%') AS is_text, contains(lower(t), 'text/event-stream') AS is_sse FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/event-stream; charset=utf-8' WHEN 1 THEN 'Application/JSON' WHEN 2 THEN 'image/png' ELSE 'Text/Html' END AS t FROM pages)")
def flt_content_type(spark, sf_dir):
    kind = F.expr("CASE page_id % 4 WHEN 0 THEN 'text/event-stream; charset=utf-8' WHEN 1 THEN 'Application/JSON' WHEN 2 THEN 'image/png' ELSE 'Text/Html' END")
    return table(spark, sf_dir, "pages").select("page_id", R.is_text(kind).alias("is_text"), R.is_event_stream(kind).alias("is_sse"))


@query("SELECT doc_id, md5(regexp_replace(text || '{{' || source || chr(10) || '}} end {{}', '(?s)\\{\\{.*?\\}\\}', '', 'g')) AS bare_md5 FROM documents")
def flt_exempt_braces(spark, sf_dir):
    body = F.concat("text", F.lit("{{"), "source", F.lit("\n}} end {{}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.without_exempt(body)).alias("bare_md5"))


# ---- bodies --------------------------------------------------------------------------------------------------------------


def bodies(spark, sf_dir):
    """A request for each conversation: conv_id, url, body."""
    c = table(spark, sf_dir, "conversations")
    turn = F.struct("turn", "role", "text")
    grouped = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))  # a conversation is one request
    kind = lambda i: F.when(i % 3 == 2, "thinking").otherwise("text")
    messages = F.transform("t", lambda x, i: F.struct(x["role"].alias("role"), F.array(F.struct(kind(i).alias("type"), x["text"].alias("text"))).alias("content")))
    system = F.array(*(F.struct(F.lit("text").alias("type"), F.concat(F.lit(s), F.col("conv_id").cast("string")).alias("text")) for s in ("first ", "second ")))
    return grouped.select("conv_id", F.lit("https://api.example/messages").alias("url"), F.to_json(F.struct(messages.alias("messages"), system.alias("system"), F.lit(7).alias("max_tokens"))).alias("body"))


_TURN = "(SELECT conv_id, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS BIGINT) AS i FROM conversations)"
_KIND = "CASE WHEN i % 3 = 2 THEN 'thinking' ELSE 'text' END"
_CONV = "(SELECT DISTINCT conv_id FROM conversations)"
LEAVES = f"""(SELECT conv_id, '$.messages[' || i || '].role' AS path, role AS text FROM {_TURN} WHERE role IS NOT NULL UNION ALL
SELECT conv_id, '$.messages[' || i || '].content[0].type', {_KIND} FROM {_TURN} UNION ALL
SELECT conv_id, '$.messages[' || i || '].content[0].text', text FROM {_TURN} WHERE text IS NOT NULL UNION ALL
SELECT conv_id, '$.system[' || k || '].type', 'text' FROM {_CONV}, (VALUES (0), (1)) s(k) UNION ALL
SELECT conv_id, '$.system[' || k || '].text', CASE k WHEN 0 THEN 'first ' ELSE 'second ' END || conv_id FROM {_CONV}, (VALUES (0), (1)) s(k))"""
_SHOWN = "conv_id, path, md5(text) AS text_md5"


def _shown(found):
    return found.select("conv_id", "path", F.md5("text").alias("text_md5"))


def _found(spark, sf_dir):
    return J.leaves(bodies(spark, sf_dir), "conv_id")


@query(f"SELECT {_SHOWN} FROM {LEAVES}")
def json_leaves(spark, sf_dir):
    return _shown(_found(spark, sf_dir))


@query(f"SELECT {_SHOWN} FROM {LEAVES} l WHERE path = '$.system[1].type' OR path = '$.system[1].text' OR (path LIKE '$.messages%.content[0].%' AND NOT EXISTS (SELECT 1 FROM {_TURN} t WHERE t.conv_id = l.conv_id AND i % 3 = 2 AND starts_with(path, '$.messages[' || i || ']')))")
def json_select_paths(spark, sf_dir):
    wanted = [".system[1:][]", '.messages[].content[] | select(.type != "thinking") | .. | strings']
    return _shown(J.select_paths(_found(spark, sf_dir), [".system[1:]", wanted[1]], "conv_id"))


@query(f"SELECT DISTINCT path FROM {LEAVES}")
def dst_path(spark, sf_dir):
    return _found(spark, sf_dir).select("path").distinct()


@query(f"SELECT conv_id, md5(text) AS text_md5 FROM {_TURN} WHERE i = 1 AND text IS NOT NULL")
def json_get(spark, sf_dir):
    """The value at one path; bodies that lack it have no row."""
    got = bodies(spark, sf_dir).select("conv_id", F.expr("try_variant_get(try_parse_json(body), '$.messages[1].content[0].text', 'string')").alias("v"))
    return got.where("v IS NOT NULL").select("conv_id", F.md5("v").alias("text_md5"))


@query(f"SELECT conv_id, path, md5(CASE WHEN path LIKE '%.role' THEN upper(text) ELSE text END) AS text_md5 FROM {LEAVES}")
def json_set(spark, sf_dir):
    found = _found(spark, sf_dir)
    updates = found.where(F.endswith("path", F.lit(".role"))).groupBy("conv_id").agg(F.collect_list(F.struct("steps", F.upper("text").alias("text"))).alias("u"))
    done = bodies(spark, sf_dir).join(updates, "conv_id", "left").select("conv_id", J.set_texts(F.col("body"), F.col("u")).alias("body"))
    return _shown(J.leaves(done, "conv_id"))


@query("SELECT 1 AS id, '$.a.text' AS path, 'keep' AS text UNION ALL SELECT 1, '$.a.source.type', 'base64'")
def flt_skip_image_payload(spark, sf_dir):
    rows = spark.createDataFrame([(1, '{"a": {"text": "keep", "source": {"type": "base64", "data": "AAAA"}}}')], "id int, body string")
    return J.leaves(rows, "id").where(~J.is_image_payload(F.col("path"))).select("id", "path", "text")


@query("SELECT 1 AS id, '$.b[0].text' AS path, false AS signed UNION ALL SELECT 1, '$.b[1].signature', true UNION ALL SELECT 1, '$.thinking.x', true")
def flt_signed_block(spark, sf_dir):
    rows = spark.createDataFrame([(1, '{"b": [{"text": "t"}, {"signature": "s"}], "thinking": {"x": "y"}}')], "id int, body string")
    return J.leaves(rows, "id").select("id", "path", J.touches_signed(F.col("steps")).alias("signed"))


_SYSTEMS = """SELECT * FROM (VALUES (1, 'https://api.example/messages', '{"m": 1}'), (2, 'https://api.example/messages', '{"system": "be kind"}'), (3, 'https://api.example/messages', '{"system": [{"type": "text", "text": "a"}]}'),
 (4, 'https://api.example/messages', '{"system": "x PROMPT"}'), (5, 'https://api.example/messages', '{"system": 5}'), (6, 'https://api.example/messages', 'no json'), (7, 'https://api.example/messages/more', '{"system": "as it was"}'), (8, CAST(NULL AS VARCHAR(9)), '{"system": "no url"}')) AS f(id, url, body)"""


@query("SELECT * FROM (VALUES (1, 'PROMPT', CAST(NULL AS VARCHAR)), (2, 'be kind' || chr(10) || chr(10) || 'PROMPT', NULL), (3, NULL, 'PROMPT'), (4, 'x PROMPT', NULL), (5, NULL, NULL), (6, NULL, NULL), (7, 'as it was', NULL), (8, 'no url', NULL)) f(id, as_text, last_block)")
def prj_inject_prompt(spark, sf_dir):
    done = spark.sql(_SYSTEMS).select("id", F.try_parse_json(J.inject_prompt(F.col("body"), "PROMPT", F.col("url"), r"https://api\.example/messages")).alias("v"))
    return done.select("id", F.expr("CASE WHEN schema_of_variant(variant_get(v, '$.system', 'variant')) = 'STRING' THEN try_variant_get(v, '$.system', 'string') END").alias("as_text"), F.expr("try_variant_get(v, '$.system[1].text', 'string')").alias("last_block"))


@query(f"SELECT conv_id, path, length(text) AS n FROM {LEAVES} WHERE length(text) >= 10 AND length(text) < 5000")
def prj_walk_fields(spark, sf_dir):
    """Strings of 10 to 4999 code points that are values of keys, not elements of lists."""
    own = F.try_element_at("steps", F.lit(-1))["key"].isNotNull()
    return _found(spark, sf_dir).where(own & F.length("text").between(10, 4999)).select("conv_id", "path", F.length("text").cast("long").alias("n"))


@query("SELECT 1 AS id, '$.tools[0].description' AS path, 'outer' AS text UNION ALL SELECT 1, '$.tools[0].schema.properties.p.description', 'inner'")
def prj_walk_schema(spark, sf_dir):
    rows = spark.createDataFrame([(1, '{"tools": [{"name": "n", "description": "outer", "schema": {"properties": {"p": {"type": "string", "description": "inner"}}}}]}')], "id int, body string")
    return J.select_paths(J.leaves(rows, "id"), [".tools[] | .. | objects | select(.description != null) | .description | strings"], "id").select("id", "path", "text")


# ---- logs and replay -----------------------------------------------------------------------------------------------------


@query(f"SELECT 'https://api.example/messages' AS url, 'POST' AS method, count(*) AS n FROM {_CONV} UNION ALL SELECT 'https://localhost/', 'POST', 1")
def src_request_log(spark, sf_dir):
    """Envelopes written with raw bodies and read again, among a broken line and a bare body."""
    path = records.scratch_path(spark, "requests")
    records.log_requests(bodies(spark, sf_dir).select("url", F.lit("POST").alias("method"), F.create_map(F.lit("x-id"), F.col("conv_id").cast("string")).alias("headers"), "body"), path)
    spark.createDataFrame([('{"bare": true}',), ("{broken",), ("[1]",)], "value string").write.mode("append").text(path)
    return records.load_requests(spark, path).groupBy("url", "method").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT conv_id, path, text_md5 FROM (SELECT {_SHOWN} FROM {LEAVES})")
def snk_request_log(spark, sf_dir):
    path = records.scratch_path(spark, "requests")
    records.log_requests(bodies(spark, sf_dir).select("url", F.lit("POST").alias("method"), F.create_map(F.lit("x-id"), F.col("conv_id").cast("string")).alias("headers"), "body"), path)
    back = records.load_requests(spark, path).select(F.col("headers")["x-id"].cast("long").alias("conv_id"), "body")
    return _shown(J.leaves(back, "conv_id"))


@query(f"SELECT conv_id, 'application/json' AS content_type, 7 AS max_tokens, 'second ' || conv_id AS system FROM {_CONV}")
def src_request_parts(spark, sf_dir):
    requests = bodies(spark, sf_dir).select("conv_id", "url", F.create_map(F.lit("x-id"), F.col("conv_id").cast("string")).alias("headers"), "body")
    parts = records.request_parts(requests)
    body = F.try_parse_json(F.decode("body", "UTF-8"))
    return parts.select(F.col("headers")["x-id"].cast("long").alias("conv_id"), F.col("headers")["content-type"].alias("content_type"), F.try_variant_get(body, "$.max_tokens", "int").alias("max_tokens"), F.try_variant_get(body, "$.system[1].text", "string").alias("system"))


@query(
    f"""WITH hit AS (SELECT DISTINCT page_id FROM {_SENT} JOIN {RULES_SQL} ON {_HIT} WHERE kind = 'anonymise_request'), spans AS MATERIALIZED (SELECT doc_id, entity FROM {_OF_BODIES(D.RESOLVED)}),
leaking AS (SELECT DISTINCT r.doc_id AS page_id FROM {_OF_BODIES(D.TYPED)} r JOIN spans s ON s.doc_id = r.doc_id AND contains({_BARE_UP.format('redacted')}, upper(entity)))
SELECT CASE WHEN h.page_id IS NULL THEN 'no_match' WHEN body IS NULL THEN 'error' WHEN l.page_id IS NOT NULL THEN 'anxious' ELSE 'ok' END AS status, count(*) AS n FROM {_SENT} s LEFT JOIN hit h USING (page_id) LEFT JOIN leaking l USING (page_id) GROUP BY 1"""
)
def replay_status(spark, sf_dir):
    """Requests sent through anew, each with an empty mapping; all domains are watched."""
    return R.replayed(sent(spark, sf_dir), rules(spark), "page_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS status, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def agg_latency_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
