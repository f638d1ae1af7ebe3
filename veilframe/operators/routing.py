"""Routing of requests by rules: deny lists, first matching rule, default deny, host lists, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from .mappings import leaks


def matched(requests: DataFrame, rules: DataFrame, key: str = "url") -> DataFrame:
    """Requests with the rules whose pattern matches the whole URL without its query: adds kind, ord, url_pattern.

    ``rules`` is a configuration file's few rows, so it is broadcast; requests without a match are absent.
    """
    bare = T.strip_query(F.col(key))
    near = F.regexp_like(bare, F.concat(F.lit("^(?:"), F.col("url_pattern"), F.lit(")$")))
    return requests.join(F.broadcast(rules.where("kind <> 'leak_domain'").select("kind", "ord", "url_pattern")), near)


def first_rule(requests: DataFrame, rules: DataFrame, id: str, kind: str) -> DataFrame:
    """The first rule of a kind, in file order, of each request that has one: id, ord, url_pattern."""
    hits = matched(requests, rules.where(F.col("kind") == kind))
    return hits.groupBy(id).agg(F.min(F.struct("ord", "url_pattern")).alias("r")).select(id, "r.ord", "r.url_pattern")


def decide(requests: DataFrame, rules: DataFrame, id: str) -> DataFrame:
    """id and decision: blocked, unknown (matches nothing, denied), deanonymise (a tool's request gets its values back and is not
    judged further), anonymise, or pass. One pass over requests x rules; see ``refused`` for the last step."""
    hits = matched(requests, rules).groupBy(id).agg(F.collect_set("kind").alias("kinds"))
    has = lambda k: F.array_contains("kinds", k)
    decision = (
        F.when(F.col("kinds").isNull(), "unknown").when(has("blocked"), "blocked").when(has("anonymise_response"), "deanonymise")
        .when(has("anonymise_request"), "anonymise").otherwise("pass")
    )
    return requests.select(id).join(hits, id, "left").select(id, decision.alias("decision"))


def watched(rules: DataFrame, key: str = "url") -> tuple[DataFrame, Column]:
    """The leak domains, and whether one of them matches the beginning of a URL without its query."""
    side = F.broadcast(rules.where("kind = 'leak_domain'").select("url_pattern"))
    return side, F.regexp_like(T.strip_query(F.col(key)), F.concat(F.lit("^(?:"), F.col("url_pattern"), F.lit(")")))


def outcome(decided: DataFrame, rules: DataFrame, known: DataFrame, id: str) -> DataFrame:
    """``decided``: id (unique), url, decision, body as it would be sent on. id and decision, where an anonymised or passed request
    that still holds a known value and goes to a leak domain is refused; so is one to be anonymised that has no body left."""
    side, near = watched(rules)
    sent = decided.where(F.col("decision").isin("anonymise", "pass")).join(side, near, "left_semi")
    leaking = leaks(sent.select(id, F.col("body").alias("text")), known, id).where("size(leaked) > 0").select(F.col(id).alias("__leaks"))
    lost = (F.col("decision") == "anonymise") & F.col("body").isNull()
    return decided.join(leaking, F.col(id) == F.col("__leaks"), "left").select(id, F.when(F.col("__leaks").isNotNull() | lost, "refused").otherwise(F.col("decision")).alias("decision"))


def replayed(requests: DataFrame, rules: DataFrame, id: str) -> DataFrame:
    """``requests``: id (unique), url, body. id and status of each request sent through anew, each with a mapping of its own:
    no_match (no rule anonymises it), error (no body to work on), anxious (it goes to a leak domain and a value found in it
    still stands in it, outside exempt braces), or ok."""
    hits = matched(requests, rules.where("kind = 'anonymise_request'")).select(id).distinct().withColumn("__hit", F.lit(True))
    side, near = watched(rules)
    far = requests.join(side, near, "left_semi").select(F.col(id).alias("__far"))
    found = S.find(requests.select(id, F.col("body").alias("text"))).withColumn("spans", S.resolve(F.col("spans")))
    left = F.upper(T.without_exempt(S.typed(F.col("text"), F.col("spans"))))
    judged = found.select(id, F.col("text").isNull().alias("__lost"), F.exists("spans", lambda s: F.contains(left, F.upper(s["text"]))).alias("__leak"))
    joined = judged.join(hits, id, "left").join(far, F.col(id) == F.col("__far"), "left")
    status = F.when(F.col("__hit").isNull(), "no_match").when(F.col("__lost"), "error").when(F.col("__leak") & F.col("__far").isNotNull(), "anxious").otherwise("ok")
    return joined.select(id, status.alias("status"))


def host_patterns(rules: DataFrame) -> DataFrame:
    """Host patterns of https rules: what stands before the first slash."""
    return rules.where(F.startswith("url_pattern", F.lit("https://"))).select(F.split(F.expr("substr(url_pattern, 9)"), "/")[0].alias("host_pattern")).distinct()


def allowed_hosts(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """Hosts to look into: those that a pattern matches whole, and empty ones."""
    near = F.regexp_like(F.col(host), F.concat(F.lit("^(?:"), F.col("host_pattern"), F.lit(")$"))) | (F.coalesce(F.col(host), F.lit("")) == "")
    return hosts.join(F.broadcast(host_patterns(rules)), near, "left_semi")


def lint(rules: DataFrame) -> DataFrame:
    """Rules of a kind that an earlier rule of the same kind shadows literally: their own pattern, read as a URL, matches it."""
    late, early = rules.alias("l"), rules.alias("e")
    plain = F.regexp_replace(F.col("l.url_pattern"), r"\\(.)", "$1")
    near = (F.col("l.kind") == F.col("e.kind")) & (F.col("e.ord") < F.col("l.ord")) & F.regexp_like(plain, F.concat(F.lit("^(?:"), F.col("e.url_pattern"), F.lit(")$")))
    return late.join(F.broadcast(early), near).select(F.col("l.kind").alias("kind"), F.col("l.ord").alias("ord"), F.col("e.ord").alias("shadowed_by"))


def is_text(content_type: Column) -> Column:
    return F.lower(content_type).rlike("^(text/|application/json)")


def is_event_stream(content_type: Column) -> Column:
    return F.contains(F.lower(content_type), F.lit("text/event-stream"))
