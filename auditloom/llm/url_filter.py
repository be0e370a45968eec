"""URL filters by redirect equivalence, in DataFrame operations only.

Explicit rules (host with its subdomains, and a path prefix) decide first; the longest fitting rule wins. Urls that no
rule fits take the method's verdict: redirects and canonical links are edges between urls, connected components of
these edges are sets of aliases, and a block decision on any alias blocks the others. An explicit allow on a url
itself takes precedence over a block that reaches it through aliases.

Edges come from ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` of the pages' markup (comments and scripts
apart) and, if given, from a table of redirects (source, target). Urls of pages, targets and redirects alike become nodes as browsers
resolve them: scheme and host in lower case, no port that is the scheme's own, dot segments and backslashes resolved, no fragment. Hosts that
hold many pages are many nodes, and no step gathers the pages of a host. A page's own rule is that of its url as it is written.

Defined results: a url that is null or has no ``://`` has empty host and path, fits no rule, is no node and is allowed; null
markup has no edges; markup of any length is read whole, in one pass; rows that repeat give repeated rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import urls
from auditloom.operators.components import connected_components

from . import common

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """A url as a node: scheme and host in lower case, no fragment, a slash for an empty path."""
    rest = _rest(url)
    tail = F.regexp_extract(rest, r"\A[^/?#]*([^#]*)", 1)
    scheme = F.translate(F.substring(url, F.lit(1), F.instr(url, "://") - 1), _UPPER, _LOWER)
    return F.when(rest.isNotNull(), F.concat(scheme, F.lit("://"), host_of(url), F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    name = verdict = None
    for how, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(how)) if verdict is None else verdict.when(fits, F.lit(how))
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _attribute(tag: Column, name: str) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{form}", 1), F.lit("")) for form in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")))


def markup_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's node and the node that it names as canonical or refreshes to."""
    # what is not closed reaches to the end, so that many open comments cost one pass
    html = F.when(pages["html"].rlike("(?i)canonical|http-equiv"), F.regexp_replace(pages["html"], r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)", " "))
    tags = pages.select(pages["url"].cast("string").alias("u"), F.explode(F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\s[^>]*>)"), 1)).alias("tag"))
    rel, equiv = F.lower(_attribute(F.col("tag"), "rel")), F.lower(F.trim(_attribute(F.col("tag"), "http-equiv")))
    href = F.when(F.col("tag").rlike("(?i)^<link") & rel.rlike(r"(^|\s)canonical(\s|$)"), _attribute(F.col("tag"), "href")).when(
        F.col("tag").rlike("(?i)^<meta") & (equiv == "refresh"), F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1)
    )
    # in written steps: one expression for all would be repeated in itself many times over, beyond what a method can hold
    named = common.written(tags.select("u", href.alias("href")), "url-links").where("href <> ''")
    return resolved_edges(named.select("u", F.regexp_replace("href", "&amp;", "&").alias("href")))


def resolved_edges(named: DataFrame) -> DataFrame:
    """(a, b): the nodes of an address u and of what it names, href, resolved on it."""
    targets = common.written(named.select(urls.resolve(F.col("u"), F.col("u")).alias("u"), urls.resolve(F.col("u"), F.col("href")).alias("v")), "url-targets")
    return targets.select(key_of(F.col("u")).alias("a"), key_of(F.col("v")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, reached (whether an alias's block decided)."""
    edges = markup_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(resolved_edges(redirects.select(redirects["source"].cast("string").alias("u"), redirects["target"].cast("string").alias("href"))))
    alias = connected_components(edges)
    # a node's own decision follows from the node itself, so pages that are named but not in the table count as well
    decided = alias.withColumn("verdict", fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules)[1])
    blocked = decided.groupBy("component").agg(F.max(F.col("verdict").eqNullSafe("block")).alias("hit")).where("hit").select("component")
    # a rule that allows a node keeps the block of its aliases from it, however the page's url is written
    reached = decided.join(blocked, "component", "left_semi").where(~F.col("verdict").eqNullSafe("allow")).select(F.col("node").alias("_node")).distinct()
    url = pages["url"].cast("string")
    # written first: the node's expression names the resolved url many times
    own = common.written(pages.select(pages["page_id"].alias("page_id"), url.alias("url"), urls.resolve(url, url).alias("node")), "url-nodes")
    rows = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("node")).alias("_key"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_own": verdict})
    joined = rows.join(reached, F.when(F.col("_own").isNull(), F.col("_key")) == F.col("_node"), "left")
    hit = F.col("_node").isNotNull()
    return joined.select("page_id", "host", "path", "rule", F.coalesce("_own", F.when(hit, "block").otherwise("allow")).alias("verdict"), hit.alias("reached"))
