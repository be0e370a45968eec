"""Pieces of DuckDB SQL that several restatements share."""

from __future__ import annotations

from auditloom.functions.text import STOPWORDS
from auditloom.functions.urls import NON_PAGE

_SCHEME = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://"


def host(u: str) -> str:
    return rf"lower(regexp_replace(regexp_extract({u}, '{_SCHEME}([^/?#\s]*)', 1), '^.*@', ''))"


def path(u: str) -> str:
    raw = rf"regexp_extract({u}, '{_SCHEME}[^/?#\s]*([^?#]*)', 1)"
    return f"(CASE WHEN {host(u)} = '' THEN '' WHEN {raw} = '' THEN '/' ELSE {raw} END)"


def depth(u: str) -> str:
    return f"len(list_filter(string_split({path(u)}, '/'), lambda s: s <> ''))"


def unescaped(x: str) -> str:
    for name, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def visible(html: str) -> str:
    body = rf"regexp_replace({html}, '(?is)^.*?<body[^>]*>', '')"
    body = rf"regexp_replace({body}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->', '', 'g')"
    body = rf"regexp_replace({body}, '(?i)</?(?:p|div|h[1-6]|li|br|tr|td|section|article|header|footer|nav|ul|ol)(?:\s[^>]*)?>', ' ', 'g')"
    flat = unescaped(f"regexp_replace({body}, '<[^>]*>', '', 'g')")
    return rf"trim(regexp_replace({flat}, '\s+', ' ', 'g'))"


PAGES = rf"""p0 AS (
    SELECT 'fixture' AS audit_id, page_id AS page_ord, page_id, url, html,
        CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS status_code,
        CASE WHEN page_id % 29 = 0 THEN 'timeout' END AS error,
        {depth("url")} AS depth, (100 + page_id % 400)::DOUBLE AS response_time_ms,
        TIMESTAMP '2020-01-01 00:00:00' + to_days((page_id * 7)::INTEGER) AS last_modified,
        {unescaped("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title,
        trim({unescaped("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")}) AS h1_text,
        nullif(regexp_extract(html, '(?is)<html[^>]*\slang="([^"]*)"', 1), '') AS lang,
        {visible("html")} AS text
    FROM pages),
pg AS (SELECT *, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word_count FROM p0)"""

NON_PAGE_RE = r"(?i)\.(" + "|".join(NON_PAGE) + r")(\?|#|$)"
_ORIGIN = r"regexp_extract(url, '^(\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
LINKS = rf"""l0 AS (SELECT url, {unescaped("h")} AS h FROM (SELECT url, unnest(list_distinct(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"', 1))) AS h FROM pages) WHERE h <> '' AND NOT regexp_matches(h, '^(mailto|tel|javascript):')),
l1 AS (SELECT DISTINCT url AS source_url,
    CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h
         WHEN starts_with(h, '/') THEN {_ORIGIN} || h
         ELSE {_ORIGIN} || regexp_replace({path("url")}, '[^/]*$', '') || h END AS target_url FROM l0),
lk AS (SELECT source_url, target_url, regexp_replace({host("target_url")}, '^www\.', '') = regexp_replace({host("source_url")}, '^www\.', '') AS is_internal
       FROM l1 WHERE NOT regexp_matches(target_url, '{NON_PAGE_RE}'))"""

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z][a-z''-]{{2,}}')"


def keywords(text: str) -> str:
    return f"list_filter({words(text)}, lambda w: w NOT IN ({STOP}))"


def shingles(w: str, k: int) -> str:
    """Distinct runs of k of a column of words; an expression would be evaluated anew for each run."""
    return f"list_distinct(list_transform(range(1, greatest(len({w}) - {k - 1}, 0) + 1), lambda i: array_to_string(list_slice({w}, i, i + {k - 1}), ' ')))"


def half_up(x: str) -> str:
    return f"floor({x} + 0.5)"


def one_place(x: str) -> str:
    return f"(floor(({x}) * 10 + 0.5) / 10)"


def share3(n: str, total: str) -> str:
    return f"(floor({n}::DOUBLE / {total} * 1000 + 0.5) / 1000)"


def percent(n: str, total: str) -> str:
    return f"(CASE WHEN {total} > 0 THEN floor(100.0::DOUBLE * {n} / {total} * 10 + 0.5) / 10 ELSE 0.0 END)"


def pct_score(bad: str, total: str) -> str:
    return f"(CASE WHEN {total} <= 0 THEN 100.0 ELSE floor(100 * (1 - {bad}::DOUBLE / {total}) * 10 + 0.5) / 10 END)"


def flesch(text: str) -> str:
    w = f"regexp_extract_all({text}, '[a-zA-Z'']+')"
    one = "regexp_replace(lower(w), '[^a-z]', '', 'g')"
    groups = f"greatest(len(regexp_extract_all({one}, '[aeiouy]+')), 1)"
    syllables = f"(CASE WHEN {one} = '' THEN 0 WHEN ends_with({one}, 'e') AND {groups} > 1 THEN {groups} - 1 ELSE {groups} END)"
    sounds = f"list_sum(list_transform({w}, lambda w: {syllables}))"
    sentences = rf"greatest(len(list_filter(regexp_split_to_array({text}, '[.!?]+'), lambda s: regexp_matches(s, '\S'))), 1)"
    score = f"206.835::DOUBLE - 1.015::DOUBLE * (len({w})::DOUBLE / {sentences}) - 84.6::DOUBLE * ({sounds}::DOUBLE / len({w}))"
    return f"(CASE WHEN len({w}) >= 20 THEN {one_place(score)} END)"


#: Findings as a function of the part table, for reports that need many of them.
FINDINGS = """fd AS (
    SELECT p_partkey::INTEGER AS ord,
        list_extract(['broken_page', 'orphan_page', 'missing_h1', 'missing_title', 'scale_summary', 'cms_detected', 'mixed_content', 'near_duplicate_content'], (p_partkey % 8)::INTEGER + 1) AS finding_type,
        CASE WHEN p_partkey % 6 = 0 THEN 'say "' || p_name || '", twice' ELSE p_name END AS title,
        list_extract(['critical', 'high', 'medium', 'low', 'unknown'], (p_size % 5)::INTEGER + 1) AS severity,
        list_extract(['ootb', 'config', 'custom_dev'], (p_partkey % 3)::INTEGER + 1) AS effort_bucket,
        CASE p_partkey % 4 WHEN 0 THEN ['ux'] WHEN 1 THEN ['content', 'business'] WHEN 2 THEN ['business'] ELSE ['ux', 'content'] END AS personas,
        p_size AS affected_page_count, p_type AS description, 'brand ' || p_brand AS detection_method
    FROM part)"""


#: What ``fixtures.rich_pages`` adds to page n's markup, and where its parts lead.
RICH = rf"""ri AS (SELECT page_id AS n, *, {_ORIGIN} AS origin, regexp_replace({path("url")}, '[^/]*$', '') AS folder FROM pg)"""
PARENT = "regexp_replace(folder, '[^/]+/$', '')"
