"""Queries on several audits at once, and on what markup alone tells of accessibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import scratch
from auditloom.operators import audit, crawl, findings, site
from auditloom.sources import corpus, sinks

from . import fixtures as fx
from . import sql as S
from .urls_text import address_variants, address_variants_sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Robots texts of the audits, by region; one has none.
_ROBOTS = ("", "User-agent: *\nDisallow: /de/\n disallow:/en/1\n", "Disallow: /a\nDisallow: /e\nAllow: /", "Disallow: /", "Disallow:\nDISALLOW: /fr/\nDisallow: /de/1")
_RULES = [(k, line.split(":", 1)[1].strip()) for k, txt in enumerate(_ROBOTS) for line in txt.split("\n") if line.strip().lower().startswith("disallow:") and line.split(":", 1)[1].strip()]


def _each():
    """The audits' ids."""
    return F.array(*(F.lit(f"a{k}") for k in range(5)))


def _audits(spark, d):
    """An audit for each region, which differ in start, budget, depth and heed of robots."""
    r = corpus.table(spark, d, "region")
    starts = corpus.table(spark, d, "pages").select(F.col("page_id").alias("_p"), F.col("url").alias("start_url"))
    k = F.col("r_regionkey")
    texts = F.element_at(F.array(*map(F.lit, _ROBOTS)), (k + 1).cast("int"))
    return r.join(starts, F.col("_p") == k * 3 + 1).select(
        F.concat(F.lit("a"), k.cast("string")).alias("audit_id"), "start_url", (F.lit(8) + k * 9).cast("int").alias("max_pages"), (F.lit(1) + k % 3).cast("int").alias("max_depth"), (k != 3).alias("respect_robots"), texts.alias("txt")
    )


def _graph(spark, d):
    """Links of every audit: each page names those with twice its number, the one after, and three times its number."""
    p = corpus.table(spark, d, "pages").select("page_id", "url")
    named = p.select(F.col("url").alias("source_url"), F.explode(F.array(F.col("page_id") * 2, F.col("page_id") * 2 + 1, F.col("page_id") * 3)).alias("page_id"))
    each = named.join(p.withColumnRenamed("url", "target_url"), "page_id").select("source_url", "target_url")
    return each.withColumn("audit_id", F.explode(_each()))


_AUDITS = f"""au AS (SELECT 'a' || r_regionkey AS audit_id, r_regionkey AS k, url AS start_url, 8 + r_regionkey * 9 AS max_pages, 1 + r_regionkey % 3 AS max_depth FROM region JOIN pages ON page_id = r_regionkey * 3 + 1),
ru(k, rule) AS (VALUES {", ".join(f"({k}, '{rule}')" for k, rule in _RULES)}),
bl AS (SELECT DISTINCT audit_id, url FROM au JOIN ru USING (k), pages WHERE au.k <> 3 AND starts_with({S.path("url")}, rule)),
ed AS (SELECT DISTINCT s.url AS a, t.url AS b FROM pages s JOIN pages t ON t.page_id IN (s.page_id * 2, s.page_id * 2 + 1, s.page_id * 3) WHERE NOT regexp_matches(t.url, '{S.NON_PAGE_RE}')),
k0 AS (SELECT audit_id, start_url AS url, 0 AS depth FROM au WHERE max_pages > 0),
s1 AS (SELECT 'a' || (page_id % 5) AS audit_id, url, page_id AS ord FROM pages WHERE page_id % 11 = 5),
k1 AS (SELECT audit_id, url, 1 AS depth FROM (SELECT s.audit_id, s.url, max_pages, row_number() OVER (PARTITION BY s.audit_id ORDER BY ord, s.url) AS r FROM s1 s JOIN au USING (audit_id) WHERE (s.audit_id, s.url) NOT IN (SELECT audit_id, url FROM k0)) WHERE r <= max_pages - 1),
t1 AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1)"""


def _level(n: int) -> str:
    """The next level of each audit from all that it has taken so far."""
    return f"""k{n + 1} AS (SELECT audit_id, url, {n} AS depth FROM (
    SELECT f.audit_id, f.url, au.max_pages - (SELECT count(*) FROM t{n} x WHERE x.audit_id = f.audit_id) AS free, row_number() OVER (PARTITION BY f.audit_id ORDER BY f.url) AS r
    FROM (SELECT DISTINCT t.audit_id, ed.b AS url FROM t{n} t JOIN au USING (audit_id) JOIN ed ON ed.a = t.url WHERE t.depth = {n - 1} AND {n - 1} < au.max_depth AND (t.audit_id, t.url) NOT IN (SELECT audit_id, url FROM bl)) f
    JOIN au ON au.audit_id = f.audit_id WHERE (f.audit_id, f.url) NOT IN (SELECT audit_id, url FROM t{n})) WHERE r <= free),
t{n + 1} AS (SELECT * FROM t{n} UNION ALL SELECT * FROM k{n + 1})"""


@query(f"WITH {_AUDITS}, {_level(1)}, {_level(2)}, {_level(3)} SELECT audit_id, url, depth, CASE WHEN (audit_id, url) IN (SELECT audit_id, url FROM bl) THEN 'blocked_by_robots_txt' END AS error FROM t4")
def crawl_audits(spark, d):
    """The pages that several audits take at once, with robots, depth and budget of each."""
    audits = _audits(spark, d)
    seeds = corpus.table(spark, d, "pages").where("page_id % 11 = 5").select(F.concat(F.lit("a"), (F.col("page_id") % 5).cast("string")).alias("audit_id"), "url", F.col("page_id").alias("ord"))
    return crawl.crawl_audits(_graph(spark, d), audits, audits.select("audit_id", "txt"), seeds)


@query(f"WITH {_AUDITS} SELECT au.audit_id, url FROM au JOIN ru USING (k), pages WHERE starts_with({S.path('url')}, rule) GROUP BY au.audit_id, url")
def disallowed_by_audit(spark, d):
    """Addresses that each audit's robots text excludes."""
    rules = crawl.indexed_rules(crawl.robots_rules(_audits(spark, d).select("audit_id", "txt")))
    each = corpus.table(spark, d, "pages").select("url", F.explode(_each()).alias("audit_id"))
    return crawl.disallowed(each, rules)


@query(f"SELECT user_id AS audit_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, CASE WHEN user_id % 3 = 0 THEN 5 ELSE user_id % 40 END AS lft FROM events) WHERE r <= lft")
def budget_by_audit(spark, d):
    """What budgets of many audits grant, in the order of arrival."""
    e = corpus.table(spark, d, "events").select(F.col("user_id").alias("audit_id"), "event_id", "ts")
    left = e.select("audit_id").distinct().withColumn("left", F.when(F.col("audit_id") % 3 == 0, F.lit(5)).otherwise(F.col("audit_id") % 40))
    return crawl.granted(e, left, ["ts", "event_id"])


_SCAN = f"""{S.PAGES}, base AS (SELECT page_id AS n, url, html FROM pages),
sc AS (SELECT n, url, unnest([
    {{'id': 'document-title', 'impact': 'serious', 'nodes': CASE WHEN trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) = '' THEN 1 ELSE 0 END}},
    {{'id': 'frame-title', 'impact': 'serious', 'nodes': (n % 6 = 1)::INTEGER + (n % 10 = 9)::INTEGER}},
    {{'id': 'html-has-lang', 'impact': 'serious', 'nodes': CASE WHEN regexp_matches(html, '(?i)<html[^>]*\\slang="[^"]') THEN 0 ELSE 1 END}},
    {{'id': 'image-alt', 'impact': 'critical', 'nodes': (n % 4 // 2)::INTEGER}},
    {{'id': 'label', 'impact': 'critical', 'nodes': CASE WHEN n % 8 = 3 THEN 1 WHEN n % 8 = 5 THEN 2 ELSE 0 END}},
    {{'id': 'link-name', 'impact': 'serious', 'nodes': (n % 5 = 2)::INTEGER + len(list_filter(regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>(.*?)</a>', 1), lambda t: trim(regexp_replace(t, '<[^>]*>', '', 'g')) = ''))::INTEGER}}]) AS v FROM base)"""


@query(f"WITH {_SCAN} SELECT n AS page_id, v.id AS id, v.impact AS impact, v.nodes AS nodes FROM sc WHERE v.nodes > 0")
def accessibility_scan(spark, d):
    """Accessibility rules that the markup of each page breaks."""
    p = audit.parsed(fx.rich_markup(spark, d))
    return p.select("page_id", F.explode("accessibility_violations").alias("v")).select("page_id", "v.id", "v.impact", F.col("v.nodesCount").alias("nodes"))


_TEXTS = {"document-title": "Documents must have <title> element to aid in navigation", "frame-title": "Frames must have an accessible name", "html-has-lang": "<html> element must have a lang attribute", "image-alt": "Images must have alternative text", "label": "Form elements must have labels", "link-name": "Links must have discernible text"}


@query(f"""WITH {_SCAN}, tx(id, description) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _TEXTS.items())})
    SELECT 'Accessibility: ' || description AS title, CASE v.impact WHEN 'critical' THEN 'critical' WHEN 'serious' THEN 'high' ELSE 'medium' END AS severity, count(*)::INTEGER AS affected_page_count, list(url ORDER BY n)[1:10] AS affected_urls_sample
    FROM sc JOIN tx ON tx.id = v.id WHERE v.nodes > 0 GROUP BY description, v.impact""")
def accessibility_from_markup(spark, d):
    """Accessibility findings made from the markup of all pages."""
    p = audit.parsed(fx.rich_markup(spark, d), ("violations",)).select("page_ord", "url", "accessibility_violations")
    return findings.accessibility(scratch.written(p, "violations")).select("title", "severity", "affected_page_count", "affected_urls_sample")


_LONG = 210_000


@query(f"SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/far/' || page_id AS target_url, {_LONG} // 5 + page_id % 7 + 1 AS word_count FROM pages")
def long_pages(spark, d):
    """Links and words behind the length at which markup is kept (H5, H8)."""
    n = F.col("page_id").cast("string")
    html = F.concat(F.lit("<html lang=en><title>t</title><body>"), F.repeat(F.lit("word "), _LONG // 5), F.repeat(F.lit("more "), (F.col("page_id") % 7).cast("int")), F.lit('<a href="/far/'), n, F.lit('">far</a></body></html>'))
    pages = corpus.table(spark, d, "pages").select("page_id", F.col("page_id").alias("page_ord"), "url", html.alias("html"))
    p = audit.parsed(pages, ("anchors", "word_count"))
    return sinks.link_rows(p, "word_count").select("page_id", "target_url", F.col("word_count").cast("long").alias("word_count"))


_TAGGED = "'?a=1&b=2&c=3&d=' || page_id || '&utm_source=x'"


@query(rf"""WITH {address_variants_sql()}, ad AS (SELECT page_id, CASE WHEN page_id % 4 = 1 THEN regexp_replace(url, '[?#].*$', '') || {_TAGGED} ELSE url END AS url FROM vp),
    a AS (SELECT page_id, url, {S.host('url')} AS host, {S.path('url')} AS path, list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda s: s <> ''), lambda s: string_split(s, '=')[1]) AS ks FROM ad),
    g AS (SELECT regexp_replace(lower(path), '/$', '') AS k, list_sort(list(DISTINCT url)) AS pages, count(DISTINCT path) AS paths, count(DISTINCT regexp_replace(path, '/$', '')) AS bare, min(page_id) AS o FROM a GROUP BY host, k),
    t AS (SELECT *, len(list_filter(ks, lambda n: n IN ('fbclid', 'gclid', 'msclkid', 'mc_cid', 'mc_eid') OR starts_with(n, 'utm_'))) > 0 AS tracked, len(ks) > 3 AS bloat FROM a)
    SELECT (SELECT coalesce(list(pages ORDER BY o), [])[1:15] FROM g WHERE len(pages) > 1 AND bare < paths) AS trailing_slash_inconsistencies, (SELECT coalesce(list(pages ORDER BY o), [])[1:15] FROM g WHERE len(pages) > 1 AND bare > 1) AS case_inconsistencies,
        (SELECT count(*) FROM t WHERE bloat) AS param_bloat_count, (SELECT count(*) FROM t WHERE tracked) AS tracking_param_count,
        (SELECT list(url ORDER BY page_id)[1:10] FROM t WHERE bloat) AS param_bloat_examples, (SELECT list(url ORDER BY page_id)[1:10] FROM t WHERE tracked) AS tracking_param_examples""")
def url_health(spark, d):
    """The summary of addresses with its capped lists of examples."""
    p = address_variants(spark, d)
    tagged = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?a=1&b=2&c=3&d="), F.col("page_id").cast("string"), F.lit("&utm_source=x"))
    return site.url_health(p.withColumn("url", F.when(F.col("page_id") % 4 == 1, tagged).otherwise(F.col("url"))))


def _layouts(spark, d):
    """Pages whose layout follows from their number: cards, an aside, classes in changing order, many empty or repeated parts."""
    n = F.col("page_id")
    k = (n % 3).cast("string")
    on = lambda hit, *parts: F.when(hit, F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))).otherwise("")
    card = F.concat(F.lit('<article class="card  b'), k, F.lit('"><p>w</p></article>'))
    html = F.concat(
        F.lit('<!doctype html><html lang="en"><head><title>T</title><script>x</script></head><body><header class="top bar"><nav><a href="/">h</a></nav></header><main><p>' + "long text of a page " * 20 + "</p>"),
        F.array_join(F.array_repeat(card, (n % 4).cast("int")), ""), on(n % 5 == 0, '<aside class="z y x w"><ul><li>a</li><li>b</li></ul></aside>'), on(n % 7 == 0, '<form class="f"><input name="q" aria-label="q"></form>'),
        F.lit("</main><footer></footer><script>y</script></body></html>"),
    )
    return audit.parsed(corpus.table(spark, d, "pages").select("page_id", n.alias("page_ord"), "url", html.alias("html"), F.when(n % 17 == 0, 404).otherwise(200).alias("status_code")))


_LAYOUTS = """ly AS (SELECT page_id AS n, url, 'header.bar.top(nav.(a.()))|main.(p.()' || CASE WHEN page_id % 4 = 0 THEN '' ELSE '|article.b' || (page_id % 3) || '.card(p.())' || CASE WHEN page_id % 4 > 1 THEN '*' ELSE '' END END
    || CASE WHEN page_id % 5 = 0 THEN '|aside.w.x.y(ul.(li.()*))' ELSE '' END || CASE WHEN page_id % 7 = 0 THEN '|form.f(input.())' ELSE '' END || ')|footer.()' AS skeleton FROM pages),
cs AS (SELECT n, url, unnest(list_concat(['header.bar.top', 'nav', 'footer'], CASE WHEN n % 4 > 0 THEN ['article.b' || (n % 3) || '.card'] ELSE [] END, CASE WHEN n % 5 = 0 THEN ['aside.w.x'] ELSE [] END, CASE WHEN n % 7 = 0 THEN ['form.f'] ELSE [] END)) AS signature FROM ly)"""


@query(f"WITH {_LAYOUTS} SELECT substr(sha1(skeleton), 1, 12) AS fingerprint, count(*) AS page_count, min(url) AS example_url, list(url ORDER BY url)[1:5] AS sample_urls FROM ly WHERE n % 17 <> 0 GROUP BY skeleton")
def templates_by_layout(spark, d):
    """Templates of pages by the hash of their skeleton."""
    return site.template_groups(_layouts(spark, d), "UTF8_BINARY").select("fingerprint", "page_count", "example_url", "sample_urls")


@query(f"WITH {_LAYOUTS}, c AS (SELECT signature, count(DISTINCT url) AS k, min(url) AS u FROM cs GROUP BY signature) SELECT signature, string_split(signature, '.')[1] AS tag, array_to_string(string_split(signature, '.')[2:], '.') AS classes, k AS page_count, u AS example_url FROM c WHERE k >= 2")
def components_by_layout(spark, d):
    """Components that pages share."""
    return site.components(site.component_hits(_layouts(spark, d)), F.lit(1)).drop("page_coverage_pct")


@query("WITH o AS (SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS page FROM orders WHERE o_custkey % 3 = 1) SELECT page, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, lag(max(o_orderkey)) OVER (ORDER BY page) AS after_key FROM o GROUP BY page")
def keyset_batches(spark, d):
    """All pages of a hundred rows that paging by key reads of a part of a table, with the key after which each begins."""
    rows = corpus.table(spark, d, "orders").where("o_custkey % 3 = 1").select("o_orderkey", "o_totalprice")
    pages = corpus.keyset_pages(rows, "o_orderkey").groupBy("page").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))
    before = pages.select((F.col("page") + 1).alias("page"), F.col("last_key").alias("after_key"))
    return pages.join(before, "page", "left")
