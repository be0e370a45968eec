"""Queries on addresses and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import text, urls
from auditloom.functions.numbers import half_up, one_place, pct_score
from auditloom.operators import content, crawl, near_duplicates, site
from auditloom.sources import corpus

from . import fixtures as fx
from . import sql as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pages(spark, d, *columns):
    return corpus.table(spark, d, "pages").select("page_id", "url", *columns)


def _docs(spark, d):
    return corpus.table(spark, d, "documents").select(F.col("doc_id").alias("page_ord"), F.col("doc_id").cast("string").alias("url"), "text")


@query(f"SELECT page_id, {S.host('url')} AS host FROM pages")
def url_host(spark, d):
    """Hosts of addresses (F1)."""
    return _pages(spark, d).select("page_id", urls.host(F.col("url")).alias("host"))


@query(f"SELECT page_id, {S.depth('url')} AS path_depth FROM pages")
def path_depth(spark, d):
    """Path segments of addresses (F2)."""
    return _pages(spark, d).select("page_id", urls.path_depth(F.col("url")).alias("path_depth"))


@query(rf"SELECT p_partkey, regexp_matches({S.path('u')}, '{S.NON_PAGE_RE}') AS non_page FROM (SELECT p_partkey, 'http://h.example/' || p_partkey || list_extract(['.pdf', '.html', '.DOCX?x=1', '/', '.jpeg', '.tar.gz', '.php?f=a.pdf'], (p_partkey % 7)::INTEGER + 1) AS u FROM part)")
def non_html_filter(spark, d):
    """Addresses of files that are no pages (P9), on paths."""
    ends = F.array(*map(F.lit, (".pdf", ".html", ".DOCX?x=1", "/", ".jpeg", ".tar.gz", ".php?f=a.pdf")))
    u = F.concat(F.lit("http://h.example/"), F.col("p_partkey").cast("string"), F.element_at(ends, (F.col("p_partkey") % 7 + 1).cast("int")))
    return corpus.table(spark, d, "part").select("p_partkey", urls.is_non_page(u).alias("non_page"))


@query(r"SELECT s_suppkey, regexp_matches(h, '(^|\.)(staging|stage|dev|test|uat|preprod|qa)(\.|-)') AS staging FROM (SELECT s_suppkey, list_extract(['dev.example.com', 'www.example.com', 'a.staging-2.example.com', 'development.example.com', 'qa.x.org'], (s_suppkey % 5)::INTEGER + 1) AS h FROM supplier)")
def staging_hosts(spark, d):
    """Hosts that look like staging."""
    names = F.array(*map(F.lit, ("dev.example.com", "www.example.com", "a.staging-2.example.com", "development.example.com", "qa.x.org")))
    u = F.concat(F.lit("https://"), F.element_at(names, (F.col("s_suppkey") % 5 + 1).cast("int")), F.lit("/p"))
    return corpus.table(spark, d, "supplier").select("s_suppkey", urls.is_staging(u).alias("staging"))


_KEYS = r"list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda s: s <> ''), lambda s: string_split(s, '=')[1])"


@query(f"SELECT page_id, url, list_filter(k, lambda n: n IN ('fbclid', 'gclid', 'msclkid', 'mc_cid', 'mc_eid') OR starts_with(n, 'utm_')) AS tracking FROM (SELECT page_id, url, {_KEYS} AS k FROM pages) WHERE len(list_filter(k, lambda n: n IN ('fbclid', 'gclid', 'msclkid', 'mc_cid', 'mc_eid') OR starts_with(n, 'utm_'))) > 0")
def tracking_params(spark, d):
    """Addresses with campaign parameters."""
    p = _pages(spark, d).withColumn("page_ord", F.col("page_id"))
    return site.parameter_counts(p).where(F.size("tracking_params") > 0).select(F.col("page_ord").alias("page_id"), "url", F.col("tracking_params").alias("tracking"))


@query(f"SELECT page_id, len({_KEYS}) AS param_count FROM pages WHERE len({_KEYS}) > 1")
def param_bloat(spark, d):
    """Addresses with more than one parameter here (the audit's limit is three; F4, A17)."""
    p = _pages(spark, d).withColumn("page_ord", F.col("page_id"))
    return site.parameter_counts(p).where("param_count > 1").select(F.col("page_ord").alias("page_id"), "param_count")


_VARIANTS = """vp AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://s.example/Dir/P' || (page_id // 5 % 40) WHEN 1 THEN 'https://s.example/dir/p' || (page_id // 5 % 40) || '/' WHEN 2 THEN 'https://S.example/dir/p' || (page_id // 5 % 40) ELSE url END AS url FROM pages)"""
_GROUPS = rf"""{_VARIANTS}, a AS (SELECT page_id, url, {S.host('url')} AS host, {S.path('url')} AS path FROM vp),
g AS (SELECT host, regexp_replace(lower(path), '/$', '') AS k, list_sort(list(DISTINCT url)) AS pages, count(DISTINCT path) AS paths, count(DISTINCT regexp_replace(path, '/$', '')) AS bare, min(page_id) AS first_page FROM a GROUP BY host, k)"""


def address_variants_sql() -> str:
    """The table vp of addresses that differ in case, a final slash, or the case of their host."""
    return _VARIANTS


def address_variants(spark, d):
    """The same as a frame."""
    n = F.floor(F.col("page_id") / 5) % 40
    k = F.col("page_id") % 5
    name = lambda head, tail="": F.concat(F.lit(head), n.cast("string"), F.lit(tail))
    u = F.when(k == 0, name("https://s.example/Dir/P")).when(k == 1, name("https://s.example/dir/p", "/")).when(k == 2, name("https://S.example/dir/p")).otherwise(F.col("url"))
    return corpus.table(spark, d, "pages").select("page_id", F.col("page_id").alias("page_ord"), u.alias("url"))


@query(f"WITH {_GROUPS} SELECT first_page, pages FROM g WHERE len(pages) > 1 AND bare < paths")
def url_slash_conflicts(spark, d):
    """Addresses with and without a final slash."""
    return site.address_groups(address_variants(spark, d)).where("slash_conflict").select(F.col("page_ord").alias("first_page"), "pages")


@query(f"WITH {_GROUPS} SELECT first_page, pages FROM g WHERE len(pages) > 1 AND bare > 1")
def url_case_conflicts(spark, d):
    """Addresses in several letter cases."""
    return site.address_groups(address_variants(spark, d)).where("case_conflict").select(F.col("page_ord").alias("first_page"), "pages")


@query(f"SELECT page_id, {S.path('url')} AS path, starts_with({S.path('url')}, '/de/') OR starts_with({S.path('url')}, '/en/1') AS blocked FROM pages")
def robots_allowed(spark, d):
    """Disallow lines as path prefixes (P10)."""
    rules = F.lit("User-agent: *\nDisallow: /de/\n disallow:/en/1\nDisallow:\nAllow: /\n")
    return _pages(spark, d).select("page_id", urls.path(F.col("url")).alias("path"), (~urls.robots_allow(rules, F.col("url"))).alias("blocked"))


@query("SELECT p_partkey, CASE WHEN e = '' THEN 'unknown' ELSE e END AS extension FROM (SELECT p_partkey, lower(regexp_extract('f/' || p_brand || list_extract(['.PDF', '', '.docx?a=b', '.tar.gz'], (p_partkey % 4)::INTEGER + 1), '(?i)\\.([a-z0-9]+)(?:\\?|$)', 1)) AS e FROM part)".replace("\\\\", "\\"))
def file_extension(spark, d):
    """First extension before a query or the end."""
    ends = F.array(*map(F.lit, (".PDF", "", ".docx?a=b", ".tar.gz")))
    return corpus.table(spark, d, "part").select("p_partkey", urls.extension(F.concat(F.lit("f/"), "p_brand", F.element_at(ends, (F.col("p_partkey") % 4 + 1).cast("int")))).alias("extension"))


@query(f"SELECT doc_id, {S.flesch('text')} AS flesch FROM documents")
def flesch(spark, d):
    """Reading ease of documents."""
    return corpus.table(spark, d, "documents").select("doc_id", text.flesch(F.col("text")).alias("flesch"))


@query(f"WITH {S.PAGES}, f AS (SELECT page_ord, url, {S.flesch('text')} AS score FROM pg) SELECT page_ord, url, score FROM f WHERE score < 30")
def low_readability(spark, d):
    """Pages that are very hard to read."""
    p = corpus.fixture_pages(spark, d).select("page_ord", "url", text.flesch(F.col("text")).alias("score"))
    return p.where("score < 30")


_WORDS = f"w AS (SELECT page_ord, url, unnest(k) AS keyword, generate_subscripts(k, 1) AS pos FROM (SELECT doc_id AS page_ord, doc_id::VARCHAR AS url, {S.keywords('text')} AS k FROM documents))"
_TOP = f"""{_WORDS}, c AS (SELECT keyword, count(*) AS occurrences, count(DISTINCT url) AS pages_found_on, min(struct_pack(o := page_ord, p := pos)) AS f FROM w GROUP BY keyword),
kw AS (SELECT row_number() OVER (ORDER BY occurrences DESC, f) AS rank, keyword, occurrences, pages_found_on, {S.share3('pages_found_on', '(SELECT count(DISTINCT doc_id) FROM documents)')} AS pct_of_pages FROM c ORDER BY rank LIMIT 20)"""
_PHRASES = f"""ph AS (SELECT page_ord, pos, keyword || ' ' || lead(keyword) OVER (PARTITION BY page_ord ORDER BY pos) AS phrase FROM w),
pc AS (SELECT phrase, count(*) AS occurrences, min(struct_pack(o := page_ord, p := pos)) AS f FROM ph WHERE phrase IS NOT NULL GROUP BY phrase),
pk AS (SELECT row_number() OVER (ORDER BY occurrences DESC, f) AS rank, phrase, occurrences FROM pc ORDER BY rank LIMIT 20)"""


@query(f"WITH {_TOP} SELECT keyword, occurrences, pages_found_on, pct_of_pages FROM kw")
def keywords(spark, d):
    """Top keywords of documents."""
    return content.top_keywords(_docs(spark, d)).drop("first")


@query(f"WITH {_TOP}, {_PHRASES} SELECT phrase, occurrences FROM pk")
def phrases(spark, d):
    """Top word pairs of documents."""
    return content.top_phrases(_docs(spark, d)).drop("first")


@query(f"WITH {_TOP}, {_PHRASES} SELECT coalesce(kw.rank, pk.rank)::INTEGER AS rank, keyword, kw.occurrences AS keyword_occurrences, phrase, pk.occurrences AS phrase_occurrences FROM kw FULL JOIN pk ON kw.rank = pk.rank")
def keywords_phrases_zip(spark, d):
    """Keywords and phrases side by side."""
    a = content.top_keywords(_docs(spark, d)).select("keyword", F.col("occurrences").alias("keyword_occurrences"), F.col("first").alias("fa"))
    b = content.top_phrases(_docs(spark, d)).select("phrase", F.col("occurrences").alias("phrase_occurrences"), F.col("first").alias("fb"))
    z = content.zipped(a, b, [F.desc("keyword_occurrences"), F.col("fa")], [F.desc("phrase_occurrences"), F.col("fb")])
    return z.select("rank", "keyword", "keyword_occurrences", "phrase", "phrase_occurrences")


@query("WITH f AS (SELECT doc_id, CASE WHEN text <> '' THEN first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) END AS f FROM documents) SELECT doc_id AS page_ord, CASE WHEN f <> doc_id THEN f::VARCHAR END AS duplicate_of FROM f")
def exact_duplicates(spark, d):
    """The first document with the same text."""
    return content.duplicate_of(_docs(spark, d)).select("page_ord", "duplicate_of")


@query("SELECT doc_id, substr(sha1(text), 1, 12) AS fingerprint FROM documents")
def sha1_prefix(spark, d):
    """Short fingerprints."""
    return corpus.table(spark, d, "documents").select("doc_id", F.substring(F.sha1("text"), 1, 12).alias("fingerprint"))


@query("SELECT doc_id, ((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END))::BIGINT::VARCHAR AS text_hash FROM (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM documents)")
def text_hash(spark, d):
    """The 32-bit rolling hash (F8)."""
    return corpus.table(spark, d, "documents").select("doc_id", content.text_hash(F.col("text")).alias("text_hash"))


_PAIRS = f"""w AS MATERIALIZED (SELECT doc_id, {S.words('text')} AS w FROM documents), s AS MATERIALIZED (SELECT doc_id AS id, unnest({S.shingles('w', 8)}) AS g FROM w), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
pr AS (SELECT a, b, i::DOUBLE / (x.n + y.n - i) AS jaccard FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE i::DOUBLE / (x.n + y.n - i) >= 0.75)"""
_CLUSTERS = f"""RECURSIVE {_PAIRS}, e AS (SELECT a AS x, b AS y FROM pr UNION SELECT b, a FROM pr), r AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node)"""


@query(f"WITH {_CLUSTERS} SELECT node AS id, min(root) AS cluster FROM r GROUP BY node")
def near_dup_clusters(spark, d):
    """Clusters of near-duplicate documents."""
    docs = corpus.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return content.near_duplicate_clusters(docs, "id", max_pages=None)


@query(f"WITH {_CLUSTERS}, cl AS (SELECT node, min(root) AS cluster FROM r GROUP BY node) SELECT count(DISTINCT cluster) AS clusters, count(*) AS pages FROM cl")
def near_dup_rollup(spark, d):
    """Number of clusters and of their pages."""
    c = near_dup_clusters(spark, d)
    return c.agg(F.countDistinct("cluster").alias("clusters"), F.count("*").alias("pages"))


@query(f"WITH {_PAIRS}, x AS (SELECT text, min(id) AS m FROM n JOIN documents ON doc_id = id GROUP BY text) SELECT a, b, floor(jaccard * 1000000 + 0.5) / 1000000 AS jaccard FROM pr WHERE jaccard < 1 AND a IN (SELECT m FROM x) AND b IN (SELECT m FROM x)")
def near_dup_pairs(spark, d):
    """Pairs of unlike near-duplicate documents, the first of each text."""
    docs = corpus.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    firsts, _ = near_duplicates.first_texts(docs, "id")
    pairs = content.unlike_pairs(content.near_duplicate_pairs(firsts, "id"))
    return pairs.select("a", "b", (half_up(F.col("jaccard") * 1000000) / 1000000).alias("jaccard"))


@query(f"WITH w AS MATERIALIZED (SELECT doc_id, {S.words('text')} AS w FROM documents), s AS MATERIALIZED (SELECT doc_id, {S.shingles('w', 2)} AS s FROM w), g AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s), i AS (SELECT x.doc_id, count(*) AS n FROM g x JOIN g y ON x.doc_id + 1 = y.doc_id AND x.g = y.g GROUP BY x.doc_id) SELECT a.doc_id, {S.half_up('1000 * coalesce(i.n, 0)::DOUBLE / greatest(len(a.s) + len(b.s) - coalesce(i.n, 0), 1)')} AS permille FROM s a JOIN s b ON a.doc_id + 1 = b.doc_id LEFT JOIN i ON i.doc_id = a.doc_id")
def jaccard(spark, d):
    """Similarity of neighbouring documents by word pairs, in thousandths (U4)."""
    w = corpus.table(spark, d, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    s = w.select("doc_id", text.shingles(F.col("w"), 2).alias("s"))
    met = s.select("doc_id", F.col("s").alias("x")).join(s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("y")), "doc_id")
    both = F.size(F.array_intersect("x", "y"))
    return met.select("doc_id", half_up(1000 * both / F.greatest(F.size("x") + F.size("y") - both, F.lit(1))).alias("permille"))


@query("SELECT CASE WHEN n < 150 THEN 'Thin' WHEN n <= 800 THEN 'Standard' ELSE 'Deep' END AS tier, count(*) AS documents FROM (SELECT len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents) GROUP BY tier".replace("\\\\", "\\"))
def word_tier(spark, d):
    """Documents by length."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return corpus.table(spark, d, "documents").select(text.word_tier(n).alias("tier")).groupBy("tier").agg(F.count("*").alias("documents"))


@query(f"SELECT l_orderkey, l_linenumber, {S.half_up('l_extendedprice * l_discount - 500')} AS rounded, {S.one_place('l_extendedprice / 7 - 5000')} AS tenth, {S.pct_score('l_quantity', '(l_linenumber * 10 - 10)')} AS score FROM lineitem")
def rounding(spark, d):
    """Halves towards plus infinity, one place, percentage scores."""
    li = corpus.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", half_up(F.col("l_extendedprice") * F.col("l_discount") - 500).alias("rounded"), one_place(F.col("l_extendedprice") / 7 - 5000).alias("tenth"), pct_score(F.col("l_quantity"), F.col("l_linenumber") * 10 - 10).alias("score"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, floor((epoch(TIMESTAMP '2024-06-30') - epoch(o_orderdate)) / 86400.0 + 0.5)::BIGINT AS days FROM orders")
def iso_dates(spark, d):
    """ISO texts and days between."""
    from auditloom.sources.sinks import iso

    days = half_up((F.lit(fx.AS_OF).cast("timestamp").cast("double") - F.col("o_orderdate").cast("timestamp").cast("double")) / 86400).cast("long")
    return corpus.table(spark, d, "orders").select("o_orderkey", iso(F.col("o_orderdate")).alias("iso"), days.alias("days"))


@query("SELECT o_orderkey, o_orderdate AS parsed FROM orders")
def http_dates(spark, d):
    """HTTP and ISO dates read back (F12); unreadable ones are left out."""
    http = F.date_format("o_orderdate", "'Mon, 'dd MMM yyyy HH:mm:ss' GMT'")
    written = F.when(F.col("o_orderkey") % 2 == 0, http).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return corpus.table(spark, d, "orders").select("o_orderkey", text.last_modified_ts(written).alias("parsed")).where("parsed IS NOT NULL")


@query(r"""SELECT p_partkey, lower(regexp_replace(p_name || ' & Co. №' || p_size, '(?i)[^a-z0-9]+', '-', 'g')) AS slug, upper(p_name[1]) || p_name[2:] AS capital FROM part""")
def slugs(spark, d):
    """File names and capital letters."""
    p = corpus.table(spark, d, "part")
    return p.select("p_partkey", text.slug(F.concat("p_name", F.lit(" & Co. №"), F.col("p_size").cast("string"))).alias("slug"), text.capital_first(F.col("p_name")).alias("capital"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_fields(spark, d):
    """Tolerant JSON."""
    return corpus.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT url, min(page_id) AS first_page FROM (SELECT page_id, unnest(regexp_extract_all('<urlset><url><LOC> ' || url || ' </LOC></url><url><loc>' || url || '.pdf</loc></url></urlset>', '(?i)<loc>\\s*([^<\\s]+)\\s*</loc>', 1)) AS url FROM pages) GROUP BY url".replace("\\\\", "\\"))
def sitemap_locs(spark, d):
    """Addresses in sitemaps."""
    xml = F.concat(F.lit("<urlset><url><LOC> "), "url", F.lit(" </LOC></url><url><loc>"), "url", F.lit(".pdf</loc></url></urlset>"))
    each = _pages(spark, d).select("page_id", F.explode(crawl.locations(xml)).alias("url"))
    return each.groupBy("url").agg(F.min("page_id").alias("first_page"))


_MADE = (("../x", f"origin || {S.PARENT} || 'x'"), ("./y/../z", "origin || folder || 'z'"), ("?q=1", f"origin || {S.path('url')} || '?q=1'"), ("#t", "regexp_replace(url, '#.*$', '') || '#t'"), ("//Other.Example/p", "regexp_extract(url, '^([a-z]+):', 1) || '://other.example/p'"), ("HTTP://U.x:80", "'http://u.x/'"), ("/r/../s", "origin || '/s'"), ("a/b", "origin || folder || 'a/b'"), ("mailto:a@b.c", "'mailto:a@b.c'"))


@query(f"WITH {S.PAGES}, {S.RICH} " + " UNION ALL ".join(f"SELECT page_id, '{h}' AS href, {u} AS target_url FROM ri" for h, u in _MADE))
def resolved_links(spark, d):
    """Links of all kinds resolved on every page's address."""
    each = _pages(spark, d).select("page_id", "url", F.explode(F.array(*(F.lit(h) for h, _ in _MADE))).alias("href"))
    return each.select("page_id", "href", urls.resolve(F.col("url"), F.col("href")).alias("target_url"))
