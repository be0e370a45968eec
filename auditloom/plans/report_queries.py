"""Queries on findings, scores and reports, and the relational kernel under them."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import scratch
from auditloom.functions.text import csv_field
from auditloom.operators import audit, crawl, findings, scoring
from auditloom.sources import corpus, sinks

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


_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_IMPACT = "CASE WHEN severity IN ('critical', 'high') THEN 'High' ELSE 'Low' END"
_EFFORT = "CASE WHEN effort_bucket = 'custom_dev' THEN 'High' ELSE 'Low' END"
_QUADRANT = f"CASE WHEN {_IMPACT} = 'High' AND {_EFFORT} = 'Low' THEN 'Quick Win' WHEN {_IMPACT} = 'High' THEN 'Major Project' WHEN {_EFFORT} = 'Low' THEN 'Fill-in' ELSE 'Time Sink' END"


@query(f"WITH {S.FINDINGS} SELECT ord, finding_type FROM fd WHERE finding_type = 'scale_summary' OR list_has_any(personas, ['ux', 'business'])")
def persona_filter(spark, d):
    """Findings for chosen personas."""
    return scoring.persona_filter(fx.findings(spark, d), ["ux", "business"]).select("ord", "finding_type")


@query(f"WITH {S.FINDINGS} SELECT {_RANK} AS rank, ord, CASE severity WHEN 'critical' THEN 'High' WHEN 'high' THEN 'High' WHEN 'low' THEN 'Low' ELSE 'Medium' END AS priority, {_IMPACT} AS impact, {_EFFORT} AS effort, CASE finding_type WHEN 'orphan_page' THEN 'IA' WHEN 'broken_page' THEN 'IA' WHEN 'missing_h1' THEN 'Accessibility' WHEN 'missing_title' THEN 'Content' ELSE 'General' END AS area, upper(title[1]) || title[2:] || '.' AS action FROM fd WHERE finding_type <> 'scale_summary'")
def action_plan(spark, d):
    """Priorities."""
    return scoring.action_plan(fx.findings(spark, d))


@query(f"WITH {S.FINDINGS} SELECT {_RANK} AS rank, ord, title, {_IMPACT} AS impact, {_EFFORT} AS effort, {_QUADRANT} AS quadrant, array_to_string(personas, ', ') AS category FROM fd WHERE finding_type <> 'scale_summary'")
def backlog(spark, d):
    """Backlog items."""
    return scoring.backlog(fx.findings(spark, d))


@query(f"WITH {S.FINDINGS} SELECT {_QUADRANT} AS quadrant, count(*) AS findings FROM fd GROUP BY 1")
def quadrants(spark, d):
    """Findings by quadrant."""
    f = fx.findings(spark, d)
    return f.groupBy(scoring.quadrant(F.col("severity"), F.col("effort_bucket")).alias("quadrant")).agg(F.count("*").alias("findings"))


@query(f"WITH {S.FINDINGS} SELECT ord, CASE effort_bucket WHEN 'custom_dev' THEN 'High' WHEN 'config' THEN 'Medium' ELSE 'Low' END AS effort, CASE effort_bucket WHEN 'custom_dev' THEN 85 WHEN 'config' THEN 50 ELSE 20 END AS x, CASE WHEN {_IMPACT} = 'High' THEN 20 ELSE 85 END AS y FROM fd WHERE finding_type <> 'scale_summary' ORDER BY {_RANK}, ord LIMIT 30")
def effort_plot(spark, d):
    """The report's chart of the first thirty findings."""
    x, y = scoring.plot_position(F.col("severity"), F.col("effort_bucket"))
    f = fx.findings(spark, d).where("finding_type <> 'scale_summary'").orderBy(scoring.severity_rank(F.col("severity")), "ord").limit(30)
    return f.select("ord", scoring.effort3(F.col("effort_bucket")).alias("effort"), x.alias("x"), y.alias("y"))


@query(f"WITH {S.FINDINGS} SELECT CASE WHEN starts_with(finding_type, 'cms') THEN 'Tech Stack' ELSE 'Risk' END AS category, count(*) AS findings FROM fd WHERE finding_type IN ('cms_detected', 'js_framework_detected', 'mixed_content', 'exposed_staging', 'pii_without_privacy_link') GROUP BY 1")
def tech_and_risk(spark, d):
    """Technology and risk findings."""
    from auditloom.functions.signatures import TECH_AND_RISK

    f = fx.findings(spark, d).where(F.col("finding_type").isin(*TECH_AND_RISK))
    kind = F.when(F.col("finding_type").rlike("^(cms|js_framework)"), "Tech Stack").otherwise("Risk")
    return f.groupBy(kind.alias("category")).agg(F.count("*").alias("findings"))


def _field(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[\",\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"


_FIELDS = ("finding_type", "title", "severity", "effort_bucket", "array_to_string(personas, '|')", "affected_page_count::VARCHAR", "description", "detection_method")


@query(f"WITH {S.FINDINGS} SELECT ord, concat_ws(',', {', '.join(map(_field, _FIELDS))}) AS line FROM fd")
def csv_rows(spark, d):
    """Findings as CSV lines."""
    return sinks.csv_rows(fx.findings(spark, d))


@query(f"SELECT p_partkey, {_field('p_name')} AS field FROM part")
def csv_fields(spark, d):
    """Quoting of fields."""
    return corpus.table(spark, d, "part").select("p_partkey", csv_field(F.col("p_name")).alias("field"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal / 100 >= 85 THEN 'Strong' WHEN s_acctbal / 100 >= 70 THEN 'Adequate' WHEN s_acctbal / 100 >= 50 THEN 'Needs Improvement' ELSE 'Critical' END AS band, CASE WHEN s_acctbal / 100 >= 70 THEN 'good' WHEN s_acctbal / 100 >= 50 THEN 'fair' ELSE 'poor' END AS tier FROM supplier")
def band(spark, d):
    """Bands and tiers of scores."""
    score = F.col("s_acctbal") / 100
    return corpus.table(spark, d, "supplier").select("s_suppkey", scoring.band(score).alias("band"), scoring.tier(score).alias("tier"))


_PCT = S.one_place("100.0::DOUBLE * (crawled - stated) / greatest(stated, 1)")


@query(f"WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN p_size END AS stated, (p_partkey % 60)::INTEGER AS crawled, p_partkey % 9 = 0 AS cut FROM part) SELECT p_partkey, crawled - stated AS difference, CASE WHEN stated IS NOT NULL THEN {_PCT} END AS difference_pct, CASE WHEN stated IS NULL THEN NULL WHEN cut THEN 'truncated' WHEN abs({_PCT}) <= 10 THEN 'as stated' WHEN crawled > stated THEN 'more than stated' ELSE 'fewer than stated' END AS verdict, CASE WHEN stated IS NULL THEN NULL WHEN abs({_PCT}) > 10 THEN 'medium' ELSE 'low' END AS severity FROM v")
def variance(spark, d):
    """Crawled against stated page counts."""
    k = F.col("p_partkey")
    v = corpus.table(spark, d, "part").select("p_partkey", scoring.variance(F.when(k % 11 > 0, F.col("p_size")), (k % 60).cast("int"), k % 9 == 0).alias("v"))
    return v.select("p_partkey", "v.difference", "v.difference_pct", "v.verdict", "v.severity")


#: Findings of single pages that counts and scores read.
_SCORED = ("missing_h1", "missing_title", "missing_meta_description")


def _site(spark, d, kinds=None):
    """Parsed pages, and the findings that the counts come from; ``kinds`` are those of single pages, all without them."""
    p, links = scratch.written(fx.rich_pages(spark, d), "site"), fx.links(spark, d)
    parts = (findings.by_page(p, kinds), findings.orphans(p, links, ""), findings.duplicate_titles(p), findings.near_duplicates(p, max_pages=None), findings.scale_summary(p))
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    return p, found


def _counts(spark, d):
    """Counts of the site, from its markup and findings."""
    return scoring.site_counts(*_site(spark, d, _SCORED))


_NEAR = f"""nw AS MATERIALIZED (SELECT page_ord AS id, {S.words('text')} AS w FROM pg), ng AS MATERIALIZED (SELECT id, unnest({S.shingles('w', 8)}) AS g FROM nw), nn AS (SELECT id, count(*) AS n FROM ng GROUP BY id),
np AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM ng a JOIN ng b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id), nd AS (SELECT a, b FROM np JOIN nn x ON x.id = a JOIN nn y ON y.id = b WHERE i::DOUBLE / (x.n + y.n - i) >= 0.75)"""
_FOUND = rf"""{S.PAGES}, {S.LINKS}, {_NEAR}, fc AS (SELECT count(*) FILTER (status_code >= 400) AS broken_page, count(*) FILTER (error IS NULL AND coalesce(h1_text, '') = '') AS missing_h1, count(*) FILTER (error IS NULL AND coalesce(trim(title), '') = '') AS missing_title,
    count(*) FILTER (error IS NULL AND page_id % 4 = 0) AS missing_meta_description, count(*) FILTER (page_id % 10 = 9 AND starts_with(url, 'https://')) AS mixed_content, count(*) FILTER (regexp_matches({S.host('url')}, '(^|\.)(staging|stage|dev|test|uat|preprod|qa)(\.|-)')) AS exposed_staging,
    count(*) FILTER (page_id % 8 = 5) AS pii_without_privacy_link, count(*) FILTER ({S.flesch('text')} < 30) AS low_readability, count(*) AS scale_summary,
    count(*) FILTER (error IS NULL AND url NOT IN (SELECT target_url FROM lk WHERE is_internal)) AS orphan_page, (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM pg WHERE trim(title) <> '' GROUP BY trim(title) HAVING count(*) > 1)) AS duplicate_title,
    (SELECT count(*) FROM (SELECT a FROM nd UNION SELECT b FROM nd)) AS near_duplicate_content FROM pg)"""
_COUNTS = f"""{_FOUND}, own AS (SELECT count(*) AS total, count(*) FILTER (depth > 3) AS deep, count(*) FILTER (word_count > 0 AND word_count < 150) AS thin, count(*) FILTER (page_id % 10 = 0) AS a11, count(*) FILTER (page_id % 3 <> 0) AS canon,
    {S.one_place("(1 - sum(page_id % 4 // 2)::DOUBLE / sum(page_id % 4)) * 100")} AS alt FROM pg),
sc AS (SELECT *, {S.one_place(f"{S.pct_score('orphan_page', 'total')} * 0.5 + {S.pct_score('deep', 'total')} * 0.5")} AS ia,
    {S.one_place(f"{S.pct_score('thin', 'total')} * 0.25 + {S.pct_score('(duplicate_title + near_duplicate_content)', 'total')} * 0.25 + {S.pct_score('missing_h1', 'total')} * 0.25 + alt * 0.25")} AS content, {S.pct_score('a11', 'total')} AS a11y,
    {S.one_place(f"{S.pct_score('missing_title', 'total')} * 0.4::DOUBLE + {S.pct_score('missing_meta_description', 'total')} * 0.4::DOUBLE + {S.pct_score('canon', 'total')} * 0.2::DOUBLE")} AS seo FROM own, fc),
uxs AS (SELECT *, {S.one_place('(ia + content + a11y + seo) / 4')} AS ux FROM sc)"""


@query(f"WITH {_COUNTS} SELECT total AS total_pages, deep AS deep_pages, thin AS thin_pages, orphan_page AS orphan_pages, duplicate_title + near_duplicate_content AS duplicate_pages, missing_h1, missing_title, missing_meta_description, canon AS missing_canonical, a11 AS accessibility_pages, broken_page AS broken_pages, alt AS image_alt_coverage_pct FROM uxs")
def site_counts(spark, d):
    """Counts of the site from parsed pages and findings (P3, P6, A23, R2-R7's inputs)."""
    names = ("total_pages", "deep_pages", "thin_pages", "orphan_pages", "duplicate_pages", "missing_h1", "missing_title", "missing_meta_description", "missing_canonical", "accessibility_pages", "broken_pages", "image_alt_coverage_pct")
    return _counts(spark, d).select(*names)


@query(f"WITH {_COUNTS} SELECT ia AS ia_health, content AS content_quality, a11y AS accessibility, seo, ux AS ux_maturity, CASE WHEN ux >= 85 THEN 'Strong' WHEN ux >= 70 THEN 'Adequate' WHEN ux >= 50 THEN 'Needs Improvement' ELSE 'Critical' END AS ux_maturity_band FROM uxs")
def scorecard(spark, d):
    """The site's scorecard."""
    return scoring.scorecard(_counts(spark, d)).select("ia_health", "content_quality", "accessibility", "seo", "ux_maturity", "ux_maturity_band")


_CUSTOMER = """cc AS (SELECT c_custkey AS audit, 100 AS total, (c_custkey % 40) AS orphan, (c_custkey % 13) AS deep, (c_custkey % 29) AS thin, (c_custkey % 150) AS dup, (c_custkey % 7) AS h1, (c_custkey % 5) * 10 AS a11, (c_custkey % 3) AS title, (c_custkey % 90) AS meta, (c_custkey % 100) AS canon, (c_custkey % 101)::DOUBLE AS alt FROM customer)"""


def _many_counts(spark, d):
    k = F.col("c_custkey")
    return corpus.table(spark, d, "customer").select(
        k.alias("audit"), F.lit(100).alias("total_pages"), (k % 40).alias("orphan_pages"), (k % 13).alias("deep_pages"), (k % 29).alias("thin_pages"), (k % 150).alias("duplicate_pages"), (k % 7).alias("missing_h1"),
        (k % 5 * 10).alias("accessibility_pages"), (k % 3).alias("missing_title"), (k % 90).alias("missing_meta_description"), (k % 100).alias("missing_canonical"), (k % 101).cast("double").alias("image_alt_coverage_pct"),
        (k % 4).alias("broken_pages"), (k % 6).cast("int").alias("max_click_depth"),
    )


_P = S.pct_score


@query(f"WITH {_CUSTOMER}, s AS (SELECT audit, {S.one_place(_P('orphan', 'total') + ' * 0.5 + ' + _P('deep', 'total') + ' * 0.5')} AS ia_health, {S.one_place(_P('thin', 'total') + ' * 0.25 + ' + _P('dup', 'total') + ' * 0.25 + ' + _P('h1', 'total') + ' * 0.25 + alt * 0.25')} AS content_quality, {_P('a11', 'total')} AS accessibility, {S.one_place(_P('title', 'total') + ' * 0.4::DOUBLE + ' + _P('meta', 'total') + ' * 0.4::DOUBLE + ' + _P('canon', 'total') + ' * 0.2::DOUBLE')} AS seo FROM cc) SELECT *, {S.one_place('(ia_health + content_quality + accessibility + seo) / 4')} AS ux_maturity FROM s")
def scorecards(spark, d):
    """Scorecards of many audits, with scores under zero."""
    return scoring.scorecard(_many_counts(spark, d)).select("audit", "ia_health", "content_quality", "accessibility", "seo", "ux_maturity")


@query(f"WITH {_CUSTOMER}, s AS (SELECT audit, {S.one_place(_P('orphan', 'total') + ' * 0.5 + ' + _P('deep', 'total') + ' * 0.5')} AS ia, {S.one_place(_P('thin', 'total') + ' * 0.25 + ' + _P('dup', 'total') + ' * 0.25 + ' + _P('h1', 'total') + ' * 0.25 + alt * 0.25')} AS co, {_P('a11', 'total')} AS ac, {S.one_place(_P('title', 'total') + ' * 0.4::DOUBLE + ' + _P('meta', 'total') + ' * 0.4::DOUBLE + ' + _P('canon', 'total') + ' * 0.2::DOUBLE')} AS seo FROM cc), u AS (SELECT audit, unnest([ia, co, ac, seo]) AS score, unnest([0, 1, 2, 3]) AS i, unnest(['Information Architecture', 'Content Quality', 'Accessibility', 'SEO & Findability']) AS name FROM s) SELECT audit, list(name ORDER BY score DESC, i) AS pillars FROM u GROUP BY audit")
def pillar_order(spark, d):
    """Pillars from best to worst."""
    return scoring.scorecard(_many_counts(spark, d)).select("audit", scoring.pillar_order().alias("pillars"))


@query(f"WITH {_COUNTS} SELECT 0 AS ord, 'UX maturity is ' || ux || '/100 (' || (CASE WHEN ux >= 85 THEN 'Strong' WHEN ux >= 70 THEN 'Adequate' WHEN ux >= 50 THEN 'Needs Improvement' ELSE 'Critical' END) || ') over ' || total || ' pages.' AS line FROM uxs")
def plain_terms_head(spark, d):
    """The first sentence of the plain-terms list."""
    return scoring.plain_terms(scoring.scorecard(_counts(spark, d))).where("ord = 0")


@query()
def narrative(spark, d):
    """Plain terms, assessment and the summary prompt."""
    card = scoring.scorecard(_counts(spark, d))
    a = scoring.plain_terms(card).select(F.lit("plain terms").alias("section"), "ord", "line")
    b = scoring.assessment(card).select(F.lit("assessment").alias("section"), "ord", "line")
    c = scoring.summary_prompt(card).select(F.lit("prompt").alias("section"), F.lit(0).alias("ord"), F.col("prompt").alias("line"))
    return a.unionByName(b).unionByName(c)


@query(f"""WITH {S.FINDINGS}, f AS (SELECT finding_type, arg_min(severity, ord) AS s, arg_min(affected_page_count, ord) AS n, arg_min(title, ord) AS t FROM fd GROUP BY finding_type),
h(ord, heuristic, types) AS (VALUES (0, 'H1 — Visibility of system status', []::VARCHAR[]), (1, 'H2 — Match between system and the real world', []), (2, 'H3 — User control and freedom', []), (3, 'H4 — Consistency and standards', ['missing_title', 'missing_meta_description']), (4, 'H5 — Error prevention', ['broken_page']), (5, 'H6 — Recognition rather than recall', ['duplicate_title', 'near_duplicate_content']), (6, 'H7 — Flexibility and efficiency of use', []), (7, 'H8 — Aesthetic and minimalist design', ['image_alt']), (8, 'H9 — Help recognize, diagnose, and recover from errors', ['broken_page']), (9, 'H10 — Help and documentation', [])),
m AS (SELECT h.ord, h.heuristic, len(types) > 0 AS yes, types, (SELECT list(struct_pack(s := s, n := n, t := t) ORDER BY list_position(types, finding_type)) FROM f WHERE list_contains(types, finding_type)) AS hits FROM h)
SELECT ord, heuristic, CASE WHEN yes THEN 'Yes' ELSE 'No' END AS assessed, CASE WHEN NOT yes THEN 'Not assessed' WHEN ord = 7 THEN 'Severity 3 — 2 finding(s)' WHEN hits IS NULL THEN 'No issues found' ELSE 'Severity ' || (CASE hits[1].s WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END) || ' — ' || hits[1].n || ' finding(s)' END AS status, CASE WHEN ord = 7 THEN 'Describe 12 image(s).' WHEN yes THEN hits[1].t END AS top_finding FROM m""")
def heuristics(spark, d):
    """The workbook's ten heuristics."""
    return scoring.heuristics(fx.findings(spark, d), 12)


@query(f"WITH {S.FINDINGS} SELECT CASE finding_type WHEN 'missing_title' THEN 'SEO' WHEN 'orphan_page' THEN 'IA' WHEN 'broken_page' THEN 'IA' WHEN 'missing_h1' THEN 'Content' WHEN 'near_duplicate_content' THEN 'Content' WHEN 'mixed_content' THEN 'Risk' WHEN 'cms_detected' THEN 'Tech Stack' ELSE 'General' END AS area, count(*) AS findings FROM fd GROUP BY 1")
def report_areas(spark, d):
    """Areas of the printed report."""
    f = fx.findings(spark, d)
    return f.groupBy(scoring.lookup(F.col("finding_type"), scoring.REPORT_AREA, "General").alias("area")).agg(F.count("*").alias("findings"))


_KINDS = ("broken_page", "missing_h1", "missing_title", "missing_meta_description", "mixed_content", "exposed_staging", "pii_without_privacy_link", "low_readability", "scale_summary", "orphan_page", "duplicate_title", "near_duplicate_content")


@query(f"WITH {_FOUND}, u AS (UNPIVOT fc ON {', '.join(_KINDS)} INTO NAME finding_type VALUE n) SELECT finding_type, n::INTEGER AS affected_page_count FROM u WHERE n > 0")
def finding_counts(spark, d):
    """Findings of a site with their pages (2.14: the kinds that a page, a title, a text or a link shows; U1)."""
    return _site(spark, d)[1].select("finding_type", "affected_page_count")


def _audit(spark, d):
    pages = corpus.fixture_pages(spark, d, markup=True).select("audit_id", "page_ord", "page_id", "url", "html", "status_code", "error", "depth", "response_time_ms", "last_modified")
    start = corpus.table(spark, d, "pages").orderBy("page_id").select("url").first()["url"]
    return audit.run(pages, start, F.lit(fx.AS_OF).cast("timestamp"), {"client_name": "Fixture & Co.", "personas": ("ux", "content")}, stated=200)


@query()
def all_findings(spark, d):
    """The whole analysis of the fixture's site (2.14, U1, X6)."""
    return _audit(spark, d).findings


@query()
def workbook_sheets(spark, d):
    """The rows of every sheet of the workbook, as text."""
    out = None
    for i, (name, sheet) in enumerate(audit.workbook(_audit(spark, d), F.lit(fx.AS_OF).cast("timestamp")).items()):
        rows = sheet.select(F.lit(i).alias("sheet"), F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {_COUNTS}, l(ord, label, value) AS (SELECT unnest([3, 7, 12, 13, 14, 15]), unnest(['Pages crawled', 'Overall UX Maturity', 'Orphan pages', 'Thin content pages', 'Duplicate content pages', 'Pages with accessibility issues']), unnest([total::VARCHAR, ux::VARCHAR || ' / 100 (' || (CASE WHEN ux >= 85 THEN 'Strong' WHEN ux >= 70 THEN 'Adequate' WHEN ux >= 50 THEN 'Needs Improvement' ELSE 'Critical' END) || ')', orphan_page::VARCHAR, thin::VARCHAR, (duplicate_title + near_duplicate_content)::VARCHAR, a11 || ' / ' || total]) FROM uxs) SELECT * FROM l")
def overview(spark, d):
    """Lines of the overview that count or score."""
    p, found = _site(spark, d, _SCORED)
    made = audit.Audit({"start_url": "https://example.com/"}, p, fx.links(spark, d), sinks.asset_rows(p), sinks.interaction_rows(p), found, scratch.written(scoring.scorecard(scoring.site_counts(p, found)), "card"))
    return audit.overview(made).where(F.col("ord").isin(3, 7, 12, 13, 14, 15))


@query(f"WITH {S.FINDINGS} SELECT to_json(list(finding_type ORDER BY ord)) AS types FROM fd")
def json_array(spark, d):
    """Findings in a document."""
    f = fx.findings(spark, d).agg(F.array_sort(F.collect_list(F.struct("ord", "finding_type"))).alias("f"))
    return f.select(F.to_json(F.transform("f", lambda x: x["finding_type"])).alias("types"))


@query()
def payload(spark, d):
    """The audit's JSON document."""
    p = fx.parsed_pages(spark, d)
    f = fx.findings(spark, d).withColumn("affected_urls_sample", F.array(F.col("description")))
    audit = {"start_url": "https://example.com/", "crawl_date": fx.AS_OF}
    return sinks.payload_json(audit, p, f, scoring.scorecard(_counts(spark, d)), 0, scoring.backlog(f))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark, d):
    """A page of rows after a key."""
    return corpus.keyset_page(corpus.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", 1000, 100)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def audit_list_recent(spark, d):
    """The newest hundred."""
    return corpus.newest(corpus.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 100)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey")
def audit_list(spark, d):
    """All in order of creation."""
    return corpus.table(spark, d, "orders").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    """One audit by key."""
    return corpus.table(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_orderstatus").limit(1)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, d):
    """Rows without a partner."""
    return corpus.table(spark, d, "customer").join(corpus.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey AS audit_id, count(DISTINCT o_orderkey) AS page_count, count(*) AS finding_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def audit_counts(spark, d):
    """Pages and findings by audit."""
    o, li = corpus.table(spark, d, "orders"), corpus.table(spark, d, "lineitem")
    return o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("audit_id")).agg(F.countDistinct("o_orderkey").alias("page_count"), F.count("*").alias("finding_count"))


@query("SELECT p_partkey AS audit_id, 'done' AS status, coalesce(n, 0) AS page_count, 0 AS finding_count FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey")
def status_json(spark, d):
    """Status documents, read back."""
    audits = corpus.table(spark, d, "part").select(F.col("p_partkey").alias("audit_id"), F.lit("done").alias("status"))
    pages = corpus.table(spark, d, "lineitem").select(F.col("l_partkey").alias("audit_id"))
    made = sinks.status_json(audits, pages, pages.where("false"))
    return made.select(F.from_json("json", "audit_id long, status string, page_count long, finding_count long").alias("j")).select("j.*")


@query("SELECT url, depth FROM (SELECT url, page_id % 4 AS depth, row_number() OVER (ORDER BY url) AS k FROM pages) WHERE k <= 100")
def budget(spark, d):
    """The first addresses within a budget."""
    p = corpus.table(spark, d, "pages").select("url", (F.col("page_id") % 4).alias("depth"))
    return crawl.reserve(p, 100, F.col("url"))


@query("SELECT DISTINCT user_id AS audit_id, event_type AS url FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id < 5000)")
def newly_seen(spark, d):
    """Addresses that weren't seen."""
    e = corpus.table(spark, d, "events").select("event_id", F.col("user_id").alias("audit_id"), F.col("event_type").alias("url"))
    return crawl.newly_seen(e, e.where("event_id < 5000").select("audit_id", "url").distinct())


@query(f"WITH {S.FINDINGS}, f AS (SELECT finding_type, arg_min(severity, ord) AS severity, arg_min(affected_page_count, ord) AS n, arg_min(title, ord) AS t FROM fd GROUP BY finding_type), h(ord, finding_type) AS (VALUES (0, NULL), (1, NULL), (2, NULL), (3, 'duplicate_title'), (4, NULL), (5, NULL), (6, NULL), (7, NULL), (8, 'broken_page'), (9, NULL)) SELECT h.ord, f.t IS NOT NULL AS assessed, severity, n AS count, t AS finding FROM h LEFT JOIN f USING (finding_type)")
def heuristics_report(spark, d):
    """The printed report's ten heuristics, of which two are assessed."""
    return scoring.report_heuristics(fx.findings(spark, d)).drop("heuristic")


@query("WITH a AS (SELECT o_custkey AS audit_id, (o_custkey % 20)::INTEGER AS max_pages, min(o_orderdate) AS s, max(o_orderdate) AS e, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS bad FROM orders GROUP BY o_custkey) SELECT audit_id, n < max_pages AS complete, bad AS page_errors, floor((epoch_ms(e) - epoch_ms(s)) / 100.0 + 0.5) / 10 AS duration_seconds FROM a")
def coverage_flags(spark, d):
    """Whether a crawl ended under its limit, its errors and duration."""
    o = corpus.table(spark, d, "orders").select(F.col("o_custkey").alias("audit_id"), "o_orderdate", F.when(F.col("o_orderstatus") == "F", "failed").alias("error"))
    ts = lambda f: f(F.col("o_orderdate").cast("timestamp"))
    audits = o.groupBy("audit_id").agg(ts(F.min).alias("started_at"), ts(F.max).alias("finished_at")).withColumn("max_pages", (F.col("audit_id") % 20).cast("int"))
    return scoring.coverage(audits, o)


_VIOLATIONS = "vi AS (SELECT l_orderkey AS page_ord, 'p' || l_orderkey AS url, l_linenumber AS pos, l_returnflag || l_linestatus AS id, list_extract(['critical', 'serious', 'moderate', 'minor', 'other'], (l_partkey % 5)::INTEGER + 1) AS impact, 'rule ' || l_suppkey AS description FROM lineitem)"


@query(f"WITH {_VIOLATIONS}, f AS (SELECT id, count(DISTINCT url) AS n, arg_min(impact, struct_pack(o := page_ord, p := pos)) AS impact, arg_min(description, struct_pack(o := page_ord, p := pos)) AS description FROM vi GROUP BY id) SELECT 'Accessibility: ' || description AS title, CASE impact WHEN 'critical' THEN 'critical' WHEN 'serious' THEN 'high' WHEN 'moderate' THEN 'medium' WHEN 'minor' THEN 'low' ELSE 'medium' END AS severity, n::INTEGER AS affected_page_count, (SELECT list(u ORDER BY o) FROM (SELECT url AS u, min(page_ord) AS o FROM vi WHERE vi.id = f.id GROUP BY url ORDER BY o LIMIT 10)) AS affected_urls_sample FROM f")
def accessibility_rollup(spark, d):
    """One finding for each accessibility rule."""
    impacts = F.array(*map(F.lit, ("critical", "serious", "moderate", "minor", "other")))
    li = corpus.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page_ord"), "l_linenumber",
        F.struct(F.concat("l_returnflag", "l_linestatus").alias("id"), F.element_at(impacts, (F.col("l_partkey") % 5 + 1).cast("int")).alias("impact"), F.concat(F.lit("rule "), F.col("l_suppkey").cast("string")).alias("description"), F.lit(1).alias("nodesCount")).alias("v"),
    )
    pages = li.groupBy("page_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "v"))), lambda x: x["v"]).alias("accessibility_violations")).withColumn("url", F.concat(F.lit("p"), F.col("page_ord").cast("string")))
    return findings.accessibility(pages).select("title", "severity", "affected_page_count", "affected_urls_sample")
