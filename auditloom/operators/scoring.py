"""Scorecard, variance, priorities and the narrative, as expressions over one row of site counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import dom_signals as ds
from auditloom.functions import signatures as sig
from auditloom.functions.numbers import one_place, pct_score
from auditloom.functions.text import capital_first

#: Counts of bad pages that the scorecard reads; image_alt_coverage_pct and total_pages besides.
COUNTS = (
    "orphan_pages", "deep_pages", "thin_pages", "duplicate_pages", "missing_h1", "accessibility_pages", "missing_title", "missing_meta_description", "missing_canonical",
)


def band(score: Column) -> Column:
    return F.when(score >= 85, "Strong").when(score >= 70, "Adequate").when(score >= 50, "Needs Improvement").otherwise("Critical")


def tier(score: Column) -> Column:
    return F.when(score >= 70, "good").when(score >= 50, "fair").otherwise("poor")


def scorecard(counts: DataFrame) -> DataFrame:
    """Four pillars, their mean and its band, beside the counts they come from."""
    total = F.greatest(F.col("total_pages"), F.lit(1))
    s = lambda name: pct_score(F.col(name), total)
    rows = counts.withColumns(
        {
            "ia_health": one_place(s("orphan_pages") * 0.5 + s("deep_pages") * 0.5),
            "content_quality": one_place(s("thin_pages") * 0.25 + s("duplicate_pages") * 0.25 + s("missing_h1") * 0.25 + F.col("image_alt_coverage_pct") * 0.25),
            "accessibility": s("accessibility_pages"),
            "seo": one_place(s("missing_title") * 0.4 + s("missing_meta_description") * 0.4 + s("missing_canonical") * 0.2),
        }
    )
    rows = rows.withColumn("ux_maturity", one_place((F.col("ia_health") + F.col("content_quality") + F.col("accessibility") + F.col("seo")) / 4))
    return rows.withColumn("ux_maturity_band", band(F.col("ux_maturity")))


def site_counts(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """The one row of counts that the scorecard and the narrative read, from parsed pages and their findings."""
    of = lambda kind: F.coalesce(F.max(F.when(F.col("finding_type") == kind, F.col("affected_page_count"))), F.lit(0)).cast("long")
    found = findings.agg(
        of("orphan_page").alias("orphan_pages"), (of("duplicate_title") + of("near_duplicate_content")).alias("duplicate_pages"), of("missing_h1").alias("missing_h1"), of("missing_title").alias("missing_title"),
        of("missing_meta_description").alias("missing_meta_description"),
    )
    dom = F.col("dom")
    images, bare = F.coalesce(F.sum(ds.images_total(dom)), F.lit(0)), F.coalesce(F.sum(ds.images_missing_alt(dom)), F.lit(0))
    own = pages.agg(
        F.count("*").alias("total_pages"), F.count_if(F.col("depth") > 3).alias("deep_pages"), F.count_if((F.col("word_count") > 0) & (F.col("word_count") < 150)).alias("thin_pages"),
        F.count_if(F.size("accessibility_violations") > 0).alias("accessibility_pages"), F.count_if(F.coalesce("canonical", F.lit("")) == "").alias("missing_canonical"), F.count_if(F.col("status_code") >= 400).alias("broken_pages"),
        F.greatest(F.lit(0), F.coalesce(F.max("depth"), F.lit(0))).alias("max_click_depth"), images.alias("images"), bare.alias("missing_alt"),
    )
    alt = F.when(F.col("images") > 0, one_place((1 - F.col("missing_alt") / F.col("images")) * 100)).otherwise(F.lit(100.0))
    return own.crossJoin(found).withColumn("image_alt_coverage_pct", alt)


def impact(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "High").otherwise("Low")


def effort(bucket: Column) -> Column:
    return F.when(bucket == "custom_dev", "High").otherwise("Low")


def effort3(bucket: Column) -> Column:
    """The report's three levels."""
    return F.when(bucket == "custom_dev", "High").when(bucket == "config", "Medium").otherwise("Low")


def quadrant(severity: Column, bucket: Column) -> Column:
    high, hard = impact(severity) == "High", effort(bucket) == "High"
    return F.when(high & ~hard, "Quick Win").when(high & hard, "Major Project").when(~high & ~hard, "Fill-in").otherwise("Time Sink")


def plot_position(severity: Column, bucket: Column) -> tuple[Column, Column]:
    """Places on the report's impact and effort chart, in percent."""
    e = effort3(bucket)
    return F.when(e == "Low", 20).when(e == "Medium", 50).otherwise(85), F.when(impact(severity) == "High", 20).otherwise(85)


def severity_rank(severity: Column) -> Column:
    rank = F.when(severity == sig.SEVERITIES[0], 0)
    for i, s in enumerate(sig.SEVERITIES[1:], 1):
        rank = rank.when(severity == s, i)
    return rank.otherwise(len(sig.SEVERITIES))


def lookup(key: Column, values: dict[str, str], default: str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.element_at(table, key), F.lit(default))


def action_plan(findings: DataFrame) -> DataFrame:
    """Findings but for the summary, by severity and then in their own order: priority, impact, effort, area, action."""
    rows = findings.where("finding_type <> 'scale_summary'")
    return rows.select(
        severity_rank(F.col("severity")).alias("rank"),
        "ord",
        lookup(F.col("severity"), sig.PRIORITY, "Medium").alias("priority"),
        impact(F.col("severity")).alias("impact"),
        effort(F.col("effort_bucket")).alias("effort"),
        lookup(F.col("finding_type"), sig.PLAN_AREA, "General").alias("area"),
        F.concat(capital_first(F.col("title")), F.lit(".")).alias("action"),
    ).orderBy("rank", "ord")


def backlog(findings: DataFrame) -> DataFrame:
    rows = findings.where("finding_type <> 'scale_summary'")
    return rows.select(
        severity_rank(F.col("severity")).alias("rank"), "ord", "title", impact(F.col("severity")).alias("impact"), effort(F.col("effort_bucket")).alias("effort"),
        quadrant(F.col("severity"), F.col("effort_bucket")).alias("quadrant"), F.array_join("personas", ", ").alias("category"),
    ).orderBy("rank", "ord")


def persona_filter(findings: DataFrame, personas: list[str]) -> DataFrame:
    return findings.where((F.col("finding_type") == "scale_summary") | F.arrays_overlap("personas", F.array(*map(F.lit, personas))))


def variance(stated: Column, crawled: Column, truncated: Column) -> Column:
    """struct(difference, difference_pct, verdict, severity) of crawled against stated pages; null if none was stated."""
    diff = crawled - stated
    pct = one_place(100.0 * diff / F.greatest(stated, F.lit(1)))
    verdict = F.when(truncated, "truncated").when(F.abs(pct) <= 10, "as stated").when(diff > 0, "more than stated").otherwise("fewer than stated")
    return F.when(stated.isNotNull(), F.struct(diff.alias("difference"), pct.alias("difference_pct"), verdict.alias("verdict"), F.when(F.abs(pct) > 10, "medium").otherwise("low").alias("severity")))


VARIANCE_NOTES = {
    "truncated": "The crawl stopped at its page limit, so the site is larger than what was crawled and the comparison understates it.",
    "as stated": "The count is close to what the client stated.",
    "more than stated": "The crawl found clearly more pages than stated: ask about old campaigns, unlinked sections or forgotten subdomains.",
    "fewer than stated": "The crawl found clearly fewer pages than stated: check for blocked, private or unlinked pages.",
}

_PILLARS = (("ia_health", "Information Architecture"), ("content_quality", "Content Quality"), ("accessibility", "Accessibility"), ("seo", "SEO & Findability"))


def pillar_order() -> Column:
    """Pillar names from the highest score to the lowest, ties in the fixed order."""
    rows = F.array(*(F.struct((-F.col(c)).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (c, n) in enumerate(_PILLARS)))
    return F.transform(F.array_sort(rows), lambda x: x["n"])


def adjective(score: Column) -> Column:
    return F.when(score >= 85, "strong").when(score >= 70, "good with gaps").when(score >= 50, "mixed").otherwise("weak at the base")


def _n(name: str) -> Column:
    return F.col(name).cast("string")


def _some(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def plain_terms(card: DataFrame) -> DataFrame:
    """The scorecard's row in sentences, one element each."""
    c = F.concat
    when = lambda name, *words: F.when(F.col(name) > 0, c(_n(name), *map(F.lit, words)))
    lines = _some(
        c(F.lit("UX maturity is "), _n("ux_maturity"), F.lit("/100 ("), F.col("ux_maturity_band"), F.lit(") over "), _n("total_pages"), F.lit(" pages.")),
        when("orphan_pages", " page(s) have no internal link to them."),
        when("thin_pages", " page(s) have fewer than 150 words."),
        when("duplicate_pages", " page(s) repeat other pages, fully or nearly."),
        F.when(F.col("accessibility_pages") > 0, c(F.lit("Automated accessibility checks flagged "), _n("accessibility_pages"), F.lit(" of "), _n("total_pages"), F.lit(" pages."))).otherwise("Automated accessibility checks flagged no page."),
        when("broken_pages", " page(s) returned an error status."),
    )
    return card.select(F.posexplode(lines).alias("ord", "line"))


def assessment(card: DataFrame) -> DataFrame:
    """Paragraphs on structure, content, accessibility, findability and where to start."""
    c, lit = F.concat, F.lit
    order = pillar_order()
    count = lambda name, words: F.when(F.col(name) > 0, c(_n(name), lit(words)))
    group = lambda head, *parts: F.when(F.size(_some(*parts)) > 0, c(lit(head), F.array_join(_some(*parts), " ")))
    content = [count("missing_h1", " page(s) lack an H1."), count("thin_pages", " page(s) are thin."), count("duplicate_pages", " page(s) repeat others.")]
    start = (
        F.when(F.col("orphan_pages") > 0, c(lit("link the "), _n("orphan_pages"), lit(" orphan page(s)")))
        .when(F.col("accessibility_pages") > 0, "work through the accessibility findings")
        .when(F.col("thin_pages") > 0, "extend the thin pages")
        .otherwise("review the remaining findings")
    )
    lines = _some(
        c(lit("UX maturity is "), _n("ux_maturity"), lit(" of 100, "), adjective(F.col("ux_maturity")), lit(" overall. Strongest: "), order[0], lit("; weakest: "), order[3], lit(".")),
        group("Structure: ", count("orphan_pages", " orphan page(s)."), F.when(F.col("max_click_depth") > 3, c(lit("The deepest page is "), _n("max_click_depth"), lit(" clicks away.")))),
        F.coalesce(group("Content: ", *content), lit("Content: no issue found.")),
        F.when(F.col("accessibility_pages") > 0, c(lit("Accessibility: issues on "), _n("accessibility_pages"), lit(" of "), _n("total_pages"), lit(" pages, as a lower bound."))).otherwise("Accessibility: nothing flagged; check by hand as well."),
        group("Findability: ", count("missing_title", " page(s) lack a title."), count("missing_meta_description", " page(s) lack a meta description.")),
        c(lit("Start here: "), start, lit(".")),
    )
    return card.select(F.posexplode(lines).alias("ord", "line"))


def summary_prompt(card: DataFrame) -> DataFrame:
    """A prompt for an external summary; sending it is left to the caller."""
    return card.select(F.concat_ws("\n", F.lit("Summarise this website audit in one paragraph."), *(F.concat(F.lit(f"{x}: "), _n(x)) for x in ("total_pages", "ux_maturity", "ia_health", "content_quality", "accessibility", "seo", *COUNTS))).alias("prompt"))


#: Usability heuristics that a crawl can't assess, and the finding types that stand for the others, in the workbook and in the report.
HEURISTICS = (
    ("H1", "Visibility of system status", ()),
    ("H2", "Match between system and the real world", ()),
    ("H3", "User control and freedom", ()),
    ("H4", "Consistency and standards", ("missing_title", "missing_meta_description")),
    ("H5", "Error prevention", ("broken_page",)),
    ("H6", "Recognition rather than recall", ("duplicate_title", "near_duplicate_content")),
    ("H7", "Flexibility and efficiency of use", ()),
    ("H8", "Aesthetic and minimalist design", ("image_alt",)),
    ("H9", "Help recognize, diagnose, and recover from errors", ("broken_page",)),
    ("H10", "Help and documentation", ()),
)
REPORT_HEURISTICS = {"H4": "duplicate_title", "H9": "broken_page"}


def heuristics(findings: DataFrame, missing_alt: int) -> DataFrame:
    """The workbook's ten rows: ord, heuristic, assessed, status, top_finding. The status texts are a fixed format."""
    spark = findings.sparkSession
    wanted = [(i, f"{h} — {name}", bool(types), h, t, k) for i, (h, name, types) in enumerate(HEURISTICS) for k, t in enumerate(types or (None,))]
    rules = spark.createDataFrame(wanted, "ord int, heuristic string, assessed boolean, id string, finding_type string, choice int")
    firsts = findings.groupBy("finding_type").agg(F.min(F.struct("ord", "severity", "affected_page_count", "title")).alias("f"))
    met = rules.join(firsts, "finding_type", "left").groupBy("ord", "heuristic", "assessed", "id").agg(F.min(F.when(F.col("f").isNotNull(), F.struct("choice", "f"))).alias("m"))
    number = severity_rank(F.col("m.f.severity")) + 1
    from_finding = F.when(F.col("m").isNull(), "No issues found").otherwise(F.concat(F.lit("Severity "), F.least(number, F.lit(4)).cast("string"), F.lit(" — "), F.col("m.f.affected_page_count").cast("string"), F.lit(" finding(s)")))
    alt = F.lit(missing_alt)
    status = F.when(~F.col("assessed"), "Not assessed").when(F.col("id") == "H8", F.when(alt > 0, "Severity 3 — 2 finding(s)").otherwise("No issues found")).otherwise(from_finding)
    top = F.when(F.col("id") == "H8", F.when(alt > 0, F.concat(F.lit("Describe "), alt.cast("string"), F.lit(" image(s).")))).otherwise(F.col("m.f.title"))
    return met.select("ord", "heuristic", F.when(F.col("assessed"), "Yes").otherwise("No").alias("assessed"), status.alias("status"), top.alias("top_finding")).orderBy("ord")

#: Work area of a finding in the printed report (fixed values); others are General.
REPORT_AREA = {
    "orphan_page": "IA", "broken_page": "IA", "missing_h1": "Content", "missing_title": "SEO", "missing_meta_description": "SEO", "duplicate_title": "SEO", "near_duplicate_content": "Content", "low_readability": "Content",
    "accessibility_violation": "Accessibility", "mixed_content": "Risk", "exposed_staging": "Risk", "pii_without_privacy_link": "Risk", "cms_detected": "Tech Stack", "js_framework_detected": "Tech Stack",
}


def report_heuristics(findings: DataFrame) -> DataFrame:
    """The printed report's ten rows: only two are assessed, each by one finding type."""
    spark = findings.sparkSession
    rules = spark.createDataFrame([(i, f"{h} — {n}", REPORT_HEURISTICS.get(h)) for i, (h, n, _) in enumerate(HEURISTICS)], "ord int, heuristic string, finding_type string")
    firsts = findings.groupBy("finding_type").agg(F.min(F.struct("ord", "severity", "affected_page_count", "title")).alias("f"))
    return rules.join(firsts, "finding_type", "left").select("ord", "heuristic", F.col("f").isNotNull().alias("assessed"), "f.severity", F.col("f.affected_page_count").alias("count"), F.col("f.title").alias("finding")).orderBy("ord")


def coverage(audits: DataFrame, pages: DataFrame) -> DataFrame:
    """Per audit: whether the crawl ended under its limit, pages with errors, and seconds to a tenth."""
    n = pages.groupBy("audit_id").agg(F.count("*").alias("pages"), F.count("error").alias("page_errors"))
    seconds = F.floor((F.unix_millis("finished_at") - F.unix_millis("started_at")) / 100 + 0.5) / 10
    met = audits.join(n, "audit_id", "left")
    return met.select("audit_id", (F.coalesce("pages", F.lit(0)) < F.col("max_pages")).alias("complete"), F.coalesce("page_errors", F.lit(0)).alias("page_errors"), seconds.alias("duration_seconds"))
