"""An audit from crawled pages to findings, scores and sheets: what follows a crawl, as one call."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import scratch
from auditloom.functions import dom_signals as ds
from auditloom.functions import html as markup
from auditloom.functions import text, urls
from auditloom.sources import corpus, sinks

from . import content, findings, scoring, site

_VIOLATIONS = "array<struct<id:string,impact:string,description:string,nodesCount:int>>"


def parsed(pages: DataFrame, fields: Iterable[str] = tuple(markup.FIELDS)) -> DataFrame:
    """Crawled pages with everything that their markup says; the markup is parsed once and whole, in the column ``dom``, and cut where it is kept.

    Accessibility violations are those of the column of that name, where a scanner in a browser made one, else what the rules for markup find.
    ``fields`` are those of ``dom`` that are asked for; columns that rest on others are left out.
    """
    fields, d = tuple(fields), F.col("dom")
    given = F.col("accessibility_violations") if "accessibility_violations" in pages.columns else d["violations"]
    columns = {
        **{c: (c, lambda c=c: d[c]) for c in ("title", "meta_description", "h1_text", "canonical", "lang", "word_count")},
        "hreflang": ("hreflang", lambda: ds.hreflang(d, F.col("url"))), "text": ("visible_text", lambda: d["visible_text"]), "is_client_rendered": ("client_rendered", lambda: d["client_rendered"]),
        "template_fingerprint": ("skeleton", lambda: markup.fingerprint(d)), "accessibility_violations": ("violations", lambda: F.coalesce(given, F.array().cast(_VIOLATIONS))),
    }
    p = pages.withColumn("dom", markup.dom(F.col("html"), fields))
    made = p.select(*(c for c in pages.columns if c != "accessibility_violations"), "dom", *(make().alias(c) for c, (field, make) in columns.items() if field in fields))
    return corpus.stored(made)


@dataclass
class Audit:
    """The tables of a finished audit."""

    facts: dict
    pages: DataFrame
    links: DataFrame
    assets: DataFrame
    interactions: DataFrame
    findings: DataFrame
    card: DataFrame
    link_status: DataFrame | None = None


def run(pages: DataFrame, start_url: str, as_of: Column, facts: dict | None = None, stated: int | None = None, max_pages: int = 500, link_status: DataFrame | None = None, near: dict | None = None) -> Audit:
    """From crawled pages (page_ord, page_id, url, html, status_code, error, depth, response_time_ms, last_modified) to all results.

    Parsed pages and findings are written once to the shared scratch folder; everything else reads them. The audit has failed
    (``facts['status']``) where no page without error is left or the start page itself failed, otherwise it is done.
    """
    p = scratch.written(parsed(pages), "parsed-pages")
    links, assets = sinks.link_rows(p), sinks.asset_rows(p)
    found = scratch.written(findings.analyze(p, links, assets, start_url, as_of, stated, max_pages, near or {"max_pages": None}), "findings")
    card = scratch.written(scoring.scorecard(scoring.site_counts(p, found)), "scorecard")
    bad = p.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if((F.col("url") == start_url) & F.col("error").isNotNull()).alias("start")).first()
    facts = {"start_url": start_url, "status": "failed" if bad["start"] or not bad["ok"] else "done", "client_stated_page_count": stated, **(facts or {})}
    return Audit(facts, p, links, assets, sinks.interaction_rows(p), found, card, link_status)


def labelled(df: DataFrame, rows: list[tuple[str, Column]]) -> DataFrame:
    """One row of values as (ord, label, value) rows."""
    return df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("label"), v.cast("string").alias("value")) for i, (k, v) in enumerate(rows)))))


def overview(audit: Audit) -> DataFrame:
    """The workbook's first sheet: what was audited, the scores and the main counts."""
    f, c = audit.facts, F.col
    shown = lambda key: F.lit(f.get(key)).cast("string")
    kinds = audit.findings.agg(F.count("*").alias("findings"))
    shapes = audit.pages.agg(F.countDistinct(F.nullif("template_fingerprint", F.lit(""))).alias("templates"))
    parts = site.components(site.component_hits(audit.pages), F.lit(1)).agg(F.count("*").alias("components"))
    known, other = integrations(audit)
    third = known.select("name").unionAll(other.select("domain")).agg(F.count("*").alias("integrations"))
    row = audit.card.crossJoin(kinds).crossJoin(shapes).crossJoin(parts).crossJoin(third)
    score = lambda name: F.concat(c(name).cast("string"), F.lit(" / 100"))
    rows = [
        ("Client", shown("client_name")), ("Site audited", shown("start_url")), ("Audited as", F.lit(", ".join(f.get("personas", ("ux", "content", "business"))))), ("Pages crawled", c("total_pages")), ("Findings", c("findings")),
        ("Crawl started", shown("started_at")), ("Crawl finished", shown("finished_at")), ("Overall UX Maturity", F.concat(score("ux_maturity"), F.lit(" ("), c("ux_maturity_band"), F.lit(")"))),
        ("Information Architecture", score("ia_health")), ("Content Quality", score("content_quality")), ("Accessibility", score("accessibility")), ("SEO / Findability", score("seo")),
        ("Orphan pages", c("orphan_pages")), ("Thin content pages", c("thin_pages")), ("Duplicate content pages", c("duplicate_pages")), ("Pages with accessibility issues", F.concat(c("accessibility_pages"), F.lit(" / "), c("total_pages"))),
        ("Unique page templates", c("templates")), ("Unique reusable components", c("components")), ("Unique third-party integrations", c("integrations")),
    ]
    if f.get("client_stated_page_count") is not None:
        rows.append(("Client-stated page count", shown("client_stated_page_count")))
    return labelled(row, rows)


def integrations(audit: Audit) -> tuple[DataFrame, DataFrame]:
    host = urls.host(F.lit(audit.facts["start_url"]))
    each = audit.pages.select("url", F.explode(ds.external_script_hosts(F.col("dom"), host)).alias("host"))
    total = audit.card.first()["total_pages"]
    return content.integrations(each, F.lit(max(1, total)))


def performance(pages: DataFrame, n: int = 10) -> DataFrame:
    """The first pages with the measures that a crawl doesn't take, as nulls."""
    none = lambda name: F.lit(None).cast("double").alias(name)
    return pages.orderBy("page_ord").limit(n).select(F.col("url").alias("Page"), none("Score"), none("LCP"), none("CLS"), none("TBT"))


def inventory(pages: DataFrame, links: DataFrame) -> DataFrame:
    """A row for each page: what it is, what it holds, what it repeats."""
    dom = F.col("dom")
    rows = pages.select(
        "page_ord", "url", "status_code", "title", "word_count", urls.path_depth(F.col("url")).alias("path_depth"), "depth", ((F.col("word_count") > 0) & (F.col("word_count") < 150)).alias("thin"),
        ds.images_total(dom).alias("images"), ds.images_missing_alt(dom).alias("missing_alt"), ds.has_structured_data(dom).alias("has_schema"), "canonical", ds.script_count(dom).alias("scripts"),
        F.size(ds.external_script_hosts(dom, urls.host(F.col("url")))).alias("external_scripts"), F.when(F.col("text") != "", text.flesch(F.col("text"))).alias("readability"), "error",
    )
    return rows.join(site.links_out(pages, links).drop("url"), "page_ord").join(content.duplicate_of(pages).drop("url"), "page_ord")


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(c).alias(n) for c, n in names.items()))


def _stacked(*parts: DataFrame) -> DataFrame:
    """Blocks of (ord, label, value) one after the other."""
    out = None
    for i, part in enumerate(parts):
        part = part.select(F.lit(i).alias("block"), "ord", F.col("label").cast("string").alias("label"), F.col("value").cast("string").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("block", "ord").select("label", "value")


def _ranked(df: DataFrame, label: str, value: str, *order: Column) -> DataFrame:
    """A short list as (ord, label, value) rows."""
    from pyspark.sql import Window

    return df.select(F.row_number().over(Window.orderBy(*order)).alias("ord"), F.col(label).alias("label"), F.col(value).alias("value"))


def workbook(audit: Audit, as_of: Column, cap: int = 15) -> dict[str, DataFrame]:
    """The sheets of the workbook by name, in order (names and columns are a fixed format)."""
    p, c = audit.pages, F.col
    f = scoring.persona_filter(audit.findings, list(audit.facts.get("personas", ("ux", "content", "business"))))
    missing_alt = audit.card.first()["missing_alt"]
    known, other = integrations(audit)
    lines = F.array_join("affected_urls_sample", "\n")
    health = audit.link_status
    broken = site.broken_external_links(audit.links, health) if health is not None else site.external_targets(audit.links).where("false").withColumn("status", F.lit(""))
    pairs = site.address_groups(p)
    slash, case = (pairs.where(x).orderBy("page_ord").limit(cap) for x in ("slash_conflict", "case_conflict"))
    params = site.parameter_counts(p)
    joined = lambda df: df.select("page_ord", F.array_join("pages", " | ").alias("pages"), F.lit(None).cast("string").alias("none"))
    address = (
        slash.agg(F.count("*").alias("a")).crossJoin(case.agg(F.count("*").alias("b"))).crossJoin(params.agg(F.count_if(c("param_count") > 3).alias("c"), F.count_if(F.size("tracking_params") > 0).alias("d")))
    )
    fresh, media, locale = site.freshness_summary(p, as_of), site.media_summary(audit.assets), site.locale_summary(p)
    of = lambda n, pct: F.concat(c(n).cast("string"), F.lit(" ("), c(pct).cast("string"), F.lit("%)"))
    stages = site.journey_stages(p, site.journey_rules(p.sparkSession))
    words = content.zipped(content.top_keywords(p), content.top_phrases(p).withColumnRenamed("occurrences", "times"), [F.desc("occurrences"), c("first")], [F.desc("times"), c("phrase")])
    scripts = content.zipped(known, other, [F.desc("pages_found_on"), c("name")], [F.desc("references"), c("domain")])
    locales = site.hreflang_links(p).groupBy("locale").agg(F.countDistinct("page_ord").alias("n"))
    sample = {"affected_page_count": "Affected Pages", "lines": "Sample URLs", "detection_method": "Detection Method"}
    return {
        "Overview": overview(audit).orderBy("ord").select("label", "value"),
        "Heuristic Evaluation": scoring.heuristics(f, missing_alt).drop("ord"),
        "Action Plan": scoring.action_plan(f).drop("rank", "ord"),
        "Feature Matrix": site.feature_matrix(p).orderBy("ord").select(c("feature").alias("Feature"), F.when(c("detected"), "Yes").otherwise("No").alias("Detected?"), F.when(c("detected"), c("pages_found_on")).alias("Pages Found On")),
        "Performance": performance(p),
        "External Link Health": _named(broken, {"url": "Broken URL", "status": "Status", "linked_from_count": "Linked From (count)", "example_linking_page": "Example Linking Page"}),
        "Accessibility": _named(f.where("finding_type = 'accessibility_violation'").withColumn("lines", lines).orderBy("ord"), {"title": "Issue", "severity": "Severity", **sample}),
        "Tech Stack & Risks": f.where(c("finding_type").isin("cms_detected", "js_framework_detected", "mixed_content", "exposed_staging", "pii_without_privacy_link")).orderBy("ord").select(
            F.when(c("finding_type").isin("cms_detected", "js_framework_detected"), "Tech Stack").otherwise("Risk").alias("Category"), c("title").alias("Title"), c("severity").alias("Severity"), c("affected_page_count").alias("Affected Pages"), c("description").alias("Description")
        ),
        "Templates": _named(
            site.template_groups(p).orderBy(F.desc("page_count"), "fingerprint").limit(25).withColumn("lines", F.array_join("sample_urls", "\n")),
            {"fingerprint": "Fingerprint", "page_count": "Page Count", "example_url": "Example URL", "example_title": "Example Title", "lines": "Sample URLs"},
        ),
        "Components": _named(
            site.components(site.component_hits(p), F.lit(max(1, audit.card.first()["total_pages"]))).orderBy(F.desc("page_count"), "signature").limit(40),
            {"signature": "Component", "tag": "Tag", "classes": "Classes", "page_count": "Page Count", "page_coverage_pct": "Page Coverage %", "example_url": "Example URL"},
        ),
        "Journey Maps": _named(stages.orderBy("ord"), {"journey": "Persona", "stage": "Stage", "present": "Present", "page_count": "Page Count", "example_url": "Example URL", "click_depth": "Click Depth"}),
        "Locale": _stacked(
            labelled(locale, [("Multilingual site?", c("is_multilingual")), ("Pages without lang attribute", c("pages_without_lang")), ("Pages with hreflang", c("pages_with_hreflang")), ("Broken hreflang links", c("broken_hreflang_count"))]),
            _ranked(locales, "locale", "n", c("locale")),
        ),
        "Media & Assets": _stacked(
            labelled(media, [("Total images", c("total_images")), ("Dominant image domain", c("dominant_image_domain")), ("Images off dominant domain", of("off_dominant_domain_image_count", "off_dominant_domain_pct")), ("Video embeds", c("video_embed_count")), ("Documents total", c("document_total"))]),
            _ranked(site.image_domains(audit.assets), "domain", "images", F.desc("images"), c("domain")),
            _ranked(site.document_types(audit.assets), "extension", "documents", F.desc("documents"), c("extension")),
        ),
        "Freshness": _stacked(
            labelled(fresh, [("Pages with known last-modified date", c("pages_with_known_date")), ("Pages with unknown date", of("pages_with_unknown_date", "unknown_date_pct")), ("Stale > 1yr", of("stale_over_1yr_count", "stale_over_1yr_pct")), ("Stale > 3yr", of("stale_over_3yr_count", "stale_over_3yr_pct"))]),
            _ranked(site.stalest_pages(p, as_of), "url", "days", F.desc("days"), c("page_ord")),
        ),
        "URL Health": _stacked(
            labelled(address, [("Trailing-slash inconsistencies", c("a")), ("Case inconsistencies", c("b")), ("Param-bloated URLs (>3 params)", c("c")), ("URLs with tracking params", c("d"))]),
            _ranked(joined(slash), "pages", "none", c("page_ord")), _ranked(joined(case), "pages", "none", c("page_ord")),
        ),
        "Keywords": _named(words.orderBy("rank"), {"keyword": "Keyword", "occurrences": "Occurrences", "pages_found_on": "Pages Found On", "pct_of_pages": "% of Pages", "phrase": "Top Phrases", "times": "Occurrences "}),
        "Integrations": _named(scripts.orderBy("rank"), {"name": "Integration", "category": "Category", "pages_found_on": "Pages Found On", "pct_of_pages": "% of Pages", "domain": "Other scripts (unrecognized)", "references": "References"}),
        "Page Inventory": _named(
            inventory(p, audit.links).orderBy("page_ord"),
            {"url": "URL", "status_code": "Status", "title": "Title", "word_count": "Words", "path_depth": "Path Depth", "depth": "Click Depth", "thin": "Thin?", "duplicate_of": "Duplicate Of", "images": "Images", "missing_alt": "Missing Alt", "has_schema": "Has Schema?", "canonical": "Canonical",
             "internal_links_out": "Internal Links Out", "scripts": "Scripts", "external_scripts": "External Scripts", "readability": "Readability", "error": "Error"},
        ),
        "Findings": _named(
            f.withColumn("lines", lines).withColumn("who", F.array_join("personas", ", ")).orderBy("ord"),
            {"finding_type": "Type", "title": "Title", "severity": "Severity", "effort_bucket": "Effort Bucket", "who": "Personas", "affected_page_count": "Affected Pages", "lines": "Sample URLs", "description": "Description", "detection_method": "Detection Method"},
        ),
    }


def report(audit: Audit) -> dict[str, DataFrame]:
    """The frames behind the sections of the printed report."""
    f = scoring.persona_filter(audit.findings, list(audit.facts.get("personas", ("ux", "content", "business"))))
    x, y = scoring.plot_position(F.col("severity"), F.col("effort_bucket"))
    return {
        "overview": overview(audit), "plain_terms": scoring.plain_terms(audit.card), "assessment": scoring.assessment(audit.card), "heuristics": scoring.report_heuristics(f), "action_plan": scoring.action_plan(f), "backlog": scoring.backlog(f),
        "areas": f.groupBy(scoring.lookup(F.col("finding_type"), scoring.REPORT_AREA, "General").alias("area")).agg(F.count("*").alias("findings")),
        "chart": f.where("finding_type <> 'scale_summary'").select("ord", "title", x.alias("x"), y.alias("y"), scoring.quadrant(F.col("severity"), F.col("effort_bucket")).alias("quadrant")),
        "features": site.feature_matrix(audit.pages), "inventory": inventory(audit.pages, audit.links),
    }
