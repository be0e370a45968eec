"""Producers of findings: one row for each issue that a site has, with a sample of the pages that show it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import dom_signals as ds
from auditloom.functions import signatures as sig
from auditloom.functions import text, urls

from . import content, site
from .scoring import VARIANCE_NOTES, lookup, variance

SAMPLE = 10
#: Findings in the order in which they are produced.
ORDER = (
    "broken_page", "missing_h1", "orphan_page", "missing_title", "missing_meta_description", "duplicate_title", "accessibility_violation", "cms_detected", "js_framework_detected", "mixed_content", "exposed_staging",
    "pii_without_privacy_link", "near_duplicate_content", "low_readability", "template_rollup", "one_off_template", "component_style_inconsistency", "broken_hreflang", "missing_lang_attribute", "media_governance_risk", "freshness_unknown", "stale_content",
    "url_trailing_slash_inconsistency", "url_case_inconsistency", "url_tracking_params_internal", "page_count_variance", "scale_summary",
)
COLUMNS = ("finding_type", "title", "description", "severity", "effort_bucket", "personas", "affected_page_count", "affected_urls_sample", "affected_template", "detection_method")
#: type: (severity, effort, personas, words after the count, description, detection)
KINDS: dict[str, tuple[str, str, str, str, str, str]] = {
    "broken_page": ("medium", "config", "ux business", " page(s) returned an error status", "Broken pages cost trust and search ranking.", "status code of 400 or more"),
    "missing_h1": ("medium", "config", "ux content", " page(s) without an H1", "Readers and search engines rely on the main heading.", "no h1 in the markup"),
    "orphan_page": ("medium", "config", "ux content", " page(s) without an inbound internal link", "Visitors can't reach these pages by navigation.", "no internal link has the page as its target"),
    "missing_title": ("high", "config", "content business", " page(s) without a title", "Titles name a page in results and tabs.", "empty title"),
    "missing_meta_description": ("low", "config", "content", " page(s) without a meta description", "Search engines make up a snippet where none is given.", "no meta description"),
    "mixed_content": ("high", "config", "business ux", " page(s) load insecure resources on a secure page", "Browsers warn about such resources or block them.", "http source on an https page"),
    "exposed_staging": ("medium", "config", "business", " page(s) look like a staging host", "Hosts of this name are seldom meant for the public.", "pattern on the host name"),
    "pii_without_privacy_link": ("medium", "config", "business", " page(s) ask for personal data without a privacy link", "To be checked by hand; no legal statement.", "form fields and link texts"),
    "low_readability": ("low", "custom_dev", "content", " page(s) are very hard to read", "The reading-ease score is below 30.", "Flesch reading ease of the visible text"),
    "missing_lang_attribute": ("medium", "config", "ux content", " page(s) without a language on a site of several", "Readers' software can't tell the language.", "no lang attribute"),
}


def _plural(n: Column, words: str) -> Column:
    return F.concat(n.cast("string"), F.lit(words))


def finding(kind: str, severity: Column, effort: str, personas: str, title: Column, description: Column, count: Column, sample: Column, method: Column, template: Column | None = None) -> list[Column]:
    values = (F.lit(kind), title, description, severity, F.lit(effort), F.array(*map(F.lit, personas.split())), count.cast("int"), sample, F.lit(None).cast("string") if template is None else template, method)
    return [v.alias(c) for v, c in zip(values, COLUMNS, strict=True)]


def _none() -> Column:
    return F.array().cast("array<string>")


def of_pages(kind: str, hits: DataFrame, severity: Callable[[Column], Column] | None = None) -> DataFrame:
    """One finding for the pages in hits (page_ord, url), none for no page."""
    level, effort, personas, words, why, how = KINDS[kind]
    n = hits.agg(F.count("*").alias("n"))
    firsts = hits.select("page_ord", "url").orderBy("page_ord").limit(SAMPLE).agg(F.array_sort(F.collect_list(F.struct("page_ord", "url"))).alias("s"))
    row = n.crossJoin(firsts).where("n > 0")
    grade = F.lit(level) if severity is None else severity(F.col("n"))
    return row.select(*finding(kind, grade, effort, personas, _plural(F.col("n"), words), F.lit(why), F.col("n"), F.transform("s", lambda x: x["url"]), F.lit(how)))


def of_flags(pages: DataFrame, flags: dict[str, Column], severity: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One finding for each kind whose flag some page shows: counts and samples of all kinds from the same pass over the pages."""
    hits = pages.select("page_ord", "url", F.explode(F.filter(F.array(*(F.when(flag, F.lit(kind)) for kind, flag in flags.items())), lambda k: k.isNotNull())).alias("kind"))
    n = hits.groupBy("kind").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("page_ord", "url"))
    firsts = hits.withColumn("r", place).where(F.col("r") <= SAMPLE).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("page_ord", "url"))).alias("s"))
    row = n.join(F.broadcast(firsts), "kind")
    out = None
    at = {k: F.lit(None) for k in ("level", "effort", "words", "why", "how", "personas")}
    for kind in flags:
        level, effort, personas, words, why, how = KINDS[kind]
        mine = F.col("kind") == kind
        made = {"level": severity[kind](F.col("n")) if severity and kind in severity else F.lit(level), "effort": F.lit(effort), "words": F.lit(words), "why": F.lit(why), "how": F.lit(how), "personas": F.array(*map(F.lit, personas.split()))}
        at = {k: F.when(mine, made[k]) if out is None else at[k].when(mine, made[k]) for k in made}
        out = kind
    return row.select(
        F.col("kind").alias("finding_type"), F.concat(F.col("n").cast("string"), at["words"]).alias("title"), at["why"].alias("description"), at["level"].alias("severity"), at["effort"].alias("effort_bucket"), at["personas"].alias("personas"),
        F.col("n").cast("int").alias("affected_page_count"), F.transform("s", lambda x: x["url"]).alias("affected_urls_sample"), F.lit(None).cast("string").alias("affected_template"), at["how"].alias("detection_method"),
    )


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def page_flags(pages: DataFrame) -> dict[str, Column]:
    """Kinds of findings that a page shows by itself, as far as the columns for them are there."""
    ok, d, has = F.col("error").isNull(), F.col("dom"), set(pages.columns)
    flags = {
        "broken_page": ("status_code", lambda: F.col("status_code") >= 400),
        "missing_h1": ("h1_text", lambda: ok & _blank("h1_text")),
        "missing_title": ("title", lambda: ok & _blank("title")),
        "missing_meta_description": ("meta_description", lambda: ok & _blank("meta_description")),
        "mixed_content": ("dom", lambda: ds.mixed_content(d, F.col("url"))),
        "exposed_staging": ("url", lambda: urls.is_staging(F.col("url"))),
        "pii_without_privacy_link": ("dom", lambda: ds.pii_form_without_privacy_link(d)),
        "low_readability": ("text", lambda: text.flesch(F.col("text")) < 30),
    }
    return {k: make() for k, (column, make) in flags.items() if column in has}


GRADED = {"broken_page": lambda n: F.when(n > 5, "high").otherwise("medium")}


def by_page(pages: DataFrame, kinds=None) -> DataFrame:
    """Findings of pages that can be told from the page alone, in one pass."""
    flags = page_flags(pages)
    return of_flags(pages, {k: v for k, v in flags.items() if kinds is None or k in kinds}, GRADED)


def orphans(pages: DataFrame, links: DataFrame, start_url: str) -> DataFrame:
    return of_pages("orphan_page", site.orphan_pages(pages, links, start_url))


def duplicate_titles(pages: DataFrame) -> DataFrame:
    named = pages.where(~_blank("title"))
    groups = named.groupBy("title").agg(F.count("*").alias("n"), F.min("page_ord").alias("first")).where("n > 1")
    total = groups.agg(F.count("*").alias("groups"), F.sum("n").alias("n"))
    # the sample follows the order of groups by their first page; ten groups hold more than ten pages
    some = groups.orderBy("first").limit(SAMPLE)
    sample = named.join(F.broadcast(some.select("title", "first")), "title").orderBy("first", "page_ord").limit(SAMPLE).agg(F.array_sort(F.collect_list(F.struct("first", "page_ord", "url"))).alias("s"))
    row = total.crossJoin(sample).where("groups > 0")
    title = F.concat(F.col("groups").cast("string"), F.lit(" title(s) shared by "), F.col("n").cast("string"), F.lit(" pages"))
    return row.select(*finding("duplicate_title", F.lit("medium"), "config", "content business", title, F.lit("Titles should tell pages apart."), F.col("n"), F.transform("s", lambda x: x["url"]), F.lit("equal titles")))


def accessibility(pages: DataFrame) -> DataFrame:
    """One finding for each rule; impact and description are those of the first page."""
    each = pages.select("page_ord", "url", F.posexplode("accessibility_violations").alias("pos", "v")).select("page_ord", "pos", "url", "v.id", "v.impact", "v.description")
    # an address may be that of several pages
    by = each.groupBy("id").agg(F.countDistinct("page_ord").alias("n"), F.min(F.struct("page_ord", "pos", "impact", "description")).alias("f"))
    place = F.row_number().over(_window("id"))
    firsts = each.select("id", "page_ord", "url").distinct().withColumn("r", place).where(F.col("r") <= SAMPLE).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("page_ord", "url"))).alias("s"))
    row = by.join(firsts, "id").orderBy("f")
    title = F.concat(F.lit("Accessibility: "), F.col("f.description"))
    why = F.concat(F.lit("Rule "), F.col("id"), F.lit(" ("), F.col("f.impact"), F.lit(") on "), F.col("n").cast("string"), F.lit(" page(s)."))
    return row.select(*finding("accessibility_violation", lookup(F.col("f.impact"), sig.AXE_SEVERITY, "medium"), "config", "ux", title, why, F.col("n"), F.transform("s", lambda x: x["url"]), F.concat(F.lit("automated scan, rule "), F.col("id"))))


def _window(key: str):
    return Window.partitionBy(key).orderBy("page_ord", "url")


def tech_stack(pages: DataFrame) -> DataFrame:
    each = site.tech_stack(pages).select("page_ord", "url", "kind", "name").distinct()
    by = each.groupBy("kind", "name").agg(F.countDistinct("page_ord").alias("n"), F.min("page_ord").alias("first"))
    firsts = each.withColumn("r", F.row_number().over(Window.partitionBy("kind", "name").orderBy("page_ord"))).where(F.col("r") <= SAMPLE).groupBy("kind", "name").agg(F.array_sort(F.collect_list(F.struct("page_ord", "url"))).alias("s"))
    row = by.join(firsts, ["kind", "name"]).orderBy("kind", "first", "name")
    what = F.when(F.col("kind") == "cms_detected", "Platform: ").otherwise("Script framework: ")
    made = finding("", F.lit("low"), "ootb", "business", F.concat(what, F.col("name")), F.concat(F.lit("Found on "), F.col("n").cast("string"), F.lit(" page(s).")), F.col("n"), F.transform("s", lambda x: x["url"]), F.lit("signature in the markup"))
    return row.select(F.col("kind").alias("finding_type"), *made[1:])


def near_duplicates(pages: DataFrame, **options) -> DataFrame:
    clusters = content.near_duplicate_clusters(pages, "page_ord", **options)
    total = clusters.agg(F.countDistinct("cluster").alias("clusters"), F.count("*").alias("n"), F.min("cluster").alias("cluster"))
    sample = clusters.join(total.select("cluster"), "cluster").select(F.col("id").alias("page_ord")).join(pages.select("page_ord", "url"), "page_ord").orderBy("page_ord").limit(SAMPLE).agg(F.array_sort(F.collect_list(F.struct("page_ord", "url"))).alias("s"))
    row = total.crossJoin(sample).where("clusters > 0")
    title = F.concat(F.col("clusters").cast("string"), F.lit(" cluster(s) of near-duplicate pages, "), F.col("n").cast("string"), F.lit(" pages"))
    return row.select(*finding("near_duplicate_content", F.lit("medium"), "config", "content", title, F.lit("Texts share three quarters of their shingles or more."), F.col("n"), F.transform("s", lambda x: x["url"]), F.lit("8-word shingles, Jaccard similarity of 0.75 or more")))


def templates(pages: DataFrame, collation: str = "UNICODE") -> list[DataFrame]:
    groups = site.template_groups(pages, collation)
    s = site.template_summary(groups)
    top = groups.orderBy(F.desc("page_count"), "fingerprint").limit(1).select(F.col("fingerprint").alias("top"), "sample_urls", F.col("page_count").alias("top_pages"))
    row = s.crossJoin(top).where("pages_analyzed > 0")
    title = F.concat(F.col("unique_template_count").cast("string"), F.lit(" page template(s) over "), F.col("pages_analyzed").cast("string"), F.lit(" page(s)"))
    why = F.concat(F.col("templates_with_reuse").cast("string"), F.lit(" of them serve two pages or more; the largest serves "), F.col("top_pages").cast("string"), F.lit("."))
    rollup = row.select(*finding("template_rollup", F.lit("low"), "ootb", "ux business", title, why, F.col("pages_analyzed"), F.col("sample_urls"), F.lit("hash of the page's skeleton"), F.col("top")))
    ones = groups.where("page_count = 1").orderBy("fingerprint").limit(SAMPLE).agg(F.collect_list("example_url").alias("s"))
    one = s.crossJoin(ones).where("one_off_count > 0")
    one_off = one.select(*finding("one_off_template", F.lit("low"), "custom_dev", "ux", _plural(F.col("one_off_count"), " page(s) with a layout of their own"), F.lit("Special pages, or drift from the design system."), F.col("one_off_count"), F.col("s"), F.lit("skeleton that one page has")))
    return [rollup, one_off]


def component_inconsistencies(pages: DataFrame) -> DataFrame:
    hits = site.component_hits(pages)
    row = site.style_inconsistencies(hits, F.lit(1))
    title = F.concat(F.col("distinct_style_count").cast("string"), F.lit(" styles of <"), F.col("tag"), F.lit("> over "), F.col("total_pages_covered").cast("string"), F.lit(" page(s)"))
    return row.select(*finding("component_style_inconsistency", F.lit("medium"), "custom_dev", "ux business", title, F.lit("Usually drift rather than intent."), F.col("total_pages_covered"), _none(), F.concat(F.lit("signatures: "), F.array_join("signatures", ", "))))


def locale_issues(pages: DataFrame) -> list[DataFrame]:
    broken = site.broken_hreflang(pages)
    n = broken.agg(F.count("*").alias("n"))
    sample = broken.orderBy("page_ord").limit(SAMPLE).agg(F.array_sort(F.collect_list(F.struct("page_ord", "from_page"))).alias("s"))
    row = n.crossJoin(sample).where("n > 0")
    bad = row.select(*finding("broken_hreflang", F.lit("medium"), "config", "content business", _plural(F.col("n"), " alternate-language link(s) to pages that weren't crawled"), F.lit("Broken, or outside of the crawl."), F.col("n"), F.transform("s", lambda x: x["from_page"]), F.lit("hreflang target not among the crawled addresses")))
    s = site.locale_summary(pages).where("is_multilingual AND pages_without_lang > 0")
    level, effort, personas, words, why, how = KINDS["missing_lang_attribute"]
    lang = s.select(*finding("missing_lang_attribute", F.lit(level), effort, personas, _plural(F.col("pages_without_lang"), words), F.lit(why), F.col("pages_without_lang"), _none(), F.lit(how)))
    return [bad, lang]


def media_governance(assets: DataFrame) -> DataFrame:
    s = site.media_summary(assets).where("total_images > 0 AND off_dominant_domain_pct > 15 AND image_domain_count > 1")
    title = F.concat(F.col("off_dominant_domain_image_count").cast("string"), F.lit(" image(s) off the main image host"))
    why = F.concat(F.lit("The main host is "), F.coalesce("dominant_image_domain", F.lit("unknown")), F.lit("; others should be governed as well."))
    return s.select(*finding("media_governance_risk", F.lit("low"), "config", "content business", title, why, F.col("off_dominant_domain_image_count"), _none(), F.lit("hosts of image sources")))


def freshness(pages: DataFrame, as_of: Column) -> list[DataFrame]:
    s = site.freshness_summary(pages, as_of).crossJoin(pages.agg(F.count("*").alias("total")))
    unknown = s.where("total > 0 AND pages_with_unknown_date / total > 0.5").select(
        *finding("freshness_unknown", F.lit("low"), "ootb", "content business", F.concat(F.lit("No date of change for "), F.col("pages_with_unknown_date").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" pages")), F.lit("Servers sent no Last-Modified."), F.col("pages_with_unknown_date"), _none(), F.lit("Last-Modified absent"))
    )
    old = site.stalest_pages(pages, as_of, SAMPLE).agg(F.array_sort(F.collect_list(F.struct((-F.col("days")).alias("d"), "page_ord", "url"))).alias("s"))
    stale = s.where("pages_with_known_date > 0 AND stale_over_3yr_count / pages_with_known_date > 0.2").crossJoin(old).select(
        *finding("stale_content", F.lit("low"), "config", "content business", _plural(F.col("stale_over_3yr_count"), " page(s) unchanged for three years or more"), F.lit("Review before a migration."), F.col("stale_over_3yr_count"), F.transform("s", lambda x: x["url"]), F.lit("Last-Modified over 1095 days ago"))
    )
    return [unknown, stale]


def url_health(pages: DataFrame, cap: int | None = 15) -> list[DataFrame]:
    groups = site.address_groups(pages)
    out = []
    for kind, flag, words, why in (
        ("url_trailing_slash_inconsistency", "slash_conflict", " address group(s) with and without a final slash", "Choose one form and redirect the other."),
        ("url_case_inconsistency", "case_conflict", " address group(s) in several letter cases", "Servers take them for different pages."),
    ):
        some = groups.where(flag).orderBy("page_ord")
        some = some if cap is None else some.limit(cap)
        s = some.agg(F.count("*").alias("n"), F.sum(F.size("pages")).alias("total"), F.min_by("pages", "page_ord").alias("s")).where("n > 0")
        out.append(s.select(*finding(kind, F.lit("medium"), "config", "business content", _plural(F.col("n"), words), F.lit(why), F.col("total"), F.col("s"), F.lit("addresses compared by host and path"))))
    tracked = site.parameter_counts(pages).where(F.size("tracking_params") > 0)
    n = tracked.agg(F.count("*").alias("n"))
    sample = tracked.orderBy("page_ord").limit(SAMPLE).agg(F.array_sort(F.collect_list(F.struct("page_ord", "url"))).alias("s"))
    row = n.crossJoin(sample).where("n > 0")
    out.append(row.select(*finding("url_tracking_params_internal", F.lit("low"), "config", "business content", _plural(F.col("n"), " address(es) with campaign parameters"), F.lit("They split analytics and repeat addresses."), F.col("n"), F.transform("s", lambda x: x["url"]), F.lit("parameter names"))))
    return out


def variance_note(pages: DataFrame, stated: int | None, max_pages: int) -> list[DataFrame]:
    if stated is None:
        return []
    row = pages.agg(F.count("*").alias("n")).select("n", variance(F.lit(stated), F.col("n"), F.col("n") >= max_pages).alias("v"))
    sign = F.when(F.col("v.difference_pct") > 0, "+").otherwise("")
    title = F.concat(F.lit("Crawled "), F.col("n").cast("string"), F.lit(f" pages, {stated} stated ("), sign, F.col("v.difference_pct").cast("string"), F.lit("%)"))
    return [row.select(*finding("page_count_variance", F.col("v.severity"), "ootb", "business", title, lookup(F.col("v.verdict"), VARIANCE_NOTES, ""), F.col("n"), _none(), F.lit("stated against crawled count")))]


def scale_counts(pages: DataFrame) -> DataFrame:
    """One row: pages, ok_pages, failed_pages, avg_response_ms, client_rendered_pages."""
    ok = F.col("error").isNull()
    client = F.coalesce(F.col("is_client_rendered"), F.lit(False)) if "is_client_rendered" in pages.columns else F.lit(False)
    return pages.agg(
        F.count("*").alias("pages"), F.count_if(ok).alias("ok_pages"), F.count_if(~ok).alias("failed_pages"),
        F.coalesce(F.floor(F.avg(F.when(ok, F.coalesce("response_time_ms", F.lit(0.0)))) + 0.5), F.lit(0)).cast("long").alias("avg_response_ms"),
        F.count_if(ok & client).alias("client_rendered_pages"),
    )


def scale_summary(pages: DataFrame) -> DataFrame:
    first = pages.select("page_ord", "url").orderBy("page_ord").limit(SAMPLE).agg(F.array_sort(F.collect_list(F.struct("page_ord", "url"))).alias("s"))
    row = scale_counts(pages).crossJoin(first)
    why = F.concat(_plural(F.col("ok_pages"), " rendered, "), _plural(F.col("failed_pages"), " failed; mean response "), _plural(F.col("avg_response_ms"), " ms; "), _plural(F.col("client_rendered_pages"), " rendered by scripts."))
    return row.select(*finding("scale_summary", F.lit("low"), "ootb", "business", F.concat(F.lit("The crawl covered "), F.col("pages").cast("string"), F.lit(" page(s)")), why, F.col("pages"), F.transform("s", lambda x: x["url"]), F.lit("counted from the crawl")))


def analyze(pages: DataFrame, links: DataFrame, assets: DataFrame, start_url: str, as_of: Column, stated: int | None = None, max_pages: int = 500, near: dict | None = None) -> DataFrame:
    """All findings in the producers' order (ord). pages carries a parsed ``dom``; cache it, every producer reads it."""
    parts = [
        by_page(pages), orphans(pages, links, start_url), duplicate_titles(pages), accessibility(pages), tech_stack(pages), near_duplicates(pages, **(near or {})), *templates(pages), component_inconsistencies(pages),
        *locale_issues(pages), media_governance(assets), *freshness(pages, as_of), *url_health(pages), *variance_note(pages, stated, max_pages), scale_summary(pages),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("finding_type"))
    # a few dozen rows: one task orders them
    return every.withColumn("ord", F.row_number().over(Window.orderBy(place, F.desc("affected_page_count"), "title")))
