"""Analyses of a whole site: templates, components, locales, media, freshness, addresses, journeys, features, links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions import dom_signals as ds
from auditloom.functions import signatures as sig
from auditloom.functions import urls
from auditloom.functions.numbers import half_up, one_place, percent
from auditloom.sources.corpus import is_real


def inbound_counts(links: DataFrame) -> DataFrame:
    return links.where("is_internal").groupBy(F.col("target_url").alias("url")).agg(F.count("*").alias("inbound"))


def orphan_pages(pages: DataFrame, links: DataFrame, start_url: str) -> DataFrame:
    """Pages without error that no internal link names, but for the start."""
    # each target once: most links of a site lead to a few of its pages
    named = links.where("is_internal").select(F.col("target_url").alias("url")).distinct()
    return pages.where(F.col("error").isNull() & (F.col("url") != start_url)).join(named, "url", "left_anti")


def links_out(pages: DataFrame, links: DataFrame) -> DataFrame:
    """page_ord, url, internal_links_out; 0 where a page has none. Links are those of an address, each once, also where several pages have it."""
    n = links.where("is_internal").select(F.col("source_url").alias("url"), "target_url").distinct().groupBy("url").agg(F.count("*").alias("n"))
    return pages.select("page_ord", "url").join(n, "url", "left").select("page_ord", "url", F.coalesce("n", F.lit(0)).alias("internal_links_out"))


def script_pages_without_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Client-rendered pages without internal links: orphans found beside them may be false."""
    return pages.where("is_client_rendered").join(links.where("is_internal").select(F.col("source_url").alias("url")), "url", "left_anti")


def external_targets(links: DataFrame, limit: int = 30, order: str | None = None) -> DataFrame:
    """External targets by the number of links to them: url, linked_from_count, and the first linking page by the column ``order`` (by address without one)."""
    first = F.min("source_url") if order is None else F.min_by("source_url", F.struct(order, "source_url"))
    each = links.where("NOT is_internal").groupBy(F.col("target_url").alias("url")).agg(F.count("*").alias("linked_from_count"), first.alias("example_linking_page"))
    return each.orderBy(F.desc("linked_from_count"), "url").limit(limit)


def broken_external_links(links: DataFrame, link_status: DataFrame, limit: int = 30, order: str | None = None) -> DataFrame:
    """The top external targets whose given status is an error text or 400 and above."""
    code = F.expr("try_cast(status AS int)")
    bad = link_status.where(code.isNull() | (code >= 400)).select("url", "status")
    return external_targets(links, limit, order).join(bad, "url").select("url", "status", "linked_from_count", "example_linking_page")


def template_groups(pages: DataFrame, collation: str = "UNICODE") -> DataFrame:
    """Templates of real pages: fingerprint, page_count, example_url, example_title, sample_urls (5), by size.

    Samples are the first by a locale's order; ``UTF8_BINARY`` gives code-point order.
    """
    real = pages.where(is_real(F.col("status_code")) & (F.coalesce("template_fingerprint", F.lit("")) != ""))
    counts = real.groupBy("template_fingerprint").agg(F.count("*").alias("page_count"))
    place = W.partitionBy("template_fingerprint").orderBy(F.collate(F.col("url"), collation), "url")
    firsts = real.withColumn("r", F.row_number().over(place)).where("r <= 5").groupBy("template_fingerprint").agg(F.array_sort(F.collect_list(F.struct("r", "url", "title"))).alias("s"))
    return counts.join(firsts, "template_fingerprint").select(
        F.col("template_fingerprint").alias("fingerprint"),
        "page_count",
        F.col("s")[0]["url"].alias("example_url"),
        F.coalesce(F.nullif(F.col("s")[0]["title"], F.lit("")), F.lit("(untitled)")).alias("example_title"),
        F.transform("s", lambda x: x["url"]).alias("sample_urls"),
    )


def template_summary(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count("*").alias("unique_template_count"),
        F.count_if(F.col("page_count") >= 2).alias("templates_with_reuse"),
        F.count_if(F.col("page_count") == 1).alias("one_off_count"),
        F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages_analyzed"),
    )


def component_hits(pages: DataFrame) -> DataFrame:
    """(url, signature) from pages with a parsed ``dom``."""
    return pages.select("url", F.explode("dom.components").alias("signature")).distinct()


def components(hits: DataFrame, total_pages: Column) -> DataFrame:
    """Signatures on two pages or more: signature, tag, classes, page_count, page_coverage_pct, example_url."""
    each = hits.groupBy("signature").agg(F.countDistinct("url").alias("page_count"), F.min("url").alias("example_url")).where("page_count >= 2")
    return each.select(
        "signature", F.substring_index("signature", ".", 1).alias("tag"), F.regexp_replace("signature", r"^[^.]*\.?", "").alias("classes"), "page_count",
        percent(F.col("page_count"), total_pages).alias("page_coverage_pct"), "example_url",
    )


def style_inconsistencies(hits: DataFrame, total_pages: Column, least: int = 3) -> DataFrame:
    """Style-sensitive tags with several reusable variants: tag, distinct_style_count, signatures, total_pages_covered."""
    variants = components(hits, total_pages).where(F.col("tag").isin(*sig.STYLE_SENSITIVE) & (F.col("classes") != "")).select("signature", "tag", "page_count")
    met = hits.join(variants, "signature")
    covered = met.groupBy("tag").agg(F.countDistinct("url").alias("total_pages_covered"))
    named = variants.groupBy("tag").agg(F.count("*").alias("distinct_style_count"), F.array_sort(F.collect_list("signature")).alias("signatures"))
    return named.where(F.col("distinct_style_count") >= least).join(covered, "tag").orderBy(F.desc("distinct_style_count"), "tag")


def lang_counts(pages: DataFrame) -> DataFrame:
    return pages.where(is_real(F.col("status_code"))).groupBy("lang").agg(F.count("*").alias("pages"))


def hreflang_links(pages: DataFrame) -> DataFrame:
    """(page_ord, from_page, locale, target_url) of real pages; pages has hreflang structs."""
    real = pages.where(is_real(F.col("status_code")))
    return real.select("page_ord", F.col("url").alias("from_page"), F.explode("hreflang").alias("h")).select("page_ord", "from_page", "h.locale", F.col("h.url").alias("target_url"))


def broken_hreflang(pages: DataFrame, resolve: bool = False) -> DataFrame:
    """Alternate links to addresses that weren't crawled; as written, or resolved on the page."""
    each = hreflang_links(pages)
    if resolve:
        each = each.withColumn("target_url", urls.resolve(F.col("from_page"), F.col("target_url")))
    return each.join(pages.select(F.col("url").alias("target_url")), "target_url", "left_anti").select("page_ord", "from_page", "locale", "target_url")


def broken_hreflang_examples(pages: DataFrame, n: int = 15) -> DataFrame:
    """The first broken alternate links in the order of their pages: page_ord, from_page, locale, target_url."""
    return broken_hreflang(pages).orderBy("page_ord", "locale", "target_url").limit(n)


def document_examples(assets: DataFrame, n: int = 15) -> DataFrame:
    """The first documents that pages link to: page_id, url."""
    return assets.where("asset_type = 'document'").select("page_id", "url").orderBy("page_id", "url").limit(n)


def locale_summary(pages: DataFrame) -> DataFrame:
    real = pages.where(is_real(F.col("status_code")))
    a = real.agg(
        F.countDistinct(F.nullif("lang", F.lit(""))).alias("_langs"), F.count_if(F.coalesce("lang", F.lit("")) == "").alias("pages_without_lang"), F.count_if(F.size("hreflang") > 0).alias("pages_with_hreflang")
    )
    b = hreflang_links(pages).agg(F.countDistinct("locale").alias("_locales"))
    c = broken_hreflang(pages).agg(F.count("*").alias("broken_hreflang_count"))
    return a.crossJoin(b).crossJoin(c).select(((F.col("_langs") > 1) | (F.col("_locales") > 1)).alias("is_multilingual"), "pages_without_lang", "pages_with_hreflang", "broken_hreflang_count")


def image_domains(assets: DataFrame, limit: int | None = 20) -> DataFrame:
    each = assets.where("asset_type = 'image'").groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("images"))
    ranked = each.orderBy(F.desc("images"), "domain")
    return ranked if limit is None else ranked.limit(limit)


def document_types(assets: DataFrame) -> DataFrame:
    return assets.where("asset_type = 'document'").groupBy(urls.extension(F.col("url")).alias("extension")).agg(F.count("*").alias("documents"))


def media_summary(assets: DataFrame) -> DataFrame:
    """Totals, the host with most images, and the images elsewhere."""
    hosts = image_domains(assets, None).agg(
        F.coalesce(F.sum("images"), F.lit(0)).alias("total_images"),
        F.coalesce(F.max("images"), F.lit(0)).alias("_most"),
        F.min_by("domain", F.struct(-F.col("images"), F.col("domain"))).alias("dominant_image_domain"),
        F.count("*").alias("image_domain_count"),
    )
    kinds = assets.agg(F.count_if(F.col("asset_type") == "video").alias("video_embed_count"), F.count_if(F.col("asset_type") == "document").alias("document_total"))
    off = F.col("total_images") - F.col("_most")
    return hosts.crossJoin(kinds).select(
        "total_images", "dominant_image_domain", off.alias("off_dominant_domain_image_count"), percent(off, F.col("total_images")).alias("off_dominant_domain_pct"), F.least("image_domain_count", F.lit(20)).alias("image_domain_count"), "video_embed_count", "document_total"
    )


def page_ages(pages: DataFrame, as_of: Column) -> DataFrame:
    """Real pages with days since their last change, null if unknown."""
    days = half_up((as_of.cast("timestamp").cast("double") - F.col("last_modified").cast("timestamp").cast("double")) / 86400).cast("long")
    return pages.where(is_real(F.col("status_code"))).select("page_ord", "url", days.alias("days"))


def freshness_summary(pages: DataFrame, as_of: Column) -> DataFrame:
    a = page_ages(pages, as_of).agg(F.count("*").alias("n"), F.count("days").alias("known"), F.count_if(F.col("days") > 365).alias("y1"), F.count_if(F.col("days") > 1095).alias("y3"))
    return a.select(
        F.col("known").alias("pages_with_known_date"), (F.col("n") - F.col("known")).alias("pages_with_unknown_date"), percent(F.col("n") - F.col("known"), F.col("n")).alias("unknown_date_pct"),
        F.col("y1").alias("stale_over_1yr_count"), percent(F.col("y1"), F.col("known")).alias("stale_over_1yr_pct"), F.col("y3").alias("stale_over_3yr_count"), percent(F.col("y3"), F.col("known")).alias("stale_over_3yr_pct"),
    )


def stalest_pages(pages: DataFrame, as_of: Column, limit: int = 15) -> DataFrame:
    return page_ages(pages, as_of).where("days IS NOT NULL").orderBy(F.desc("days"), "page_ord").limit(limit)


def address_groups(pages: DataFrame) -> DataFrame:
    """Addresses that differ only in letter case or a final slash of the path: first page_ord, pages, and in which way."""
    p = F.regexp_replace("path", "/$", "")
    each = pages.select("page_ord", "url", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path")).where("host <> ''")
    groups = each.groupBy("host", F.lower(p).alias("key")).agg(
        F.array_sort(F.collect_set("url")).alias("pages"), F.countDistinct("path").alias("paths"), F.countDistinct(p).alias("bare"), F.min("page_ord").alias("page_ord")
    )
    several = groups.where(F.size("pages") > 1)
    return several.select("page_ord", "pages", (F.col("bare") < F.col("paths")).alias("slash_conflict"), (F.col("bare") > 1).alias("case_conflict"))


def parameter_counts(pages: DataFrame) -> DataFrame:
    """page_ord, url, param_count, tracking_params."""
    keys = urls.param_keys(F.col("url"))
    return pages.where(urls.host(F.col("url")) != "").select("page_ord", "url", F.size(keys).alias("param_count"), F.filter(keys, urls.is_tracking).alias("tracking_params"))


#: Examples that summaries list of conflicts, broken links and documents, and of parameters (fixed values).
EXAMPLES, PARAMETER_EXAMPLES, BLOAT = 15, 10, 3


def url_health(pages: DataFrame) -> DataFrame:
    """One row on the addresses: groups in conflict (15 at most of either kind), counts and examples of parameters."""
    groups = address_groups(pages)
    listed = lambda df, value, n, name: df.orderBy("page_ord").limit(n).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_ord", value))), lambda x: x[value]).alias(name))
    params = parameter_counts(pages)
    bloat, tracked = params.where(F.col("param_count") > BLOAT), params.where(F.size("tracking_params") > 0)
    counts = params.agg(F.count_if(F.col("param_count") > BLOAT).alias("param_bloat_count"), F.count_if(F.size("tracking_params") > 0).alias("tracking_param_count"))
    row = listed(groups.where("slash_conflict"), "pages", EXAMPLES, "trailing_slash_inconsistencies").crossJoin(listed(groups.where("case_conflict"), "pages", EXAMPLES, "case_inconsistencies"))
    return row.crossJoin(counts).crossJoin(listed(bloat, "url", PARAMETER_EXAMPLES, "param_bloat_examples")).crossJoin(listed(tracked, "url", PARAMETER_EXAMPLES, "tracking_param_examples"))


def journey_rules(spark: SparkSession, custom=()) -> DataFrame:
    """The journeys' stages in order: journey_id, journey, stage_id, stage, keywords, ord."""
    rows, n = [], 0
    for jid, jname, stages in (*sig.JOURNEYS, *custom):
        for sid, sname, words in stages:
            rows.append((jid, jname, sid, sname, words.split() if isinstance(words, str) else list(words), n))
            n += 1
    return spark.createDataFrame(rows, "journey_id string, journey string, stage_id string, stage string, keywords array<string>, ord int")


def keyword_matcher(rules: dict[str, set[int]]) -> Callable[[str], set[int]]:
    """From keywords, each with the numbers of its rules, a function from a text to the numbers of the rules that it meets.

    One automaton goes over the text once for all keywords, so the cost of a text doesn't grow with the rules.
    """
    always = rules.get("", set())
    words = {k: v for k, v in rules.items() if k}
    try:
        import ahocorasick
    except ImportError:  # one search for each keyword
        return lambda x: always.union(*(v for k, v in words.items() if k in x))
    if not words:
        return lambda x: always
    machine = ahocorasick.Automaton()
    for k, v in words.items():
        machine.add_word(k, v)
    machine.make_automaton()
    return lambda x: always.union(*(v for _, v in machine.iter(x)))


def keyword_hits(texts: DataFrame, rules: dict[str, set[int]]) -> DataFrame:
    """texts (..., hay) to a row for each rule that hay meets, with the rule's number ``ord`` in place of hay."""
    held = [f for f in texts.schema.fields if f.name != "hay"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held), "ord int"])
    names = [f.name for f in held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = keyword_matcher(rules)
        for batch in batches:
            found = [sorted(matcher(x)) for x in batch.column("hay").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            columns = [batch.column(n).take(at) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([o for x in found for o in x], pa.int32())], names=[*names, "ord"])

    return texts.mapInArrow(run, schema)


def journey_stages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """For each stage: present, page_count, example_url and click_depth of the shallowest page.

    ``rules`` is configuration, of thousands of rows at most: it goes to the tasks as one automaton, and only matches leave them.
    """
    words: dict[str, set[int]] = {}
    for r in rules.select("ord", "keywords").collect():
        for k in r["keywords"]:
            words.setdefault(k, set()).add(r["ord"])
    hay = F.lower(F.concat_ws(" ", "url", F.coalesce("title", F.lit(""))))
    each = keyword_hits(pages.where(is_real(F.col("status_code"))).select("page_ord", "url", "depth", hay.alias("hay")), words)
    best = each.groupBy("ord").agg(F.count("*").alias("page_count"), F.min(F.struct("depth", "page_ord", "url")).alias("best"))
    return rules.join(best, "ord", "left").select(
        "ord", "journey_id", "journey", "stage_id", "stage", F.col("best").isNotNull().alias("present"), F.coalesce("page_count", F.lit(0)).alias("page_count"), F.col("best.url").alias("example_url"), F.col("best.depth").alias("click_depth")
    )


def journeys(stages: DataFrame) -> DataFrame:
    """For each journey: stages_present, stages_total and notes on what is missing, deep or complete."""
    by = stages.groupBy("journey_id", "journey").agg(
        F.min("ord").alias("ord"), F.count_if("present").alias("stages_present"), F.count("*").alias("stages_total"),
        F.array_sort(F.collect_list(F.when(~F.col("present"), F.struct("ord", "stage")))).alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("present") & (F.col("click_depth") > 3), F.struct("ord", "stage")))).alias("deep"),
    )
    names = lambda c: F.array_join(F.transform(c, lambda x: x["stage"]), ", ")
    notes = F.array(
        F.when(F.col("stages_present") == 0, "No page matches any stage of this journey.").when(F.size("missing") > 0, F.concat(F.lit("No page matches: "), names("missing"), F.lit("."))),
        F.when(F.size("deep") > 0, F.concat(F.lit("More than three clicks deep: "), names("deep"), F.lit("."))),
        F.when((F.size("missing") == 0) & (F.size("deep") == 0), "Every stage has a page within three clicks."),
    )
    return by.select("ord", "journey_id", "journey", "stages_present", "stages_total", F.filter(notes, lambda x: x.isNotNull()).alias("notes"))


def url_features(pages: DataFrame) -> DataFrame:
    """(page_ord, feature) by patterns on the address."""
    hits = F.array(*(F.when(F.col("url").rlike(p), F.lit(n)) for n, p in sig.URL_FEATURES))
    return pages.select("page_ord", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("feature"))


def feature_matrix(pages: DataFrame) -> DataFrame:
    """The fixed list of features: ord, feature, detected, pages_found_on. pages: page_ord, url, dom.

    Forms and chat scripts count each, everything else once for a page; several languages count all pages.
    """
    d, f = F.col("dom"), F.filter
    purposes = F.transform(F.expr("dom.forms"), lambda x: x["purpose"])
    named = F.create_map(*(F.lit(x) for pair in sig.PURPOSE_FEATURES for x in pair))
    by_form = f(F.transform(purposes, lambda p: named[p]), lambda x: x.isNotNull())
    chats = F.transform(f(d["scripts"], lambda s: F.coalesce(s["src"].rlike("|".join(x.replace(".", r"\.") for x in sig.CHAT_SOURCES)), F.lit(False))), lambda _: F.lit("Live Chat Widget"))
    hints = F.array_join(F.transform(d["forms"], lambda x: x["hints"]), " ")
    single = F.array(
        F.when(hints.rlike(sig.REGISTER) | F.lower("url").rlike(sig.REGISTER), "User Registration / Signup"),
        F.when(d["has_video"], "Video Content"),
        F.when(F.lower(d["body_text"]).rlike(sig.TESTIMONIAL), "Testimonials / Reviews"),
        F.when(F.exists(d["anchors"], lambda a: F.coalesce(a["href"].rlike(r"\.(pdf|doc|docx|xls|xlsx)$"), F.lit(False))), "Downloadable Resources"),
        *(F.when(F.col("url").rlike(p), F.lit(n)) for n, p in sig.URL_FEATURES),
    )
    hits = pages.select(F.explode(F.concat(by_form, chats, f(single, lambda x: x.isNotNull()))).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    locales = pages.agg(F.max(F.size(d["hreflang"]) > 0).alias("any"), F.count("*").alias("pages"))
    fixed = pages.sparkSession.createDataFrame(list(enumerate(sig.FEATURE_ORDER)), "ord int, feature string")
    n = F.when(F.col("feature") == "Multi-language Support", F.when(F.col("any"), F.col("pages")).otherwise(0)).otherwise(F.coalesce("n", F.lit(0)))
    return fixed.join(hits, "feature", "left").crossJoin(F.broadcast(locales)).select("ord", "feature", n.alias("pages_found_on")).select("ord", "feature", (F.col("pages_found_on") > 0).alias("detected"), "pages_found_on")


def tech_stack(pages: DataFrame) -> DataFrame:
    """(kind, name, pages) of platforms and script frameworks; pages: url, html."""
    kinds = [("cms_detected", ds.cms(F.col("html"))), ("js_framework_detected", ds.frameworks(F.col("html")))]
    each = None
    for kind, names in kinds:
        part = pages.select("page_ord", "url", F.lit(kind).alias("kind"), F.explode(names).alias("name"))
        each = part if each is None else each.unionByName(part)
    return each


def alt_coverage(pages: DataFrame) -> DataFrame:
    """Share of images with a text alternative, 100 without images."""
    s = pages.agg(F.sum(ds.images_total(F.col("dom"))).alias("n"), F.sum(ds.images_missing_alt(F.col("dom"))).alias("m"))
    return s.select(F.when(F.coalesce("n", F.lit(0)) > 0, one_place((1 - F.col("m") / F.col("n")) * 100)).otherwise(F.lit(100.0)).alias("image_alt_coverage_pct"), F.coalesce("n", F.lit(0)).alias("images"), F.coalesce("m", F.lit(0)).alias("missing_alt"))
