"""Signals of a page from the struct that ``html.dom`` makes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import signatures as sig
from . import urls


def images_total(d: Column) -> Column:
    return F.size(d["images"])


def images_missing_alt(d: Column) -> Column:
    return F.size(F.filter(d["images"], lambda i: F.coalesce(F.trim(i["alt"]), F.lit("")) == ""))


def has_structured_data(d: Column) -> Column:
    return (F.size(d["json_ld"]) > 0) | d["itemscope"]


def script_count(d: Column) -> Column:
    return F.size(d["scripts"])


def external_script_hosts(d: Column, root_host: Column) -> Column:
    """Hosts of scripts from elsewhere, repeats kept."""
    base = F.concat(F.lit("https://"), root_host, F.lit("/"))
    hosts = F.transform(F.filter(d["scripts"], lambda s: F.coalesce(s["src"], F.lit("")) != ""), lambda s: urls.host(urls.resolve(base, s["src"])))
    return F.filter(hosts, lambda h: (h != "") & (h != root_host))


def meta_completeness(d: Column) -> Column:
    has = lambda key, value: F.exists(d["metas"], lambda m: m[key] == value)
    title, text, image = (has("property", f"og:{x}") for x in ("title", "description", "image"))
    return F.struct(
        F.coalesce(title, F.lit(False)).alias("has_og_title"),
        F.coalesce(text, F.lit(False)).alias("has_og_description"),
        F.coalesce(image, F.lit(False)).alias("has_og_image"),
        F.coalesce(has("name", "twitter:card"), F.lit(False)).alias("has_twitter_card"),
        F.coalesce(title & text & image, F.lit(False)).alias("og_complete"),
    )


def schema_types(d: Column) -> Column:
    """Types of interest that the page's JSON-LD declares at its top level; malformed blocks count for nothing."""
    one, many = "struct<`@type`:string>", "array<struct<`@type`:string>>"

    def types(raw: Column) -> Column:
        as_list = F.when(F.trim(raw).startswith("["), F.from_json(raw, many)).otherwise(F.array(F.from_json(raw, one)))
        return F.flatten(
            F.transform(
                F.coalesce(as_list, F.array().cast(many)),
                lambda x: F.when(F.coalesce(x["@type"], F.lit("")).startswith("["), F.from_json(x["@type"], "array<string>")).otherwise(F.array(x["@type"])),
            )
        )

    known = F.array(*map(F.lit, sig.SCHEMA_TYPES))
    found = F.filter(F.flatten(F.transform(d["json_ld"], types)), lambda t: F.coalesce(F.array_contains(known, t), F.lit(False)))
    return F.array_distinct(found)


def hreflang(d: Column, url: Column) -> Column:
    """Alternate-language links with their addresses resolved on the page, as written where that can't be done."""
    return F.transform(d["hreflang"], lambda h: F.struct(h["locale"].alias("locale"), F.coalesce(urls.resolve(url, h["url"]), h["url"]).alias("url")))


def cms(html: Column) -> Column:
    hits = F.array(*(F.when(html.rlike(p), F.lit(n)) for n, p in sig.CMS), F.when(html.rlike(sig.GENERATOR), F.regexp_extract(html, sig.GENERATOR, 1)))
    return F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))


def frameworks(html: Column) -> Column:
    return F.filter(F.array(*(F.when(html.rlike(p), F.lit(n)) for n, p in sig.FRAMEWORKS)), lambda x: x.isNotNull())


def mixed_content(d: Column, url: Column) -> Column:
    return url.startswith("https://") & F.exists(d["resources"], lambda r: r.startswith("http://"))


def pii_form_without_privacy_link(d: Column) -> Column:
    personal = F.exists(d["forms"], lambda f: F.exists(f["inputs"], lambda i: i["type"].isin("email", "tel", "password") | i["name"].rlike(r"ssn|aadhaar|passport|pan\b|national.?id")))
    linked = F.exists(d["anchors"], lambda a: F.lower(a["text"]).contains("privacy") | F.coalesce(F.lower(a["href"]).contains("privacy"), F.lit(False)))
    return personal & ~linked


def documents(d: Column, url: Column) -> Column:
    linked = F.filter(d["anchors"], lambda a: F.coalesce(a["href"].rlike(sig.DOCUMENT_LINK), F.lit(False)))
    return F.transform(linked, lambda a: urls.resolve(url, a["href"]))


def links(d: Column, url: Column) -> Column:
    """Distinct resolved links of a page but for mail, phone, script and file addresses: url, is_internal."""
    usable = F.filter(d["anchors"], lambda a: (F.coalesce(a["href"], F.lit("")) != "") & ~a["href"].rlike("^(mailto|tel|javascript):"))
    full = F.array_distinct(F.transform(usable, lambda a: urls.resolve(url, a["href"])))
    pages = F.filter(full, lambda u: ~u.rlike(urls.NON_PAGE_PATTERN) & (urls.host(u) != ""))
    return F.transform(pages, lambda u: F.struct(u.alias("url"), urls.same_site(urls.host(u), urls.host(url)).alias("is_internal")))
