"""Page corpora: tables of crawled pages, links and assets, and the columns that fixtures lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import text, urls
from auditloom.operators.ranks import numbered

AUDIT = "fixture"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def of_audit(df: DataFrame, audit_id: str) -> DataFrame:
    """Rows of one audit; the filter reaches the scan."""
    return df.where(F.col("audit_id") == audit_id)


def keyset_page(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The n rows that follow a key, in its order."""
    rows = df if after is None else df.where(F.col(key) > after)
    return rows.orderBy(key).limit(n)


def keyset_pages(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    """df with ``page``, the number of the page of n rows that each row falls into in the key's order, for all pages at once.

    A filter on df reaches the scan. Ranges of the key are read, sorted and numbered by tasks of their own; null keys come first.
    """
    return numbered(df.withColumn("_all", F.lit(0)), ["_all"], [key], "_place").withColumn("page", F.floor(F.col("_place") / n)).drop("_all", "_place")


def assets_of(assets: DataFrame, pages: DataFrame) -> DataFrame:
    """Assets whose page is in pages, each once."""
    return assets.join(pages.select("page_id"), "page_id", "left_semi")


def newest(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    rows = df.orderBy(F.desc(column), *(c for c in df.columns if c != column))
    return rows if n is None else rows.limit(n)


def fixture_pages(spark: SparkSession, folder: str, markup: bool = False) -> DataFrame:
    """The pages table as a crawl result; status, error, depth, timing and dates follow from page_id and url.

    ``markup`` keeps the html column. Titles, headings, languages and visible text come from regular expressions, which the
    fixtures' markup allows; ``functions.html`` parses any markup.
    """
    raw = table(spark, folder, "pages")
    seen = text.visible_text(F.col("html"))
    found = raw.select(
        F.lit(AUDIT).alias("audit_id"),
        F.col("page_id").alias("page_ord"),
        "page_id",
        "url",
        *(["html"] if markup else []),
        F.when(F.col("page_id") % 17 == 0, 404).otherwise(200).alias("status_code"),
        F.when(F.col("page_id") % 29 == 0, "timeout").alias("error"),
        urls.path_depth(F.col("url")).alias("depth"),
        (100 + F.col("page_id") % 400).cast("double").alias("response_time_ms"),
        (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(F.col("page_id") * 7)).alias("last_modified"),
        text.unescaped(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"),
        F.trim(text.unescaped(F.regexp_extract("html", r"(?is)<h1>(.*?)</h1>", 1))).alias("h1_text"),
        F.nullif(F.regexp_extract("html", r'(?is)<html[^>]*\slang="([^"]*)"', 1), F.lit("")).alias("lang"),
        seen.alias("text"),
    )
    return found.withColumn("word_count", F.size(F.filter(F.split("text", " "), lambda w: w != "")))


def fixture_links(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct links of each page: source_url, target_url, is_internal."""
    raw = table(spark, folder, "pages")
    hrefs = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'), 1)
    each = raw.select("url", F.explode(F.array_distinct(hrefs)).alias("href")).where(~F.col("href").rlike("^(mailto|tel|javascript):") & (F.col("href") != ""))
    full = each.select(F.col("url").alias("source_url"), urls.resolve(F.col("url"), text.unescaped(F.col("href"))).alias("target_url")).distinct()
    return full.where(~F.col("target_url").rlike(urls.NON_PAGE_PATTERN)).withColumn("is_internal", urls.same_site(urls.host(F.col("target_url")), urls.host(F.col("source_url"))))


def with_error_defaults(rendered: DataFrame, queued: DataFrame) -> DataFrame:
    """A row for every queued address: what was rendered, or an error row with defaults where nothing was, or where nothing came back."""
    met = queued.select("url", F.col("depth").alias("_depth")).join(rendered, "url", "left")
    empty = F.col("status_code").isNull() & (F.coalesce("title", F.lit("")) == "") & (F.coalesce("word_count", F.lit(0)) == 0)
    error = F.when(empty & F.col("error").isNull(), F.concat(F.lit("Empty result for "), "url")).otherwise(F.substring("error", 1, 2000))
    return met.withColumns({"error": error, "word_count": F.coalesce("word_count", F.lit(0)), "depth": F.coalesce("depth", "_depth")}).drop("_depth")


#: Characters that are kept of a page's columns (fixed values).
STORED = {"html": 200_000, "url": 2000, "title": 500, "h1_text": 500, "canonical": 2000, "error": 2000}


def stored(pages: DataFrame) -> DataFrame:
    """Pages as they are stored: texts cut to the lengths that are kept."""
    return pages.withColumns({c: F.substring(c, 1, n) for c, n in STORED.items() if c in pages.columns})


def is_real(status: Column) -> Column:
    """A page that answered without an error status."""
    return F.coalesce(status < 400, F.lit(False))
