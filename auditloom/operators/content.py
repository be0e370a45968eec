"""Keywords, phrases, duplicates and third-party scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom import scratch
from auditloom.functions import signatures as sig
from auditloom.functions import text
from auditloom.functions.numbers import share3

from . import near_duplicates


def top_keywords(pages: DataFrame, limit: int = 20) -> DataFrame:
    """Words by occurrences: keyword, occurrences, pages_found_on, pct_of_pages; ties by the first page and place seen.

    pages: url, text, page_ord.
    """
    # stopwords go after the explode, in generated code; places keep their order
    each = pages.select("url", "page_ord", F.posexplode(text.words(F.col("text"))).alias("pos", "keyword")).where(~F.col("keyword").isin(*text.STOPWORDS))
    # one row for each word and page first, so that a word on all pages is counted in parts
    by_page = each.groupBy("keyword", "url").agg(F.count("*").alias("n"), F.min(F.struct("page_ord", "pos")).alias("first"))
    counts = by_page.groupBy("keyword").agg(F.sum("n").alias("occurrences"), F.count("*").alias("pages_found_on"), F.min("first").alias("first"))
    total = pages.agg(F.greatest(F.countDistinct("url"), F.lit(1)).alias("total"))
    top = counts.orderBy(F.desc("occurrences"), "first").limit(limit)
    return top.crossJoin(F.broadcast(total)).select("keyword", "occurrences", "pages_found_on", share3(F.col("pages_found_on"), F.col("total")).alias("pct_of_pages"), "first")


def top_phrases(pages: DataFrame, limit: int = 20) -> DataFrame:
    """Pairs of neighbouring keywords by occurrences: phrase, occurrences."""
    words = text.keywords(F.col("text"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    each = pages.select("page_ord", words.alias("w")).select("page_ord", F.posexplode(pairs).alias("pos", "phrase"))
    counts = each.groupBy("phrase").agg(F.count("*").alias("occurrences"), F.min(F.struct("page_ord", "pos")).alias("first"))
    return counts.orderBy(F.desc("occurrences"), "first").limit(limit)


def zipped(left: DataFrame, right: DataFrame, order_left: list[Column], order_right: list[Column]) -> DataFrame:
    """Two short ranked lists side by side, by place; rank is the place. Both are of bounded length (top-k reports)."""
    a = left.withColumn("rank", F.row_number().over(W.orderBy(*order_left)))
    b = right.withColumn("rank", F.row_number().over(W.orderBy(*order_right)))
    return a.join(b, "rank", "full")


def near_duplicate_pairs(pages: DataFrame, key: str, threshold: float = 0.75, k: int = 8) -> DataFrame:
    """Pairs (a, b, jaccard) of keys, a < b, whose word shingles have at least this Jaccard similarity.

    Texts with equal sets of shingles meet in a chain at 1, as one class; its first one stands for it in all other pairs.
    """
    return near_duplicates.pairs(pages, key, threshold, k)


def unlike_pairs(pairs: DataFrame) -> DataFrame:
    """All pairs under 1 from those of near_duplicate_pairs, also those of the members of a class for which its first one stands."""
    pairs = scratch.written(pairs, "pairs")
    members = pairs.where("jaccard = 1").select(F.col("a").alias("first"), F.col("b").alias("member"))
    out = pairs.where("jaccard < 1")
    for side in ("a", "b"):
        other = out.join(members, F.col(side) == F.col("first")).drop(side, "first").withColumnRenamed("member", side)
        out = out.unionByName(other)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")


def near_duplicate_clusters(pages: DataFrame, key: str, threshold: float = 0.75, k: int = 8, max_pages: int | None = 300) -> DataFrame:
    """(id, cluster) of pages in clusters of more than one; none if there are more than max_pages, unless that is None."""
    if max_pages is not None and pages.limit(max_pages + 1).count() > max_pages:
        pages = pages.where(F.lit(False))
    return near_duplicates.forest(pages, key, threshold, k)[0].select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def duplicate_of(pages: DataFrame) -> DataFrame:
    """url, duplicate_of: the first url with the same text for later pages; empty texts are no duplicates."""
    firsts = pages.where("text <> ''").groupBy(F.sha2("text", 256).alias("h")).agg(F.min_by("url", "page_ord").alias("first_url"))
    met = pages.select("page_ord", "url", F.when(F.col("text") != "", F.sha2("text", 256)).alias("h")).join(firsts, "h", "left")
    return met.select("page_ord", "url", F.when(F.col("first_url") != F.col("url"), F.col("first_url")).alias("duplicate_of"))


def text_hash(x: Column) -> Column:
    """The 32-bit rolling hash of a text, as a string."""
    return F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), x).cast("string")


def integration_of(host: Column) -> Column:
    """struct(name, category) of a known third party, null if unknown."""
    found = None
    for pieces, name, category in sig.INTEGRATIONS:
        hit = host.contains(pieces[0])
        for p in pieces[1:]:
            hit = hit | host.contains(p)
        made = F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"))
        found = F.when(hit, made) if found is None else found.when(hit, made)
    return found


def integrations(references: DataFrame, total_pages: Column) -> tuple[DataFrame, DataFrame]:
    """Of script references (url, host): the known ones by pages, the others by references."""
    each = references.select("url", "host", integration_of(F.col("host")).alias("i"))
    known = each.where("i IS NOT NULL").groupBy(F.col("i.name").alias("name"), F.col("i.category").alias("category")).agg(F.countDistinct("url").alias("pages_found_on"))
    other = each.where("i IS NULL").groupBy(F.col("host").alias("domain")).agg(F.count("*").alias("references"))
    return known.withColumn("pct_of_pages", share3(F.col("pages_found_on"), total_pages)).orderBy(F.desc("pages_found_on"), "name"), other.orderBy(F.desc("references"), "domain")
