"""The crawl as a level-by-level search over a static corpus: frontier, seen set, page budget; robots and sitemaps as tables.

``reachable`` searches one site; ``crawl_audits`` searches for any number of audits at once, each with its robots text, depth and budget.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom import scratch
from auditloom.functions import urls
from auditloom.sources.bucketed import BucketedTable

from .ranks import numbered

#: Rows of a counted side up to which it is broadcast.
SMALL = 200_000
#: The error of a page that robots exclude (a fixed text).
BLOCKED = "blocked_by_robots_txt"
STATUSES = ("queued", "crawling", "analyzing", "done", "failed")
PERSONAS = ("ux", "content", "business")


@dataclass
class AuditRequest:
    """A crawl's options; ``check`` raises ValueError with all that is wrong."""

    client_name: str
    start_url: str
    max_pages: int = 500
    max_depth: int = 10
    respect_robots: bool = True
    client_stated_page_count: int | None = None
    max_concurrency: int = 4
    selected_personas: list[str] = field(default_factory=lambda: list(PERSONAS))

    def check(self) -> AuditRequest:
        bad = []
        if not 1 <= len(self.client_name) <= 200:
            bad.append("client_name needs 1 to 200 characters")
        scheme, _, rest = self.start_url.partition("://")
        if not scheme.isalnum() or not rest.strip("/") or any(c.isspace() for c in self.start_url):
            bad.append("start_url is no address")
        for name, value, low, high in (("max_pages", self.max_pages, 1, 20_000), ("max_depth", self.max_depth, 1, 50), ("max_concurrency", self.max_concurrency, 1, 20)):
            if not low <= value <= high:
                bad.append(f"{name} must be from {low} to {high}")
        if self.client_stated_page_count is not None and self.client_stated_page_count <= 0:
            bad.append("client_stated_page_count must be positive")
        if not self.selected_personas or set(self.selected_personas) - set(PERSONAS):
            bad.append(f"selected_personas must be some of {', '.join(PERSONAS)}")
        if bad:
            raise ValueError("; ".join(bad))
        return self


def sitemap_candidates(robots_txt: Column, start_url: Column) -> Column:
    """Addresses of Sitemap lines, else the usual place."""
    lines = F.filter(F.transform(F.split(F.coalesce(robots_txt, F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: F.lower(s).startswith("sitemap:"))
    named = F.filter(F.transform(lines, lambda s: F.trim(F.regexp_replace(s, r"^[^:]*:", ""))), lambda u: u != "")
    return F.when(F.size(named) > 0, named).otherwise(F.array(urls.resolve(start_url, F.lit("/sitemap.xml"))))


def locations(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1)


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex[\s>]")


def sitemap_urls(sitemaps: DataFrame, candidates: DataFrame, root_host: str, most_files: int = 10, most_urls: int | None = 2000) -> DataFrame:
    """Page addresses (url, ord) that the candidate sitemaps name, through one level of indexes.

    sitemaps(url, xml) stands for the web; candidates(url, ord). At most ``most_files`` files are read, in order, and the first
    ``most_urls`` addresses kept; ``None`` keeps all.
    """
    top = candidates.orderBy("ord").limit(most_files).join(sitemaps, "url").select(F.col("ord").alias("i"), F.lit(-1).alias("j"), "url", "xml")
    nested = top.where(is_sitemap_index(F.col("xml"))).select("i", F.posexplode(locations(F.col("xml"))).alias("j", "url")).join(sitemaps, "url").select("i", "j", "url", "xml")
    read = top.unionByName(nested).orderBy("i", "j").limit(most_files)
    each = read.where(~is_sitemap_index(F.col("xml"))).select("i", "j", F.posexplode(locations(F.col("xml"))).alias("k", "url"))
    good = each.where((urls.host(F.col("url")) == root_host) & ~urls.is_non_page(F.col("url")))
    found = good.groupBy("url").agg(F.min(F.struct("i", "j", "k")).alias("ord"))
    return found if most_urls is None else found.orderBy("ord").limit(most_urls)


def reachable(links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int | None = None, robots_txt: str | None = None) -> DataFrame:
    """(url, depth) by breadth-first search over links (source_url, target_url); seeds(url, depth).

    An address keeps the depth at which it is first seen; those that robots or the file type exclude are not queued; with a
    budget the first in address order at the level that exhausts it are taken. Each level is checkpointed.
    """
    edges = links.select(F.col("source_url").alias("from"), F.col("target_url").alias("url")).where(~urls.is_non_page(F.col("target_url"))).distinct()
    if robots_txt:
        edges = edges.where(urls.robots_allow(F.lit(robots_txt), F.col("url")))
    waiting = seeds.groupBy("url").agg(F.min("depth").cast("int").alias("depth"))
    seen = scratch.cut(waiting)
    total = seen.count()
    for depth in range(max_depth):
        frontier = seen.where(F.col("depth") == depth).select(F.col("url").alias("from"))
        new = frontier.join(edges, "from").select("url").distinct().join(seen, "url", "left_anti").select("url", F.lit(depth + 1).alias("depth"))
        if max_pages is not None:
            if total >= max_pages:
                break
            new = new.orderBy("url").limit(max_pages - total)
        new = scratch.cut(new)
        n = new.count()
        if not n and not seen.where(F.col("depth") > depth).limit(1).count():
            break
        total += n
        seen = scratch.cut(seen.unionByName(new))
    return seen


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def robots_rules(robots: DataFrame) -> DataFrame:
    """Path prefixes (audit_id, rule) that the Disallow lines of robots(audit_id, txt) name, of any agent; an empty one excludes nothing."""
    lines = F.filter(F.transform(F.split(F.coalesce("txt", F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: F.lower(s).startswith("disallow:"))
    rules = robots.select("audit_id", F.explode(F.transform(lines, lambda s: F.trim(F.regexp_replace(s, r"^[^:]*:", "")))).alias("rule"))
    return rules.where("rule <> ''").distinct()


def indexed_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules (audit_id, rule), and the lengths that they have for each audit (audit_id, lengths), both written and broadcast if counted to be small."""
    rules = scratch.written(rules, "robots-rules")
    lengths = scratch.written(rules.groupBy("audit_id").agg(F.collect_set(F.length("rule")).alias("lengths")), "rule-lengths")
    return _small(rules), _small(lengths)


def disallowed(addresses: DataFrame, index: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The distinct (audit_id, url) of addresses whose path begins with a rule of their audit; index is that of ``indexed_rules``.

    Rules are looked up by equal prefixes: a path gives one for each length that its audit's rules have, so the cost of an address
    grows with the lengths, not with the rules.
    """
    rules, lengths = index
    paths = addresses.select("audit_id", "url").distinct().join(lengths, "audit_id").withColumn("path", urls.path(F.col("url")))
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    prefixes = paths.select("audit_id", "url", F.explode(F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("rule"))
    return prefixes.join(rules, ["audit_id", "rule"], "left_semi").select("audit_id", "url").distinct()


def granted(new: DataFrame, left: DataFrame, order: list[str]) -> DataFrame:
    """Of new(audit_id, url, ...) the first ``left`` of each audit in the order given; left(audit_id, left).

    Only audits that ask for more than they have left are put in order, and by running counts over a range-partitioned sort: neither
    all audits nor one large one are sorted in one task.
    """
    asked = new.groupBy("audit_id").agg(F.count("*").alias("asked")).join(left, "audit_id")
    short = scratch.written(asked.where(F.col("asked") > F.greatest(F.col("left"), F.lit(0))).select("audit_id", "left"), "short-audits")
    if short.isEmpty():
        return new
    some = _small(short)
    ranked = numbered(new.join(some.select("audit_id"), "audit_id", "left_semi"), ["audit_id"], order, "_place")
    return new.join(some.select("audit_id"), "audit_id", "left_anti").unionByName(ranked.join(some, "audit_id").where(F.col("_place") < F.col("left")).drop("_place", "left"))


def crawl_audits(links: DataFrame, audits: DataFrame, robots: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """(audit_id, url, depth, error) of the pages that each audit's crawl takes, by breadth-first search for all audits at once.

    links(audit_id, source_url, target_url); audits(audit_id, start_url, max_pages, max_depth, respect_robots); robots(audit_id, txt);
    seeds(audit_id, url, ord), addresses that sitemaps name, at depth 1. The start page takes the first place of the budget, then the seeds in
    their order, then each level's new addresses in their own. A page that robots exclude takes its place, with an error, and leads
    nowhere. A null start or address is none; of audits that repeat an id one row counts, that with the smallest options.

    What is seen grows by appending each level to a table in buckets of (audit_id, url); a level writes its new addresses only, and neither
    it nor the next one shuffles what was seen before.
    """
    spark = links.sparkSession
    options = audits.where("audit_id IS NOT NULL AND start_url IS NOT NULL").groupBy("audit_id").agg(F.min(F.struct("start_url", "max_pages", "max_depth", "respect_robots")).alias("o"))
    options = _small(scratch.written(options.select("audit_id", "o.*"), "audits"))
    edges = links.select("audit_id", F.col("source_url").alias("from"), F.col("target_url").alias("url")).where("url IS NOT NULL").where(~urls.is_non_page(F.col("url")))
    edges = scratch.written(edges.join(options.select("audit_id"), "audit_id", "left_semi").distinct(), "crawl-links")
    index = None
    if robots is not None:
        index = indexed_rules(robots_rules(robots.join(options.where("respect_robots").select("audit_id"), "audit_id", "left_semi")))
    table = BucketedTable(spark, "crawl_seen", "audit_id string, url string, depth int, error string", ("audit_id", "url"))
    used = options.select("audit_id", F.lit(0).cast("long").alias("used"))

    def take(new: DataFrame, depth: int, order: list[str]) -> int:
        """Grant, mark and append new addresses; returns how many."""
        nonlocal used
        left = options.join(used, "audit_id").select("audit_id", (F.col("max_pages") - F.col("used")).alias("left"))
        rows = granted(new, left, order).select("audit_id", "url")
        if index is not None:
            blocked = disallowed(rows, index).withColumn("error", F.lit(BLOCKED))
            rows = rows.join(blocked, ["audit_id", "url"], "left")
        else:
            rows = rows.withColumn("error", F.lit(None).cast("string"))
        rows = scratch.written(rows.select("audit_id", "url", F.lit(depth).alias("depth"), "error"), "crawl-level")
        n = rows.count()
        if n:
            table.append(rows)
            counts = rows.groupBy("audit_id").agg(F.count("*").alias("n"))
            used = scratch.written(used.join(counts, "audit_id", "left").select("audit_id", (F.col("used") + F.coalesce("n", F.lit(0))).alias("used")), "crawl-used")
        return n

    def unseen(new: DataFrame) -> DataFrame:
        return new.join(table.read().select("audit_id", "url"), ["audit_id", "url"], "left_anti")

    take(options.select("audit_id", F.col("start_url").alias("url")), 0, ["url"])
    if seeds is not None:
        named = seeds.join(options.select("audit_id"), "audit_id", "left_semi").where("url IS NOT NULL").groupBy("audit_id", "url").agg(F.min("ord").alias("ord"))
        take(scratch.written(unseen(named), "crawl-seeds"), 1, ["ord", "url"])
    deepest = options.agg(F.max("max_depth")).first()[0] or 0
    for depth in range(deepest):
        frontier = table.read().where((F.col("depth") == depth) & F.col("error").isNull()).join(options.where(F.col("max_depth") > depth).select("audit_id"), "audit_id", "left_semi")
        found = frontier.select("audit_id", F.col("url").alias("from")).join(edges, ["audit_id", "from"]).select("audit_id", "url").distinct()
        new = scratch.written(unseen(found), "crawl-found")
        if not take(new, depth + 1, ["url"]) and table.read().where(F.col("depth") > depth).isEmpty():
            break
    return table.close()


def reserve(candidates: DataFrame, remaining: int, order: Column) -> DataFrame:
    """The first ``remaining`` candidates, as a budget grants them."""
    return candidates.orderBy(order).limit(max(0, remaining))


def newly_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct addresses of an audit that weren't seen."""
    return candidates.select("audit_id", "url").distinct().join(seen, ["audit_id", "url"], "left_anti")


def latest_status(log: DataFrame) -> DataFrame:
    """The current status of each audit from a log (audit_id, status, at)."""
    return log.groupBy("audit_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def first_arrivals(pages: DataFrame) -> DataFrame:
    """Pages with unique (audit_id, url): a later row of an address becomes an error row under the address that was asked for."""
    place = F.row_number().over(W.partitionBy("audit_id", "url").orderBy("page_ord"))
    ranked = pages.withColumn("_r", place)
    late = F.col("_r") > 1
    return ranked.withColumns({"error": F.when(late, "duplicate address").otherwise(F.col("error")), "url": F.when(late, F.col("requested_url")).otherwise(F.col("url"))}).drop("_r")


def outstanding(events: DataFrame) -> DataFrame:
    """Per audit: pages queued less pages finished, and whether the crawl is complete. events(audit_id, kind 'queued'/'finished', url)."""
    n = events.select("audit_id", "kind", "url").distinct().groupBy("audit_id").agg((F.count_if(F.col("kind") == "queued") - F.count_if(F.col("kind") == "finished")).alias("outstanding"))
    return n.withColumn("complete", F.col("outstanding") <= 0)


def empty_corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "url string, depth int")
