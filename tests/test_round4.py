"""Tests of what the third round's findings were about."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from auditloom.functions import html as markup
from auditloom.plans import catalog

SF = "/root/testdata/sf0.001"


def test_long_pages_are_parsed_once(spark):
    """Links and word counts come from the same parse, which makes and sends back nothing else."""
    plan = catalog.QUERIES["long_pages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "visible_text" not in plan


def test_named_fields_are_those_of_all():
    text = "<title> a  b </title><h1> c </h1><a href=x>l</a><p>one two</p>three<form class=search><input name=q></form>"
    whole = markup.extract_page(text)
    assert set(whole) == set(markup.FIELDS) and whole["word_count"] == 5
    for name in markup.FIELDS:
        assert markup.extract_page(text, fields=(name,)) == {name: whole[name]}


def test_words_are_counted_as_split_counts_them():
    rng = random.Random(5)
    for n in range(200):
        text = "".join(rng.choices("ab \t\n\x0b\x1c\x85\xa0\u1680\u2003\u2028\u3000\u3001\U0001f600\ud800", k=n))
        assert markup.count_words(text) == len(text.split())


def settled(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(settled, v))
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query has the rows of its SQL on pages made by a function from the fixture's."""

    def check(name, made):
        made(spark.read.parquet(f"{SF}/pages.parquet")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
        got = catalog.QUERIES[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(repr, map(settled, got.collect()))) == sorted(map(repr, map(settled, want)))
        return want

    return check


def many_addresses(pages):
    """Ninety times as many pages, all addresses apart and on the start's host."""
    at = F.col("page_id") * 90 + F.col("k")
    return pages.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(89)))).select(at.alias("page_id"), F.concat(F.lit("https://h.example/p"), at.cast("string")).alias("url"), "html")


def test_sitemaps_of_more_than_two_thousand_addresses(agrees):
    assert len(agrees("sitemap_seeds", many_addresses)) > 2000


def shared_addresses(pages):
    """Every third page has the address of the page before it."""
    before = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("_before")).where("page_id % 3 = 0")
    return pages.join(before, "page_id", "left").select("page_id", F.coalesce("_before", "url").alias("url"), "html")


def test_technologies_are_counted_by_page(agrees):
    assert agrees("tech_signatures", shared_addresses)


def test_accessibility_findings_count_pages(agrees):
    assert agrees("accessibility_from_markup", shared_addresses)


def cut_titles(pages):
    """Titles and headings that end in references cut short, and one that has others inside."""
    bad = F.when(F.col("page_id") % 2 == 0, F.lit("a&amp&lt;b &eacute; x&y&amp")).otherwise(F.lit("c &copy; d&quo"))
    html = F.regexp_replace("html", "(?s)<title>.*?</title>", F.concat(F.lit("<title>"), bad, F.lit("</title>")))
    return pages.withColumn("html", F.regexp_replace(html, "(?s)<h1>.*?</h1>", F.concat(F.lit("<h1>"), bad, F.lit("</h1>")))).select("page_id", "url", "html")


def test_references_that_are_cut_short_are_text_to_the_fixtures(agrees):
    assert {r[1] for r in agrees("parsed_fields", cut_titles)} == {"a&amp<b &eacute; x&y&amp", "c © d&quo"}
    assert markup.extract_page("<title>a&amp</title>")["title"] == "a&"


def test_links_are_rows_of_each_page_of_their_address(agrees):
    assert agrees("extracted_rows", shared_addresses)


def test_inventory_counts_each_link_of_an_address_once(agrees):
    assert agrees("page_inventory", lambda pages: shared_addresses(cut_titles(pages)))
