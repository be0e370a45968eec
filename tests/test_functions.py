import csv
import io
import math
import random
import time
from urllib.parse import urljoin

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.functions import numbers, text, urls
from auditloom.functions.html import extract_page, parse


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("x", "expected"), [(0.5, 1), (1.5, 2), (2.5, 3), (-2.5, -2), (-0.5, 0), (2.4, 2)])
def test_halves_go_up(spark, x, expected):
    assert one(spark, numbers.half_up(F.lit(x))) == expected


def test_scores(spark):
    assert one(spark, numbers.pct_score(F.lit(0), F.lit(10))) == 100.0
    assert one(spark, numbers.pct_score(F.lit(3), F.lit(0))) == 100.0
    assert one(spark, numbers.pct_score(F.lit(15), F.lit(10))) == -50.0
    assert one(spark, numbers.percent(F.lit(1), F.lit(3))) == 33.3


@pytest.mark.parametrize(
    ("url", "host", "depth"),
    [
        ("HTTPS://User:pw@Example.COM:443/a//b/?x#y", "example.com", 2),
        ("http://h:8080", "h:8080", 0),
        ("http://h:80/x", "h", 1),
        ("not a url", "", 0),
        ("", "", 0),
        ("  https://é.example/ü/ß", "é.example", 2),
        ("mailto:a@b", "", 0),
    ],
)
def test_hosts_and_depth(spark, url, host, depth):
    assert one(spark, urls.host(F.lit(url))) == host
    assert one(spark, urls.path_depth(F.lit(url))) == depth


@pytest.mark.parametrize(
    ("href", "full"),
    [("/x", "https://a.b/x"), ("y", "https://a.b/d/y"), ("//c.d/z", "https://c.d/z"), ("http://q/", "http://q/"), ("#t", "https://a.b/d/e?f#t")],
)
def test_resolve(spark, href, full):
    assert one(spark, urls.resolve(F.lit("https://a.b/d/e?f"), F.lit(href))) == full


_BASES = ("https://h.example/a/b/c.html", "https://h.example/a/b/c.html?q=2#f", "http://h.example/", "http://h.example:8080/x/", "https://u@h.example/d/e")
_LINKS = ("../x", "./y", ".", "..", "../", "../../../z", "/r/../s", "/r/./s/..", "?q=1", "#t", "x/y/../z?a=../b#c", "//other.example/p", "http://q/r", "mailto:a@b", "g;x=1/../y", "/", "a b", "/..", "...", "/.hidden/..x", "x?y#z?w", "javascript:void(0)")


def test_resolve_as_urllib_does(spark):
    df = spark.createDataFrame([(b, h) for b in _BASES for h in _LINKS], "b string, h string")
    for r in df.select("b", "h", urls.resolve(F.col("b"), F.col("h")).alias("u")).collect():
        assert r["u"] == urljoin(r["b"], r["h"]), (r["b"], r["h"])


@pytest.mark.parametrize(
    ("base", "href", "full"),
    [
        ("https://h.e/a/b?q#f", "", "https://h.e/a/b?q"), ("https://h.e/a", "//Other.E/P", "https://other.e/P"), ("https://h.e/a", "HTTP://U.x", "http://u.x/"), ("https://h.e/a", "HTTPS://u.x:443/", "https://u.x/"), ("http://H.E:80/a/b", "c", "http://h.e/a/c"),
        ("https://h.e/a/b", "%2E%2e/c", "https://h.e/c"), ("https://h.e/a/b", "\\\\w.x\\y", "https://w.x/y"), ("https://h.e/a/b", " \tc\nd ", "https://h.e/a/cd"), ("https://h.e", "?q", "https://h.e/?q"), ("https://h.e/d/e", "https:rel", "https://h.e/d/rel"), ("http://h.e/d", "https:rel", "https://rel/"),
        ("nowhere", "x", None), ("nowhere", "http://q/a/../b", "http://q/b"), (None, "x", None), ("https://h.e/", None, None), ("https://h.e/a", "http://", None),
    ],
)
def test_resolve_as_browsers_do(spark, base, href, full):
    assert one(spark, urls.resolve(F.lit(base).cast("string"), F.lit(href).cast("string"))) == full


def test_www_is_the_same_site(spark):
    assert one(spark, urls.same_site(F.lit("www.a.b"), F.lit("a.b")))
    assert not one(spark, urls.same_site(F.lit("x.a.b"), F.lit("a.b")))


@pytest.mark.parametrize(("url", "file"), [("http://a/x.PDF", True), ("http://a/x.pdf?y", True), ("http://a/?f=x.pdf", False), ("http://a/pdf", False), ("x.pdf", False)])
def test_files_are_no_pages(spark, url, file):
    assert one(spark, urls.is_non_page(F.lit(url))) == file


def test_robots(spark):
    rules = F.lit("User-agent: *\n Disallow: /a\nDISALLOW:/b:c\nDisallow:\n")
    for path, ok in (("/a", False), ("/ab", False), ("/b:c/d", False), ("/b", True), ("/", True)):
        assert one(spark, urls.robots_allow(rules, F.lit("http://h" + path))) == ok
    assert one(spark, urls.robots_allow(F.lit(None).cast("string"), F.lit("http://h/a")))


def test_tracking_parameters(spark):
    keys = urls.param_keys(F.lit("http://a/?utm_x=1&gclid&b=%zz&c=1=2&&UTM_y=2#?d=3"))
    assert one(spark, keys) == ["utm_x", "gclid", "b", "c", "UTM_y"]
    assert one(spark, F.filter(keys, urls.is_tracking)) == ["utm_x", "gclid"]


def plain_flesch(s):
    import re

    words = re.findall(r"[a-zA-Z']+", s)
    if len(words) < 20:
        return None
    sentences = max(1, sum(1 for x in re.split(r"[.!?]+", s) if x.strip()))

    def sounds(w):
        w = re.sub("[^a-z]", "", w.lower())
        if not w:
            return 0
        n = len(re.findall("[aeiouy]+", w)) or 1
        return max(1, n - 1 if w.endswith("e") and n > 1 else n)

    score = 206.835 - 1.015 * (len(words) / sentences) - 84.6 * (sum(map(sounds, words)) / len(words))
    return math.floor(score * 10 + 0.5) / 10


@pytest.mark.parametrize("s", ["One two three.", "The quick brown fox jumps over the lazy dog. " * 3, "a'b ''' " * 15 + "!?", "strengths the be " * 9 + ". . ."])
def test_flesch(spark, s):
    assert one(spark, text.flesch(F.lit(s))) == plain_flesch(s)


def test_shingles(spark):
    words = F.split(F.lit("a b a b a"), " ")
    assert one(spark, text.shingles(words, 2)) == ["a b", "b a"]
    assert one(spark, text.shingles(words, 6)) == []


def test_dates(spark):
    for s in ("Mon, 01 Jan 2024 10:00:00 GMT", "2024-01-01T10:00:00Z"):
        assert one(spark, F.date_format(text.last_modified_ts(F.lit(s)), "yyyy-MM-dd HH:mm")) == "2024-01-01 10:00"
    assert one(spark, text.last_modified_ts(F.lit("yesterday"))) is None


def test_csv_fields_round_trip(spark):
    fields = ["plain", 'say "x"', "a,b", "line\nbreak", "", "ünï"]
    line = ",".join(r["x"] for r in spark.createDataFrame([(f,) for f in fields], "f string").select(text.csv_field(F.col("f")).alias("x")).collect())
    assert next(csv.reader(io.StringIO(line))) == fields


def test_visible_text_separates_blocks(spark):
    html = "<html><head><title>T</title></head><body><h1>Welcome</h1><p>Credit<b>card</b></p><script>x('</p>')</script><!-- no --><br>a&amp;amp;b</body></html>"
    assert one(spark, text.visible_text(F.lit(html))) == "Welcome Creditcard a&amp;b"
    assert extract_page(html)["visible_text"] == "Welcome Creditcard a&amp;b"


def shape(html):
    def show(n):
        return n if isinstance(n, str) else f"{n.tag}[{','.join(show(c) for c in n.children)}]"

    return ",".join(show(c) for c in parse(html).body.children)


@pytest.mark.parametrize(
    ("html", "tree"),
    [
        ("<p>a<p>b", "p[a],p[b]"),
        ("<ul><li>a<li>b</ul>c", "ul[li[a],li[b]],c"),
        ("<p><b>x<p>y", "p[b[x]],p[b[y]]"),
        ("<b>x<i>y</b>z</i>", "b[x,i[y]],i[z]"),
        ("<div></span>a</div>", "div[a]"),
        ("a</p>b", "a,p[],b"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "table[tr[td[1],td[2]],tr[td[3]]]"),
        ("x<br>y<img src=a>z", "x,br[],y,img[],z"),
        ("<script>a<b</script>t", "t"),
    ],
)
def test_tree(html, tree):
    assert shape(html) == tree


def test_page_fields():
    html = """<html lang=en><head><title> A &amp; B </title><meta name=description content=d><link rel=canonical href=/c>
    <link rel=alternate hreflang=de href=/de><meta property=og:title content=x><script type=application/ld+json>{"@type":"Article"}</script></head>
    <body><h1> H </h1><img src=a alt=" "><img src=b alt=x><img><form action=/search><input name=q></form>
    <form class=newsletter><input type=EMAIL></form><form><input type=password></form><form id=contact><textarea></textarea></form><form><input type=tel></form><form><select></select></form>
    <a href=/x.pdf>Doc</a><div role=dialog></div><button aria-expanded=false></button><div itemscope></div></body></html>"""
    p = extract_page(html)
    assert (p["title"], p["meta_description"], p["canonical"], p["h1_text"], p["lang"]) == ("A & B", "d", "/c", "H", "en")
    assert p["hreflang"] == [{"locale": "de", "url": "/de"}] and p["itemscope"]
    assert [f["purpose"] for f in p["forms"]] == ["search", "newsletter", "login", "contact", "lead-gen", "other"]
    assert p["interactions"] == ["modal", "accordion"] and p["json_ld"] == ['{"@type":"Article"}']
    empty = extract_page(None)
    assert empty["title"] is None and empty["skeleton"] == "" and empty["word_count"] == 0


def test_skeleton_folds_repeats():
    assert extract_page("<ul><li>a<li>b<li>c</ul>")["skeleton"] == extract_page("<ul><li>a<li>b</ul>")["skeleton"]
    assert extract_page("<ul><li>a</ul>")["skeleton"] != extract_page("<ul><li>a<li>b</ul>")["skeleton"]
    assert extract_page('<p class="b a d c">x')["skeleton"] == "p.a.b.c()"


@given(st.text(alphabet="<>/abp \"'=&;!-", max_size=60))
def test_any_markup_parses(s):
    extract_page(s)


def test_syllables_of_whole_texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeiouybcdxe") for _ in range(rng.randrange(1, 9))) for _ in range(400)] + ["the", "tree", "eye", "queue", "cycle", "e", "rhythm", "bee", "ae", "axe"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))),) for _ in range(200)]
    df = spark.createDataFrame(rows, "t string")
    each = F.aggregate(F.split("t", " "), F.lit(0), lambda a, w: a + text.syllables(w))
    assert df.select(each.alias("a"), text.syllables_of(F.col("t")).alias("b")).where("a <> b").count() == 0
    began = time.time()
    long = spark.createDataFrame([("x" * 200_000,), ("ab" * 100_000 + "e",), (" " * 200_000,), ("a" * 200_000 + "'",)], "t string")
    assert long.select(text.flesch(F.col("t"))).count() == 4 and long.agg(F.sum(text.syllables_of(F.col("t")))).first()[0] == 1 + 100_000 + 0 + 1
    assert time.time() - began < 30
