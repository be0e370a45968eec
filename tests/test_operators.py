import json
import os
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from auditloom import scratch
from auditloom.functions import dom_signals as ds
from auditloom.functions import html as markup
from auditloom.functions import urls
from auditloom.operators import audit, components, content, crawl, findings, scoring, site
from auditloom.sources import corpus, sinks

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_components_on_a_chain(spark):
    n = 40
    edges = [(i, i + 1) for i in range(n)] + [(100, 101), (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_a_hub(spark):
    edges = [(1, i) for i in range(2, 3000)] + [(2999 + i, 5000) for i in range(500)] + [(5000, 9000), (-5, 1)]
    for hub in (10, 10**6):
        got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), hub=hub).collect()}
        assert set(got.values()) == {-5} and len(got) == len({x for e in edges for x in e})


def test_scratch_tables(spark, monkeypatch):
    before = scratch.mark()
    a, b = scratch.written(spark.range(3), "one"), scratch.written(spark.range(4), "two")
    assert scratch.release(spark, before, keep=b) == 1 and b.count() == 4 and scratch.mark() == before + 1
    with pytest.raises(Exception):
        a.count()
    assert scratch.release(spark, before) == 1


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())


def test_a_missing_dependency_leaves_the_audit_queries():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'keywords' in q, any(n.startswith('op1_') for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.split()[1:] == ["True", "False"], out.stderr


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "https://s.example/", '<html lang="en"><title>Home</title><body><h1>Hi</h1><a href="/a">a</a><img src="http://x/i.png"><script src="https://js.example.net/x.js"></script><p>' + "word " * 30),
        (2, "https://s.example/a", "<title>Home</title><body><a href='/'>up</a><form><input type=email></form>" + "<p>alpha beta gamma delta epsilon zeta eta theta iota kappa</p>"),
        (3, "https://s.example/b/", "<html lang='de'><title></title><body><link rel=alternate hreflang=fr href=/fr>" + "<p>alpha beta gamma delta epsilon zeta eta theta iota kappa</p>"),
        (4, "https://dev.s.example/B", None),
    ]
    p = spark.createDataFrame(rows, "page_ord long, url string, html string").withColumn("dom", markup.dom(F.col("html")))
    return p.select(
        "*", F.col("page_ord").alias("page_id"), F.when(F.col("page_ord") == 4, 500).otherwise(200).alias("status_code"), F.when(F.col("page_ord") == 4, "boom").alias("error"), urls.path_depth(F.col("url")).alias("depth"),
        F.lit(10.0).alias("response_time_ms"), F.when(F.col("page_ord") < 3, F.lit("2020-01-01").cast("timestamp")).alias("last_modified"),
        *(F.col(f"dom.{c}").alias(c) for c in ("title", "meta_description", "h1_text", "canonical", "lang", "hreflang", "word_count")),
        F.col("dom.visible_text").alias("text"), F.lit(False).alias("is_client_rendered"), markup.fingerprint(F.col("dom")).alias("template_fingerprint"),
        F.when(F.col("page_ord") < 3, F.expr("array(named_struct('id', 'image-alt', 'impact', 'serious', 'description', 'Images need alt', 'nodesCount', 1))")).alias("accessibility_violations"),
    ).cache()


def test_links_and_assets(pages):
    links = sinks.link_rows(pages)
    assert {(r["source_url"], r["target_url"], r["is_internal"]) for r in links.collect()} == {("https://s.example/", "https://s.example/a", True), ("https://s.example/a", "https://s.example/", True)}
    assert [(r["asset_type"], r["url"], r["domain"]) for r in sinks.asset_rows(pages).collect()] == [("image", "http://x/i.png", "x")]
    orphans = site.orphan_pages(pages, links.withColumnRenamed("page_id", "p"), "https://s.example/").select("url").collect()
    assert [r["url"] for r in orphans] == ["https://s.example/b/"]


def test_signals(pages):
    r = {x["page_ord"]: x for x in pages.select("page_ord", ds.mixed_content(F.col("dom"), F.col("url")).alias("mixed"), ds.pii_form_without_privacy_link(F.col("dom")).alias("pii"), ds.external_script_hosts(F.col("dom"), F.lit("s.example")).alias("hosts")).collect()}
    assert [r[i]["mixed"] for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert [r[i]["pii"] for i in (1, 2, 3, 4)] == [False, True, False, False]
    assert r[1]["hosts"] == ["js.example.net"] and r[4]["hosts"] == []


def test_schema_types(spark):
    blocks = ['{"@type":"Article"}', '[{"@type":["Product","X"]},{"@type":"FAQPage"}]', "{bad", '{"@graph":[{"@type":"WebPage"}]}', "{}"]
    html = "".join(f"<script type=application/ld+json>{b}</script>" for b in blocks)
    d = spark.createDataFrame([(html,)], "h string").select(markup.dom(F.col("h")).alias("d")).select(ds.schema_types(F.col("d")).alias("t")).first()["t"]
    assert d == ["Article", "Product", "FAQPage"]


def test_analysis(spark, pages):
    links = sinks.link_rows(pages).drop("page_id")
    assets = sinks.asset_rows(pages)
    found = {r["finding_type"]: r for r in findings.analyze(pages, links, assets, "https://s.example/", F.lit("2024-06-30").cast("timestamp"), stated=4).collect()}
    assert found["broken_page"]["affected_page_count"] == 1 and found["broken_page"]["severity"] == "medium"
    assert found["duplicate_title"]["affected_urls_sample"] == ["https://s.example/", "https://s.example/a"]
    assert found["missing_title"]["affected_page_count"] == 1
    assert found["orphan_page"]["affected_urls_sample"] == ["https://s.example/b/"]
    assert found["accessibility_violation"]["severity"] == "high" and found["accessibility_violation"]["affected_page_count"] == 2
    assert found["mixed_content"]["affected_page_count"] == 1 and found["exposed_staging"]["affected_page_count"] == 1 and found["pii_without_privacy_link"]["affected_page_count"] == 1
    assert found["broken_hreflang"]["affected_page_count"] == 1 and found["missing_lang_attribute"]["affected_page_count"] == 1
    assert found["stale_content"]["affected_page_count"] == 2
    assert found["near_duplicate_content"]["affected_page_count"] == 2
    assert found["page_count_variance"]["severity"] == "low" and found["scale_summary"]["affected_page_count"] == 4
    assert found["template_rollup"]["affected_template"] is not None


def test_an_audit_from_pages_to_workbook(spark, tmp_path):
    rows = [
        (1, "https://s.example/", '<html lang="en"><head><title>Home</title><link rel=canonical href=/></head><body><h1>Hi</h1><a href="a">a</a><a href="https://out.example/x">x</a><img src="i.png"><video src="v.mp4"></video><script src="https://www.google-analytics.com/x.js"></script>' + "word " * 30, 200, None, 0),
        (2, "https://s.example/a", "<title>A</title><body><h1>A</h1><a href='./'>up</a><a href='f.pdf'>f</a><iframe src='https://player.vimeo.com/1'></iframe>" + "text " * 200, 200, None, 1),
        (3, "https://s.example/gone", None, 404, "not found", 1),
    ]
    pages = spark.createDataFrame(rows, "page_ord long, url string, html string, status_code int, error string, depth int").withColumns({"page_id": F.col("page_ord"), "response_time_ms": F.lit(20.0), "last_modified": F.lit(None).cast("timestamp")})
    as_of = F.lit("2024-01-01").cast("timestamp")
    status = spark.createDataFrame([("https://out.example/x", "503")], "url string, status string")
    made = audit.run(pages, "https://s.example/", as_of, {"client_name": "S"}, link_status=status)
    assert made.facts["status"] == "done"
    assert {(r["asset_type"], r["url"]) for r in made.assets.collect()} == {("image", "https://s.example/i.png"), ("video", "https://s.example/v.mp4"), ("video", "https://player.vimeo.com/1"), ("document", "https://s.example/f.pdf")}
    assert {(r["target_url"], r["is_internal"]) for r in made.links.collect()} == {("https://s.example/a", True), ("https://out.example/x", False), ("https://s.example/", True)}
    card = made.card.first()
    assert (card["total_pages"], card["missing_canonical"], card["thin_pages"], card["broken_pages"], card["images"], card["missing_alt"], card["image_alt_coverage_pct"]) == (3, 2, 1, 1, 1, 1, 0.0)
    sheets = audit.workbook(made, as_of)
    assert list(sheets) == [
        "Overview", "Heuristic Evaluation", "Action Plan", "Feature Matrix", "Performance", "External Link Health", "Accessibility", "Tech Stack & Risks", "Templates", "Components", "Journey Maps", "Locale", "Media & Assets", "Freshness", "URL Health",
        "Keywords", "Integrations", "Page Inventory", "Findings",
    ]
    shown = {r["label"]: r["value"] for r in sheets["Overview"].collect()}
    assert shown["Client"] == "S" and shown["Pages crawled"] == "3" and shown["Orphan pages"] == "0" and shown["Unique third-party integrations"] == "1"
    assert [tuple(r) for r in sheets["External Link Health"].collect()] == [("https://out.example/x", "503", 1, "https://s.example/")]
    assert {r["label"]: r["value"] for r in sheets["Media & Assets"].collect()}["Video embeds"] == "2"
    sinks.write_xlsx(sheets, str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert sum(n.startswith("xl/worksheets/") for n in z.namelist()) == 19
    assert {k: v.count() for k, v in audit.report(made).items()}["inventory"] == 3
    assert audit.run(pages.withColumn("error", F.lit("x")), "https://s.example/", as_of).facts["status"] == "failed"


def test_rows_appended_and_texts_cut(spark, tmp_path):
    path = str(tmp_path / "rows")
    for _ in range(2):
        sinks.append(spark.createDataFrame([(1, "a")], "page_id long, url string"), path)
    assert spark.read.parquet(path).count() == 2
    long = spark.createDataFrame([("h" * 200_001, "t" * 501, "e" * 2001)], "html string, title string, error string")
    assert [len(x) for x in corpus.stored(long).first()] == [200_000, 500, 2000]


def test_first_linking_page_by_order(spark):
    links = spark.createDataFrame([(2, "https://a/z", "https://x/", False), (1, "https://b/y", "https://x/", False), (3, "https://a/a", "https://x/", False)], "ord int, source_url string, target_url string, is_internal boolean")
    assert site.external_targets(links, order="ord").first()["example_linking_page"] == "https://b/y"
    assert site.external_targets(links).first()["example_linking_page"] == "https://a/a"


def test_near_duplicates_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") * 3 + str(i % 7).replace("0", "x") for i in range(60)] for _ in range(4)]
    rows = []
    for i in range(40):
        w = list(base[i % 4])
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(60)] = "zz" + chr(97 + rng.randrange(26)) * 2
        rows.append((i, " ".join(x.replace("1", "q").replace("2", "r").replace("3", "s").replace("4", "t").replace("5", "u").replace("6", "v") for x in w)))
    rows += [(100, ""), (101, rows[0][1])]

    def sets(s, k=4):
        w = s.split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    s = {i: sets(t) for i, t in rows}
    want = {(a, b) for a in s for b in s if a < b and s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.6}
    got = content.near_duplicate_pairs(spark.createDataFrame(rows, "id long, text string"), "id", 0.6, 4)
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    clusters = {r["id"]: r["cluster"] for r in content.near_duplicate_clusters(spark.createDataFrame(rows, "id long, text string"), "id", 0.6, 4, None).collect()}
    assert clusters == {i: root(i) for i, _ in rows if any(root(i) == root(j) for j, _ in rows if j != i)}
    pairs = {(r["a"], r["b"]) for r in got.collect()}
    assert pairs <= want
    assert content.near_duplicate_clusters(spark.createDataFrame(rows, "id long, text string"), "id", max_pages=10).count() == 0


def test_search_respects_depth_files_robots_and_budget(spark):
    h = "http://h/"
    edges = [("", "a"), ("", "b"), ("a", "c"), ("c", "d"), ("b", "x.pdf"), ("d", ""), ("b", "no/1"), ("c", "c")]
    links = spark.createDataFrame([(h + a, h + b) for a, b in edges], "source_url string, target_url string")
    seeds = spark.createDataFrame([(h, 0), (h + "z", 1)], "url string, depth int")
    got = lambda **o: {r["url"].removeprefix(h): r["depth"] for r in crawl.reachable(links, seeds, **o).collect()}
    assert got(max_depth=2, robots_txt="Disallow: /no") == {"": 0, "z": 1, "a": 1, "b": 1, "c": 2}
    assert got(max_depth=9) == {"": 0, "z": 1, "a": 1, "b": 1, "c": 2, "no/1": 2, "d": 3}
    assert len(got(max_depth=9, max_pages=4)) == 4


def test_sitemaps(spark):
    maps = spark.createDataFrame(
        [("http://h/i.xml", "<sitemapindex ><loc>http://h/1.xml</loc><loc>http://h/2.xml</loc></sitemapindex>"), ("http://h/1.xml", "<loc>http://h/a</loc><loc>http://other/b</loc><loc>http://h/c.pdf</loc>"), ("http://h/2.xml", "<loc>\n http://h/d </loc><loc>http://h/a</loc>")],
        "url string, xml string",
    )
    c = spark.createDataFrame([("http://h/i.xml", 0)], "url string, ord int")
    assert [r["url"] for r in crawl.sitemap_urls(maps, c, "h").collect()] == ["http://h/a", "http://h/d"]
    found = spark.range(1).select(crawl.sitemap_candidates(F.lit("Sitemap: http://h/i.xml\nSITEMAP:http://h/j.xml"), F.lit("http://h/")).alias("a"), crawl.sitemap_candidates(F.lit(""), F.lit("http://h/x")).alias("b")).first()
    assert found["a"] == ["http://h/i.xml", "http://h/j.xml"] and found["b"] == ["http://h/sitemap.xml"]


def test_requests():
    crawl.AuditRequest("c", "https://a.b").check()
    with pytest.raises(ValueError, match="max_pages"):
        crawl.AuditRequest("c", "https://a.b", max_pages=0).check()
    with pytest.raises(ValueError, match="start_url"):
        crawl.AuditRequest("c", "nope").check()
    with pytest.raises(ValueError, match="personas"):
        crawl.AuditRequest("c", "https://a.b", selected_personas=[]).check()


def test_assets_don_t_multiply_pages(spark):
    pages = spark.createDataFrame([(1,), (1,), (2,)], "page_id long")
    assets = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "page_id long, url string")
    assert corpus.assets_of(assets, pages).count() == 2


def test_error_rows(spark):
    queued = spark.createDataFrame([("http://a", 0), ("http://b", 1)], "url string, depth int")
    done = spark.createDataFrame([("http://a", 0, 200, "T", 5, None)], "url string, depth int, status_code int, title string, word_count int, error string")
    r = {x["url"]: x for x in corpus.with_error_defaults(done, queued).collect()}
    assert r["http://a"]["error"] is None and r["http://b"]["error"].startswith("Empty") and r["http://b"]["word_count"] == 0 and r["http://b"]["depth"] == 1


def test_perfect_site(spark):
    names = [*scoring.COUNTS, "broken_pages"]
    row = spark.createDataFrame([(10, 100.0, 2, *[0] * len(names))], ["total_pages", "image_alt_coverage_pct", "max_click_depth", *names])
    card = scoring.scorecard(row)
    got = card.first()
    assert all(got[c] == 100.0 for c in ("ia_health", "content_quality", "accessibility", "seo", "ux_maturity")) and got["ux_maturity_band"] == "Strong"
    assert scoring.assessment(card).where("line LIKE 'Content: no issue%'").count() == 1
    assert scoring.plain_terms(card).count() == 2


def test_report_tables(spark):
    f = spark.createDataFrame([(1, "broken_page", "3 pages", "high", 3), (2, "duplicate_title", "t", "medium", 2)], "ord int, finding_type string, title string, severity string, affected_page_count int")
    rows = {r["heuristic"][:2]: r for r in scoring.report_heuristics(f).collect()}
    assert rows["H9"]["assessed"] and rows["H9"]["count"] == 3 and not rows["H5"]["assessed"]
    audits = spark.sql("SELECT 'a' AS audit_id, 3 AS max_pages, timestamp'2024-01-01 00:00:00' AS started_at, timestamp'2024-01-01 00:00:01.26' AS finished_at")
    pages = spark.createDataFrame([("a", None), ("a", "x")], "audit_id string, error string")
    c = scoring.coverage(audits, pages).first()
    assert (c["complete"], c["page_errors"], c["duration_seconds"]) == (True, 1, 1.3)
    blockers = sinks.accessibility_blockers(f.withColumn("finding_type", F.lit("missing_lang_attribute")), 2).first()["blockers"]
    assert blockers == ["Missing alt text", "Missing lang tag"]


def test_outputs(spark, tmp_path):
    f = spark.createDataFrame([(1, "t", 'a "b", c', "low", "config", ["ux", "content"], 2, "d", "m")], "ord int, finding_type string, title string, severity string, effort_bucket string, personas array<string>, affected_page_count int, description string, detection_method string")
    sinks.write_csv(f, str(tmp_path / "f.csv"))
    import csv

    rows = list(csv.reader(open(tmp_path / "f.csv", encoding="utf-8", newline="")))
    assert rows == [list(sinks.CSV_HEADER), ["t", 'a "b", c', "low", "config", "ux|content", "2", "d", "m"]]
    sinks.write_xlsx({"One": f, "Two & three": f.limit(0)}, str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert 'name="Two &amp; three"' in z.read("xl/workbook.xml").decode() and "ux\ncontent" in z.read("xl/worksheets/sheet1.xml").decode()
    out = str(tmp_path / "findings")
    for _ in range(2):
        sinks.replace_audit(f.withColumn("audit_id", F.lit("a")), out)
    assert spark.read.parquet(out).count() == 1


def test_near_dup_pairs_of_case_variants(spark, tmp_path):
    import duckdb

    from auditloom.plans import catalog

    words = [a * 3 + b * 2 for a in "abcdef" for b in "klmnop"]
    text, near = " ".join(words), " ".join([*words[:-1], "another"])
    rows = [(5, text), (2, text.upper()), (9, text + "."), (4, near), (1, near.title()), (7, text), (8, "nothing like the others at all but long enough for some shingles"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(catalog.ORACLE_SQL["near_dup_pairs"]).fetchall())
    got = catalog.QUERIES["near_dup_pairs"](spark, str(tmp_path)).collect()
    assert sorted((r["a"], r["b"], r["jaccard"]) for r in got) == want and len(want) == 6


def test_payload_is_json(spark):
    from auditloom.plans import catalog

    row = catalog.QUERIES["payload"](spark, "/root/testdata/sf0.001").first()["json"]
    assert set(json.loads(row)) == {"project_metadata", "scores", "persona_findings"}


def test_payload_covers_all_findings(spark):
    from auditloom.plans import catalog, fixtures

    d = "/root/testdata/sf0.001"
    found = json.loads(catalog.QUERIES["payload"](spark, d).first()["json"])["persona_findings"]
    f = fixtures.findings(spark, d)
    types = {r["finding_type"]: r for r in f.groupBy("finding_type").agg(F.count("*").alias("n"), F.max("affected_page_count").alias("most")).collect()}
    assert f.count() > 100 and len(found["content_strategist"]["duplicate_clusters"]) == types["near_duplicate_content"]["n"]
    assert found["ux_lead"]["orphan_pages_count"] == types["orphan_page"]["most"] and found["content_strategist"]["missing_metadata_count"] == types["missing_title"]["most"]
    assert len(found["business_analyst"]["prioritized_backlog_items"]) == scoring.backlog(f).count()


def test_streams(spark, tmp_path):
    from auditloom.streaming import crawl_state

    rows = [("a", "queued", "u", "2024-01-01 00:00:00"), ("a", "queued", "u", "2024-01-01 00:00:01"), ("a", "finished", "u", "2024-01-01 00:00:02")]
    df = spark.createDataFrame(rows, "audit_id string, kind string, url string, t string").select("audit_id", "kind", "url", F.to_timestamp("t").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, made, mode in (("seen", crawl_state.first_seen(stream), "append"), ("progress", crawl_state.progress(stream), "complete")):
        q = made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("seen").count() == 1
    assert spark.table("progress").first()["queued"] == 2
