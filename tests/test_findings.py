"""Values of findings on a site made by hand, lists of examples, journeys of one's own, frames of the report."""

import datetime
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from auditloom.operators import audit, findings, site
from auditloom.sources import sinks

PAGE = "page_ord long, page_id long, url string, html string, status_code int, error string, depth int, response_time_ms double, last_modified timestamp"
NOW = datetime.datetime(2024, 6, 30)


def page(i, path, body="", head="", status=200, changed=None):
    html = f"<html lang=en><head><title>Page {i}</title>{head}</head><body><h1>H</h1>{body}</body></html>"
    return (i, i, f"https://s.example{path}", html, status, None, 1, 10.0, changed)


def made(spark, rows):
    return audit.parsed(spark.createDataFrame(rows, PAGE))


def rows_of(parts):
    parts = parts if isinstance(parts, list) else [parts]
    return {r["finding_type"]: r for part in parts for r in part.collect()}


def test_address_findings(spark):
    paths = ["/Team", "/team", "/news", "/news/", "/a?utm_source=x", "/b?gclid=1&q=2", "/c?q=1", "/Mixed/", "/mixed"]
    got = rows_of(findings.url_health(made(spark, [page(i, p) for i, p in enumerate(paths)])))
    slash, case, tracked = got["url_trailing_slash_inconsistency"], got["url_case_inconsistency"], got["url_tracking_params_internal"]
    # the last pair differs in both ways: without the slash it's in two cases still, so the number of forms doesn't shrink
    assert slash["affected_page_count"] == 2 and slash["affected_urls_sample"] == ["https://s.example/news", "https://s.example/news/"]
    assert case["affected_page_count"] == 4 and case["affected_urls_sample"] == ["https://s.example/Team", "https://s.example/team"] and case["title"].startswith("2 ")
    assert tracked["affected_page_count"] == 2 and tracked["affected_urls_sample"] == ["https://s.example/a?utm_source=x", "https://s.example/b?gclid=1&q=2"]
    assert (slash["severity"], case["severity"], tracked["severity"]) == ("medium", "medium", "low")


def test_fifteen_groups_are_counted(spark):
    """Counts are taken after the lists are cut to 15 groups."""
    p = made(spark, [page(2 * i + k, f"/p{i}{'/' * k}") for i in range(18) for k in (0, 1)])
    assert rows_of(findings.url_health(p))["url_trailing_slash_inconsistency"]["affected_page_count"] == 30
    assert rows_of(findings.url_health(p, cap=None))["url_trailing_slash_inconsistency"]["affected_page_count"] == 36
    row = site.url_health(p).first()
    assert len(row["trailing_slash_inconsistencies"]) == 15 and row["trailing_slash_inconsistencies"][0] == ["https://s.example/p0", "https://s.example/p0/"]
    assert row["case_inconsistencies"] == [] and row["param_bloat_count"] == 0 == row["tracking_param_count"]


def test_example_lists_are_cut_at_fifteen(spark):
    links = "".join(f'<a href="/f{i:02d}.pdf">f</a>' for i in range(20))
    p = made(spark, [page(i, f"/{i}", links, f'<link rel=alternate hreflang=fr href="https://s.example/fr/{i}">') for i in range(20)])
    assert [r["page_ord"] for r in site.broken_hreflang_examples(p).collect()] == list(range(15))
    assert site.broken_hreflang(p).count() == 20
    some = site.document_examples(sinks.asset_rows(p)).collect()
    assert len(some) == 15 and {r["page_id"] for r in some} == {0} and some[0]["url"] == "https://s.example/f00.pdf"


@pytest.mark.parametrize(("known", "want"), [(2, 3), (3, None), (0, 5)])
def test_unknown_dates(spark, known, want):
    rows = [page(i, f"/{i}", changed=NOW if i < known else None) for i in range(5)]
    row = rows_of(findings.freshness(made(spark, rows), F.lit(NOW))).get("freshness_unknown")
    assert (row and row["affected_page_count"]) == want
    assert row is None or (row["severity"] == "low" and row["title"] == f"No date of change for {want} of 5 pages")


@pytest.mark.parametrize(("elsewhere", "want"), [(1, None), (2, 2), (0, None)])
def test_media_governance(spark, elsewhere, want):
    body = "".join(f'<img src="https://cdn.example/{i}.png" alt=x>' for i in range(8)) + "".join(f'<img src="https://old.example/{i}.png" alt=x>' for i in range(elsewhere))
    row = rows_of(findings.media_governance(sinks.asset_rows(made(spark, [page(1, "/", body)])))).get("media_governance_risk")
    assert (row and row["affected_page_count"]) == want
    assert row is None or "cdn.example" in row["description"]


def test_components_in_many_styles(spark):
    styles = ["a", "b", "c"]
    text = "<p>" + "long text of the page " * 20 + "</p>"
    rows = [page(3 * k + i, f"/{s}{k}", f'{text}<button class="btn {s}">Go</button>') for k in range(2) for i, s in enumerate(styles)] + [page(20, "/once", f'{text}<button class="btn only">Go</button>')]
    row = rows_of(findings.component_inconsistencies(made(spark, rows)))["component_style_inconsistency"]
    assert row["affected_page_count"] == 6 and row["title"] == "3 styles of <button> over 6 page(s)" and row["detection_method"] == "signatures: button.a.btn, button.b.btn, button.btn.c"
    assert findings.component_inconsistencies(made(spark, rows[:4])).count() == 0


def test_templates_of_one_page(spark):
    rows = [page(i, f"/{i}", "<div class=x><p>t</p></div>") for i in range(3)] + [page(7, "/odd", "<section><ul><li>t</ul></section>"), page(8, "/gone", "<aside>t</aside>", status=404)]
    got = rows_of(findings.templates(made(spark, rows)))
    assert got["one_off_template"]["affected_page_count"] == 1 and got["one_off_template"]["affected_urls_sample"] == ["https://s.example/odd"]
    assert got["template_rollup"]["affected_page_count"] == 4 and got["template_rollup"]["title"] == "2 page template(s) over 4 page(s)"
    assert got["template_rollup"]["affected_urls_sample"] == [f"https://s.example/{i}" for i in range(3)]


def test_platforms_and_frameworks(spark):
    rows = [page(1, "/1", '<img src="/wp-content/x.png" alt=x>'), page(2, "/2", '<img src="/wp-content/y.png" alt=x><div data-v-0a1b2c3d></div>'), page(3, "/3", '<script id="__NEXT_DATA__">{}</script>')]
    got = {(r["finding_type"], r["title"]): r for r in findings.tech_stack(made(spark, rows)).collect()}
    assert {(k, t.split(": ")[1]): (r["affected_page_count"], r["affected_urls_sample"]) for (k, t), r in got.items()} == {
        ("cms_detected", "WordPress"): (2, ["https://s.example/1", "https://s.example/2"]),
        ("js_framework_detected", "Vue.js / Nuxt"): (1, ["https://s.example/2"]),
        ("js_framework_detected", "React / Next.js"): (1, ["https://s.example/3"]),
    }


def test_journeys_of_ones_own(spark):
    own = ("own", "Own", (("one", "One", ("zebra", "yak")), ("two", "Two", ("none such",)), ("all", "All", ("",))))
    rules = site.journey_rules(spark, [own])
    p = spark.createDataFrame([(1, "https://h/zebra-yak", "T", 200, 3), (2, "https://h/x", "A ZEBRA", 200, 1), (3, "https://h/yak", None, 404, 0), (4, "https://h/pricing", None, 200, 2)], "page_ord long, url string, title string, status_code int, depth int")
    got = {r["stage_id"]: (r["present"], r["page_count"], r["example_url"], r["click_depth"]) for r in site.journey_stages(p, rules).where("journey_id = 'own'").collect()}
    assert got == {"one": (True, 2, "https://h/x", 1), "two": (False, 0, None, None), "all": (True, 3, "https://h/x", 1)}
    assert site.journey_stages(p, site.journey_rules(spark)).where("stage_id = 'decision'").first()["page_count"] == 1
    notes = {r["journey_id"]: r["notes"] for r in site.journeys(site.journey_stages(p, rules)).collect()}
    assert notes["own"] == ["No page matches: Two."]


def test_matching_costs_one_pass_for_all_rules():
    rules = {f"word{i}x": {i, i % 7} for i in range(5_000)}
    match = site.keyword_matcher(rules)
    for text in ("", "word12x word4999x", "word12", "aword3xword33xb"):
        assert match(text) == set().union(*(v for k, v in rules.items() if k in text))


def test_report_frames(spark):
    rows = [page(i, f"/{i}", "<p>" + " ".join(f"w{i}{k}" for k in range(200)) + "</p>", changed=NOW) for i in range(4)] + [page(9, "/bad", status=404)]
    a = audit.run(spark.createDataFrame(rows, PAGE), "https://s.example/0", F.lit(NOW), {"client_name": "C"})
    r = audit.report(a)
    shown = {x["label"]: x["value"] for x in r["overview"].collect()}
    assert (shown["Client"], shown["Pages crawled"], shown["Site audited"]) == ("C", "5", "https://s.example/0")
    kinds = {x["finding_type"]: x["affected_page_count"] for x in a.findings.collect()}
    assert kinds["broken_page"] == 1 and kinds["orphan_page"] == 4 and int(shown["Findings"]) == len(a.findings.collect())
    assert sum(x["findings"] for x in r["areas"].collect()) == len(a.findings.collect())
    assert r["inventory"].count() == 5 and r["features"].count() == 16
    assert {x["title"] for x in r["chart"].collect()} == {x["title"] for x in a.findings.where("finding_type <> 'scale_summary'").collect()}
    assert r["action_plan"].count() > 0 and r["backlog"].count() > 0 and r["heuristics"].count() > 0
    assert r["plain_terms"].where("ord = 0").count() == 1 and r["assessment"].count() > 0


def cells(path):
    """Sheets by name, their rows as lists of texts."""
    with zipfile.ZipFile(path) as z:
        names = re.findall(r'<sheet name="([^"]*)"', z.read("xl/workbook.xml").decode())
        sheets = [z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in range(1, len(names) + 1)]
        assert z.testzip() is None
    return {n: [re.findall(r"<c/>()|<v>(.*?)</v>|<t [^>]*>(.*?)</t>", r, re.S) for r in re.findall(r"<row>(.*?)</row>", x, re.S)] for n, x in zip(names, sheets, strict=True)}


def test_long_sheets_go_on(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).selectExpr("id AS `n`", "concat('<row> ', id, ' & ', CASE WHEN id % 2 = 0 THEN 'x' END) AS `n `").orderBy("n")
    path = str(tmp_path / "w.xlsx")
    sinks.write_xlsx({"Long": rows, "Short": rows.limit(3), "None": rows.limit(0)}, path, most=300)
    got = cells(path)
    assert list(got) == ["Long", "Long (2)", "Long (3)", "Long (4)", "Short", "None"] or all(len(v) <= 300 for v in got.values())
    assert all(len(v) <= 300 for v in got.values()) and len(got["Short"]) == 4 and len(got["None"]) == 1
    numbers = [int(r[0][1]) for name, v in got.items() if name.startswith("Long") for r in v[1:]]
    assert numbers == list(range(1000))
    assert got["Long"][1][1][2] == "&lt;row&gt; 0 &amp; x" and got["Long"][2][1] == ("", "", "")


def test_broken_writes_leave_no_file(spark, tmp_path):
    bad = spark.range(0, 100, 1, 4).selectExpr("CASE WHEN id = 77 THEN raise_error('broken') ELSE id END AS x")
    with pytest.raises(Exception, match="broken"):
        sinks.write_xlsx({"Good": spark.range(5).toDF("x"), "Bad": bad}, str(tmp_path / "w.xlsx"))
    assert list(tmp_path.iterdir()) == []
