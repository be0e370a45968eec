"""Several audits at once, their state machine, near-duplicate clusters without pairs, accessibility rules, whole pages."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom import scratch
from auditloom.functions import accessibility, html
from auditloom.operators import audit, content, crawl, near_duplicates, ranks
from auditloom.sources import corpus, sinks
from auditloom.sources.bucketed import BucketedTable
from auditloom.streaming import audit_machine

LINK, AUDIT = "audit_id string, source_url string, target_url string", "audit_id string, start_url string, max_pages int, max_depth int, respect_robots boolean"


# numbering and buckets


def test_places_without_one_task_per_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.randrange(300)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, x int")
    got = ranks.numbered(df, ["k"], ["x"]).where("k IS NOT NULL").collect()
    for k in ("hot", "a", "b"):
        mine = sorted((r["place"], r["x"]) for r in got if r["k"] == k)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert [x for _, x in mine] == sorted(x for key, x in rows if key == k)


def test_buckets_only_grow(spark):
    t = BucketedTable(spark, "growing", "k long, v long", ("k",), 4)
    assert t.read().count() == 0
    for i in range(3):
        t.append(spark.range(10 * i, 10 * i + 10).selectExpr("id AS k", "id AS v"))
    plan = spark.range(40).withColumnRenamed("id", "k").join(t.read().hint("merge"), "k", "left_anti")
    assert sorted(r["k"] for r in plan.collect()) == list(range(30, 40))
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert shown.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    assert t.close().count() == 30


# many audits


def plain_crawl(links, audits, robots, seeds):
    out = {}
    for a, start, most, deepest, heeds in audits:
        if start is None:
            continue
        rules = [x.split(":", 1)[1].strip() for x in (robots.get(a) or "").split("\n") if x.strip().lower().startswith("disallow:")] if heeds else []
        path = lambda u: "/" + u.split("/", 3)[3].split("?")[0]
        blocked = lambda u, rules=rules: any(r and path(u).startswith(r) for r in rules)
        taken = {}

        def take(urls, depth, taken=taken, most=most):
            for u in urls:
                if u not in taken and len(taken) < most:
                    taken[u] = depth

        take([start], 0)
        take([u for _, u in sorted((o, u) for x, u, o in seeds if x == a and u)], 1)
        for depth in range(deepest):
            here = {u for u, d in taken.items() if d == depth and not blocked(u)}
            take(sorted({t for x, s, t in links if x == a and s in here and t and not t.lower().endswith((".pdf", ".png"))}), depth + 1)
        out |= {(a, u): (d, crawl.BLOCKED if blocked(u) else None) for u, d in taken.items()}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_crawls_of_many_audits(spark, seed):
    rng = random.Random(seed)
    page = lambda: f"https://h/{rng.choice(['de', 'en', 'fr'])}/{rng.randrange(60)}{rng.choice(['', '', '', '.pdf', '?q=1'])}"
    names = [f"a{i}" for i in range(6)]
    links = [(rng.choice(names[:5]), page(), rng.choice([page(), page(), page(), None])) for _ in range(1500)]
    audits = [(n, page(), rng.choice([0, 1, 7, 30, 1000]), rng.randrange(1, 5), rng.random() < 0.7) for n in names] + [("none", None, 5, 2, True)]
    robots = {n: rng.choice([None, "", "Disallow: /de/", "User-agent: x\nDISALLOW: /en/1\n disallow: /fr/\nDisallow:", "Disallow: /"]) for n in names[:4]}
    seeds = [(rng.choice(names), rng.choice([page(), None]), i) for i in range(25)]
    made = crawl.crawl_audits(spark.createDataFrame(links, LINK), spark.createDataFrame(audits, AUDIT), spark.createDataFrame(list(robots.items()), "audit_id string, txt string"), spark.createDataFrame(seeds, "audit_id string, url string, ord int"))
    rows = made.collect()
    got = {(r["audit_id"], r["url"]): (r["depth"], r["error"]) for r in rows}
    assert got == plain_crawl(links, audits, robots, seeds) and len(got) == len(rows)


def test_crawls_of_nothing(spark):
    none = spark.createDataFrame([], LINK)
    assert crawl.crawl_audits(none, spark.createDataFrame([], AUDIT)).count() == 0
    one = spark.createDataFrame([("a", "https://h/", 5, 3, True), ("a", "https://h/", 5, 3, True)], AUDIT)
    assert [tuple(r) for r in crawl.crawl_audits(none, one).collect()] == [("a", "https://h/", 0, None)]


def test_levels_write_new_addresses_only(spark):
    """A long path: a level of one address writes one row, however many were seen."""
    n = 8
    links = [("a", f"https://h/{i}", f"https://h/{j}") for i in range(n) for j in (i + 1, i, max(0, i - 1))]
    begun = scratch.mark()
    rows = crawl.crawl_audits(spark.createDataFrame(links, LINK), spark.createDataFrame([("a", "https://h/0", 100, 50, False)], AUDIT)).collect()
    assert sorted(r["depth"] for r in rows) == list(range(n + 1))
    levels = [p for p in scratch._made[begun:] if "/crawl-level-" in p]
    assert sum(spark.read.parquet(p).count() for p in levels) == n + 1


# the state machine


def run_events(spark, folder, batches, ttl_ms=audit_machine.DAY_MS):
    """Feed batches of events one by one; returns the actions of each."""
    # timers make batches without data, which would go on for ever here
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    (folder / "in").mkdir(exist_ok=True)
    out = []
    for i, batch in enumerate(batches):
        events = batch(out) if callable(batch) else batch
        lines = [json.dumps({"audit_id": a, "kind": k, **more}) for a, k, more in events]
        (folder / "in" / f"{i:03d}.json").write_text("\n".join(lines) + "\n")
        stream = spark.readStream.schema(audit_machine.EVENT).json(str(folder / "in"))
        made: list[dict] = []
        query = audit_machine.actions(stream, ttl_ms).writeStream.foreachBatch(lambda df, _, made=made: made.extend(r.asDict() for r in df.collect())).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(90)
        out.append(made)
    return out


def test_life_of_audits(spark, tmp_path):
    page = lambda a, u, d, links=(), error=None: (a, "page", {"url": u, "depth": d, "links": list(links), "error": error})
    start = lambda a, u, pages, depth, seeds=(): (a, "start", {"url": u, "max_pages": pages, "max_depth": depth, "links": list(seeds)})
    got = run_events(
        spark,
        tmp_path,
        [
            [start("a", "/", 4, 2, ["/s"]), start("b", "/", 9, 9), start("c", "/", 9, 1), page("x", "/", 0)],
            [page("a", "/", 0, ["/p", "/s", "/q", "/r", "/p"]), page("b", "/", 0, error="no answer"), page("c", "/", 0, ["/k"]), page("c", "/unknown", 1)],
            [page("a", "/", 0, ["/late"]), page("a", "/s", 1, ["/t"]), page("a", "/p", 1, error="broken"), page("b", "/more", 1), page("c", "/k", 1, ["/deeper"])],
            [page("a", "/q", 1), ("c", "analyzed", {}), ("a", "analyzed", {"error": "early"})],
            [("a", "analyzed", {"error": "no memory"}), ("c", "analyzed", {}), start("c", "/", 9, 1)],
        ],
    )
    queued = [sorted((r["audit_id"], r["url"], r["depth"]) for r in rows if r["action"] == "enqueue") for rows in got]
    assert queued[0] == [("a", "/", 0), ("a", "/s", 1), ("b", "/", 0), ("c", "/", 0)]
    # a has four places: two are taken, two of three new links get the others, the third is given back
    assert queued[1] == [("a", "/p", 1), ("a", "/q", 1), ("c", "/k", 1)] and not any(queued[2:])
    used = {r["audit_id"]: (r["used"], r["outstanding"]) for r in got[1]}
    assert used["a"] == (4, 3) and used["c"] == (2, 1)
    moves = [sorted((r["audit_id"], r["status"], r["error"]) for r in rows if r["action"] == "status") for rows in got]
    assert moves[0] == [("a", "crawling", None), ("b", "crawling", None), ("c", "crawling", None)]
    assert moves[1] == [("b", "failed", "no answer")]
    assert moves[2] == [("c", "analyzing", None)]
    # within one batch the last page comes before the analysis
    assert moves[3] == [("a", "analyzing", "broken"), ("a", "failed", "early"), ("c", "done", None)]
    ignored = [sorted((r["audit_id"], r["url"] or "") for r in rows if r["action"] == "ignored") for rows in got]
    assert ignored[0] == [("x", "/")] and ignored[1] == [("c", "/unknown")] and ignored[2] == [("a", "/"), ("b", "/more")]
    assert moves[4] == [] and len(ignored[4]) == 3
    # the log of the stream, read by the batch queries
    log = spark.createDataFrame([(r["audit_id"], r["status"], i) for i, rows in enumerate(got) for r in rows if r["action"] == "status" and (i, r["status"]) != (3, "analyzing")], "audit_id string, status string, at int")
    assert {r["audit_id"]: r["status"] for r in crawl.latest_status(log).collect()} == {"a": "failed", "b": "failed", "c": "done"}


def test_stream_takes_what_the_batch_crawl_takes(spark, tmp_path):
    rng = random.Random(4)
    links = sorted({(a, f"https://h/{rng.randrange(25)}", f"https://h/{rng.randrange(25)}") for a in "ab" for _ in range(60)})
    audits = [("a", "https://h/1", 1000, 3, False), ("b", "https://h/2", 9, 6, False)]
    want = crawl.crawl_audits(spark.createDataFrame(links, LINK), spark.createDataFrame(audits, AUDIT)).collect()

    def finished(level):
        """The pages that the batch before queued, in the order of their addresses; links in theirs, each page twice."""

        def made(out):
            rows = sorted((r["audit_id"], r["url"], r["depth"]) for r in out[level - 1] if r["action"] == "enqueue")
            done = [(a, "page", {"url": u, "depth": d, "links": sorted(t for x, s, t in links if (x, s) == (a, u))}) for a, u, d in rows]
            return done + done[:3]

        return made

    out = run_events(spark, tmp_path, [[(a, "start", {"url": s, "max_pages": p, "max_depth": d}) for a, s, p, d, _ in audits], *(finished(i) for i in range(1, 7))])
    got = [(r["audit_id"], r["url"], r["depth"]) for rows in out for r in rows if r["action"] == "enqueue"]
    assert len(got) == len(set(got))
    assert sorted(x for x in got if x[0] == "a") == sorted((r["audit_id"], r["url"], r["depth"]) for r in want if r["audit_id"] == "a")
    assert Counter(a for a, *_ in got)["b"] == 9 == sum(r["audit_id"] == "b" for r in want)
    last = [r for rows in out for r in rows if r["action"] == "status"]
    assert Counter((r["audit_id"], r["status"]) for r in last) == Counter([(a, s) for a in "ab" for s in ("crawling", "analyzing")])
    events = [(r["audit_id"], "queued", r["url"]) for rows in out for r in rows if r["action"] == "enqueue"]
    events += [(a, "finished", u) for a, _, u in events]
    assert all(r["outstanding"] == 0 and r["complete"] for r in crawl.outstanding(spark.createDataFrame(events, "audit_id string, kind string, url string")).collect())


def test_silent_audits_fail(spark, tmp_path):
    out = run_events(spark, tmp_path, [[("a", "start", {"url": "/", "max_pages": 5, "max_depth": 2})], [("z", "page", {"url": "/"})], [("a", "page", {"url": "/", "depth": 0})]], ttl_ms=1)
    moves = [(r["audit_id"], r["status"], r["error"]) for rows in out for r in rows if r["action"] == "status"]
    assert moves == [("a", "crawling", None), ("a", "failed", audit_machine.SILENT)]


# near duplicates


def words(rng, n):
    return [rng.choice("bcdfghklmnprst") + rng.choice("aeiou") + rng.choice("bcdfghklmnprst") + rng.choice("aeiou") + rng.choice("xyz") for _ in range(n)]


def plain_clusters(rows, t, k):
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, s in rows for w in [(s or "").split()]}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t:
                pairs.add((a, b))
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets if any(root(j) == root(i) for j in sets if j != i)}, pairs


@pytest.mark.parametrize("seed", range(3))
def test_clusters_and_pairs_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    shared, rows = words(rng, 30), []
    for f in range(8):
        base = words(rng, rng.randrange(20, 120))
        for _ in range(rng.randrange(1, 16)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 8)):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            rows.append((len(rows) * 7 % 991, " ".join(w + (shared if f % 3 == 0 else []))))
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (1999, "few words"), (1998, None), (1997, ""), (1996, "few words"), (1995, " ".join(shared))]
    df = spark.createDataFrame(rows, "id long, text string")
    want, pairs = plain_clusters(rows, 0.75, 8)
    assert {r["id"]: r["cluster"] for r in content.near_duplicate_clusters(df, "id", max_pages=None).collect()} == want
    got = content.near_duplicate_pairs(df, "id")
    assert {(r["a"], r["b"]) for r in got.collect()} <= pairs
    firsts, _ = near_duplicates.first_texts(df, "id")
    unlike = {(r["a"], r["b"]) for r in content.unlike_pairs(content.near_duplicate_pairs(firsts, "id")).collect()}
    text, first = dict(rows), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        first.setdefault(t, i)
    sets = {i: frozenset(zip(*(t.split()[j:] for j in range(8)))) for i, t in rows if t}
    assert unlike == {(a, b) for a, b in pairs if first[text[a]] == a and first[text[b]] == b and sets[a] != sets[b]}


def test_a_family_costs_about_its_size(spark):
    """Half of the rows are near copies of one text; the rest share a passage with it."""
    rng = random.Random(9)
    base, passage = words(rng, 300), words(rng, 40)
    rows = []
    for i in range(400):
        w = list(base) if i % 2 else words(rng, 260)
        for _ in range(2):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        rows.append((i, " ".join(w + passage)))
    forest, compared = near_duplicates.forest(spark.createDataFrame(rows, "id long, text string"), "id")
    assert {r["node"]: r["component"] for r in forest.collect()} == {i: 1 for i in range(1, 400, 2)}
    assert 199 <= compared["star"] + compared["across"] < 3 * 200


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert content.near_duplicate_clusters(df, "id", max_pages=None).count() == 0 and content.near_duplicate_pairs(df, "id").count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(-(2**62), 2**62, 500))
    for cut in (0, 3, 200, 490):
        b = np.unique(np.concatenate([a[cut:], rng.integers(-(2**62), 2**62, cut)]))
        apart = sum(int(x).bit_count() for x in (near_duplicates.sketch(a) ^ near_duplicates.sketch(b)).view(np.uint64))
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


# accessibility


def broken(markup):
    return {v["id"]: v["nodesCount"] for v in accessibility.violations(html.parse(f"<html lang=en><head><title>t</title></head><body>{markup}</body></html>"))}


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<img src=a><img src=b alt=''><img src=c role=presentation><img src=d aria-label=x><img src=e title=y>", {"image-alt": 1}),
        ("<div hidden><img src=a></div><p style='display: none'><img src=b></p><p aria-hidden=true><a href=x></a></p>", {}),
        ("<a href=x></a><a href=y> </a><a href=z><img src=i alt=Home></a><a>plain</a><a href=w aria-labelledby=n></a><b id=n>name</b>", {"link-name": 2}),
        ("<a href=w aria-labelledby=missing></a>", {"link-name": 1}),
        ("<button></button><button>Go</button><button aria-label=Go></button><input type=button><input type=button value=x><input type=submit>", {"button-name": 1, "input-button-name": 1}),
        ("<input name=a><input id=b><label for=b>B</label><label>C <input></label><input type=hidden><textarea></textarea><select></select><input placeholder=p>", {"label": 2, "select-name": 1}),
        ("<label for=b></label><input id=b>", {"label": 1}),
        ("<h1>a</h1><h2>b</h2><h4>c</h4><h2>d</h2><h3>e</h3><div role=heading aria-level=5>f</div>", {"heading-order": 2}),
        ("<i id=a></i><i id=a></i><i id=b></i><i id=b></i><i id=b></i><i id=c></i><i id=''></i><i id=''></i>", {"duplicate-id": 2}),
        ("<iframe src=a></iframe><iframe src=b title=t></iframe><input type=image src=c><input type=image alt=d>", {"frame-title": 1, "input-image-alt": 1}),
    ],
)
def test_rules_of_markup(markup, want):
    assert broken(markup) == want


def test_rules_of_documents():
    ids = lambda x: {v["id"] for v in accessibility.violations(html.parse(x))}
    assert ids("") == {"document-title", "html-has-lang"} == ids("<html lang=' '><title> </title><p>x</p>")
    assert ids("<html lang=de><title>x</title>") == set()


def test_scanner_results_come_first(spark):
    kind = "page_id long, page_ord long, url string, html string, accessibility_violations array<struct<id:string,impact:string,description:string,nodesCount:int>>"
    rows = [(1, 1, "https://h/1", "<img src=a>", [("color-contrast", "serious", "Contrast", 3)]), (2, 2, "https://h/2", "<img src=a>", None)]
    df = spark.createDataFrame(rows, kind)
    assert [[v["id"] for v in r[0]] for r in audit.parsed(df).orderBy("page_id").select("accessibility_violations").collect()] == [["color-contrast"], []]
    own = audit.parsed(df.drop("accessibility_violations")).select("accessibility_violations").first()[0]
    assert [v["id"] for v in own] == ["document-title", "html-has-lang", "image-alt"]


# whole pages


def test_pages_are_parsed_whole_and_kept_cut(spark):
    long = "<html lang=en><title>" + "t" * 600 + "</title><body>" + "word " * 41_000 + '<a href="/far">far</a><img src="/far.png"><h1>' + "h" * 600 + "</h1></body></html>"
    p = audit.parsed(spark.createDataFrame([(1, 1, "https://h/", long)], "page_id long, page_ord long, url string, html string"))
    row = p.select("html", "title", "h1_text", "word_count").first()
    assert (len(row["html"]), len(row["title"]), len(row["h1_text"]), row["word_count"]) == (corpus.STORED["html"], 500, 500, 41_002)
    assert [r["target_url"] for r in sinks.link_rows(p).collect()] == ["https://h/far"]
    assert [r["url"] for r in sinks.asset_rows(p).collect()] == ["https://h/far.png"]
    assert p.select(F.size("dom.images")).first()[0] == 1
