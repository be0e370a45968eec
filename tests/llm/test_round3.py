"""Line runs, Merkle manifest and hard negatives against plain forms."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import hard_negatives, line_dedup, merkle, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("h", "g", "doc", "docs", "last", "owner", "batch", "place", "places", "salt", "salts", "key", "digest", "idx", "n", "block", "levels", "path", "id", "v", "x", "rank")


def with_clashes(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


# line dedup

LONG = "This line stands in many of the documents of the table"


def plain_lines(rows, min_docs=5):
    held = {}
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        least = lambda x: -(10**9) if x is None else x
        lost = [key(x) in held and len(held[key(x)]) >= min_docs and d != max(held[key(x)], key=least) for x in ls]
        kept = "\n".join(x for x, y in zip(ls, lost, strict=True) if not y)
        out.append((d, len(ls), sum(lost), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(3)
    lines = [f"{LONG}, number {i:03d}" for i in range(40)] + ["short", "", "   ", "é" * 39, "é" * 40, "ÀÉ" + "x" * 45]
    rows = []
    for d in range(1, 60):
        ls = [rng.choice(lines) for _ in range(rng.randrange(0, 12))]
        ls = [rng.choice([x, "\t " + x.upper() + " \x0b", x + "\r"]) for x in ls]
        rows.append((d, "\n".join(ls)))
    rows += [(None, f"{LONG}, number 001\n{LONG}, number 002"), (None, f"{LONG}, number 001"), (7, f"{LONG}, number 001\nother"), (7, f"{LONG}, number 001\nother")]
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, "\n".join([lines[3], "y" * 60] * 3_000)), (74, "z" * 300_000)]
    return rows


@pytest.mark.parametrize("how", [{}, {"batches": 1}, {"batches": 7, "fanout": 2, "hot_docs": 2}, {"batches": 5, "fanout": 3, "min_docs": 2}])
def test_lines_against_a_plain_form(spark, how):
    rows = line_rows()
    df = with_clashes(spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOC))
    got = sorted((tuple(r) for r in line_dedup.dedup(df, **how).collect()), key=repr)
    assert got == plain_lines(rows, how.get("min_docs", 5))


def test_clean_keeps_all_columns(spark):
    rows = line_rows()
    df = with_clashes(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOC))
    made = line_dedup.clean(df)
    assert made.columns == df.columns
    got = sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in made.collect()), key=repr)
    assert got == sorted(((d, s) for d, _, _, s in plain_lines(rows)), key=repr)
    assert made.where("text IS NULL").count() == 1
    assert line_dedup.dedup(spark.createDataFrame([], DOC)).count() == 0


def test_runs_by_level(spark):
    runs = line_dedup.LineRuns(spark, buckets=3, fanout=2)
    rng, want, owner = random.Random(1), {}, {}
    for b in range(7):
        batch = {(rng.randrange(30), 0): (rng.randrange(1, 4), 100 * (9 - b) + rng.randrange(100)) for _ in range(12)}
        df = spark.createDataFrame([(h, g, n, last) for (h, g), (n, last) in batch.items()], "h long, g long, docs long, last long")
        assert {(r["h"], r["g"]) for r in runs.unseen(df).collect()} == {k for k in batch if k not in want}
        runs.add(df)
        for k, (n, last) in batch.items():
            want[k] = want.get(k, 0) + n
            owner.setdefault(k, last)
        assert {(r["h"], r["g"]): (r["docs"], r["owner"]) for r in runs.lines().collect()} == {k: (want[k], owner[k]) for k in want}
    # 7 = 4 + 2 + 1: a run on each of three levels
    assert [x and x[1] for x in runs.levels] == [1, 1, 1]
    runs.drop()
    assert runs.lines().count() == 0


def test_runs_are_not_shuffled_again(spark):
    runs = line_dedup.LineRuns(spark, buckets=4, fanout=4)
    for b in range(2):
        runs.add(spark.range(50 * b, 50 * b + 80).selectExpr("id AS h", "id AS g", "1L AS docs", "id AS last"))
    plan = runs.lines()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 0
    runs.drop()


# Merkle manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_manifest(rows):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(enc(v) for v in (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        """Root and, for each node, its siblings by level."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([sha("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
        paths = []
        for i in range(len(nodes)):
            path = []
            for below in levels[:-1]:
                at = i // 16 * 16
                path.append(("".join(below[at:i]), "".join(below[i + 1 : at + 16])))
                i //= 16
            paths.append(path)
        return levels[-1][0], paths

    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t) if t is not None else None
    sources, made = {}, []
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    roots = {}
    for s in order:
        held = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        roots[s] = (held, *tree([leaf(r, r[1]) for r in held]))
    root, above = tree([roots[s][1] for s in order])
    for s, over in zip(order, above, strict=True):
        held, subroot, paths = roots[s]
        for r, path in zip(held, paths, strict=True):
            path = path + over
            crc = zlib.crc32(("" if r[0] is None else str(r[0])).encode())
            node = leaf(r, lower(r[1]) if crc % 5 == 0 else r[1])
            for a, b in path:
                node = sha(a + node + b)
            made.append((r[0], leaf(r, r[1]), subroot, root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(made, key=repr)


def merkle_rows(n):
    rng = random.Random(5)
    rows = [(i, rng.choice(["Text Ä", "no capitals", "", None, "A" * 50]), rng.choice(["en", None]), rng.choice(["hot"] * 6 + ["b", "é", "Z", "", None]), rng.choice([i, None])) for i in rng.sample(range(10 * n), n)]
    return rows + [(None, "Null id", "en", "hot", 1), (None, "Other", "en", "hot", 1), (rows[0][0], "Repeated id", "en", "hot", 2), (5, "Alone", "en", "single", 3), (6, "x" * 200_000 + "Y", "en", "long", 4)]


@pytest.mark.parametrize(("n", "depth"), [(40, 3), (700, 1), (700, 2), (0, 3)])
def test_manifest_against_a_plain_form(spark, n, depth):
    rows = merkle_rows(n) if n else [(5, "Alone", "en", "single", 3)]
    got = merkle.manifest(with_clashes(spark.createDataFrame(rows, DOC)).repartition(7), depth).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_repeats_and_nothing(spark):
    rows = [(1, "Same", "en", "s", 1)] * 300 + [(2, "b", "en", "s", 1)]
    got = merkle.manifest(spark.createDataFrame(rows, DOC), 1).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_manifest(rows)
    assert merkle.manifest(spark.createDataFrame([], DOC)).count() == 0


# hard negatives

VEC = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows):
    held = {}
    for i, e, lab in rows:
        if i is None or lab is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        r = ((lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in e])
        held[i] = min(held.get(i, r), r)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in sorted(held):
        if a % 100:
            continue
        scored = sorted(((-dot(held[a][1], v), i) for i, (_, v) in held.items() if i != a))
        for s, p in [(-s, i) for s, i in scored if held[i][0] == held[a][0]][:5]:
            found = [(i, -n) for n, i in scored if held[i][0] != held[a][0] and 80 * s <= -100 * n <= 100 * s][:5]
            out += [(a, p, k + 1, i, s, n) for k, (i, n) in enumerate(found)]
    return sorted(out)


def vectors(kind):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(4, 6)) / 3
    rows = []
    for i in range(900):
        e = (base[i % 4] + rng.normal(size=6) / 9).tolist() if kind != "ties" else rng.integers(-1, 2, 3).astype(float).tolist()
        rows.append((i, e, int(rng.integers(0, 3))))
    if kind == "awkward":
        rows += [(None, [0.1] * 6, 1), (1000, None, 1), (1001, [0.1] * 6, None), (1002, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (1003, [0.1, float("nan")], 1), (1100, [float("inf")] * 6, 1)]
        rows += [(200, [0.3] * 6, 2), (200, [0.3] * 6, 2), (1200, [], 1), (1300, [0.5, 0.5], 1), (1400, [0.5] * 9, 2), (1500, [-3.0] * 6, 9)]
        rows += [(2000 + i, [0.4] * 6, 1) for i in range(400)]  # one vector on a third of the rows
    return rows


@pytest.mark.parametrize("kind", ["plain", "ties", "awkward"])
def test_negatives_against_a_plain_form(spark, kind):
    rows = vectors(kind)
    df = with_clashes(spark.createDataFrame(rows, VEC))
    for how in ({}, {"anchor_rows": 3, "block_rows": 50}):
        got = hard_negatives.mine(df, **how).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_negatives_with_dealt_anchors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SMALL", 1)
    monkeypatch.setattr(hard_negatives, "DEALT", 3)
    rows = vectors("plain")
    got = hard_negatives.mine(spark.createDataFrame(rows, VEC), anchor_rows=2, block_rows=100).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VEC)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(100, [0.5], 1)], VEC)).count() == 0


def test_planes_drop_pairs():
    rng = np.random.default_rng(0)
    a, r = rng.integers(-200, 200, (20, 16)), rng.integers(-256, 256, (500, 16))
    seen = []

    def reach(low, high):
        out = high >= hard_negatives._kth(low, 5)[:, None]
        seen.append(int(out.sum()))
        return out

    at, to, score = hard_negatives.sliced(a, r, 8, np.ones((20, 500), bool), reach)
    assert (score == (a @ r.T)[at, to]).all()
    assert seen == sorted(seen, reverse=True) and seen[-2] < 0.1 * 20 * 500
    best = np.sort(a @ r.T, axis=1)[:, -5:]
    for i in range(20):
        assert sorted(score[at == i])[-5:] == best[i].tolist()


# url filters


def test_aliases_by_any_spelling(spark):
    """Ports, dot segments, case and backslashes don't make two nodes of one address."""
    page = lambda i, url, named=None: (i, url, f'<link rel="canonical" href="{named}">' if named else "<p>x</p>")
    pages = [
        page(1, "http://d.net/m", "http://e.net:80/n"), page(2, "http://e.net/n", "http://www.example.org/es/1"),
        page(3, "http://k.net/a/../b"), page(4, "http://l.net/", "http://k.net/b"), page(5, "http://l.net", "http://a.com/de/x"),
        page(6, "HTTP://Q.net/y"), page(7, "http://r.net/", "http:\\\\q.NET\\y"), page(8, "http://r.net:80/?", "http://a.com:80/z/../de/1"), page(9, "http://r.net/#top"),
        page(10, "https://t.net:443/./u#f"), page(11, "http://v.net/w", "https://t.net/u"), page(12, "http://v.net/w/../w", "http://b.com/x/%2e%2e/de/"),
        page(13, "http://clean.net:81/m", "http://clean.net/m"), page(14, "http://clean.net/m"), page(15, None, "http://a.com/de/"), page(16, "no address", "http://a.com/de/"), page(17, "http://x.org:80/", "http://a.com/de/x"),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    blocked = {i for i, v in got.items() if v == "block"}
    # page 8 has an empty query, which is another address than page 7's; page 17's address is allowed once its port is gone
    assert blocked == {1, 2, 3, 4, 5, 8, 10, 11, 12}, blocked


def test_redirects_by_any_spelling(spark):
    pages = spark.createDataFrame([(1, "http://s.net/a", None), (2, "http://t.net/b", None), (3, "http://u.net/c", None)], "page_id long, url string, html string")
    hops = spark.createDataFrame([("http://S.net:80/x/../a", "http://t.net/./b"), ("http://t.net/b", "//a.com:80/de/1"), (None, "http://a.com/de/"), ("http://u.net/c", None)], "source string, target string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, redirects=hops).collect()} == {1: "block", 2: "block", 3: "allow"}
