"""The registered queries opN_<name> and the SQL that restates them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontam, exact_dedup, hard_negatives, hpylm, language_id, line_dedup, merkle, mixing, ngram_join, pii, quality, secrets, url_filter


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of equal texts, one row per document."""
    return exact_dedup.owners(common.table(spark, sf_dir, "documents"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, base patterns and Markov models."""
    return secrets.scan(common.table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and selection of every document."""
    return quality.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of every document for the target weights of the domains."""
    return mixing.mix(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    return pii.extract(common.table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, also re-parameterised."""
    return decontam.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every whole text, learned from the documents outside the fold 2 of 7."""
    docs = common.table(spark, sf_dir, "documents")
    held = common.id_mod(F.col("doc_id"), 7) == 2
    return hpylm.score(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.similar(common.table(spark, sf_dir, "documents"), 3, 90, 100)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return url_filter.judge(common.table(spark, sf_dir, "pages"))


def url_alias_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts where each page but every fourth names the next one as canonical, written with its port, an upper-case host and dot segments."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.regexp_extract("url", r"\A([a-z]+)", 1).alias("scheme"), F.col("url").alias("named"))
    port = F.when(F.col("scheme") == "https", ":443").otherwise(":80")
    parts = [F.regexp_extract("named", r"\A[a-z]+://([^/?#]*)(/?[^?#]*)(.*)", i) for i in (1, 2, 3)]
    link = F.concat(F.lit('<link rel="canonical" href="'), F.upper("scheme"), F.lit("://"), F.upper(parts[0]), port, F.lit("/a/.."), parts[1], parts[2], F.lit('">'))
    made = pages.join(after, "page_id", "left").select("page_id", "url", F.when(F.col("page_id") % 4 != 3, link).alias("html"))
    return url_filter.judge(made).select("page_id", "rule", "verdict", "reached")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id.identify(common.table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that five documents or more share, but in the largest of them."""
    return line_dedup.dedup(common.table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and roots of every document, and whether it still proves after tampering."""
    return merkle.manifest(common.table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor's positives."""
    return hard_negatives.mine(common.table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_lm_score": op7_lm_score,
    "op8_ngram_join": op8_ngram_join,
    "op9_url_filter": op9_url_filter,
    "url_alias_verdicts": url_alias_verdicts,
    "op10_language_id": op10_language_id,
    "op11_line_dedup": op11_line_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY norm)
    """,
    "op8_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
        r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node)
        SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
    """,
    # the fixtures' markup has no canonical link or refresh, so the method's verdict is allow; propagation is tested apart
    "op9_url_filter": r"""
        WITH p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
        h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
        r(v, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        m AS (SELECT h.page_id, r.rh || r.rp AS rule, r.v, row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rh || r.rp) DESC) AS k
              FROM h JOIN r ON (h.host = r.rh OR ends_with(h.host, '.' || r.rh)) AND starts_with(h.path, r.rp)),
        b AS (SELECT * FROM m WHERE k = 1)
        SELECT h.page_id, h.host, h.path, b.rule, coalesce(b.v, 'allow') AS verdict, false AS reached FROM h LEFT JOIN b USING (page_id)
    """,
    "url_alias_verdicts": r"""
        WITH RECURSIVE p AS (SELECT page_id, url, substr(url, position('://' IN url) + 3) AS rest, regexp_replace(url, '#.*$', '') AS bare FROM pages),
        h AS (SELECT page_id, regexp_extract(bare, '^([a-z]+://[^/?]*)', 1) || CASE WHEN regexp_matches(bare, '^[a-z]+://[^/?]*/') THEN '' ELSE '/' END || regexp_extract(bare, '^[a-z]+://[^/?]*(.*)$', 1) AS node,
                     lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        r(v, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        m AS (SELECT h.page_id, r.rh || r.rp AS rule, r.v, row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rh || r.rp) DESC) AS k
              FROM h JOIN r ON (h.host = r.rh OR ends_with(h.host, '.' || r.rh)) AND starts_with(h.path, r.rp)),
        b AS (SELECT h.*, m.rule, m.v FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.k = 1),
        e AS (SELECT x.node AS a, y.node AS b FROM h x JOIN h y ON y.page_id = x.page_id + 1 WHERE x.page_id % 4 <> 3 AND x.node <> y.node),
        s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        c AS (SELECT DISTINCT node AS x, node AS y FROM b WHERE v = 'block' AND node IN (SELECT a FROM s) UNION SELECT c.x, s.b FROM c JOIN s ON s.a = c.y)
        SELECT page_id, rule, CASE WHEN v IS NOT NULL THEN v WHEN node IN (SELECT y FROM c) THEN 'block' ELSE 'allow' END AS verdict, v IS NULL AND node IN (SELECT y FROM c) AS reached FROM b
    """,
    "op11_line_dedup": r"""
        WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        x AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
              FROM l, unnest(range(1, len(ls) + 1)) AS u(i)),
        s AS (SELECT k, max(doc_id) AS own FROM x WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT x.*, s.k IS NOT NULL AND x.doc_id <> s.own AS lost FROM x LEFT JOIN s ON x.k = s.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE e AS (
            SELECT doc_id, source, text, (CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END) || (CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END)
                || (CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) || (CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                -- crc32, a bit at a time
                xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
                    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda p, q: xor(p >> 1, (p & 1) * 3988292384))), 4294967295::UBIGINT) AS crc
            FROM documents),
        d AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
                     CASE WHEN crc % 5 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(low) || ':' || low END) END AS altered FROM e),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
        t AS (SELECT source, idx, leaf AS h, n, 0 AS lvl FROM r
              UNION ALL SELECT source, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16, lvl + 1 FROM t WHERE n > 1 GROUP BY source, idx // 16, n, lvl),
        s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (SELECT idx, h, n, 0 AS lvl FROM s UNION ALL SELECT idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16, lvl + 1 FROM u WHERE n > 1 GROUP BY idx // 16, n, lvl),
        w AS (SELECT r.doc_id, r.leaf, t.lvl, coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (WHERE t.idx < r.idx // (16 ** t.lvl)::BIGINT), '') AS l, coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (WHERE t.idx > r.idx // (16 ** t.lvl)::BIGINT), '') AS g
              FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source AND t.n > 1 AND t.idx // 16 = r.idx // (16 ** (t.lvl + 1))::BIGINT GROUP BY r.doc_id, r.leaf, t.lvl),
        v AS (SELECT s.source, 100 + u.lvl AS lvl, coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (WHERE u.idx < s.idx // (16 ** u.lvl)::BIGINT), '') AS l, coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (WHERE u.idx > s.idx // (16 ** u.lvl)::BIGINT), '') AS g
              FROM s JOIN u ON u.n > 1 AND u.idx // 16 = s.idx // (16 ** (u.lvl + 1))::BIGINT GROUP BY s.source, u.lvl),
        p AS (SELECT doc_id, leaf, list(l ORDER BY lvl) AS l, list(g ORDER BY lvl) AS g FROM (
                  SELECT doc_id, leaf, lvl, l, g FROM w UNION ALL SELECT r.doc_id, r.leaf, v.lvl, v.l, v.g FROM r JOIN v ON v.source IS NOT DISTINCT FROM r.source) GROUP BY doc_id, leaf),
        f AS (SELECT r.doc_id, r.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(p.l, []) AS l, coalesce(p.g, []) AS g, coalesce(r.altered, r.leaf) AS now
              FROM r JOIN s ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN p ON p.doc_id = r.doc_id AND p.leaf = r.leaf),
        b AS (SELECT doc_id, 0 AS i, now AS h FROM f UNION ALL SELECT f.doc_id, b.i + 1, sha256(f.l[b.i + 1] || b.h || f.g[b.i + 1]) FROM b JOIN f ON f.doc_id = b.doc_id WHERE b.i < len(f.l))
        SELECT f.doc_id, f.leaf, f.subroot, f.root, sha256(array_to_string(list_transform(range(1, len(f.l) + 1), lambda i: f.l[i] || f.g[i]), '')) AS proof_sha256, b.h AS folded_root, b.h = f.root AS verified
        FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = len(f.l)
    """,
    "op13_hard_negatives": r"""
        WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM q a JOIN q r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
}
