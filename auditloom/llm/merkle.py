"""Merkle manifest of a dataset, in higher-order SQL blocks.

Every row is a leaf. Per source the leaves ascend by doc_id, and runs of 16 nodes become their hash until one node remains: the source's
subroot; subroots, by source, likewise make the root. Nodes are numbered by a range-partitioned sort and running totals of the
partitions' counts, so no task orders a whole source. A block is an ordered array of 16 ** 3 nodes: ``aggregate`` over the levels,
``transform`` over a ``sequence`` of runs and ``slice`` of each collapse it natively, and the block's roots are the nodes of the next round,
log(n) / log(4096) rounds in all. Proofs go the other way: a block hands the siblings above it to its members.

Defined results: a null value hashes as ``-``; a null source is first; null ids come first in their source; rows that repeat a doc_id are
leaves of their own, ordered by their leaf; rows that repeat wholly are interchangeable; a null doc_id counts as the empty text for its crc32; a single row is
leaf, subroot and root at once, with the hash of nothing as its proof; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Nodes of a run, and levels of a block.
ARITY, DEPTH = 16, 3
#: Rows of the partitions' counts up to which they are broadcast.
SMALL = 300_000
_PATH = "array<struct<l:string,r:string>>"


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The hash of a row's values, each with its length in bytes."""
    return F.sha2(F.concat(*(_encoded(v) for v in values)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, digest, altered): a row's leaf, and the leaf after tampering with every fifth id's text."""
    d = docs
    head = [d["doc_id"].cast("long"), d["source"], d["lang"], d["n_chars"].cast("long")]
    text = d["text"].cast("string")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = leaf_of(*head, text)
    altered = F.when((common.id_mod(d["doc_id"].cast("long"), 5) == 0) & (lowered != text), leaf_of(*head, lowered))
    # the byte order of a source is that of its string; null goes before every string
    key = F.coalesce(F.concat(F.lit("1"), d["source"].cast("string")), F.lit(""))
    return d.select(key.alias("key"), d["doc_id"].cast("long").alias("doc_id"), leaf.alias("digest"), altered.alias("altered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx, their place in their key from 0, and n, the key's rows. ``rows`` is a written table with a column key."""
    spark = rows.sparkSession
    # rows that are alike in all of this are interchangeable; their own number lets them fall into several ranges
    dealt = rows.withColumn("_row", F.monotonically_increasing_id())
    by = ["key", *order, "_row"]
    placed = dealt.repartitionByRange(common.parts(spark), *by).sortWithinPartitions(*by).drop("_row").withColumn("_at", F.monotonically_increasing_id())
    placed = common.written(placed, "ordered").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part", "key").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = W.partitionBy("key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", "key", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(W.partitionBy("key")).alias("n")
    )
    offsets = common.small_side(common.written(offsets, "offsets"), SMALL)
    return placed.join(offsets, ["_part", "key"]).withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def _levels_of(n: Column, depth: int) -> Column:
    """Levels that n nodes collapse within a block: until one remains, ``depth`` at most."""
    out = F.lit(depth)
    for d in range(depth - 1, -1, -1):
        out = F.when(n <= ARITY**d, d).otherwise(out)
    return out.cast("int")


def _upto(n: Column) -> Column:
    """0 to n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def collapsed(digests: Column, levels: Column) -> Column:
    """An ordered array of digests to the arrays of its levels, its own first."""

    def up(made: Column, _: Column) -> Column:
        below = F.element_at(made, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / ARITY).cast("int"))
        return F.concat(made, F.array(F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(F.element_at(made, -1), i * ARITY + 1, ARITY), "").cast("binary"), 256))))

    return F.aggregate(_upto(levels), F.array(digests), up)


def blocks(nodes: DataFrame, depth: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, block, n, items, levels) of nodes (key, idx, n, digest, extra), written."""
    size = ARITY**depth
    gathered = nodes.groupBy("key", F.floor(F.col("idx") / size).cast("long").alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("idx", "digest", *extra))).alias("items"))
    return common.written(gathered.withColumn("levels", collapsed(F.col("items.digest"), _levels_of(F.col("n"), depth))), "merkle-blocks")


def _top(block: DataFrame) -> Column:
    return F.element_at(F.element_at(block["levels"], -1), 1)


def tree(nodes: DataFrame, depth: int, extra: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, and (key, digest) of the keys' roots."""
    rounds, roots, size = [], [], ARITY**depth
    while True:
        made = blocks(nodes, depth, extra if not rounds else ())
        rounds.append(made)
        roots.append(made.where(F.col("n") <= size).select("key", _top(made).alias("digest")))
        rest = made.where(F.col("n") > size)
        if rest.isEmpty():
            break
        nodes = rest.select("key", F.col("block").alias("idx"), F.ceil(F.col("n") / size).cast("long").alias("n"), _top(made).alias("digest"))
    every = roots[0]
    for more in roots[1:]:
        every = every.unionByName(more)
    return rounds, common.written(every, "merkle-roots")


def _within(levels: Column, at: Column) -> Column:
    """The siblings, left and right, of the member at place ``at`` (from 0), on each level of its block."""

    def siblings(j: Column) -> Column:
        nodes, own = F.element_at(levels, j + 1), F.floor(at / F.pow(F.lit(float(ARITY)), j)).cast("int")
        # bound to names, so that they are computed once
        return F.transform(
            F.array(F.struct(nodes.alias("nodes"), own.alias("own"), (own % ARITY).alias("left"))),
            lambda x: F.struct(F.array_join(F.slice(x["nodes"], x["own"] - x["left"] + 1, x["left"]), "").alias("l"), F.array_join(F.slice(x["nodes"], x["own"] + 2, F.lit(ARITY - 1) - x["left"]), "").alias("r")),
        )[0]

    return F.transform(_upto(F.size(levels) - 1), siblings)


def _members(made: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """A round's blocks with the path and subroot of their root; above has (key, block, path, subroot), block null for keys of one block."""
    single = F.col("n") <= ARITY**depth
    blocks_of = made.withColumn("_block", F.when(~single, F.col("block")))
    over = above.select(F.col("key").alias("_key"), F.col("block").alias("_over"), "path", "subroot")
    return blocks_of.join(over, (F.col("key") == F.col("_key")) & F.col("_block").eqNullSafe(F.col("_over"))).drop("_key", "_over", "_block")


def paths(rounds: list[DataFrame], tops: DataFrame, depth: int) -> DataFrame:
    """The first round's blocks with the path above each and its subroot; tops has (key, path, subroot) of the keys' roots."""
    roots = tops.select("key", F.lit(None).cast("long").alias("block"), "path", "subroot")
    above = roots
    for made in reversed(rounds[1:]):
        inner = _members(made, above, depth)
        each = F.transform("items", lambda x, i: F.struct(x["idx"].alias("block"), F.concat(_within(F.col("levels"), i), F.col("path")).alias("path")))
        below = inner.select("key", "subroot", F.explode(each).alias("x")).select("key", "x.block", "x.path", "subroot")
        above = common.written(roots.unionByName(below), "merkle-paths")
    return _members(rounds[0], above, depth)


def proof_of(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["l"], node, x["r"]).cast("binary"), 256))


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = common.written(leaves(docs), "leaves")
    rounds, subroots = tree(numbered(rows, ["doc_id", "digest"]), depth, ("doc_id", "altered"))
    # the subroots are the leaves of one more tree, under one key
    over = numbered(common.written(subroots.select(F.lit("").alias("key"), F.col("key").alias("source"), "digest"), "subroots"), ["source"])
    upper, root = tree(over, depth, ("source",))
    found = root.first()
    tops = root.select("key", F.array().cast(_PATH).alias("path"), F.col("digest").alias("subroot"))
    sources = paths(upper, tops, depth).select(
        F.explode(F.transform("items", lambda x, i: F.struct(x["source"].alias("key"), F.concat(_within(F.col("levels"), i), F.col("path")).alias("path"), x["digest"].alias("subroot")))).alias("x")
    )
    made = paths(rounds, common.written(sources.select("x.*"), "source-paths"), depth)

    def checked(x: Column, i: Column) -> Column:
        path = F.concat(_within(F.col("levels"), i), F.col("path"))
        return F.transform(
            F.array(path),
            lambda p: F.struct(x["doc_id"].alias("doc_id"), x["digest"].alias("leaf"), proof_of(p).alias("proof_sha256"), folded(F.coalesce(x["altered"], x["digest"]), p).alias("folded_root")),
        )[0]

    each = made.select("subroot", F.explode(F.transform("items", checked)).alias("x"))
    top = F.lit(found["digest"] if found else None).cast("string")
    return each.select("x.doc_id", "x.leaf", "subroot", top.alias("root"), "x.proof_sha256", "x.folded_root", (F.col("x.folded_root") == top).alias("verified"))
