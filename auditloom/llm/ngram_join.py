"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of its distinct k-word shingles. Tokens of the set are hashed into groups; the counts by group
are a point; two sets overlap in at most the sum of the coordinate minima of their points. R-trees over the points
give the pairs that the bound can't exclude, and those are verified with the sets themselves.

One tree over all documents would be searched in nearly every node (the spread of random counts in many dimensions
exceeds the search radius only summed over all of them), so the points are first dealt to many small trees by the same
grouping: two sets of at most U tokens that reach the similarity differ in r = 2U(1-t)/(1+t) tokens or fewer, so of more
than r groups one at least holds the same tokens in both. Each document goes to the trees of its groups' contents, for
its own size level and the next. Levels step by 1/t, so that partners are in the same or in neighbouring levels.

Steps: (1) classes of equal sets, by a 128-bit digest; copies go no further than one row for each task. (2) Group
signatures, packed in binary blobs by bucket, one shuffle; only signatures with two classes or more remain. (3) A tree for
each signature; its pairs within the bound are joined to a spanning forest. A signature of more than ``SIG_CLASSES`` classes is cut to
blocks, and each pair of blocks is a tree. (4) Families: components of these edges. (5) Sets of a family are read again, searched in
a tree and verified; a pair whose ends are already connected isn't verified again. A family of several blocks is first verified against its
first block, each block in a task; then, only where it isn't connected yet, the sets outside of its largest part against all blocks.
(6) Components of the verified edges.

Work is linear in the number of shingles, besides pairs of blocks in a signature, and in a family of which large parts don't link.

Defined results: text null, empty or blank: no shingle, linked with nothing, component_id is its doc_id; rows with a
null doc_id take part in no link and have a null component_id; rows that repeat a doc_id are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.components import connected_components

from . import common
from .rtree import CountTree, Labels
from .shingles import WordHashes, mix, shingle_set

#: Rows of ids up to which a side is broadcast (about 50 MB); beyond it the join shuffles both.
SMALL = 1_000_000
#: Signatures in a blob, documents and shingles in a block of a family.
BLOB, BLOCK_DOCS, BLOCK_SHINGLES = 600_000, 2_000, 1_000_000
#: Classes of a signature up to which they stand in one tree.
SIG_CLASSES = 4_000


class Levels:
    """Sizes, allowed differences and numbers of groups by level, for similarity num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.step, self.known = num, den, math.log(den / num), {}

    def of(self, n: int) -> int:
        return int(math.log(n) / self.step + 1e-12)

    def groups(self, level: int) -> tuple[int, int]:
        """(groups, margin): one group more than can differ, and a margin for groups that are empty; (0, 0) if only equal sets can link."""
        if level not in self.known:
            most = math.ceil(math.exp((level + 1) * self.step) + 1e-9)
            r = 2 * most * (self.den - self.num) // (self.den + self.num)
            margin = 0
            for _ in range(20):
                g = r + 1 + margin
                empty = g * math.exp(-math.exp((level - 1) * self.step) / g)
                margin = min(r + 8, math.ceil(empty + 3 * math.sqrt(empty)))
            self.known[level] = (r + 1 + margin, margin) if r else (0, 0)
        return self.known[level]


def signatures(s: np.ndarray, levels: Levels) -> np.ndarray:
    """Of a set: the contents of its groups, for its level and the next."""
    if not len(s):
        return s
    out = []
    with np.errstate(over="ignore"):
        scrambled = mix(s + np.uint64(0x5851F42D4C957F2D))
        for level in (levels.of(len(s)), levels.of(len(s)) + 1):
            g, margin = levels.groups(level)
            if not g:
                continue
            at = (s % np.uint64(g)).astype(np.int64)
            held = np.bincount(at, minlength=g)
            content = np.zeros(g, np.uint64)
            np.add.at(content, at, scrambled)
            full = np.flatnonzero(held)
            # a pair of which both have more empty groups than the margin allows for meets in one of those
            some = np.arange(g) if g - len(full) > margin else full
            salt = np.uint64(level) * np.uint64(0x9E3779B97F4A7C15) + some.astype(np.uint64)
            out.append(mix(mix(content[some] + salt) + salt))
    return np.concatenate(out) if out else s[:0]


def fineness(n: int) -> int:
    """Binary logarithm of the number of groups: the larger a set, the finer, for random counts differ as their square root only."""
    return 6 if n < 1_000 else 8 if n < 4_000 else 10


def counts(s: np.ndarray, bits: int) -> np.ndarray:
    """A set's tokens by group; coarser groups are sums of neighbouring finer ones."""
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def packed_counts(s: np.ndarray) -> bytes:
    """The point of a set: a byte for its fineness and width, then counts in the narrowest of three widths."""
    bits = fineness(len(s))
    c = counts(s, bits)
    top = c.max(initial=0)
    width = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2
    return bytes([bits + 16 * width]) + c.astype((np.uint8, np.uint16, np.uint32)[width]).tobytes()


def unpacked(points: list[bytes], bits: int | None = None) -> np.ndarray:
    """Points as rows of one matrix, all as coarse as the coarsest, or as ``bits`` asks for."""
    bits = min(p[0] & 15 for p in points) if bits is None else bits
    out = np.empty((len(points), 1 << bits), np.int32)
    for i, p in enumerate(points):
        c = np.frombuffer(p, (np.uint8, np.uint16, np.uint32)[p[0] >> 4], offset=1)
        out[i] = c if len(c) == 1 << bits else c.reshape(1 << bits, -1).sum(axis=1)
    return out


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def short(d: bytes) -> int:
    """A class by its digest's first eight bytes; where two share them, both are searched."""
    return int.from_bytes(d[:8], "little", signed=True)


def _classes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        n, cls, point = [], [], []
        for text in b.column(1).to_pylist():
            s = shingle_set(text, k, hashes)
            n.append(len(s))
            cls.append(digest(s))
            point.append(packed_counts(s))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array([short(c) for c in cls], pa.int64()), pa.array(point, pa.binary())], names=["id", "n", "cls", "c64", "point"])


def _blobs(batches: Iterator[pa.RecordBatch], k: int, levels: Levels, buckets: int) -> Iterator[pa.RecordBatch]:
    hashes, seen = WordHashes(), set()
    sig: list[np.ndarray] = []
    cls: list[np.ndarray] = []
    held = 0

    def sent() -> Iterator[pa.RecordBatch]:
        s, c = np.concatenate(sig), np.concatenate(cls)
        at = (s % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=buckets))
        s, c = s[order], c[order]
        rows = [(i, s[a:e].tobytes(), c[a:e].tobytes()) for i, (a, e) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)) if e > a]
        for at in range(0, len(rows), 256):
            i, x, y = zip(*rows[at : at + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["bucket", "sig", "cls"])

    for b in batches:
        for text in b.column(1).to_pylist():
            s = shingle_set(text, k, hashes)
            if not len(s):
                continue
            c = short(digest(s))
            if c in seen:
                continue
            if len(seen) >= 200_000:
                seen.clear()
            seen.add(c)
            x = signatures(s, levels)
            if len(x):
                sig.append(x)
                cls.append(np.full(len(x), c, np.int64))
                held += len(x)
            if held >= BLOB:
                yield from sent()
                sig, cls, held = [], [], 0
    if held:
        yield from sent()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures with two classes or more; blobs of a partition may be of several buckets."""
    by: dict[int, tuple[list, list]] = {}
    for b in batches:
        for i, s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = by.setdefault(i, ([], []))
            x[0].append(np.frombuffer(s, np.uint64))
            x[1].append(np.frombuffer(c, np.int64))
    for i in list(by):
        sig, cls = (np.concatenate(x) for x in by.pop(i))
        order = np.argsort(sig, kind="stable")
        s = sig[order]
        same = s[1:] == s[:-1]
        run = np.append(False, same) | np.append(same, False)
        order = order[run]
        if not len(order):
            continue
        s, c = sig[order], cls[order]
        order = np.lexsort((c, s))
        s, c = s[order], c[order]
        new = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]))
        s, c = s[new], c[new]
        same = s[1:] == s[:-1]
        run = np.append(False, same) | np.append(same, False)
        s, c = s[run].view(np.int64), c[run]
        ends = np.flatnonzero(np.append(s[1:] != s[:-1], True)) + 1 if len(s) else np.zeros(0, np.int64)
        held = np.diff(ends, prepend=0)
        n = np.repeat(held, held)
        for at in range(0, len(s), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in (s, c, n)], names=["sig", "c64", "classes"])


def _whole_runs(batches: Iterator[pa.RecordBatch], key: str, least: int = 20_000) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables that no run of equal keys is cut by."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        if rows >= least and (keys[0] != held[-1].column(key)[held[-1].num_rows - 1].as_py() or keys[0] != keys[-1]):
            cut = int(np.argmax(keys != held[-1].column(key)[held[-1].num_rows - 1].as_py()))
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, rows = [b.slice(cut)], b.num_rows - cut
        else:
            held.append(b)
            rows += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _forest(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the pairs that each signature's tree can't exclude.

    Near copies share many signatures: trees of the same members are built once. Of two members the bound itself is the tree.
    """
    out: set[tuple[int, int]] = set()
    seen: set[bytes] = set()
    for t in _whole_runs(batches, "sig"):
        sig, ids, n = t["sig"].to_numpy(), t["rep"].to_numpy(), t["n"].to_numpy()
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        sizes = np.diff(np.append(starts, len(sig)))
        raw = t["point"].to_pylist()
        two = starts[sizes == 2]
        if len(two):
            lo, hi = np.minimum(ids[two], ids[two + 1]), np.maximum(ids[two], ids[two + 1])
            _, first = np.unique(np.stack([lo, hi]), axis=1, return_index=True)
            coarse = np.array([min(raw[i][0] & 15, raw[i + 1][0] & 15) for i in two[first]])
            for bits in np.unique(coarse):
                at = first[coarse == bits]
                i = two[at]
                bound = np.minimum(unpacked([raw[j] for j in i], bits), unpacked([raw[j + 1] for j in i], bits)).sum(axis=1, dtype=np.int64)
                at = at[bound * (num + den) >= num * (n[i] + n[i + 1])]
                out.update(zip(lo[at].tolist(), hi[at].tolist(), strict=True))
        for a, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            order = a + np.argsort(ids[a : a + size], kind="stable")
            mark = xxhash.xxh3_128_digest(ids[order].tobytes())
            if mark in seen:
                continue
            if len(seen) > 200_000:
                seen.clear()
            seen.add(mark)
            i_ids, i_n, points = ids[order], n[order], unpacked([raw[i] for i in order])
            tree, labels = CountTree(points, i_n, num, den), Labels(size)
            for i in range(size):
                near = tree.search(points[i], int(i_n[i]))
                near = near[labels.of[near] != labels.of[i]]
                if len(near):
                    _, first = np.unique(labels.of[near], return_index=True)
                    out.update((int(min(i_ids[i], i_ids[j])), int(max(i_ids[i], i_ids[j]))) for j in near[first])
                    labels.join(i, near)
        if len(out) > 50_000:
            yield _pairs(out)
            out = set()
    if out:
        yield _pairs(out)


def _pairs(pairs) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def linked_in(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int, parts: np.ndarray | None = None, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the links among the sets: tree search, then verification of what isn't connected yet.

    ``parts`` names what is connected already; only sets with ``asks`` are searched for.
    """
    n = np.array([len(s) for s in sets])
    bits = fineness(int(n.max(initial=0)))
    points = np.array([counts(s, bits) for s in sets], dtype=np.int32)
    tree, labels, out = CountTree(points, n, num, den), Labels(len(ids)), []
    if parts is not None:
        labels.of = np.unique(parts, return_inverse=True)[1]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    starts = ends - n
    member = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
    for i in range(len(ids)) if asks is None else np.flatnonzero(asks):
        near = tree.search(points[i], int(n[i]))
        near = near[labels.of[near] != labels.of[i]]
        if not len(near):
            continue
        mine = flat[starts[i] : ends[i]]
        member[mine] = True
        for at in range(0, len(near), 500):
            some = near[at : at + 500]
            some = some[labels.of[some] != labels.of[i]]
            if not len(some):
                continue
            both = np.array([np.count_nonzero(member[flat[starts[j] : ends[j]]]) for j in some])
            hit = some[den * both >= num * (n[i] + n[some] - both)]
            if len(hit):
                _, first = np.unique(labels.of[hit], return_index=True)
                out += [(int(ids[i]), int(ids[j])) for j in hit[first]]
                labels.join(i, hit)
        member[mine] = False
    return out


def _verify(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for t in common.runs(batches, ["family", "x", "y"]):
        ids = t["rep"].to_numpy()
        if len(ids) < 2:
            continue
        found = linked_in(ids, [shingle_set(x, k, hashes) for x in t["text"].to_pylist()], num, den, t["part"].to_numpy(), t["asks"].to_numpy(zero_copy_only=False))
        if found:
            yield _pairs(found)


def similar(docs: DataFrame, k: int, num: int, den: int, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES, sig_classes: int = SIG_CLASSES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id; links are Jaccard similarities of num/den or more."""
    spark = common.prepare(docs.sparkSession)
    levels, parts = Levels(num, den), common.parts(spark)
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), common.text_of(docs).alias("text"))
    sets = common.written(texts.transform(common.arrow, lambda it: _classes(it, k), "id long, n long, cls binary, c64 long, point binary"), "sets")
    classes = common.written(
        sets.where("n > 0 AND id IS NOT NULL").groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("c64").alias("c64"), F.first("point").alias("point")), "classes"
    )
    blobs = texts.where("id IS NOT NULL").transform(common.arrow, lambda it: _blobs(it, k, levels, parts), "bucket int, sig binary, cls binary")
    shared = blobs.repartitionById(parts, F.col("bucket")).transform(common.arrow, _shared, "sig long, c64 long, classes long")
    points = shared.join(classes.select("c64", "rep", "n", "point"), "c64").select(_tree("sig", "rep", "classes", sig_classes).alias("sig"), "rep", "n", "point")
    edges = points.repartition(parts, "sig").sortWithinPartitions("sig").transform(common.arrow, lambda it: _forest(it, num, den), "a long, b long")
    families = connected_components(edges).withColumnRenamed("node", "rep").withColumnRenamed("component", "family")
    sized = families.join(classes.groupBy("rep").agg(F.sum("n").alias("n")), "rep")
    blocks = sized.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    blocked = common.cut(families.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))

    def verified(members: DataFrame) -> DataFrame:
        """Links found among members (rep, family, x, y, part, asks), each (family, x, y) in a task."""
        met = common.small_side(common.cut(members), SMALL).join(texts.withColumnRenamed("id", "rep"), "rep")
        sorted_in = met.repartition(4 * parts, "family", "x", "y").sortWithinPartitions("family", "x", "y", "rep")
        return common.cut(sorted_in.transform(common.arrow, lambda it: _verify(it, k, num, den), "a long, b long"))

    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = blocked.withColumn("y", F.explode(F.when(F.col("own") == 0, every).otherwise(F.array("own"))))
    links = verified(first.select("rep", "family", F.lit(0).alias("x"), "y", F.col("rep").alias("part"), F.lit(True).alias("asks")))
    linked = connected_components(links)
    large = blocked.where("blocks > 1")
    if not large.isEmpty():
        named = large.join(linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
        sizes = named.groupBy("family", "part").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.count("*").alias("parts"))
        rest = common.cut(named.join(sizes.where("parts > 1"), "family").select("rep", "family", "own", "blocks", "part", (F.col("part") != F.col("most")).alias("asks")))
        if not rest.isEmpty():
            asking = rest.where("asks").select("rep", "family", F.col("own").alias("x"), F.explode(every).alias("y"), "part", "asks")
            asked = rest.join(rest.where("asks").select("family", F.col("own").alias("x")).distinct(), "family").select("rep", "family", "x", F.col("own").alias("y"), "part", F.lit(False).alias("asks"))
            linked = connected_components(links.unionByName(verified(asking.unionByName(asked))))
    named = classes.select("cls", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("component"))
    return sets.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("cls")).alias("cls")).join(named, "cls", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def _tree(sig: str, rep: str, classes: str, most: int):
    """The tree of a class: its signature's, or one for each pair of blocks of a signature with many classes."""
    blocks = F.ceil(F.col(classes) / most).cast("int")
    own = F.pmod(F.xxhash64(rep), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.xxhash64(F.col(sig), F.least(own, other), F.greatest(own, other)))
    return F.explode(F.when(F.col(classes) > most, pairs).otherwise(F.array(sig)))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs whose doc_id names their component, with all columns; rows with a null doc_id stay."""
    gone = common.cut(similar(docs, k, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias("_al_gone")).distinct())
    return docs.join(common.small_side(gone, SMALL), docs["doc_id"].cast("long") == F.col("_al_gone"), "left_anti").select(*docs.columns)
