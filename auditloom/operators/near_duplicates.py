"""Near-duplicate texts by word shingles: pairs by a filtered prefix join, clusters by a spanning forest.

Shingles are 64-bit hashes of k words. Texts with equal sets of shingles are one class, of which one text stands for the others. A text's shingles are
ordered by an estimate of how common they are, rare ones first; two sets over the threshold share a shingle among the first
n - ceil(t n) + 1 of each (prefix filter). Where the first shared one stands bounds what can follow (positional filter). Of the pairs that are left,
a parity sketch of both sets bounds their symmetric difference from below (in place of a suffix filter), before the sets themselves are compared.

Clusters need no table of pairs. First every member of a shingle's list is compared with one of its members only, so that a family of m near copies
costs little more than m comparisons; what they connect is joined to components. Only lists that still hold several components are gone
through, and there only pairs across components. No link between two classes is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import scratch
from auditloom.functions import text

from .components import connected_components

#: Buckets of the estimate of how common a shingle is (a byte each goes to the tasks), and of a slice of them; bits of a sketch, in 64s; rows of a side that is broadcast.
BUCKETS, SLICE, WORDS, SMALL = 1 << 20, 1 << 16, 16, 200_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number over all of it."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words, given the words' hashes."""
    n, total = len(words) - k + 1, None
    if n < 1:
        return np.zeros(0, np.int64)
    for j in range(k):
        part = words[j : j + n]
        total = part.copy() if total is None else total * _MULTIPLIER + part
    return np.unique(_mixed(total).view(np.int64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of a set in ``64 * WORDS`` places: two sets differ in at least as many elements as their sketches in places."""
    at = _mixed(hashes.view(np.uint64)) % np.uint64(64 * WORDS)
    odd = np.bincount(at.astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def shingle_sets(pages: DataFrame, key: str, k: int) -> DataFrame:
    """(id, n, digest, s, bits) of the texts with k words or more: sorted hashes of their shingles, and their sketch. Written."""
    kind = pages.schema[key].dataType
    words = pages.select(F.col(key).alias("id"), text.words(F.col("text")).alias("w")).where(F.size("w") >= k)
    hashed = words.select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, ends = column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            sets = [shingle_hashes(flat[a:b], k) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64())), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))], names=["id", "n", "s", "bits"]
            )

    made = hashed.mapInArrow(run, f"id {kind.simpleString()}, n int, s array<long>, bits array<long>")
    digest = F.struct(F.col("n"), F.xxhash64("s").alias("x"), F.xxhash64(F.lit(1), "s").alias("y"))
    return scratch.written(made.select("id", "n", digest.alias("digest"), "s", "bits"), "shingle-sets")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def first_texts(pages: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The pages without those whose whole text an earlier key has, and (a, b) of these: the first key of their text, and their own. Written."""
    hashed = pages.where("text IS NOT NULL").select(F.col(key).alias("id"), F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"))
    groups = hashed.groupBy("x", "y").agg(F.min("id").alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
    same = hashed.join(_small(scratch.written(groups, "same-texts")), ["x", "y"]).where("a < id").select("a", F.col("id").alias("b"))
    same = scratch.written(same, "text-copies")
    return pages.join(_small(same.select(F.col("b").alias(key))), key, "left_anti"), same


def classes(sets: DataFrame) -> DataFrame:
    """(a, b) for each text b whose set equals that of a, the smallest id of the class."""
    first = sets.groupBy("digest").agg(F.min("id").alias("a"))
    return sets.select("digest", F.col("id").alias("b")).join(first, "digest").where("a < b").select("a", "b")


def prepared(pages: DataFrame, key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Sets of one text of each class, and (a, b) of each class's first text with its others. Both written."""
    firsts, copies = first_texts(pages, key)
    sets = shingle_sets(firsts, key, k)
    alike = scratch.written(classes(sets), "same-sets")
    # a copy belongs to the class of the first with its text, if that has a set
    named = alike.select(F.col("a").alias("first"), F.col("b").alias("a"))
    of_copies = copies.join(sets.select(F.col("id").alias("a")), "a", "left_semi").join(named, "a", "left").select(F.coalesce("first", "a").alias("a"), "b")
    return representatives(sets, alike), scratch.written(alike.unionByName(of_copies), "class-members")


def representatives(sets: DataFrame, same: DataFrame) -> DataFrame:
    """One text of each class; ``same`` is a written table of (a, b)."""
    return sets.join(_small(same.select(F.col("b").alias("id")).distinct()), "id", "left_anti")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of the buckets of all its shingles, packed in slices."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount(batch.column(0).flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
    blobs = [zlib.compress(part.astype(np.uint32 if part.max() < 1 << 32 else np.uint64).tobytes(), 1) for part in total.reshape(-1, SLICE)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs)], names=["slice", "counts"])


def _unpacked(blob: bytes) -> np.ndarray:
    raw = zlib.decompress(blob)
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * SLICE else np.uint64)


def _added(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of a slice."""
    total, at = np.zeros(SLICE, np.uint64), None
    for batch in groups:
        for at, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total += _unpacked(blob)
    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)])], names=["slice", "counts"])


def commonness(sets: DataFrame) -> np.ndarray:
    """For each bucket of hashes, how far the number of its shingles stands out from chance: 0, or one more than the binary logarithm of the excess."""
    slices = sets.select("s").mapInArrow(_counted, "slice int, counts binary").groupBy("slice").applyInArrow(_added, "slice int, counts binary").collect()
    found = np.zeros(BUCKETS)
    for r in slices:
        found[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = _unpacked(r["counts"])
    usual = np.median(found)
    excess = found - usual - 5 * np.sqrt(usual)
    return np.where(excess >= 1, 1 + np.log2(np.maximum(excess, 1)), 0).astype(np.uint8)


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, h, place) of the first shingles of every set, in an order from rare to common; only those that two sets or more have. Written."""
    weight = commonness(sets)
    kind = sets.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = batch.column(2), batch.column(1).to_numpy()
            flat = column.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            # any order common to all sets is right; this one has the shingles of crowded buckets last
            order = np.lexsort((flat, weight[flat & (BUCKETS - 1)], row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            kept = place < np.repeat(n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[kept])), pa.array(n[row[kept]], pa.int32()), pa.array(flat[order][kept]), pa.array(place[kept], pa.int32())], names=["id", "n", "h", "place"])

    each = scratch.written(sets.select("id", "n", "s").mapInArrow(run, f"id {kind.simpleString()}, n int, h long, place int"), "prefixes")
    shared = each.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    return scratch.written(each.join(_small(scratch.written(shared, "shared-shingles")), "h", "left_semi").select("id", "n", "h", "place"), "shared-prefixes")


def _possible(threshold: float, a: str = "a", b: str = "b") -> Column:
    """Whether two sets of these sizes can meet the threshold with their first shared shingle where it stands."""
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    needed = F.ceil(F.lit(threshold / (1 + threshold)) * (na + nb) - 1e-9)
    rest = 1 + F.least(na - F.col(f"place{a}") - 1, nb - F.col(f"place{b}") - 1)
    return (na >= threshold * nb - 1e-9) & (nb >= threshold * na - 1e-9) & (rest >= needed)


def _sided(df: DataFrame, side: str, *more: str) -> DataFrame:
    return df.select("h", F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("place").alias(f"place{side}"), *(F.col(c).alias(f"{c}{side}") for c in more))


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs (a, b) whose sets meet the threshold; sketches are compared first, whole sets only of what is left."""
    short = sets.select("id", "n", "bits")
    for side in ("a", "b"):
        candidates = candidates.join(short.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits{side}")), side)
    apart = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = (1 + threshold) * apart <= (1 - threshold) * (F.col("na") + F.col("nb")) + 1e-6
    left = scratch.written(candidates.where(near).select("a", "b"), "candidates")
    # only sets that some pair needs are shuffled
    needed = scratch.written(left.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed")
    whole = sets.join(_small(needed), "id", "left_semi")
    met = left.join(whole.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return met.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def pairs(pages: DataFrame, key: str, threshold: float = 0.75, k: int = 8) -> DataFrame:
    """(a, b, jaccard) of the representatives' pairs over the threshold, and of each class the pairs of its first text with the others, at 1."""
    reps, same = prepared(pages, key, k)
    each = prefixes(reps, threshold)
    met = _sided(each, "a").join(_sided(each, "b"), "h").where((F.col("a") < F.col("b")) & _possible(threshold))
    found = verified(met.select("a", "b").distinct(), reps, threshold)
    return found.unionByName(same.select("a", "b", F.lit(1.0).alias("jaccard")))


def _starred(each: DataFrame, threshold: float) -> DataFrame:
    """Pairs of every member of a shingle's list with the list's first, by id, so that the lists of a family mostly agree on it."""
    firsts = each.groupBy("h").agg(F.min(F.struct("id", "n", "place")).alias("x"))
    star = firsts.select("h", F.col("x.id").alias("a"), F.col("x.n").alias("na"), F.col("x.place").alias("placea"))
    return _ordered(_sided(each, "b").join(star, "h").where((F.col("a") != F.col("b")) & _possible(threshold)))


def _across(each: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of members of a list that are in unlike components; those of the list's largest component aren't paired among themselves."""
    marked = each.join(parts.withColumnsRenamed({"node": "id", "component": "part"}), "id", "left").withColumn("part", F.coalesce("part", "id"))
    counts = marked.groupBy("h", "part").agg(F.count("*").alias("m"))
    split = scratch.written(counts.groupBy("h").agg(F.count("*").alias("parts"), F.max(F.struct("m", "part")).alias("top")).where("parts > 1").select("h", F.col("top.part").alias("top")), "split-lists")
    rest = scratch.written(marked.join(_small(split), "h"), "split-members")
    x, y = _sided(rest, "a", "part", "top").where("parta <> topa"), _sided(rest, "b", "part", "top")
    once = (F.col("partb") == F.col("topb")) | (F.col("a") < F.col("b"))
    return _ordered(x.join(y, "h").where((F.col("parta") != F.col("partb")) & once & _possible(threshold)))


def forest(pages: DataFrame, key: str, threshold: float = 0.75, k: int = 8) -> tuple[DataFrame, dict]:
    """((node, component) of the texts with a near duplicate, the numbers of compared pairs by step)."""
    reps, same = prepared(pages, key, k)
    each = prefixes(reps, threshold)
    first = scratch.written(_starred(each, threshold), "star-pairs")
    links = scratch.written(verified(first, reps, threshold).select("a", "b"), "links")
    parts = scratch.written(connected_components(links), "parts")
    rest = scratch.written(_across(each, parts, threshold), "pairs-across")
    compared = {"star": first.count(), "across": rest.count()}
    edges = same
    if compared["across"]:
        edges = edges.unionByName(verified(rest, reps, threshold).select("a", "b"))
    # a component stands for its members: one edge each
    return connected_components(edges.unionByName(parts.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))), compared
