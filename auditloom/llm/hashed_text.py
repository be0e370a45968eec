"""Hashed text features shared by the quality and the domain classifier, and what both do with the labels table."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 18
DIM = 1 << BITS
#: Picked labels up to which they are broadcast, so that texts stay where they are.
SMALL = 500_000
_UPPER = bytes(range(65, 91))
_MARKS = b"!$#%|&*<>{}_~^="


def bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) & (DIM - 1)


class Buckets(dict):
    """Of a raw word: the bucket of its core, and above it one more than the bucket of its shape, 0 if it has none; forgets all when full."""

    def __init__(self):
        super().__init__()
        self.shapes: dict[tuple, int] = {}

    def __missing__(self, raw: str) -> int:
        if len(self) > 200_000:
            self.clear()
        if raw.islower() and raw.isalpha():
            v = bucket(raw)
        else:
            core = raw.strip(string.punctuation)
            at = raw.index(core)
            shape = (raw[: min(at, 3)], raw[at + len(core) :][:3], len(core) > 1 and core.isupper())
            more = self.shapes.get(shape)
            if more is None:
                more = self.shapes[shape] = (1 + bucket("\x01{}\x02{}\x02{}".format(*shape))) << BITS
            v = bucket(core.lower()) | more
        self[raw] = v
        return v

    def step(self, name: str, value: int) -> int:
        """The bucket of one of the few values of a count."""
        if (name, value) not in self.shapes:
            self.shapes[name, value] = bucket(f"\x03{name}{value}")
        return self.shapes[name, value]


def featured(text: str, buckets: Buckets) -> tuple[np.ndarray, int]:
    """Distinct buckets of a whole text (words, their shapes, and a few counts of the text in steps), and its number of words."""
    words = text.split()
    distinct = set(words)
    found = np.fromiter(map(buckets.__getitem__, distinct), np.int64, len(distinct))
    shapes = found >> BITS
    lines = text.split("\n")
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    steps = {
        "twice": int(10 * (1 - len(set(lines)) / len(lines))),
        "marks": min(10, int(40 * (n - len(raw.translate(None, _MARKS))) / n)),
        "upper": int(10 * (n - len(raw.translate(None, _UPPER))) / n),
        "length": len(words).bit_length(),
        "word": min(12, int(n / max(1, len(words)))),
        "variety": int(10 * len(distinct) / max(1, len(words))),
    }
    of_text = np.array([buckets.step(k, v) for k, v in steps.items()])
    return np.unique(np.concatenate([found & (DIM - 1), shapes[shapes > 0] - 1, of_text])), len(words)


def features(text: str, buckets: Buckets) -> np.ndarray:
    return featured(text, buckets)[0]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets = Buckets()
    for b in batches:
        at = [np.sort(features(t, buckets)).astype(np.uint32).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.binary()), b.column(2)], names=["y", "at", "order"])


def labelled_sample(docs: DataFrame, labels: DataFrame, target, rows: int) -> list[tuple[np.ndarray, int]]:
    """About ``rows`` labelled documents by a hash of doc_id: (buckets, label), in a fixed order. ``target`` is a column of labels, null where a row has no label; of a document's several labels the smallest counts."""
    unit = F.xxhash64(common.id_text(labels["doc_id"]), F.lit("labels")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    known = labels.select(labels["doc_id"].cast("long").alias("_id"), target.cast("int").alias("_y"), unit.alias("_u")).where("_y IS NOT NULL AND _id IS NOT NULL").groupBy("_id", "_u").agg(F.min("_y").alias("_y"))
    total = known.count()
    picked = common.cut(known.where(F.col("_u") < min(1.0, rows / max(1, total))))
    texts = docs.select(docs["doc_id"].cast("long").alias("_id"), common.text_of(docs).alias("_t"))
    got = texts.join(common.small_side(picked, SMALL), "_id").select("_y", "_t", F.xxhash64("_id", F.lit("order"))).transform(common.arrow, _sampled, "y int, at binary, order long").collect()
    got.sort(key=lambda r: (r["order"], r["y"], r["at"]))
    return [(np.frombuffer(r["at"], np.uint32).astype(np.int64), r["y"]) for r in got]


def unit_of(text: str) -> float:
    """A number in [0, 1) by hash of a text."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=1) / 2.0**64


def scored(docs: DataFrame, score: Callable[[list[np.ndarray]], list[np.ndarray]], names: list[str], count: bool = False) -> DataFrame:
    """doc_id, a double for each name, and if ``count`` the number of words and the text's ``unit``; score maps feature arrays to one array for each name."""
    common.prepare(docs.sparkSession)

    def run(batches):
        buckets = Buckets()
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [featured(t, buckets) for t in texts]
            made = score([r for r, _ in rows])
            more = [pa.array([n for _, n in rows], pa.int64()), pa.array([unit_of(t) for t in texts], pa.float64())] if count else []
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.float64()) for x in made), *more], names=["doc_id", *names, *["n_tokens", "unit"] * count])

    schema = ", ".join(["doc_id long", *(f"`{n}` double" for n in names), *["n_tokens long", "unit double"] * count])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text")).transform(common.arrow, run, schema)


def sums(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Sum of the weights at each row's buckets."""
    return np.array([weights[r].sum(axis=0) for r in rows]).reshape(len(rows), *weights.shape[1:])
