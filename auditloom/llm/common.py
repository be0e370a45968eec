"""What the operators of this subpackage share: scratch tables, text columns, partition counts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.scratch import cut, mark, release, shared_dir, written  # noqa: F401

#: The whitespace of all contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of whole texts handed to Python at once; Spark also bounds a batch by bytes.
BATCH_ROWS = "1000"


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches of whole texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text as a string, null as the empty one."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def id_text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def id_mod(col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(id_text(col).cast("binary")) % F.lit(m)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _released() -> None:
    """Give free memory back: workers serve many tasks, and would keep what the largest took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow that leaves the worker lean behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _released()

    return df.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that are sorted by keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows - 1, dtype=bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1), b.num_rows]
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, e - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def small_side(df: DataFrame, most: int) -> DataFrame:
    """A join side of few short columns, with a broadcast hint if it is counted to have at most ``most`` rows. Pass a checkpointed or written side."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
