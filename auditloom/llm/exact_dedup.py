"""Exact deduplication with Patricia-trie owners.

Rows are dealt by byte length and content hash. Each input partition first folds its own copies in a trie, so
that a group of copies of any size sends at most one row for each task and flush; the tasks behind the shuffle
insert whole byte strings into their own trie, whose terminals own the smallest doc_id.

Defined results: a null text is the empty text; a null doc_id is larger than any other, so it owns a group only
where all ids are null; rows that repeat the owner's doc_id are one document and all marked kept by
``owners`` - ``deduplicate`` returns one row of them. An empty table gives an empty table. Other columns of the
input are not read by ``owners`` and pass through ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .trie import PatriciaTrie

#: Bytes of trie that a task holds before it sends off (map side) or spills (behind the shuffle).
MAP_BYTES, TASK_BYTES = 48 << 20, 192 << 20
#: Rows of a group from which it is dealt to several tasks, and groups of that size up to which their list is broadcast.
HOT_ROWS, SMALL = 1_000, 500_000
_FOLDED = pa.schema([("n_bytes", pa.int64()), ("sha", pa.binary()), ("norm", pa.binary()), ("id", pa.int64()), ("rows", pa.int64()), ("ties", pa.int64())])
_OWNED = pa.schema([("n_bytes", pa.int64()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("ties", pa.int64())])


def normalized(text: Column) -> Column:
    """Every run of whitespace as one space."""
    return F.regexp_replace(text, common.SPACE, " ")


def _keyed(docs: DataFrame) -> DataFrame:
    norm = normalized(common.text_of(docs)).cast("binary")
    return docs.select(docs["doc_id"].cast("long").alias("id"), norm.alias("norm")).select(
        "id", "norm", F.octet_length("norm").cast("long").alias("n_bytes"), F.unhex(F.sha2("norm", 256)).alias("sha")
    )


def _fold(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    trie, held = PatriciaTrie(1 << 62), 0

    def sent(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], [], [], []]
        size = 0
        for text, own in trie.drain():
            for column, x in zip(rows, (len(text), own.tag, text, own.id, own.rows, own.ties), strict=True):
                column.append(x)
            size += len(text)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _FOLDED.types, strict=True)], schema=_FOLDED)
                rows, size = [[], [], [], [], [], []], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _FOLDED.types, strict=True)], schema=_FOLDED)

    for batch in batches:
        for id_, norm, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            trie.insert(norm, id_, tag=sha)
            if trie.size > budget:
                yield from sent(trie)
                held += 1
    yield from sent(trie)


def _own(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    trie = PatriciaTrie(budget)
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("norm", "id", "rows", "ties", "sha")]
        for norm, id_, rows, ties, sha in zip(*columns, strict=True):
            trie.insert(norm, id_, rows, ties, sha)
    out: list[tuple] = []
    for text, own in trie.drain():
        out.append((len(text), own.tag, own.id, own.rows, own.ties))
        if len(out) == 20_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OWNED.types, strict=True)], schema=_OWNED)


def groups(docs: DataFrame, map_bytes: int = MAP_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row for each distinct normalised text: n_bytes, sha, keep_id, group_size, ties (rows that bear keep_id)."""
    common.prepare(docs.sparkSession)
    folded = _keyed(docs).select("id", "norm", "sha").transform(common.arrow, lambda it: _fold(it, map_bytes), "n_bytes long, sha binary, norm binary, id long, rows long, ties long")
    return folded.repartition(F.col("n_bytes"), F.col("sha")).transform(common.arrow, lambda it: _own(it, task_bytes), "n_bytes long, sha binary, keep_id long, group_size long, ties long")


def owners(docs: DataFrame, hot_rows: int = HOT_ROWS, **sizes: int) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Rows find their group by a join; a group of ``hot_rows`` or more is dealt to several tasks by doc_id, its owner's row copied to each.
    """
    found = common.written(groups(docs, **sizes), "owners")
    salts = F.ceil(F.col("group_size") / hot_rows).cast("int")
    hot = found.where(F.col("group_size") >= hot_rows).select("n_bytes", "sha", salts.alias("salts"))
    salt = F.coalesce(F.pmod(F.xxhash64("id"), "salts").cast("int"), F.lit(0))
    rows = _keyed(docs).select("id", "n_bytes", "sha").join(common.small_side(hot, SMALL), ["n_bytes", "sha"], "left").withColumn("salt", salt)
    dealt = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("group_size") >= hot_rows, salts - 1).otherwise(F.lit(0)))))
    return rows.join(dealt, ["n_bytes", "sha", "salt"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, **sizes: int) -> DataFrame:
    """The row with the smallest doc_id of each group of equal texts, with all columns of docs."""
    norm = normalized(common.text_of(docs)).cast("binary")
    found = common.written(groups(docs, **sizes), "owners").select(F.col("n_bytes").alias("_al_n"), F.col("sha").alias("_al_sha"), F.col("keep_id").alias("_al_own"), F.col("ties").alias("_al_ties"))
    keyed = docs.withColumns({"_al_norm_n": F.octet_length(norm).cast("long"), "_al_norm_sha": F.unhex(F.sha2(norm, 256))})
    same = (F.col("_al_norm_n") == F.col("_al_n")) & (F.col("_al_norm_sha") == F.col("_al_sha")) & docs["doc_id"].cast("long").eqNullSafe(F.col("_al_own"))
    kept = keyed.join(found.where("_al_ties = 1"), same, "left_semi").select(*(docs[c] for c in docs.columns))
    tied = found.where("_al_ties > 1")
    if tied.isEmpty():
        return kept
    # rows that repeat their owner's doc_id: one of them stays
    several = keyed.join(tied, same).dropDuplicates(["_al_norm_n", "_al_norm_sha"]).select(*(docs[c] for c in docs.columns))
    return kept.unionAll(several)
