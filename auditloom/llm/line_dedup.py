"""Line deduplication with levelled sorted runs of line hashes.

``LineRuns`` keeps what is known of lines as runs: rows (h, g, docs, owner) sorted by a 128-bit hash of the line's key, in as many
buckets at each level. A batch's distinct lines are merge-anti-joined with the runs: what no run holds is new, and owned by the batch's
largest document that has it. Then the batch's own run goes to the lowest level; ``fanout`` runs of a level are compacted into one
of the next. Runs are bucketed tables, so neither joins nor compactions shuffle them again, and a line is rewritten once for each level.

``dedup`` feeds the documents in batches from the largest ids down, so that a line's owner is the largest document with it, then
reads the compacted runs for the lines that enough documents share. Rows of long lines are shuffled as hashes, never as text;
lines are pre-aggregated before their runs are made, and a line that very many documents share is dealt to several tasks.

Defined results: a null text is one empty line; a null doc_id is smaller than any other and one document; rows that repeat a doc_id are
one document, each row with its own lines; a line that a document has several times counts once and loses all its places; an empty table
gives an empty table. Other columns of the input are not read by ``dedup`` and pass through ``clean``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import scratch

from . import common

#: Least code points of a line's key, and least documents that share it, for it to be dropped.
MIN_CHARS, MIN_DOCS = 40, 5
#: Batches of a whole table; runs of a level that are compacted into one of the next.
BATCHES, FANOUT = 4, 2
#: Documents of a line from which it is dealt to several tasks; rows and positions of a broadcast side.
HOT_DOCS, SMALL, SMALL_PLACES = 1_000, 300_000, 1_000_000
_BLANK = " \t\n\x0b\x0c\r"


def key_of(line: Column) -> Column:
    """A line without outer whitespace, A to Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, text_hash, place, h, g) of every line whose key has ``min_chars`` code points or more."""
    text = common.text_of(docs)
    each = docs.select(docs["doc_id"].cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    keyed = each.where(F.length("line") >= min_chars).withColumn("key", key_of(F.col("line"))).where(F.length("key") >= min_chars)
    # two hashes of unlike seeds: 128 bits, so that no two of any number of lines meet
    return keyed.select("doc", "text_hash", "place", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(h, g, docs, last): documents that hold a line, and the largest of them; counted in parts before each shuffle."""
    return lines.select("h", "g", "doc").distinct().groupBy("h", "g").agg(F.count("*").alias("docs"), F.max("doc").alias("last"))


class LineRuns:
    """Runs by level, each level a table bucketed and sorted by (h, g): h, g, docs, owner; owner is null where an earlier batch has the line.

    Each level holds fewer than ``fanout`` runs. A join or a group on (h, g) reads a level's buckets in place.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets or common.parts(spark), max(2, fanout)
        self._name, self._tables = f"line_runs_{uuid.uuid4().hex}", 0
        #: (table, runs in it) of each level; None where the level is empty
        self.levels: list[tuple[str, int] | None] = []

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (h, g, ...) that no run holds: a merge-anti-join with each level."""
        for level in filter(None, self.levels):
            keys = keys.join(self.spark.table(level[0]).select("h", "g"), ["h", "g"], "left_anti")
        return keys

    def _owned(self, keys: DataFrame) -> DataFrame:
        """A batch as a run: the anti-join with every level, which also keeps the rows that it finds, without an owner."""
        seen = F.lit(False)
        for i, level in enumerate(self.levels):
            if level is not None:
                held = self.spark.table(level[0]).groupBy("h", "g").agg(F.lit(True).alias(f"in_{i}"))
                keys, seen = keys.join(held.hint("merge"), ["h", "g"], "left"), seen | F.col(f"in_{i}").isNotNull()
        return keys.select("h", "g", "docs", F.when(~seen, F.col("last")).alias("owner"))

    def add(self, keys: DataFrame) -> None:
        """Add a batch's (h, g, docs, last), one row for each line; lines that no run holds get their owner here."""
        self._put(0, self._owned(keys))

    def _put(self, level: int, run: DataFrame) -> None:
        """Append a run to its level; a full level is compacted into one run of the next."""
        while len(self.levels) <= level:
            self.levels.append(None)
        writer = run.write.format("parquet").bucketBy(self.buckets, "h", "g").sortBy("h", "g")
        if self.levels[level] is None:
            self._tables += 1
            table, runs = f"{self._name}_{self._tables}", 0
            writer.option("path", scratch.fresh_path(self.spark, table)).saveAsTable(table)
        else:
            table, runs = self.levels[level]
            writer.mode("append").saveAsTable(table)
        self.levels[level] = (table, runs + 1)
        if runs + 1 >= self.fanout:
            self._put(level + 1, self._summed(self.spark.table(table)))
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self.levels[level] = None

    @staticmethod
    def _summed(runs: DataFrame) -> DataFrame:
        return runs.groupBy("h", "g").agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner"))

    def lines(self, min_docs: int = 1) -> DataFrame:
        """(h, g, docs, owner) of the lines that ``min_docs`` documents or more hold."""
        parts = [self._summed(self.spark.table(level[0])) for level in filter(None, self.levels)]
        if not parts:
            return self.spark.createDataFrame([], "h long, g long, docs long, owner long")
        held = parts[0]
        for part in parts[1:]:
            held = held.unionByName(part)
        return (self._summed(held) if len(parts) > 1 else held).where(F.col("docs") >= min_docs)

    def drop(self) -> None:
        """Remove the runs; their files go with ``scratch.release``."""
        for level in filter(None, self.levels):
            self.spark.sql(f"DROP TABLE IF EXISTS {level[0]}")
        self.levels = []


def _batched(lines: DataFrame, docs: DataFrame, batches: int) -> DataFrame:
    """lines with their batch: equal shares of the documents by id, the largest ids first, null ids last."""
    ids = docs.select(docs["doc_id"].cast("long").alias("id")).where("id IS NOT NULL")
    shares = [i / batches for i in range(1, batches)]
    bounds = sorted(set(ids.approxQuantile("id", shares, 0.01)), reverse=True) if shares else []
    batch = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        batch = F.when(F.col("doc") >= int(bounds[i]), i).otherwise(batch)
    return common.written(lines.withColumn("batch", batch.cast("int")), "lines", by=("batch",))


def shared_lines(docs: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(h, g, docs, owner) of the lines that ``min_docs`` documents share; ``lines`` have their batch."""
    runs = LineRuns(docs.sparkSession, fanout=fanout)
    for b in range(max(1, batches)):
        runs.add(distinct_lines(lines.where(F.col("batch") == b)))
    found = common.written(runs.lines(min_docs), "shared-lines")
    runs.drop()
    return found


def dropped_places(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, hot_docs: int = HOT_DOCS) -> DataFrame:
    """(doc, text_hash, places): places of the lines that a text loses, ascending, from 0."""
    lines = _batched(lines_of(docs, min_chars), docs, batches)
    shared = shared_lines(docs, lines, min_docs, batches, fanout)
    salts = F.ceil(F.col("docs") / hot_docs).cast("int")
    hot = shared.where(F.col("docs") > hot_docs).select("h", "g", salts.alias("salts"))
    dealt = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    salt = F.coalesce(F.pmod(F.xxhash64("doc", "text_hash"), "salts").cast("int"), F.lit(0))
    marked = lines.join(common.small_side(hot, SMALL), ["h", "g"], "left").withColumn("salt", salt)
    lost = marked.join(common.small_side(dealt, SMALL), ["h", "g", "salt"]).where("doc IS NULL OR doc < owner")
    return common.written(lost.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("place")).alias("places")), "dropped-places")


def _small(places: DataFrame) -> DataFrame:
    """With a broadcast hint if few texts lose few lines, both counted."""
    size = places.agg(F.count("*").alias("rows"), F.sum(F.size("places")).alias("n")).first()
    return F.broadcast(places) if size["rows"] <= SMALL and (size["n"] or 0) <= SMALL_PLACES else places


def kept_text(text: Column, places: Column) -> Column:
    """The text without the lines at ``places``, in one pass over both; null places drop nothing."""

    def rest(lines: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
        ends = F.concat(places, F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(begins, ends, lambda a, e: F.slice(lines, a + 1, e - a))), "\n")

    # the lines are bound to a name, so that they are split once for each text
    return F.when(places.isNull(), text).otherwise(F.transform(F.array(F.split(text, "\n")), rest)[0])


def _joined(docs: DataFrame, kept: list[Column], **how: int) -> DataFrame:
    places = _small(dropped_places(docs, **how)).select(F.col("doc").alias("_al_doc"), F.col("text_hash").alias("_al_hash"), F.col("places").alias("_al_places"))
    rows = docs.select(*kept, docs["doc_id"].cast("long").alias("_al_id"), common.text_of(docs).alias("_al_text")).withColumn("_al_own", F.xxhash64("_al_text"))
    return rows.join(places, F.col("_al_id").eqNullSafe(F.col("_al_doc")) & (F.col("_al_own") == F.col("_al_hash")), "left")


def dedup(docs: DataFrame, **how: int) -> DataFrame:
    """One row per document: doc_id, n_lines (before dropping), n_dropped, kept_sha256."""
    joined = _joined(docs, [], **how)
    lost = F.coalesce(F.size("_al_places"), F.lit(0))
    return joined.select(
        F.col("_al_id").alias("doc_id"),
        F.size(F.split("_al_text", "\n")).cast("long").alias("n_lines"),
        F.when(F.col("_al_places").isNull(), 0).otherwise(lost).cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("_al_text"), F.col("_al_places")).cast("binary"), 256).alias("kept_sha256"),
    )


def clean(docs: DataFrame, **how: int) -> DataFrame:
    """docs with all their columns, the texts without the dropped lines; a null text stays null."""
    joined = _joined(docs, [docs[c].alias(f"_al_{i}") for i, c in enumerate(docs.columns)], **how)
    names = [F.col(f"_al_{i}") for i in range(len(docs.columns))]
    text = kept_text(F.col("_al_text"), F.col("_al_places"))
    return joined.select(*(F.when(n.isNotNull(), text).alias(c) if c == "text" else n.alias(c) for n, c in zip(names, docs.columns, strict=True)))
