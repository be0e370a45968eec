"""Places of rows in the order of their key, without a task that orders a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom import scratch

#: Rows of the partitions' counts up to which they are broadcast.
SMALL = 300_000


def numbered(rows: DataFrame, keys: list[str], order: list[str], place: str = "place") -> DataFrame:
    """rows with their place in their key, from 0, by a range-partitioned sort and running totals of the partitions' counts.

    A key of any size is spread over many partitions; what is ordered per key is one count for each partition that it touches.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [*keys, *order]
    sorted_rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.written(sorted_rows, "numbered").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = scratch.written(counts.select("_part", *keys, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")), "offsets")
    if offsets.limit(SMALL + 1).count() <= SMALL:
        offsets = F.broadcast(offsets)
    return placed.join(offsets, ["_part", *keys]).withColumn(place, F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")
