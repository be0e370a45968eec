"""Append-only tables in buckets of a key, so that joins on the key don't shuffle what the table already holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from auditloom import scratch


class BucketedTable:
    """A scratch table that grows by appending; every append adds a file to each bucket and rewrites none.

    Its files go with ``scratch.release``; ``close`` takes its entry out of the catalog.
    """

    def __init__(self, spark: SparkSession, name: str, schema: str, keys: tuple[str, ...], buckets: int | None = None):
        self.spark, self.keys, self.schema = spark, keys, schema
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        self.path = scratch.fresh_path(spark, self.table)
        self._begun = False

    def append(self, rows: DataFrame, dealt: bool = False, **options: str) -> None:
        """dealt: the rows lie by their keys in as many partitions as there are buckets already."""
        rows = rows if dealt else rows.repartition(self.buckets, *self.keys)
        writer = rows.write.format("parquet").options(**options).bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        if self._begun:
            writer.mode("append").saveAsTable(self.table)
        else:
            writer.option("path", self.path).saveAsTable(self.table)
        self._begun = True

    def read(self) -> DataFrame:
        """All rows; joins and groups on the key find them in place."""
        return self.spark.table(self.table) if self._begun else self.spark.createDataFrame([], self.schema)

    def close(self) -> DataFrame:
        """The rows as plain files, once nothing is appended any more."""
        if not self._begun:
            return self.read()
        rows = self.spark.read.schema(self.spark.table(self.table).schema).parquet(self.path)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        return rows
