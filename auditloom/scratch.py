"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables written by this process and not yet removed.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder set in the session; a folder of our own only in local mode.

    A machine's own folder would lose rows on a cluster, so a cluster without a shared one is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="auditloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder for a scratch table, which ``release`` removes."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table and read it back: later steps start from it, also after lost executors. ``release`` removes it.

    ``by`` are the last columns of df; each of their values gets a folder, so that reads of one value read no other.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=list(by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """The tables written so far, for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Remove the tables written after ``mark`` but those that ``keep`` reads; frames that rest on the others can't be used any more."""
    held = {f.split("/part-")[0].rpartition("/")[2] for f in keep.inputFiles()} if keep is not None else set()
    gone = [p for p in _made[since:] if p.rpartition("/")[2] not in held]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
        _made.remove(path)
    return len(gone)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration's small state with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
