"""Cutting lineage through the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; only where the session names none and runs on one machine (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="webloom-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` materialised by a reliable checkpoint, with no lineage behind them."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        _written.append(file.get())
    return out


def written(df: DataFrame, label: str) -> DataFrame:
    """As ``cut``, but as a Parquet table: columns that a later reader doesn't select are not read again."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for what is written there by other means; ``clear_written`` deletes it too."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _written.remove(p)
    return len(paths)


def clear_written(spark: SparkSession) -> int:
    """Deletes the tables and checkpoints that this module made in this process. Call it when the results that read them are stored."""
    return _delete(spark, list(_written))


def marked() -> int:
    """A mark for ``settled``: what was written up to now stays."""
    return len(_written)


def settled(df: DataFrame, label: str, mark: int) -> DataFrame:
    """As ``written``; then everything else that this module wrote since the mark is deleted: the caller knows that nothing else reads it."""
    out = written(df, label)
    _delete(df.sparkSession, _written[mark:-1])
    return out


def small_side(df: DataFrame, most_rows: int = 100_000, cells: Column | None = None) -> DataFrame:
    """``df`` to be broadcast if it has at most so many narrow rows, else as it is, for a shuffled join.

    Where rows hold arrays, ``cells`` is the number of a row's elements, and these are counted.
    """
    if cells is None:
        return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
    n = df.agg(F.count("*") + F.coalesce(F.sum(cells), F.lit(0))).collect()[0][0]
    return F.broadcast(df) if n <= most_rows else df


#: Rows that go to Python at a time where they hold whole texts.
ROWS_IN_BATCH = 500
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for rows with whole texts, unless the session names a size of its own: executors hold a few at once.

    It changes the session, so it is for those who own it: the registered queries and the pipeline call it, operators don't.
    """
    if spark.conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(ROWS_IN_BATCH))
