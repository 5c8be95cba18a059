"""Session helpers: tables, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is only ever broadcast below this many bytes (estimated from its rows).
BROADCAST_BYTES = 64 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that setting is
    absent (tests, a laptop) a fresh local folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp" if os.path.isdir("/tmp") else None)
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the checkpoint folder, with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def broadcast_below(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast only if ``rows * row_bytes`` stays below ``limit``.

    ``rows`` is a count measured by the caller.  Beyond the limit the frame is
    returned unmarked, and the join that uses it becomes a shuffle join.
    """
    return F.broadcast(df) if rows * row_bytes <= limit else df


#: Inputs above this many bytes (of the scan, as Spark estimates them) are never spread.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small scan in fewer partitions than there are cores, spread over them; any other frame as it is.

    A file of one row group is one task however long its rows take.  Only inputs below
    ``SPREAD_BYTES`` are shuffled, so the cost is bounded whatever the number of cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() * 2 <= cores else df
