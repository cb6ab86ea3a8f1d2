"""Cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators.skew import estimated_bytes

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# An input that fills less than this per core is spread before heavy work on its rows.
SPREAD_BYTES_PER_CORE = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names; a temporary one only in local mode."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    named = tempfile.mkdtemp(prefix="ledgerline-")
    spark.conf.set(CHECKPOINT_DIR, named)
    return named


def new_path(spark: SparkSession) -> str:
    """A path under the shared folder that nothing uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, fmt: str = "parquet", free: bool = False) -> DataFrame:
    """Write to a new place under the shared folder and read back.

    The result is computed once, lost executors cost no recomputation of it, and
    later reads take only the columns they need. With ``free``, the shuffle files of
    the write go when it ends, not when the driver next collects garbage.
    """
    path, conf = new_path(df.sparkSession), df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    if free:
        conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.format(fmt).save(path)
    finally:
        if free:
            conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input over all cores; one too large for that has enough splits already.

    The size is the planner's estimate, so nothing runs to find it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * SPREAD_BYTES_PER_CORE else df
