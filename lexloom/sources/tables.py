"""Parquet tables of a scale directory, and cuts of lineage in shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a scale directory; columns are pruned by whoever selects from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core work: a table read from fewer splits than there are cores is spread out.

    Large tables have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def settled(df: DataFrame, last: bool = False) -> DataFrame:
    """Materialise ``df`` in the folder all executors share, so that a lost executor loses nothing.

    The folder is :func:`shared_folder`'s; what a query leaves there is removed by
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` when its frames are gone.  With ``last``
    this is the last use of ``df``, and its shuffle files are removed before it returns.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    found = df.checkpoint()
    if last:
        _released(df)
    return found


def _released(df: DataFrame) -> None:
    """Remove the shuffle files that ``df`` has made.

    Spark's cleaner would do it some time after the driver has collected its garbage.
    """
    plan = df._jdf.queryExecution().executedPlan()
    cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner()
    if cleaner.isDefined() and plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        for shuffle in list(plan.context().shuffleIds().keySet()):
            cleaner.get().doCleanupShuffle(shuffle, True)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset a session of one machine (tests, a local run) gets a temporary folder; on a
    cluster that would be no shared one, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="lexloom-checkpoint-")
    return _own


_own: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
