"""What every operator needs of a session: shipped code, even scans, checked broadcasts, durable cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_DIR = Path(__file__).resolve().parent
BATCH_BYTES = 32 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers; the driver serves it as a job file.

    Runs once per application. The archive holds code only, so it stays well under 1 MB.
    """
    context = spark.sparkContext
    if getattr(context, "_inkgrove_shipped", False):
        return
    fd, name = tempfile.mkstemp(prefix="inkgrove-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(PACKAGE_DIR.rglob("*.py")):
            archive.write(path, Path(PACKAGE_DIR.name) / path.relative_to(PACKAGE_DIR))
    context.addPyFile(name)
    context._inkgrove_shipped = True
    bound_batches(spark)


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes as well as rows: texts may be megabytes each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key, "-1").rstrip("bB") or -1) in range(1, BATCH_BYTES + 1):
            return
        spark.conf.set(key, str(BATCH_BYTES))
    except Exception:  # an older Spark without the setting: rows alone bound a batch
        pass


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a scan has fewer splits than the cluster has cores.

    Only a small input meets the condition; a large one already has more splits than cores and
    passes through without a shuffle. Streams and plans that shuffle anyway stay as they are: their
    partitions follow the shuffle, and looking at them would run it.
    """
    if df.isStreaming or "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores)


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if the side really has at most max_rows rows; otherwise leave the
    choice of join to the optimizer, which then shuffles."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in spark.checkpoint.dir. Where it is unset, a folder of our
    own that goes with the session, if driver and executors are one process; None on a cluster."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            return None
        wanted = tempfile.mkdtemp(prefix="inkgrove-checkpoint-")
        atexit.register(shutil.rmtree, wanted, ignore_errors=True)
    context.setCheckpointDir(wanted)
    return wanted


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    On a cluster that names none the rows are kept in the executors with their lineage instead, so
    what is lost is computed again.
    """
    if ensure_checkpoint_dir(df.sparkSession) is None:
        return df.persist()
    return df.checkpoint(eager)


def bounded_groups(df: DataFrame, group_col: str, most: int) -> DataFrame:
    """The same rows, after a look whether a group has more than most of them: it would be one row.

    Groups are counted map-side first, so the look moves a count a group and task.
    """
    large = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("n").first()
    if large is not None:
        raise ValueError(f"a group of {group_col} has {large['n']} rows, more than {most}")
    return df
