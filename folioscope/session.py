"""Session set-up and lineage cutting."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings an operator relies on; anything else is the cluster's business.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(name: str = "folioscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf wins (dots are written as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the session's shared checkpoint folder and reads it from there.

    The folder is the one the cluster names in spark.checkpoint.dir.  Only where the master is this
    machine alone, as in tests, one is made if none is named, and removed at the end; elsewhere an
    error says what is missing, as executors share no local folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
            named = tempfile.mkdtemp(prefix="folioscope-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """The number of partitions of a shuffle that this session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, rows: int, rows_per_part: int) -> int:
    """Enough partitions for rows, and no fewer than the session asks for."""
    return max(partitions(spark), math.ceil(rows / rows_per_part))


def _bytes(size: str) -> int:
    """A size setting in bytes, such as 16m or 128MB."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]?)b?", size.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its input is too small to have a split for each; else as it is.

    For narrow stages over a scan that cost much more per row than moving the row: one small file
    must not keep a cluster waiting for one task.  Decided by the optimizer's size of the input, so
    no job is run, and what is moved is bounded by the cluster's size, not by the data's.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
