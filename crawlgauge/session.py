"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Tables written by this process, until ``remove_written``.
WRITTEN: list[str] = []

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Broadcast only what adaptive execution has measured: size estimates are far too low behind an explode.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # no sort where each partition of the smaller side is known to be small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # the last of two equal JSON keys wins
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Where none is set a temporary folder serves on a local master, as in tests; on a cluster that is an error, as
    executors don't see the driver's disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        folder = named
    elif context.getCheckpointDir():
        folder = context.getCheckpointDir()
    elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="crawlgauge-")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def written_table(df, name: str):
    """Write ``df`` to the shared folder and read it back: several passes then read only the columns they need."""
    path = written_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def written_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for tables written step by step."""
    WRITTEN.append(f"{shared_dir(spark)}/crawlgauge/{name}-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def remove_written(spark: SparkSession) -> None:
    """Delete the tables that ``written_table`` has written in this process; call it when results have been used."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while WRITTEN:
        path = hadoop(WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
