"""Helpers shared by the training-data operators: shared folder, sessions, hashing, small samples."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgauge.session import WRITTEN, shared_dir

#: Rows of one Arrow batch: with whole texts of some 100 kB a batch stays within some tens of MB.
BATCH_ROWS = "256"

#: Same words in SQL, Java and Python: runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: small Arrow batches, UTC, adaptive plans."""
    for key, value in {
        "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)  # for session.remove_written
    return spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mix of unsigned 64-bit integers (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def by_hash(column: str, wanted: int, total: int) -> Column:
    """Condition that about ``wanted`` of ``total`` distinct values of ``column`` meet, all if there are no more.

    The choice hangs on the values alone, so it is the same in every run, and no task or driver sees more than its part
    of the sample, however many partitions there are.
    """
    steps = 1 << 40
    return F.pmod(F.xxhash64(F.lit("sample"), column), F.lit(steps)) < F.lit(steps if total <= wanted else steps * wanted // total)


def labelled_sample(documents: DataFrame, labels: DataFrame, n_labels: int) -> DataFrame:
    """(doc_id, text, quality, toxic) of about ``n_labels`` labelled documents, chosen by a hash of their id.

    Null ids or null labels are left out, of repeated ids one label stays.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    chosen = (
        known.where(by_hash("doc_id", n_labels, known.count()))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).cast("int").alias("toxic"))
    )
    return documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
