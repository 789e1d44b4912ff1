"""Tables a stream writes: snapshots that replace each other, and batches that add up.

Both are folders of Parquet partitions written with overwrite and tied to the number
of the micro-batch, so a batch that runs again after a failure leaves what it left
before.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Everything written, or only batches before one; null when nothing is."""
    rows = _read(spark, path)
    if rows is None:
        return None
    kept = rows if before is None else rows.filter(F.col("batch_id") < before)
    return kept.drop("batch_id")


def _newest(rows: DataFrame | None, before: int | None):
    """``(version, slot)`` of the newest snapshot, or the newest before a version."""
    if rows is None:
        return None
    kept = rows if before is None else rows.filter(F.col("version") < before)
    return kept.agg(F.max(F.struct("version", "slot")).alias("m")).first()["m"]


def write_snapshot(rows: DataFrame, path: str, version: int) -> None:
    """Replace a small table. Two snapshots are kept: this one takes the place of the
    older, so what it was made from stays readable until it is complete."""
    newest = _newest(_read(rows.sparkSession, path), version)
    slot = 0 if newest is None else 1 - newest["slot"]
    stamped = rows.withColumn("version", F.lit(version).cast("long"))
    stamped.write.mode("overwrite").parquet(f"{path}/slot={slot}")


def read_snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest snapshot, or the newest before a version; null when there is none."""
    rows = _read(spark, path)
    newest = _newest(rows, before)
    if newest is None:
        return None
    return rows.filter(F.col("slot") == newest["slot"]).drop("slot", "version")
