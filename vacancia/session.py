"""Session settings the results and the plans rely on."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Results depend on the first two; the rest keep pages small in Python and let
# the engine re-plan joins and skewed partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}

# What streams keep: a commit writes the changes instead of whole files, and a join has one
# store a partition instead of four.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session that already exists."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "vacancia", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


_folder: str | None = None


def use_folder(path: str) -> None:
    """Name the shared folder for sessions that do not have ``spark.checkpoint.dir``."""
    global _folder
    _folder = path.rstrip("/")


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables, which every executor reaches."""
    named = spark.conf.get("spark.checkpoint.dir", None) or _folder
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return named.rstrip("/")


def ship(spark: SparkSession) -> str:
    """Send this package to executors that do not have it installed."""
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="vacancia-package-")
    whole = shutil.make_archive(f"{folder}/vacancia", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(whole)
    return whole
