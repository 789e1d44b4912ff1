"""Starting and finishing streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vacancia.session import STATE_SETTINGS, checkpoint_root, configure


def stateful(spark: SparkSession) -> SparkSession:
    """A session whose streams may keep state of their own."""
    configure(spark)
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run, in the place every executor reaches."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def drain_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read back what it wrote."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .format("parquet")
        .start(f"{folder}/out")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_batches(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is there now, handing each micro-batch to ``write``."""
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
