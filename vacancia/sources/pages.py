"""Readers of the stored tables, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.functions.urls import url_parts
from vacancia.schemas import CAPTURES, PAGES, REMOTE_COPIES


def read_pages(spark: SparkSession, path: str, schema: str = PAGES) -> DataFrame:
    """Captured pages from Parquet; columns a query does not use are not read."""
    return spark.read.schema(schema).parquet(path)


def write_pages(pages: DataFrame, path: str, files: int) -> None:
    """Store pages with their host, in ``files`` files of neighbouring hosts.

    Within a file rows are sorted by host, so that readers skip row groups of others.
    """
    hosts = pages.withColumn("host", url_parts(F.col("url"))["host"])
    by_host = hosts.repartitionByRange(files, "host", "url").sortWithinPartitions("host", "url")
    by_host.write.parquet(path)


def read_pages_json(spark: SparkSession, path: str, schema: str = PAGES) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_captures(
    spark: SparkSession, path: str, schema: str = CAPTURES, files_per_trigger: int = 64
) -> DataFrame:
    """A growing folder of captures as a stream, a bounded number of files at a time."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def read_remote_copies(spark: SparkSession, path: str, schema: str = REMOTE_COPIES) -> DataFrame:
    """Fetched copies keyed by ``remote_url``; answers that were not ``ok`` hold no page."""
    return spark.read.schema(schema).parquet(path)
