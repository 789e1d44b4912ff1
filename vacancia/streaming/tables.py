"""Streams that keep tables: fetched copies, adapter health, staged submissions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.operators.health import latest_adapter_health, upsert_adapter_health
from vacancia.operators.lookup import first_by, only_new, role_key
from vacancia.operators.stages import stage
from vacancia.operators.submissions import confirm_submissions, not_yet_staged, staged_rows
from vacancia.sources.stored import (
    read_batches,
    read_snapshot,
    write_batch,
    write_snapshot,
)


def health_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes health rows of a micro-batch over the stored table.

    A batch is merged with the snapshot before it, so running it again yields
    the same snapshot.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        stored = read_snapshot(rows.sparkSession, path, before=batch_id)
        latest = latest_adapter_health(rows) if stored is None else upsert_adapter_health(stored, rows)
        write_snapshot(latest, path, batch_id)

    return write


def _unseen(rows: DataFrame, key: Column, earlier: DataFrame | None, column: str) -> DataFrame:
    """Rows whose key no earlier batch has; only that column of the history is read."""
    if earlier is None:
        return rows
    seen = earlier.select(F.col(column).alias("_seen")).filter(F.col("_seen").isNotNull())
    return stage(rows, _own=key).join(seen, F.col("_own") == F.col("_seen"), "left_anti").drop("_own")


def submission_writer(
    path: str, applications: Callable[[], DataFrame], order: str, row_id: str
) -> Callable[[DataFrame, int], None]:
    """Stages the new postings of a micro-batch, as one batch of all rows would.

    The first posting of each URL that is not logged is kept with its role, staged or not:
    a later one is compared with both, over all earlier batches. Postings are expected in
    order from batch to batch; what is staged is not taken back for an earlier posting that
    comes late. Only earlier batches count, so a batch that runs again replaces its own rows
    and stages nothing twice. ``applications`` is read anew per batch.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        earlier = read_batches(rows.sparkSession, path, before=batch_id)
        role = role_key(F.col("company"), F.col("title"))
        fresh = only_new(rows, applications(), row_id)
        fresh = _unseen(fresh, F.col("source_url"), earlier, "source_url")
        firsts = stage(first_by(fresh, F.col("source_url"), order, row_id), role=role)
        new_role = _unseen(firsts, F.col("role"), earlier, "role")
        staged = first_by(new_role, F.col("role"), order, row_id)
        sent = staged_rows(staged).select(row_id, "pending_token", "job_posting_text")
        kept = firsts.select(row_id, "source_url", "role").join(sent, row_id, "left")
        write_batch(kept, path, batch_id)

    return write


def read_staged(spark: SparkSession, path: str) -> DataFrame | None:
    """``pending_token, job_posting_text, source_url`` of what was staged."""
    rows = read_batches(spark, path)
    if rows is None:
        return None
    staged = rows.filter(F.col("pending_token").isNotNull())
    return staged.select("pending_token", "job_posting_text", "source_url")


def confirmation_writer(
    path: str, staged: Callable[[], DataFrame]
) -> Callable[[DataFrame, int], None]:
    """Turns the confirmations of a micro-batch into applications.

    A token is spent once: those confirmed in earlier batches are gone.
    """

    def write(confirms: DataFrame, batch_id: int) -> None:
        done = confirm_submissions(staged(), confirms)
        spent = read_batches(confirms.sparkSession, path, before=batch_id)
        write_batch(done if spent is None else not_yet_staged(done, spent), path, batch_id)

    return write
