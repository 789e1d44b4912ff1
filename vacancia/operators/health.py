"""Adapter health and liveness signals: the last write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.labels import (
    SIGNAL_LABELS,
    health_label,
    health_status,
    method_label,
    relative_time,
)
from vacancia.operators.adapters import adapters_dim, per_adapter
from vacancia.operators.routing import INDEED


def health_rows(extractions: DataFrame, seen_at: str, row_id: str) -> DataFrame:
    """One health row per capture that tells how an adapter fared.

    Hidden and loading captures tell nothing, and Indeed keeps no health. ``row`` is the
    capture's number, which decides between captures of the same instant.
    """
    told = extractions.filter(
        F.col("status").isin("ok", "not-found") & (F.col("adapter_id") != INDEED)
    )
    method = F.col("posting.detection.method")
    return told.select(
        "adapter_id",
        per_adapter(F.col("adapter_id"), lambda a: F.lit(a.label)).alias("adapter_label"),
        "host",
        health_status(method).alias("status"),
        method.alias("method"),
        F.col(seen_at).alias("last_seen"),
        F.col("posting.title").alias("sample_title"),
        F.col(row_id).alias("row"),
    )


def latest_adapter_health(rows: DataFrame) -> DataFrame:
    """The last row per adapter. Map tasks reduce to one row per adapter first."""
    others = [c for c in rows.columns if c != "adapter_id"]
    order = F.struct("last_seen", "row")
    return (
        rows.groupBy("adapter_id")
        .agg(F.max_by(F.struct(*others), order).alias("_last"))
        .select("adapter_id", "_last.*")
    )


def upsert_adapter_health(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """The stored table after ``rows``, in whatever order they came."""
    return latest_adapter_health(stored.unionByName(rows))


def health_report(health: DataFrame, now: Column) -> DataFrame:
    """Every adapter in registry order with its badge and detail.

    Health has one row per adapter of the registry, so broadcasting the registry
    and joining is bounded by the registry's size.
    """
    dim = adapters_dim(health.sparkSession)
    known = dim.join(health.drop("adapter_label", "host", "sample_title"), "adapter_id", "left")
    via = F.coalesce(
        F.concat(F.lit("via "), method_label(F.col("method")), F.lit(" · ")), F.lit("")
    )
    seen = F.col("status").isNotNull()
    return known.select(
        "ord",
        "adapter_id",
        F.coalesce("status", F.lit("unseen")).alias("state"),
        health_label(F.col("status")).alias("badge"),
        F.concat("label", F.lit(" ("), "platform", F.lit(")")).alias("name"),
        F.when(seen, F.concat(via, relative_time(F.col("last_seen"), now)))
        .otherwise(F.array_join("hosts", ", "))
        .alias("detail"),
    ).orderBy("ord")


def latest_signals(signals: DataFrame) -> DataFrame:
    """One row with the latest time per known signal; null when never seen."""
    return signals.agg(
        *[F.max(F.when(F.col("signal") == s, F.col("at"))).alias(s) for s in SIGNAL_LABELS]
    )


def signal_report(latest: DataFrame, now: Column) -> DataFrame:
    """The one-row table of signals as one labelled row per signal."""
    entries = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(label).alias("name"),
            F.when(F.col(s).isNotNull(), F.lit("OK")).otherwise(F.lit("Never")).alias("badge"),
            F.when(F.col(s).isNull(), F.lit("never recorded"))
            .otherwise(
                F.concat(
                    relative_time(F.col(s), now),
                    F.lit(" ("),
                    F.date_format(F.col(s), "yyyy-MM-dd HH:mm:ss"),
                    F.lit(")"),
                )
            )
            .alias("detail"),
        )
        for i, (s, label) in enumerate(SIGNAL_LABELS.items())
    ]
    return latest.select(F.inline(F.array(*entries)))
