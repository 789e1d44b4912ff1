"""Postings against applications that are already logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacancia.functions.company import canonical_company
from vacancia.operators.keys import shuffled_anew, spread_nulls
from vacancia.operators.stages import stage

MATCH = ("id", "company", "role", "stage", "date_applied")


def role_key(company: Column, role: Column) -> Column:
    """Canonical company and unmodified role as one key; null when either is."""
    return F.concat(canonical_company(company), F.lit("\0"), role)


def _earliest(applications: DataFrame, key: Column, match: str) -> DataFrame:
    """The earliest application per key, so that no posting meets two."""
    first = (
        stage(applications, _key=key)
        .filter(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(F.min_by(F.struct(*MATCH), F.struct("date_applied", "id")).alias(match))
    )
    return shuffled_anew(first, "_key")


def lookup_existing(postings: DataFrame, applications: DataFrame, row_id: str) -> DataFrame:
    """Add ``match`` and ``matched_by`` (``url`` or ``role``); both null for new postings.

    The exact source URL decides first, then canonical company and role. Every
    posting stays one row. Neither join forces a broadcast: the engine takes one
    when the applications prove small, and splits a hot key when they do not.
    """
    by_url = _earliest(applications, F.col("source_url"), "_by_url")
    by_role = _earliest(applications, role_key(F.col("company"), F.col("role")), "_by_role")
    found = (
        postings.withColumn("_key", spread_nulls(F.col("source_url"), F.col(row_id)))
        .join(by_url, "_key", "left")
        .withColumn(
            "_key",
            spread_nulls(
                # A posting found by its URL needs no second look-up.
                F.when(F.col("_by_url").isNull(), role_key(F.col("company"), F.col("title"))),
                F.col(row_id),
            ),
        )
        .join(by_role, "_key", "left")
    )
    return (
        found.withColumn("match", F.coalesce("_by_url", "_by_role"))
        .withColumn(
            "matched_by",
            F.when(F.col("_by_url").isNotNull(), F.lit("url")).when(
                F.col("_by_role").isNotNull(), F.lit("role")
            ),
        )
        .drop("_key", "_by_url", "_by_role")
    )


def only_new(postings: DataFrame, applications: DataFrame, row_id: str) -> DataFrame:
    """Postings that match no application."""
    return lookup_existing(postings, applications, row_id).filter(F.col("match").isNull()).drop(
        "match", "matched_by"
    )


def only_duplicates(postings: DataFrame, applications: DataFrame, row_id: str) -> DataFrame:
    return lookup_existing(postings, applications, row_id).filter(F.col("match").isNotNull())


def first_by(postings: DataFrame, key: Column, order: str, row_id: str) -> DataFrame:
    """The first posting per key; postings without one stay.

    ``row_number() = 1`` is limited in each map task before the shuffle, so a
    posting repeated without end sends one row per task.
    """
    at = W.partitionBy("_key").orderBy(order, row_id)
    return (
        stage(postings, _key=spread_nulls(key, F.col(row_id)))
        .withColumn("_n", F.row_number().over(at))
        .filter(F.col("_n") == 1)
        .drop("_key", "_n")
    )


def first_in_batch(postings: DataFrame, order: str, row_id: str) -> DataFrame:
    """Of equal postings in one batch the first: per URL, then per company and role."""
    per_url = first_by(postings, F.col("source_url"), order, row_id)
    return first_by(per_url, role_key(F.col("company"), F.col("title")), order, row_id)
