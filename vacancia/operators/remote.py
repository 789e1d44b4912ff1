"""Server-rendered copies of pages, and when they are preferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.operators.adapters import per_adapter, with_remote_copies
from vacancia.operators.keys import shuffled_anew, spread_nulls
from vacancia.operators.routing import remote_source_url, route
from vacancia.plans.extract import read_postings


FETCH = ("remote_url", "fetched_at", "fetch_id")


def first_fetches(copies: DataFrame) -> DataFrame:
    """The first answer per remote URL, as its key. Map tasks reduce to one row per URL first."""
    first = F.min(F.struct("fetched_at", "fetch_id")).alias("_first")
    return copies.groupBy("remote_url").agg(first).select("remote_url", "_first.*")


def first_remote_copy(copies: DataFrame) -> DataFrame:
    """One answer per remote URL, the first one, failures included.

    Only keys are reduced; the pages meet the keys that won.
    """
    return copies.join(first_fetches(copies), list(FETCH), "left_semi").select(*copies.columns)


def trusted_copies(copies: DataFrame) -> DataFrame:
    """``_key, _remote``: the posting of each address whose first answer is trusted."""
    copied = with_remote_copies()
    fetched = copies.withColumn("url", F.col("remote_url"))
    if "adapter_id" in copies.columns:
        named = route(fetched.withColumnRenamed("adapter_id", "_named"))
        fetched = named.withColumn("adapter_id", F.coalesce("_named", "adapter_id"))
    else:
        fetched = route(fetched)
    fetched = fetched.filter(F.col("ok") & F.col("adapter_id").isin(copied))
    read = read_postings(fetched.select(*FETCH, "url", "host", "adapter_id", "html"), copied, gated=False)
    confident = (F.col("status") == "ok") & (F.col("posting.detection.confidence") == "high")
    trusted = read.filter(confident).join(first_fetches(copies), list(FETCH), "left_semi")
    return shuffled_anew(
        trusted.select(F.col("remote_url").alias("_key"), F.col("posting").alias("_remote")), "_key"
    )


def live_postings(captures: DataFrame) -> DataFrame:
    """What the captures themselves show, and in ``_asks`` the address of the copy that is
    preferred, null where there is none."""
    asks = F.when(
        F.col("status") != "hidden", remote_source_url(F.col("adapter_id"), F.col("url"))
    )
    return read_postings(captures).withColumn("_asks", asks)


def preferred(live: DataFrame, trusted: DataFrame, row_id: str) -> DataFrame:
    """``live_postings`` with those of ``trusted_copies`` in their place."""
    own_url = per_adapter(F.col("adapter_id"), lambda a: a.source_url(F.col("url")))
    has = F.col("_remote").isNotNull()
    keyed = live.withColumn("_key", spread_nulls(F.col("_asks"), F.col(row_id)))
    return keyed.join(trusted, "_key", "left").select(
        *[c for c in live.columns if c not in ("status", "posting", "outcome", "_asks")],
        F.when(has, F.lit("ok")).otherwise(F.col("status")).alias("status"),
        F.when(has, F.col("_remote").withField("source_url", own_url))
        .otherwise(F.col("posting"))
        .alias("posting"),
        F.when(has, F.lit("detected")).otherwise(F.col("outcome")).alias("outcome"),
        has.alias("from_remote"),
    )


def prefer_remote(captures: DataFrame, copies: DataFrame, row_id: str = "page_id") -> DataFrame:
    """Postings of routed captures, from the trusted copy where there is one.

    Captures and copies are each parsed where they are scanned, once; what is joined
    afterwards are postings. A copy is read as its ``adapter_id`` says, or as the site of
    its own address where it says nothing. Only a first copy that was answered and gave a
    confident posting is trusted, and only captures that are single postings take it.
    """
    return preferred(live_postings(captures), trusted_copies(copies), row_id)
