"""Which pages are in scope and who reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.text import let
from vacancia.functions.urls import url_parts
from vacancia.operators.adapters import adapters, per_adapter

INDEED = "indeed"


def is_indeed_host(host: Column) -> Column:
    return (host == "indeed.com") | F.endswith(host, F.lit(".indeed.com"))


def in_scope(url: Column) -> Column:
    """True for pages the capture covers: https, on Indeed or where an adapter claims the
    address, query included."""

    def test(u: Column) -> Column:
        query = F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise("")
        target = F.concat(u["path"], query)
        covered = is_indeed_host(u["host"])
        for a in adapters():
            covered = covered | a.claims(u["host"], target)
        return F.coalesce((u["scheme"] == "https") & covered, F.lit(False))

    return let(url_parts(url), test)


def claimed_host(host: Column) -> Column:
    """True for hosts on which a page can be in scope: plain comparisons, which a scan can
    test on its own statistics before it reads anything else."""
    hosts = sorted({h for a in adapters() for h in a.hosts})
    return host.isin(*hosts) | is_indeed_host(host)


def adapter_for(url: Column) -> Column:
    """Id of the first adapter that claims the page, else null."""

    def first(u: Column) -> Column:
        return F.coalesce(
            *[F.when(a.claims(u["host"], u["path"]), F.lit(a.adapter_id)) for a in adapters()]
        )

    return let(url_parts(url), first)


def is_posting_page(adapter_id: Column, url: Column) -> Column:
    """False where an adapter knows the page is no single posting."""
    path = url_parts(url)["path"]
    return F.coalesce(
        per_adapter(
            adapter_id,
            lambda a: path.rlike(a.posting_path) if a.posting_path else F.lit(True),
        ),
        F.lit(True),
    )


def remote_source_url(adapter_id: Column, url: Column) -> Column:
    """Address of a page's server-rendered copy where its adapter has one."""
    return per_adapter(
        adapter_id, lambda a: a.remote_url(url) if a.remote_url else F.lit(None).cast("string")
    )


def route(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``adapter_id`` (``indeed`` for Indeed pages), null when nobody reads
    the page. Nothing here looks at the page's content, so a filter on it runs
    before any page is parsed."""
    parts = url_parts(F.col(url))
    return pages.withColumn("host", parts["host"]).withColumn(
        "adapter_id",
        F.when(is_indeed_host(F.col("host")), F.lit(INDEED)).otherwise(adapter_for(F.col(url))),
    )
