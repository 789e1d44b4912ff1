"""Pages in, postings out: route, parse once, extract, decide.

No step shuffles. Scope and routing read only the address, so pages nobody
claims are dropped before the one Python step. The page table is scanned once
and each page is parsed once, whichever site it belongs to.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import zip_longest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.functions.labels import outcome
from vacancia.functions.text import let
from vacancia.operators import indeed
from vacancia.operators.adapters import adapters
from vacancia.operators.dom import with_dom
from vacancia.operators.indeed import indeed_posting, indeed_stages, indeed_status
from vacancia.operators.routing import INDEED, claimed_host, in_scope, is_posting_page, route
from vacancia.operators.selectors import attributes_used
from vacancia.operators.stages import stage
from vacancia.operators.tiers import site_posting, site_stages


def attributes_read(among: Sequence[str]) -> list[str]:
    """Attributes the sites' selectors read; no others leave the parser."""
    selectors = [s for a in adapters() if a.adapter_id in among for s in a.chains.all()]
    if INDEED in among:
        selectors += indeed.ALL_SELECTORS
    return sorted(attributes_used(selectors))


def read_postings(
    routed: DataFrame, among: Sequence[str] | None = None, gated: bool = True
) -> DataFrame:
    """Add ``status``, ``posting`` and ``outcome`` to routed pages.

    ``among`` names the sites that can occur, where that is known: the plan then
    holds the selectors of no others. A claimed page that is no single posting is
    ``hidden``; its content does not reach the parser. Copies are not ``gated``: the
    address that decides is that of the page they stand for. Pages that come parsed, as
    ``write_parsed`` has stored them, are not parsed again.
    """
    among = [INDEED, *(a.adapter_id for a in adapters())] if among is None else among
    on_indeed = F.col("adapter_id") == INDEED
    url, is_posting = F.col("url"), F.col("_is_posting")
    allowed = is_posting_page(F.col("adapter_id"), url) if gated else F.lit(True)
    read = routed.withColumn("_is_posting", allowed)
    if "dom_nodes" not in routed.columns:
        read = with_dom(
            read.withColumn("html", F.when(is_posting, F.col("html"))), attributes_read(among)
        )
    # Both kinds of pages go through the same stages, so a page's elements are
    # handed on as seldom as possible.
    others = indeed_stages(on_indeed) if INDEED in among else []
    sites = site_stages(~on_indeed & is_posting, among)
    for site, other in zip_longest(sites, others, fillvalue={}):
        read = stage(read, **site, **other)
    read = read.withColumn("_site", site_posting(F.col("adapter_id"), url))
    posting = F.col("_site")
    if INDEED in among:
        posting = F.when(on_indeed, indeed_posting(url)).otherwise(posting)
    status = (
        F.when(~is_posting, F.lit("hidden"))
        .when(on_indeed, indeed_status() if INDEED in among else F.lit(None))
        .when(F.col("_site").isNotNull(), F.lit("ok"))
        .otherwise(F.lit("not-found"))
    )
    confidence = let(F.col("posting"), lambda p: p["detection"]["confidence"])
    kept = [c for c in routed.columns if c != "html" and not c.startswith("dom_")] + ["_is_posting"]
    read = stage(read, status=status, posting=posting).select(*kept, "status", "posting")
    read = stage(read, outcome=outcome(F.col("status"), confidence, is_posting))
    return read.drop("_is_posting")


def extract_postings(pages: DataFrame) -> DataFrame:
    """Postings of all captured pages that are in scope and claimed by a site.

    Where the pages are stored with their ``host`` (as ``sources.pages.write_pages`` does),
    files and row groups of other hosts are not read.
    """
    if "host" in pages.columns:
        pages = pages.filter(claimed_host(F.col("host"))).drop("host")
    routed = route(pages.filter(in_scope(F.col("url")))).filter(F.col("adapter_id").isNotNull())
    return read_postings(routed)


def write_parsed(pages: DataFrame, path: str, attributes: Sequence[str] = ()) -> None:
    """Store pages as the parser reads them, beside their columns but ``html``.

    The attributes kept are those that the sites' selectors read now, and ``attributes``;
    a site registered later that reads others needs the pages parsed again. A query over the
    stored pages reads the fields it uses and runs no Python.
    """
    among = [INDEED, *(a.adapter_id for a in adapters())]
    with_dom(pages, {*attributes_read(among), *attributes}).write.parquet(path)
