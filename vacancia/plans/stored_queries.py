"""Queries over pages that are stored first: by host, as parsed, and of a site registered for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.operators.adapters import Adapter, SelectorChains, register_adapter, unregister_adapter
from vacancia.plans import page_queries
from vacancia.plans.extract import extract_postings, write_parsed
from vacancia.plans.page_queries import with_provenance
from vacancia.plans.page_templates import collapsed, documents, site_pages
from vacancia.plans.tables import fmt
from vacancia.schemas import STORED_PAGES
from vacancia.sources.pages import read_pages, write_pages
from vacancia.streaming.runs import new_folder

GUILD = "guild"


def extract_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of pages that were stored by host and are read again."""
    folder = new_folder(spark, "stored-pages")
    write_pages(site_pages(spark, sf), f"{folder}/pages", 8)
    return with_provenance(extract_postings(read_pages(spark, f"{folder}/pages", STORED_PAGES)))


def extract_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of pages that were stored as parsed; this query runs no Python."""
    folder = new_folder(spark, "parsed-pages")
    write_parsed(site_pages(spark, sf), f"{folder}/pages")
    return with_provenance(extract_postings(spark.read.parquet(f"{folder}/pages")))


def registered_adapter(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a site that is registered for this query alone."""
    chains = SelectorChains(title=("h4",), description=('[data-guild="text"]',), location=('[data-guild="place"]',))
    docs = documents(spark, sf)
    page = '<h4>Cooper {k}</h4><i data-guild="place">Hall {k}</i><p data-guild="text">{t}</p>'
    pages = docs.select(
        F.col("k").alias("page_id"),
        fmt("https://work.guild.test/{k}", k=F.col("k")).alias("url"),
        fmt(page, k=F.col("k"), t=F.col("t")).alias("html"),
    )
    register_adapter(Adapter(GUILD, "Guild", "own", ["work.guild.test"], chains, "Guild"))
    try:
        read = extract_postings(pages)
    finally:
        unregister_adapter(GUILD)
    return read.select(
        "page_id",
        "adapter_id",
        "status",
        F.col("posting.title").alias("title"),
        F.col("posting.company").alias("company"),
        F.col("posting.location").alias("location"),
        F.col("posting.detection.method").alias("method"),
        F.col("posting.description_text").alias("description_text"),
    )


QUERIES = {f.__name__: f for f in (extract_stored, extract_parsed, registered_adapter)}

ORACLES = {
    "extract_stored": page_queries.ORACLES["tiered_extract"],
    "extract_parsed": page_queries.ORACLES["tiered_extract"],
    "registered_adapter": f"""
        WITH src AS (SELECT doc_id AS k, {collapsed("replace(text, '$', '')")} AS d FROM documents),
          ok AS (SELECT *, length(d) >= 100 AS found FROM src)
        SELECT k AS page_id, '{GUILD}' AS adapter_id, CASE WHEN found THEN 'ok' ELSE 'not-found' END AS status,
          CASE WHEN found THEN 'Cooper ' || k END AS title, CASE WHEN found THEN 'Guild' END AS company,
          CASE WHEN found THEN 'Hall ' || k END AS location, CASE WHEN found THEN 'selector' END AS method,
          CASE WHEN found THEN d END AS description_text
        FROM ok""",
}
