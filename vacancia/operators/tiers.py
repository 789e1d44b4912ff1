"""The three tiers that turn a career-site page into a posting.

Embedded JSON-LD, then the site's selectors, then the largest block of text. A
tier is worked out only for rows the tiers before it left empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancia.functions.salary import parse_salary
from vacancia.functions.text import at_least
from vacancia.functions.text import let as let_column
from vacancia.operators import jsonld
from vacancia.operators.adapters import SelectorChains, per_adapter, per_chains
from vacancia.operators.selectors import chain_text, let
from vacancia.operators.structural import structural_content
from vacancia.schemas import MIN_DESCRIPTION, POSTING, SALARY, UNKNOWN_COMPANY, UNKNOWN_TITLE

CONTENT = (
    f"struct<title:string,company:string,location:string,salary:{SALARY},"
    "description:string,method:string,confidence:string>"
)


def _content(found: Column, method: str, confidence: str, **fields: Column) -> Column:
    names = ("title", "company", "location", "salary", "description")
    values = [fields.get(n, F.lit(None)).alias(n) for n in names]
    marks = [F.lit(method).alias("method"), F.lit(confidence).alias("confidence")]
    return F.when(found, F.struct(*values, *marks)).cast(CONTENT)


def _selected(chains: SelectorChains) -> str:
    """What a site's selectors find, as SQL text; null without a long enough description."""
    return let(
        "d",
        chain_text("dom", chains.description),
        f"CASE WHEN length(d) >= {MIN_DESCRIPTION}"
        f" OR octet_length(encode(d, 'UTF-16BE')) >= {2 * MIN_DESCRIPTION} THEN struct("
        f"{chain_text('dom', chains.title)} AS title, {chain_text('dom', chains.company)} AS company,"
        f"{chain_text('dom', chains.location)} AS location, d AS description) END",
    )


def _long_enough(ld: Column) -> Column:
    return F.coalesce(at_least(ld["description"], MIN_DESCRIPTION), F.lit(False))


def site_stages(wanted: Column, among: Sequence[str]) -> list[dict[str, Column]]:
    """Columns to add stage by stage to parsed pages with ``adapter_id``: what each tier finds."""
    no_ld = wanted & ~F.coalesce(let_column(F.col("_ld"), _long_enough), F.lit(False))
    return [
        {"_raw": F.when(wanted, F.expr(jsonld.fields(jsonld.first_job_posting("dom"))))},
        {"_ld": let_column(F.col("_raw"), jsonld.read_fields)},
        {"_selected": F.when(no_ld, F.expr(per_chains("adapter_id", _selected, among)))},
        {
            "_block": F.when(
                no_ld & F.col("_selected").isNull(), F.expr(structural_content("dom"))
            )
        },
    ]


def site_posting(adapter_id: Column, url: Column) -> Column:
    """The posting of the first tier that holds, from the columns of the stages; else null."""
    label = per_adapter(adapter_id, lambda a: F.lit(a.label))
    employer = per_adapter(adapter_id, lambda a: F.lit(a.company_label))
    source_url = per_adapter(adapter_id, lambda a: a.source_url(url))

    def embedded(ld: Column) -> Column:
        fields = ("title", "company", "location", "salary", "description")
        return _content(_long_enough(ld), "json-ld", "high", **{f: ld[f] for f in fields})

    def selected(found: Column, ld: Column) -> Column:
        texts = {f: F.coalesce(found[f], ld[f]) for f in ("title", "company", "location")}
        return _content(
            found.isNotNull(), "selector", "high", description=found["description"], **texts
        )

    def structural(block: Column) -> Column:
        fields = {f: block[f] for f in ("title", "description")}
        return _content(block.isNotNull(), "structural", "low", **fields)

    def finish(c: Column) -> Column:
        return F.when(
            c.isNotNull(),
            F.struct(
                F.coalesce(c["title"], F.lit(UNKNOWN_TITLE)).alias("title"),
                F.coalesce(employer, c["company"], F.lit(UNKNOWN_COMPANY)).alias("company"),
                c["location"].alias("location"),
                F.coalesce(c["salary"], parse_salary(c["description"])).alias("salary"),
                c["description"].alias("description_text"),
                source_url.alias("source_url"),
                F.lit(None).cast("string").alias("container_tier"),
                F.struct(
                    adapter_id.alias("adapter_id"),
                    label.alias("adapter_label"),
                    c["method"].alias("method"),
                    c["confidence"].alias("confidence"),
                ).alias("detection"),
            ),
        )

    found = F.struct(F.col("_ld").alias("ld"), F.col("_selected").alias("s"), F.col("_block").alias("b"))
    tiers = let_column(
        found, lambda f: F.coalesce(embedded(f["ld"]), selected(f["s"], f["ld"]), structural(f["b"]))
    )
    return let_column(tiers, finish).cast(POSTING)
