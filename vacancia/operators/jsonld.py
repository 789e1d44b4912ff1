"""Embedded JSON-LD job postings, as SQL text over the objects the parser hands over.

The page's objects are taken in order and the first one that is a job posting is read.
Everything stays inside array expressions: no explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancia.functions.markup import html_to_text
from vacancia.functions.salary import base_salary
from vacancia.functions.text import MAX_DOUBLE, blank_to_null, number_of, trim
from vacancia.operators.selectors import let
from vacancia.schemas import SALARY

LD = f"struct<title:string,company:string,location:string,salary:{SALARY},description:string>"


def looks_like_job_posting(node: str) -> str:
    """Typed as a job posting, or untyped with a description and an employer name."""
    typed = f"exists({node}.types, k -> lower(k) = 'jobposting')"
    described = f"coalesce({node}.description != '', false)"
    return f"({typed} OR ({described} AND {node}.employer IS NOT NULL))"


def first_job_posting(dom: str) -> str:
    """The first job posting among the page's objects, in document order, else null."""
    return f"get(filter({dom}_ld, j -> {looks_like_job_posting('j')}), 0)"


def _location(node: str) -> str:
    """Places joined by a middle dot; each is its address text or its parts."""
    # Blank parts are dropped; a part is never trimmed.
    filled = "filter(pl.parts, p -> p RLIKE '[^\\\\s\\\\u00A0\\\\uFEFF]')"
    place = f"coalesce(pl.address, nullif(array_join({filled}, ', '), ''))"
    texts = f"filter(transform({node}.places, pl -> {place}), q -> q IS NOT NULL)"
    return let("ts", texts, "CASE WHEN size(ts) > 0 THEN array_join(ts, ' · ') END")


def fields(node: str) -> str:
    """The posting's values as they stand in the block; null without a posting."""
    values = (
        f"struct(j.title AS title, j.identifier AS identifier, j.employer AS company, {_location('j')} AS location,"
        " j.pay AS pay, coalesce(j.description, '') AS description)"
    )
    return let("j", node, f"CASE WHEN j IS NOT NULL THEN {values} END")


def read_fields(raw: Column) -> Column:
    """Fields of :func:`fields` cleaned up, as :data:`LD`; null stays null."""

    def clean(name: str) -> Column:
        return blank_to_null(trim(raw[name]))

    def amount(name: str) -> Column:
        value = raw["pay"][name]
        finite = F.when(F.abs(value["number"]) <= F.lit(MAX_DOUBLE), value["number"])
        return F.coalesce(number_of(F.translate(value["text"], "$,", "")), finite)

    amounts = F.struct(*[amount(n).alias(n) for n in ("min", "max", "single")])
    pay = F.when(
        raw["pay"].isNotNull(), base_salary(amounts, raw["pay"]["currency"], raw["pay"]["unit"])
    )
    return F.when(
        raw.isNotNull(),
        F.struct(
            F.coalesce(clean("title"), clean("identifier")).alias("title"),
            clean("company").alias("company"),
            raw["location"].alias("location"),
            pay.alias("salary"),
            html_to_text(raw["description"]).alias("description"),
        ),
    ).cast(LD)
