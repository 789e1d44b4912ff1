"""Company names in one spelling, for duplicate look-ups only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.text import WS, let, trim
from vacancia.schemas import UNKNOWN_COMPANY

# What is cut from a name, in this order, and the known aliases.
LEADING_CODE = rf"^[0-9]{{2,}}{WS}+"
TRAILING_PARENTHETICAL = rf"{WS}*\([^)]*\){WS}*\z"
LEGAL_SUFFIX = (
    rf"(?i)[,]?{WS}*(?<![A-Za-z0-9_])"
    r"(incorporated|inc\.?|limited|ltd\.?|llc|corp\.?|corporation|co\.?|company|plc)"
    rf"{WS}*\z"
)
ALIASES = {
    "royal bank of canada": "RBC",
    "rbc": "RBC",
    "canadian imperial bank of commerce": "CIBC",
    "cibc bank usa": "CIBC",
    "cibc": "CIBC",
    "best buy canada": "Best Buy Canada",
    "best buy": "Best Buy",
    "walmart": "Walmart",
}


def bare_company(name: Column) -> Column:
    """The name without tenant code, trailing parenthetical and legal suffix."""

    def cut(s: Column) -> Column:
        without_code = F.regexp_replace(s, LEADING_CODE, "")
        without_note = trim(F.regexp_replace(without_code, TRAILING_PARENTHETICAL, ""))
        return F.when(F.lower(s).isin("", UNKNOWN_COMPANY.lower()), s).otherwise(
            trim(F.regexp_replace(without_note, LEGAL_SUFFIX, ""))
        )

    return let(trim(name), cut)


def canonical_company(name: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return let(bare_company(name), lambda s: F.coalesce(F.try_element_at(aliases, F.lower(s)), s))


def with_canonical_company(df: DataFrame, company: str, aliases: DataFrame, out: str) -> DataFrame:
    """As :func:`canonical_company`, with the aliases in a table of any size.

    ``aliases(alias_lower, canonical)`` holds one row per alias. No broadcast is
    forced; the engine picks one when the table proves small at run time.
    """
    named = df.withColumn("_bare", bare_company(F.col(company)))
    keyed = named.withColumn("_alias", F.lower("_bare"))
    return (
        keyed.join(
            aliases.select(F.col("alias_lower").alias("_alias"), F.col("canonical").alias("_canonical")),
            "_alias",
            "left",
        )
        .withColumn(out, F.coalesce("_canonical", "_bare"))
        .drop("_alias", "_bare", "_canonical")
    )
