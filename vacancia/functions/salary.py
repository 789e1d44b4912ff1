"""Pay ranges from text and from structured pay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancia.functions.text import WS, blank_to_null, let, number_of, number_text, trim
from vacancia.schemas import SALARY

# The two dialects of pay text, and one amount.
PAY_SITES = (
    rf"(?i)\$[\d,]+(?:\.\d+)?(?:{WS}*(?:-|to|–|—){WS}*\$?[\d,]+(?:\.\d+)?)?{WS}*(?:an|a|per)?{WS}*"
    r"(?:year|yr|hour|hr|month|mo|week|wk|day|annually|hourly)?"
)
PAY_INDEED = (
    rf"(?i)\$[\d,]+(?:\.\d+)?(?:{WS}*(?:-|to|–){WS}*\$?[\d,]+(?:\.\d+)?)?{WS}*(?:an|a|per)?{WS}*"
    r"(?:year|hour|month|week|day)?"
)
AMOUNT = r"\$[\d,]+(?:\.\d+)?"


def pay_text(text: Column, pattern: str = PAY_SITES) -> Column:
    """First pay expression in ``text``, trimmed; null when there is none."""
    found = F.when(F.contains(text, F.lit("$")), F.regexp_extract(text, pattern, 0))
    return blank_to_null(trim(found))


def pay_range(raw: Column) -> Column:
    """Amounts of a pay expression: the first, and the second or again the first."""
    amounts = F.transform(
        F.regexp_extract_all(raw, F.lit(AMOUNT), 0),
        lambda a: number_of(F.translate(a, "$,", "")),
    )

    def build(found: Column) -> Column:
        first = F.get(found, F.lit(0))
        return F.struct(
            first.alias("min"),
            F.when(F.size(found) > 1, F.get(found, F.lit(1))).otherwise(first).alias("max"),
            raw.alias("raw"),
        )

    return F.when(raw.isNotNull(), let(amounts, build)).cast(SALARY)


def parse_salary(text: Column, pattern: str = PAY_SITES) -> Column:
    """Pay range of the first pay expression in ``text``, else null."""
    return let(pay_text(text, pattern), pay_range)


def base_salary(value: Column, currency: Column, unit: Column) -> Column:
    """Pay range of structured pay.

    ``value`` is ``struct(min, max, single)`` of doubles, each null when not a
    finite number; ``currency`` and ``unit`` are null when not text.
    """

    def build(v: Column) -> Column:
        low = F.coalesce(v["min"], v["single"])
        high = F.coalesce(v["max"], v["single"])
        amount = F.when(
            low.isNotNull() & high.isNotNull() & (low != high),
            F.concat(number_text(low), F.lit("–"), number_text(high)),
        ).otherwise(number_text(F.coalesce(low, high)))
        raw = F.concat(
            F.coalesce(F.concat(currency, F.lit(" ")), F.lit("")),
            amount,
            F.coalesce(F.concat(F.lit(" per "), F.lower(unit)), F.lit("")),
        )
        return F.when(
            low.isNotNull() | high.isNotNull(),
            F.struct(
                F.coalesce(low, high).alias("min"),
                F.coalesce(high, low).alias("max"),
                trim(raw).alias("raw"),
            ),
        )

    return let(value, build).cast(SALARY)
