"""Text helpers with ECMAScript semantics, as Column expressions.

Java's ``\\s`` and Spark's ``trim`` know fewer white-space characters than the
pages' own language, and lengths there count UTF-16 units, so both are spelled
out here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and line terminators of ECMAScript.
WS = (
    r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
)
WS_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


MAX_DOUBLE = 1.7976931348623157e308


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as ``body`` likes."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def collapse(text: Column) -> Column:
    """White-space runs become one space; both ends are trimmed."""
    return F.btrim(F.regexp_replace(text, f"{WS}+", " "), F.lit(" "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def len16(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def at_least(text: Column, units: int) -> Column:
    """``len16(text) >= units``, counting units only when characters fall short."""
    return (F.length(text) >= units) | (len16(text) >= units)


def truncate_label(text: Column, limit: int) -> Column:
    """At most ``limit`` UTF-16 units, the last one an ellipsis when cut.

    A pair of surrogates that straddles the cut is dropped whole.
    """
    room = limit - 1
    astral = F.length(text) != len16(text)
    fits = F.filter(F.sequence(F.lit(0), F.lit(room)), lambda k: len16(F.left(text, k)) <= room)
    kept = F.when(astral, F.array_max(fits)).otherwise(F.lit(room))
    return F.when(len16(text) > limit, F.concat(F.left(text, kept), F.lit("…"))).otherwise(text)


def number_text(number: Column) -> Column:
    """A double the way ECMAScript prints it."""
    digits = number.cast("string")
    fixed = digits.try_cast("decimal(38,16)").cast("string")
    plain = F.regexp_replace(fixed, r"\.0+\z|(\.[0-9]*?)0+\z", "$1")
    # Very large and very small numbers are written with an exponent.
    scientific = F.regexp_replace(F.regexp_replace(digits, r"(\.0)?E", "e"), "e([0-9])", "e+$1")
    size = F.abs(number)
    return F.when((size >= 1e21) | ((size < 1e-6) & (size > 0)), scientific).otherwise(plain)


def number_of(text: Column) -> Column:
    """``Number(text)`` for decimal text; empty text is 0, anything else null."""
    bare = trim(text)
    decimal = bare.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")
    value = F.when(decimal, bare.try_cast("double"))
    finite = F.abs(value) <= F.lit(MAX_DOUBLE)
    return F.when(bare == "", F.lit(0.0)).when(finite, value)


def compose_posting_text(
    title: Column, company: Column, location: Column, salary_raw: Column, description: Column
) -> Column:
    """The posting as one text: header lines, an empty line, the description."""
    return F.concat_ws("\n", title, company, location, salary_raw, F.lit(""), description)
