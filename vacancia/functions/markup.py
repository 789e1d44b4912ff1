"""Markup carried inside text values: entities and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancia.functions.text import collapse, let

# The named references that are decoded; all others stay as they are.
ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "ndash": "–",
    "mdash": "—",
    "rsquo": "’",
    "lsquo": "‘",
    "rdquo": "”",
    "ldquo": "“",
    "hellip": "…",
    "bull": "•",
    "middot": "·",
}

_REFERENCE_OR_TEXT = r"(?i)&(?:#x?[0-9a-f]+|[a-z]+);|[^&]+|&"
_SCRIPT_OR_STYLE = r"(?is)<(script|style)(?![A-Za-z0-9_])[^>]*>.*?</\1>"


def _code_point(token: Column) -> Column:
    """Code point of a numeric reference; null when it has no digits or too many."""
    hexadecimal = F.conv(F.regexp_extract(token, r"(?i)^&#x0*([0-9a-f]{1,6});", 1), 16, 10)
    # Without the x only the leading decimal digits count.
    decimal = F.regexp_extract(token, r"(?i)^&#0*([0-9]{1,7})(?:[a-f][0-9a-f]*)?;", 1)
    is_hex = F.lower(F.substring(token, 3, 1)) == "x"
    return F.when(is_hex, hexadecimal).otherwise(decimal).try_cast("int")


def _character(code: Column) -> Column:
    """The character, or null outside 1..10FFFF and for half a surrogate pair."""
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Decode character references in a single pass."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def decode(token: Column) -> Column:
        named = F.try_element_at(names, F.lower(F.substring(token, F.lit(2), F.length(token) - 2)))
        numeric = let(_code_point(token), _character)
        is_reference = F.startswith(token, F.lit("&")) & F.endswith(token, F.lit(";"))
        decoded = F.when(F.substring(token, 2, 1) == "#", numeric).otherwise(named)
        return F.when(is_reference, F.coalesce(decoded, token)).otherwise(token)

    tokens = F.regexp_extract_all(text, F.lit(_REFERENCE_OR_TEXT), 0)
    return F.when(
        F.contains(text, F.lit("&")), F.array_join(F.transform(tokens, decode), "")
    ).otherwise(text)


def html_to_text(value: Column) -> Column:
    """Plain, marked-up or doubly escaped text as collapsed plain text."""
    escaped = value.rlike(r"(?i)&lt;|&gt;")
    return let(
        F.when(escaped, decode_entities(value)).otherwise(value),
        lambda s: collapse(
            decode_entities(
                F.regexp_replace(F.regexp_replace(s, _SCRIPT_OR_STYLE, " "), "<[^>]+>", " ")
            )
        ),
    )
