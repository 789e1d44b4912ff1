"""JSON-LD blocks as rows of the members that are read.

Blocks are decoded where their page is parsed. An object hands over the members that some
rule looks at, with their JSON types told by the columns they are in: a text is only a
JSON string, a number only a JSON number. What nothing reads, however deep or long, stays
behind; what is read is handed over whole.
"""

from __future__ import annotations

import json
import sys
from json import scanner

import pyarrow as pa

AMOUNT = "struct<text:string,number:double>"
LD_OBJECT = (
    "struct<types:array<string>,title:string,identifier:string,employer:string,description:string,"
    "places:array<struct<address:string,parts:array<string>>>,"
    f"pay:struct<min:{AMOUNT},max:{AMOUNT},single:{AMOUNT},currency:string,unit:string>>"
)

# The parts of an address, in the order they are written.
ADDRESS_PARTS = ("addressLocality", "addressRegion", "addressCountry")

_TEXTS = pa.list_(pa.string())
_AMOUNT = pa.struct([("text", pa.string()), ("number", pa.float64())])
ARROW_OBJECT = pa.struct(
    [
        ("types", _TEXTS),
        *((n, pa.string()) for n in ("title", "identifier", "employer", "description")),
        ("places", pa.list_(pa.struct([("address", pa.string()), ("parts", _TEXTS)]))),
        (
            "pay",
            pa.struct(
                [*((n, _AMOUNT) for n in ("min", "max", "single")), ("currency", pa.string()), ("unit", pa.string())]
            ),
        ),
    ]
)


def _no_number(text: str) -> float:
    raise ValueError(text)


def _number(text: str) -> float | None:
    value = float(text)
    return value if abs(value) != float("inf") else None


_NUMBERS = {"parse_constant": _no_number, "parse_float": _number, "parse_int": _number}


class _Deep(json.JSONDecoder):
    """Decodes by Python calls, whose depth only memory limits."""

    def __init__(self) -> None:
        super().__init__(**_NUMBERS)
        self.scan_once = scanner.py_make_scanner(self)


def _decoded(text: str) -> object:
    try:
        return json.loads(text, **_NUMBERS)
    except RecursionError:
        limit = sys.getrecursionlimit()
        # Three calls a level, and no more levels than brackets.
        sys.setrecursionlimit(limit + 4 * (text.count("[") + text.count("{")))
        try:
            return _Deep().decode(text)
        finally:
            sys.setrecursionlimit(limit)


def flatten_json(text: str) -> list[dict]:
    """The objects of one JSON-LD block in document order; none if it is malformed.

    Members of arrays count as if they stood alone, members of ``@graph`` come ahead of the
    object that holds them. However deep they nest, the walk keeps its own stack.
    """
    try:
        block = _decoded(text)
    except ValueError:
        return []
    out: list[dict] = []
    todo: list[tuple[object, bool]] = [(block, False)]
    while todo:
        value, unfolded = todo.pop()
        if unfolded:
            out.append(value)
        elif isinstance(value, list):
            todo += [(member, False) for member in reversed(value)]
        elif isinstance(value, dict):
            todo.append((value, True))
            if isinstance(graph := value.get("@graph"), list):
                todo.append((graph, False))
    return out


def _text(value: object) -> str | None:
    """A JSON string; half a surrogate pair is written as a question mark."""
    if not isinstance(value, str):
        return None
    return value if value.isascii() else value.encode("utf-8", "replace").decode("utf-8")


def _member(value: object, name: str) -> object:
    return value.get(name) if isinstance(value, dict) else None


def _amount(value: object) -> dict:
    number = value if isinstance(value, float) else None
    return {"text": _text(value), "number": number}


def _place(value: object) -> dict | None:
    address = _member(value, "address")
    if isinstance(address, dict):
        parts = [_text(address.get(n)) for n in ADDRESS_PARTS]
        return {"address": None, "parts": [p for p in parts if p is not None]}
    return {"address": _text(address), "parts": None}


def _pay(value: object) -> dict | None:
    amount = _member(value, "value")
    if not isinstance(amount, dict):
        return None
    return {
        "min": _amount(amount.get("minValue")),
        "max": _amount(amount.get("maxValue")),
        "single": _amount(amount.get("value")),
        "currency": _text(_member(value, "currency")),
        "unit": _text(amount.get("unitText")),
    }


def read_members(found: dict) -> dict:
    """What is read of one object, as ``LD_OBJECT``."""
    kind, where = found.get("@type"), found.get("jobLocation")
    kinds = kind if isinstance(kind, list) else [kind]
    if isinstance(where, dict):
        where = [where]
    return {
        "types": [t for k in kinds if (t := _text(k)) is not None],
        "title": _text(found.get("title")),
        "identifier": _text(_member(found.get("identifier"), "name")),
        "employer": _text(_member(found.get("hiringOrganization"), "name")),
        "description": _text(found.get("description")),
        "places": [_place(p) for p in where] if isinstance(where, list) else None,
        "pay": _pay(found.get("baseSalary")),
    }
