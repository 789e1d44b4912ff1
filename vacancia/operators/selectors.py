"""Selector chains over ``dom_nodes``, as Spark SQL text.

Selectors are written in the dialect the adapters use: ``tag``, ``#id``,
``.class``, ``[attr="v"]`` and compounds of them, ``:first-child``,
``:has(> tag)``, and the combinators descendant (space), child (``>``) and later
sibling (``~``). Each becomes one array expression, so a chain costs no shuffle
and no Python.

The functions take and return SQL text: a page's expressions are large, and one
text is planned far faster than thousands of Column calls.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

_SIMPLE = re.compile(
    r"""(?P<tag>^[a-z][a-z0-9]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[(?P<attr>[\w-]+)="(?P<value>[^"]*)"\]|(?P<first>:first-child)|:has\(>\s*(?P<child>[a-z0-9]+)\)""",
    re.VERBOSE,
)
_COMPOUND = re.compile(r"""\s*([>~]|\s|^)\s*((?:[^\s>~\[(]|\[[^\]]*\]|\([^)]*\))+)""")
# Fixed value: HTML compares the values of this attribute without regard to case.
_CASELESS = {"type"}


def sql_text(value: str | None) -> str:
    """A SQL string literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _simple_parts(compound: str) -> list[re.Match]:
    parts = list(_SIMPLE.finditer(compound))
    if "".join(p.group() for p in parts) != compound:
        raise ValueError(f"selector outside the dialect: {compound!r}")
    return parts


def _steps(selector: str) -> list[tuple[str, str]]:
    """``(combinator, compound)`` pairs, left to right; the first has none."""
    return [(m.group(1).strip() or " ", m.group(2)) for m in _COMPOUND.finditer(selector.strip())]


def attributes_used(selectors: Iterable[str]) -> set[str]:
    """Attributes the selectors read, for :func:`vacancia.operators.dom.parse_html`."""
    return {p["attr"] for s in selectors for _, c in _steps(s) for p in _simple_parts(c) if p["attr"]}


def _matches(n: str, compound: str, nodes: str) -> str:
    return " AND ".join(_tests(n, compound, nodes))


def _tests(n: str, compound: str, nodes: str) -> list[str]:
    tests = []
    for part in _simple_parts(compound):
        if part["tag"]:
            tests.append(f"{n}.tag = {sql_text(part['tag'])}")
        elif part["id"]:
            tests.append(f"{n}.id <=> {sql_text(part['id'])}")
        elif part["cls"]:
            tests.append(f"array_contains({n}.classes, {sql_text(part['cls'])})")
        elif part["attr"]:
            have, want = f"try_element_at({n}.attrs, {sql_text(part['attr'])})", part["value"]
            if part["attr"] in _CASELESS:
                have, want = f"lower({have})", want.lower()
            tests.append(f"{have} <=> {sql_text(want)}")
        elif part["first"]:
            tests.append(f"{n}.sib = 1")
        else:
            tests.append(
                f"exists({nodes}, c -> c.parent = {n}.idx AND c.tag = {sql_text(part['child'])})"
            )
    return tests


def contains(outer: str, inner: str) -> str:
    """``inner`` is ``outer`` itself or lies inside it."""
    return f"({outer}.idx <= {inner}.idx AND {inner}.idx < {outer}.end)"


def inside(outer: str, inner: str) -> str:
    return f"({outer}.idx < {inner}.idx AND {inner}.idx < {outer}.end)"


_RELATED: dict[str, Callable[[str, str], str]] = {
    " ": inside,
    ">": lambda a, n: f"{n}.parent = {a}.idx",
    "~": lambda a, n: f"({n}.parent = {a}.parent AND {a}.idx < {n}.idx)",
}


def query_all(nodes: str, selector: str) -> str:
    """Every match of one selector, in document order.

    Left parts are resolved first: their few matches anchor the next part, so a
    long page is scanned once per part and not once per candidate.
    """
    (_, first), *rest = _steps(selector)
    found = f"filter({nodes}, n -> {_matches('n', first, nodes)})"
    for depth, (combinator, compound) in enumerate(rest):
        anchors = f"s{depth}"
        related = _RELATED[combinator]("a", "n")
        tests = _tests("n", compound, nodes)
        cheap = [t for t in tests if not t.startswith("exists(")] or ["true"]
        dear = [t for t in tests if t.startswith("exists(")]
        found = let(
            anchors,
            found,
            # The anchor is tested ahead of what may look at the whole page.
            f"filter({nodes}, n -> {' AND '.join(cheap)} AND exists({anchors}, a -> {related})"
            f"{''.join(f' AND {t}' for t in dear)})",
        )
    return found


def query_first(nodes: str, chain: Sequence[str], within: str | None = None) -> str:
    """First match of the first selector that matches at all, else null.

    A match wins even when it is empty. ``within`` keeps matches inside a node;
    as in the page's own language, outer parts may match beyond it.
    """

    def first(selector: str) -> str:
        found = query_all(nodes, selector)
        if within is not None:
            found = f"filter({found}, n -> {inside('w', 'n')})"
        return f"get({found}, 0)"

    matches = f"coalesce({', '.join(first(s) for s in chain)})"
    return matches if within is None else let("w", within, matches)


def text_of(dom: str, node: str) -> str:
    """Collapsed text of a node; null when the node is missing or empty."""
    return let("x", node, f"nullif(substring({dom}_ctext, x.c0 + 1, x.clen), '')")


def raw_text_of(dom: str, node: str) -> str:
    """Text of a node with white space as captured, trimmed."""
    return let("x", node, f"substring({dom}_text, x.r0 + 1, x.rlen)")


def chain_text(dom: str, chain: Sequence[str], within: str | None = None) -> str:
    if not chain:
        return sql_text(None)
    return text_of(dom, query_first(f"{dom}_nodes", chain, within))
