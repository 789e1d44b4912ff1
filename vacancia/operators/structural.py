"""The largest coherent block of text on a page, without site knowledge."""

from __future__ import annotations

from vacancia.operators.selectors import contains, inside, let, sql_text, text_of
from vacancia.schemas import DOMINANT_SHARE, MIN_STRUCTURAL, UNKNOWN_TITLE

BLOCK_TAGS = ("main", "article", "section", "div")


def units(node: str) -> str:
    """UTF-16 length of a node's collapsed text."""
    return f"({node}.clen + {node}.wide)"


def raw_units(node: str) -> str:
    """UTF-16 length of a node's text as captured, trimmed."""
    return f"({node}.rlen + {node}.wide)"


def tag_in(node: str, tags: tuple[str, ...]) -> str:
    return f"{node}.tag IN ({', '.join(map(sql_text, tags))})"


def largest(nodes: str, size) -> str:
    """The node of an array with the greatest ``size``; the first in the page on a tie."""
    best = f"array_max(transform(ns, n -> struct({size('n')} AS n, -n.idx AS at)))"
    return let("ns", nodes, let("b", best, "get(filter(ns, n -> n.idx = -b.at), 0)"))


def largest_block(dom: str) -> str:
    """Largest block element by collapsed text, when it is long enough."""
    blocks = (
        f"filter({dom}_nodes, n -> n.idx > {dom}_body AND {tag_in('n', BLOCK_TAGS)}"
        f" AND {units('n')} >= {MIN_STRUCTURAL})"
    )
    return largest(blocks, units)


def tighten(dom: str, block: str) -> str:
    """The innermost descendant that still holds the dominant share of the text.

    Two disjoint subtrees cannot both hold that share, so the descendants that
    do form a chain and its last member in document order is the innermost.
    """
    holds = f"{units('n')} >= {units('bl')} * CAST({DOMINANT_SHARE} AS DOUBLE)"
    chain = f"filter({dom}_nodes, n -> {contains('bl', 'n')} AND {holds})"
    return let("bl", block, f"CASE WHEN bl IS NOT NULL THEN try_element_at({chain}, -1) END")


def guess_title(dom: str, container: str) -> str:
    """Text of the container's or the page's first h1, else the page title's
    first part, else the sentinel."""
    pick = f"coalesce(get(filter(hs, n -> {inside(container, 'n')}), 0), get(hs, 0))"
    heading = let("hs", f"filter({dom}_nodes, n -> n.tag = 'h1')", pick)
    page_title = f"nullif(trim(split({dom}_title, '[|–—-]')[0]), '')"
    return f"coalesce({text_of(dom, heading)}, {page_title}, {sql_text(UNKNOWN_TITLE)})"


def structural_content(dom: str) -> str:
    """``struct(title, description)`` of the tightened largest block, else null."""
    content = (
        f"CASE WHEN {units('ct')} >= {MIN_STRUCTURAL} THEN struct("
        f"{guess_title(dom, 'ct')} AS title, {text_of(dom, 'ct')} AS description) END"
    )
    return let("ct", tighten(dom, largest_block(dom)), content)
