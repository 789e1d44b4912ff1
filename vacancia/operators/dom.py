"""Captured HTML as a relational element array.

One Arrow UDF per page table turns HTML into ``dom``; every later decision is a
Column expression over it.

``dom`` holds the page's title, its text with white space as captured (``text``)
and collapsed (``ctext``), the position of ``body``, and ``nodes`` in document
order, and ``ld``, what is read of the objects of its JSON-LD blocks. A node's subtree is
``[idx, end)``. Its own text is a slice of the page's text, so a page's size stays linear
however deep it nests:

* collapsed and trimmed: ``substring(ctext, c0 + 1, clen)``
* as captured, trimmed: ``substring(text, r0 + 1, rlen)``
* ``wide`` counts characters that take two UTF-16 units.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.text import WS_CHARS
from vacancia.operators.linked_data import ARROW_OBJECT, LD_OBJECT, flatten_json, read_members

NODE = (
    "struct<idx:int,parent:int,end:int,sib:int,tag:string,id:string,classes:array<string>,"
    "attrs:map<string,string>,c0:int,clen:int,r0:int,rlen:int,wide:int>"
)
DOM_FIELDS = ("title", "body", "text", "ctext", "nodes", "ld")
DOM = f"struct<title:string,body:int,text:string,ctext:string,nodes:array<{NODE}>,ld:array<{LD_OBJECT}>>"

LINKED_DATA = "application/ld+json"

# Element sets of the HTML parsing rules that are applied here.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes template".split())
DECODED_RAW_TEXT = frozenset(("textarea", "title"))
FOREIGN = frozenset(("svg", "math"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = HEADINGS | frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption "
    "center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form "
    "frame frameset head header hgroup hr html iframe img input li link listing main marquee menu "
    "meta nav noembed noframes noscript object ol p param plaintext pre script search section "
    "select source style summary table tbody td template textarea tfoot th thead title tr track "
    "ul wbr xmp".split()
)
SCOPE = frozenset("applet body caption html marquee object table td template th".split())
TABLE_SCOPE = frozenset("body html table template".split())
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form header hgroup hr li listing main menu nav ol p plaintext pre search "
    "section summary table ul xmp".split()
)

# Start tags that end foreign content.
BREAKS_OUT = HEADINGS | frozenset(
    "b big blockquote body br center code dd div dl dt em embed head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)

_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?)?"""
_TOKEN = re.compile(
    rf"""([^<]+)                                                # text
    |<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)>       # tag
    |<!--(?:-?>|.*?(?:--!?>|\Z))                                # comment
    |<(?:[!?][^>]*+>?|/>|/[^A-Za-z>][^>]*+>?)                    # bogus comment
    |<[A-Za-z/].*\Z                                             # cut off inside a tag
    |(<)""",
    re.ASCII | re.DOTALL | re.VERBOSE,
)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.ASCII)
_RAW_END = {tag: re.compile(rf"(?i)</{tag}(?=[\s/>])[^>]*>") for tag in RAW_TEXT}
_IS_WS = np.zeros(0x10000, dtype=bool)
_IS_WS[[ord(c) for c in WS_CHARS]] = True
_BUTTON_SCOPE = SCOPE | {"button"}
_ITEM_BOUNDARY = SPECIAL - {"address", "div", "p"}
_ROW_GROUPS = ("tbody", "thead", "tfoot")

# Per tag, what its start or end closes: the nearest open element of these names
# that no boundary hides.
_CLOSED_BY_START: dict[str, list[tuple[tuple[str, ...], frozenset[str]]]] = {
    tag: [(("p",), _BUTTON_SCOPE)] for tag in CLOSES_P
}
for _tags, _names, _boundary in (
    (("li",), ("li",), _ITEM_BOUNDARY),
    (("dd", "dt"), ("dd", "dt"), _ITEM_BOUNDARY),
    (("option", "optgroup"), ("option",), SPECIAL),
    (("optgroup",), ("optgroup",), SPECIAL),
    (("td", "th"), ("td", "th"), TABLE_SCOPE | {"tr"}),
    (("tr",), ("tr",), TABLE_SCOPE),
    (_ROW_GROUPS, _ROW_GROUPS, TABLE_SCOPE),
    (("button",), ("button",), SCOPE),
    (("a",), ("a",), SPECIAL),
):
    for _tag in _tags:
        _CLOSED_BY_START.setdefault(_tag, []).append((_names, _boundary))

_CLOSED_BY_END: dict[str, tuple[tuple[str, ...], frozenset[str]]] = {
    **{tag: ((tag,), SCOPE) for tag in SPECIAL | SCOPE},
    **{tag: (tuple(HEADINGS), SCOPE) for tag in HEADINGS},
    **{tag: ((tag,), TABLE_SCOPE) for tag in (*_ROW_GROUPS, "table", "td", "th", "tr")},
    "p": (("p",), _BUTTON_SCOPE),
    "li": (("li",), SCOPE | {"ol", "ul"}),
}


class _Node:
    """An element: its place in the tree and the range of page text it covers."""

    __slots__ = ("idx", "tag", "attrs", "parent", "sib", "children", "start", "end", "stop")

    def __init__(self, idx: int, tag: str, attrs: dict[str, str], start: int) -> None:
        self.idx = idx
        self.tag = tag
        self.attrs = attrs
        self.parent = -1
        self.sib = 1
        self.children = 0
        self.start = start


class _Tree:
    """Elements of one page, appended in document order."""

    def __init__(self, keep: frozenset[str]) -> None:
        self.keep = keep | {"type"}
        self.types = "type" in keep
        self.nodes: list[_Node] = []
        self.stack: list[_Node] = []
        self.pieces: list[str] = []
        self.size = 0
        self.body: _Node | None = None
        self.title: _Node | None = None
        self.blocks: list[_Node] = []
        self.foreign = 0
        self.root = self.open("html", {})
        self.open("head", {})

    def open(self, tag: str, attrs: dict[str, str]) -> _Node:
        node = _Node(len(self.nodes), tag, attrs, self.size)
        if self.stack:
            parent = self.stack[-1]
            parent.children += 1
            node.parent = parent.idx
            node.sib = parent.children
        self.nodes.append(node)
        self.stack.append(node)
        if tag in FOREIGN:
            self.foreign += 1
        return node

    def close(self) -> None:
        node = self.stack.pop()
        node.end = len(self.nodes)
        node.stop = self.size
        if node.tag in FOREIGN:
            self.foreign -= 1

    def text(self, piece: str) -> None:
        self.pieces.append(piece)
        self.size += len(piece)

    def start_body(self) -> None:
        if self.body is None:
            while len(self.stack) > 1:
                self.close()
            self.body = self.open("body", {})

    def close_to(self, names: tuple[str, ...], boundary: frozenset[str]) -> bool:
        """Close up to the nearest open element in ``names``, unless a boundary hides it."""
        stack = self.stack
        for depth in range(len(stack) - 1, 0, -1):
            tag = stack[depth].tag
            if tag in names:
                if stack[depth] is self.body:
                    return False
                while len(stack) > depth:
                    self.close()
                return True
            if tag in boundary:
                return False
        return False

    def start(self, tag: str, attr_text: str, nested: bool) -> None:
        attrs = _attributes(attr_text, self.keep) if attr_text else {}
        kind = attrs.get("type", "") if self.types else attrs.pop("type", "")
        if tag in ("html", "body"):
            if tag == "body":
                self.start_body()
            target = (self.root if tag == "html" else self.body).attrs
            for name, value in attrs.items():
                target.setdefault(name, value)
            return
        if tag == "head":
            return
        if self.body is None and tag not in HEAD_ONLY:
            self.start_body()
        if self.foreign and tag in BREAKS_OUT:
            while self.foreign:
                self.close()
        if self.body is not None and not self.foreign:
            for names, boundary in _CLOSED_BY_START.get(tag, ()):
                self.close_to(names, boundary)
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.close()
        node = self.open(tag, attrs)
        if tag == "script" and kind.lower() == LINKED_DATA:
            self.blocks.append(node)
        if tag == "title" and self.title is None and not self.foreign:
            self.title = node
        if tag in VOID or (nested and self.foreign):
            self.close()

    def end(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            return
        names, boundary = _CLOSED_BY_END.get(tag) or ((tag,), SPECIAL)
        if tag == "br":
            self.start(tag, "", False)
        elif not self.close_to(names, boundary) and tag == "p":
            self.start(tag, "", False)
            self.close()


def _attributes(text: str, keep: frozenset[str]) -> dict[str, str]:
    attrs: dict[str, str] = {}
    for name, value in _ATTR.findall(text):
        name = name.lower()
        if name in keep and name not in attrs:
            if value[:1] in ("'", '"'):
                value = value[1:-1]
            attrs[name] = html_entities.unescape(value) if "&" in value else value
    return attrs


def _build(source: str, keep: frozenset[str]) -> _Tree:
    tree = _Tree(keep)
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    at, size = 0, len(source)
    match_at = _TOKEN.match
    while at < size:
        token = match_at(source, at)
        at = token.end()
        text, slash, name, attr_text, bare = token.groups()
        if text or bare:
            piece = text or bare
            if tree.body is None:
                if not piece.strip(" \t\n\f"):
                    continue
                tree.start_body()
            tree.text(html_entities.unescape(piece) if "&" in piece else piece)
        elif name and slash:
            tree.end(name.lower())
        elif name:
            tag = name.lower()
            tree.start(tag, attr_text, attr_text.endswith("/"))
            if tag in RAW_TEXT and not tree.foreign:
                closing = _RAW_END[tag].search(source, at)
                raw = source[at : closing.start() if closing else size]
                at = closing.end() if closing else size
                # What a template holds is not part of the page.
                if tag != "template":
                    tree.text(html_entities.unescape(raw) if tag in DECODED_RAW_TEXT else raw)
                tree.close()
    tree.start_body()
    while tree.stack:
        tree.close()
    return tree


def _linked_data(tree: _Tree, text: str) -> list[dict]:
    """What is read of the page's JSON-LD blocks."""
    blocks = (text[n.start : n.stop].strip(WS_CHARS) for n in tree.blocks)
    return [read_members(found) for block in blocks for found in flatten_json(block)]


# Pages are sliced together until they hold this many characters.
_SLICE_CHARS = 1 << 20


def _slices(trees: list[_Tree]) -> tuple[list[str], list[str], list[np.ndarray]]:
    """Raw and collapsed text per page and, per node, its trimmed slices of both."""
    texts = ["".join(t.pieces) for t in trees]
    begin = np.cumsum([0, *map(len, texts)])
    shift = np.repeat(begin[:-1], [len(t.nodes) for t in trees])
    starts = np.array([n.start for t in trees for n in t.nodes]) + shift
    stops = np.array([n.stop for t in trees for n in t.nodes]) + shift

    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = _IS_WS[np.minimum(codes, 0xFFFF)]
    kept = ~space
    kept[1:] |= ~space[:-1]
    # A page's first character follows nothing.
    kept[begin[:-1][begin[:-1] < len(codes)]] = True
    collapsed = np.where(space, 32, codes)[kept].tobytes().decode("utf-32-le", "surrogatepass")
    kept_before = np.concatenate(([0], np.cumsum(kept, dtype=np.int32)))
    ink = np.append(np.flatnonzero(~space), 0)
    ink_before = np.concatenate(([0], np.cumsum(~space, dtype=np.int32)))
    wide_before = np.concatenate(([0], np.cumsum(codes > 0xFFFF, dtype=np.int32)))

    ink_from, ink_to = ink_before[starts], ink_before[stops]
    filled = ink_to > ink_from
    first = np.where(filled, ink[ink_from], shift)
    after = np.where(filled, ink[ink_to - 1] + 1, shift)
    ctext_begin = kept_before[begin]
    return (
        texts,
        [collapsed[a:b] for a, b in zip(ctext_begin[:-1], ctext_begin[1:])],
        [
            kept_before[first] - kept_before[shift],
            kept_before[after] - kept_before[first],
            first - shift,
            after - first,
            wide_before[after] - wide_before[first],
        ],
    )


def _offsets(sizes: Iterable[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(list(sizes)))), type=pa.int32())


# White space as HTML has it; other kinds are text.
_HTML_SPACE = re.compile("[ \t\n\f\r]+")


def _parts(text: str) -> list[str]:
    return [p for p in _HTML_SPACE.split(text) if p]


def _title(tree: _Tree, text: str) -> str:
    """The page's title, collapsed."""
    return " ".join(_parts(text[tree.title.start : tree.title.stop])) if tree.title else ""


def _to_arrow(pages: pa.Array, keep: frozenset[str]) -> pa.Array:
    """The ``dom`` column of one Arrow batch."""
    trees: list[_Tree] = []
    texts: list[str] = []
    ctexts: list[str] = []
    slices: list[list[np.ndarray]] = []
    waiting: list[_Tree] = []
    held = 0

    def flush() -> None:
        if waiting:
            raw, collapsed, of_nodes = _slices(waiting)
            texts.extend(raw)
            ctexts.extend(collapsed)
            slices.append(of_nodes)
            waiting.clear()

    for source in pages:
        tree = _build(source.as_py() or "", keep)
        trees.append(tree)
        waiting.append(tree)
        held += tree.size
        if held > _SLICE_CHARS:
            flush()
            held = 0
    flush()

    nodes = [n for t in trees for n in t.nodes]
    columns = [
        [n.idx for n in nodes],
        [n.parent for n in nodes],
        [n.end for n in nodes],
        [n.sib for n in nodes],
        *(np.concatenate(c) for c in zip(*slices)),
    ]
    attrs = [n.attrs for n in nodes]
    numbers = [pa.array(c, type=pa.int32()) for c in columns]
    numbers += [pa.array([], type=pa.int32())] * (9 - len(numbers))
    classes = [_parts(a.pop("class", "")) for a in attrs]
    ids = [a.pop("id", None) for a in attrs]
    class_lists = pa.ListArray.from_arrays(
        _offsets(map(len, classes)), pa.array([c for cs in classes for c in cs], pa.string())
    )
    attr_maps = pa.MapArray.from_arrays(
        _offsets(map(len, attrs)),
        pa.array([k for a in attrs for k in a], pa.string()),
        pa.array([v for a in attrs for v in a.values()], pa.string()),
    )
    named = {
        "idx": numbers[0],
        "parent": numbers[1],
        "end": numbers[2],
        "sib": numbers[3],
        "tag": pa.array([n.tag for n in nodes], pa.string()),
        "id": pa.array(ids, pa.string()),
        "classes": class_lists,
        "attrs": attr_maps,
        "c0": numbers[4],
        "clen": numbers[5],
        "r0": numbers[6],
        "rlen": numbers[7],
        "wide": numbers[8],
    }
    elements = pa.StructArray.from_arrays(list(named.values()), names=list(named))
    return pa.StructArray.from_arrays(
        [
            pa.array([_title(t, text) for t, text in zip(trees, texts)], pa.string()),
            pa.array([t.body.idx for t in trees], pa.int32()),
            pa.array(texts, pa.string()),
            pa.array(ctexts, pa.string()),
            pa.ListArray.from_arrays(_offsets(len(t.nodes) for t in trees), elements),
            pa.array(
                [_linked_data(t, text) for t, text in zip(trees, texts)], pa.list_(ARROW_OBJECT)
            ),
        ],
        names=list(DOM_FIELDS),
    )


def parse_html(source: Column, attributes: Iterable[str]) -> Column:
    """``dom`` of an HTML column, keeping ``id``, ``class`` and the named attributes.

    Only attributes that some selector reads are worth their bytes on the way
    from Python to the engine, so callers pass ``selectors.attributes_used``.
    """
    keep = frozenset(attributes) | {"id", "class"}

    @F.arrow_udf(DOM)
    def to_dom(pages: pa.Array) -> pa.Array:
        return _to_arrow(pages, keep)

    return to_dom(source)


def with_dom(pages: DataFrame, attributes: Iterable[str]) -> DataFrame:
    """Replace ``html`` by ``dom_title``, ``dom_body``, ``dom_text``, ``dom_ctext``, ``dom_nodes``,
    ``dom_ld``."""
    parsed = pages.withColumn("_dom", parse_html(F.col("html"), attributes))
    kept = [F.col(f"`{c}`") for c in pages.columns if c != "html"]
    return parsed.select(*kept, *[F.col(f"_dom.{f}").alias(f"dom_{f}") for f in DOM_FIELDS])
