"""The element array, against plain tree walks and against stated fragments."""

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacancia.functions.text import WS_CHARS
from vacancia.operators import dom, linked_data, selectors, structural
from vacancia.plans.extract import extract_postings


def parse(html, *attributes):
    return dom._to_arrow(pa.array([html]), frozenset(("id", "class", *attributes))).to_pylist()[0]


def shape(html):
    """The tree as nested ``tag(text|children)`` below body, white space dropped."""
    page = parse(html)
    nodes = page["nodes"]

    def show(i):
        kids = [n["idx"] for n in nodes if n["parent"] == i]
        inner = " ".join(show(k) for k in kids)
        return nodes[i]["tag"] + (f"({inner})" if inner else "")

    return show(page["body"])


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p>a<p>b", "body(p p)"),
        ("<p><b>a<br><p>b</p>", "body(p(b(br)) p)"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "body(ul(li li(ul(li)) li))"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "body(dl(dt dd dt))"),
        ("<table><tr><td>a<td>b<tr><th>c</table>", "body(table(tr(td td) tr(th)))"),
        ("<select><option>a<option>b</select>", "body(select(option option))"),
        ("<div><p>a</div>b", "body(div(p))"),
        ("<div/>x</div><br/><img>", "body(div br img)"),
        ("<p>a<div>b</div></p>", "body(p div p)"),
        ("<h1>a<h2>b", "body(h1 h2)"),
        ("<b><p>a</b>b</p>c", "body(b(p))"),
        ("<a>x<a>y</a>", "body(a a)"),
        ("<svg><path/><g><path/></g></svg><p>", "body(svg(path g(path)) p)"),
        ("<button><p>a</button><p>b", "body(button(p) p)"),
        ("<script>var a='<p>'</script><p>", "body(p)"),
        ("<body class=x><p>a</body><p>b", "body(p p)"),
        ("<!-- <p> --><p><!--><i></i>", "body(p(i))"),
        ("</p></div><p", "body(p)"),
        ("<template><p>a</p></template><p>b", "body(p)"),
    ],
)
def test_tree(html, expected):
    assert shape(html) == expected


def test_title_head_and_text():
    page = parse(
        "<!doctype html><html lang=en><head><title> a &amp;\n b</title><svg><title>no</title></svg>"
        "<script>x &amp; y</script><p>c&nbsp;d &lt; e"
    )
    assert page["title"] == "a & b"
    assert "x &amp; y" in page["text"]
    assert page["text"].endswith("c d < e")
    assert page["nodes"][page["body"]]["parent"] == 0


def test_attributes_are_kept_by_name():
    page = parse("<div id=a class=' x  y ' data-k='1&amp;2' data-z=3 DATA-K=9>t</div>", "data-k")
    node = page["nodes"][-1]
    assert (node["id"], node["classes"], dict(node["attrs"])) == ("a", ["x", "y"], {"data-k": "1&2"})


def test_empty_and_null_pages():
    pages = dom._to_arrow(pa.array(["", None, "x"]), frozenset()).to_pylist()
    assert [len(p["nodes"]) for p in pages] == [3, 3, 3]
    assert dom._to_arrow(pa.array([], pa.string()), frozenset()).to_pylist() == []


_text = st.text(alphabet="ab \n\t  😀", max_size=6)
_tree = st.recursive(
    _text,
    lambda kids: st.tuples(st.sampled_from(["div", "span", "section", "em"]), st.lists(kids, max_size=4)),
    max_leaves=25,
)


def _render(tree):
    if isinstance(tree, str):
        return tree
    return f"<{tree[0]}>{''.join(map(_render, tree[1]))}</{tree[0]}>"


def _texts(tree, out):
    """textContent of every element, in document order."""
    if isinstance(tree, str):
        return tree
    at = len(out)
    out.append(None)
    out[at] = "".join(_texts(k, out) for k in tree[1])
    return out[at]


def _collapse(text):
    return re.sub(f"[{WS_CHARS}]+", " ", text).strip(" ")


@settings(max_examples=150, deadline=None)
@given(st.lists(_tree, max_size=4))
def test_slices_are_the_text_of_the_subtree(trees):
    html = "<div>" + "".join(map(_render, trees)) + "</div>"
    expected = []
    _texts(("div", trees), expected)
    page = parse(html)
    nodes = page["nodes"][page["body"] + 1 :]
    assert len(nodes) == len(expected)
    for node, raw in zip(nodes, expected):
        assert page["ctext"][node["c0"] : node["c0"] + node["clen"]] == _collapse(raw)
        assert page["text"][node["r0"] : node["r0"] + node["rlen"]] == raw.strip(WS_CHARS)
        units = len(_collapse(raw).encode("utf-16-le")) // 2
        assert node["clen"] + node["wide"] == units


_fragments = st.lists(
    st.sampled_from(
        "<p> </p> <div> </div> <b> </b> <li> <ul> </ul> <table> <tr> <td> </table> <a href='x> <a b=\" \" > < "
        "<!-- --> <! </ <script> </script> <title> </title> <svg> </svg> <br/> <body> </body> </html> "
        "<template> </template> <h1> <h2> <option> <button> &amp; &lt &#0; text \x00 é 😀".split(" ")
        + [" ", "\r\n"]
    ),
    max_size=30,
)


@settings(max_examples=300, deadline=None)
@given(_fragments)
def test_any_input_gives_a_tree(fragments):
    page = parse("".join(fragments))
    nodes = page["nodes"]
    assert [n["idx"] for n in nodes] == list(range(len(nodes)))
    assert nodes[0]["end"] == len(nodes) and nodes[page["body"]]["tag"] == "body"
    for n in nodes[1:]:
        parent = nodes[n["parent"]]
        assert parent["idx"] < n["idx"] < n["end"] <= parent["end"]
        siblings = [m for m in nodes[: n["idx"]] if m["parent"] == n["parent"]]
        assert n["sib"] == len(siblings) + 1
        # A node's text lies inside its parent's.
        if n["clen"]:
            assert parent["c0"] <= n["c0"] and n["c0"] + n["clen"] <= parent["c0"] + parent["clen"]


def test_long_hostile_pages_take_linear_time():
    import time

    for html in ("<" * 200_000, "<a " * 100_000, '<a b="' * 50_000, "<!--" * 100_000, "</" * 100_000, "&" * 200_000):
        began = time.perf_counter()
        parse(html)
        assert time.perf_counter() - began < 5


def _tighten_by_walking(nodes, start):
    """Step into the child that holds the dominant share until there is none."""
    at = start
    need = 0.85 * (nodes[start]["clen"] + nodes[start]["wide"])
    while True:
        kids = [n for n in nodes if n["parent"] == at]
        into = next((k for k in kids if k["clen"] + k["wide"] >= need), None)
        if into is None:
            return at
        at = into["idx"]


def test_tighten_equals_the_walk(spark):
    import random

    rng = random.Random(7)

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            return "word " * rng.randint(0, 40)
        tag = rng.choice(["div", "section", "span", "p1"])
        kids = "".join(grow(depth - 1) for _ in range(rng.choice([1, 1, 2, 3])))
        return f"<{tag}>{kids}</{tag}>" + "x " * rng.randint(0, 6)

    pages = [f"<main>{grow(7)}{'pad ' * rng.randint(100, 300)}{grow(7)}</main>" for _ in range(60)]
    pages += [f"<main>{grow(8)}{grow(2)}</main>" for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    parsed = dom.with_dom(df, ()).withColumn("block", F.expr(structural.largest_block("dom")))
    inner = parsed.withColumn("inner", F.expr(structural.tighten("dom", "block")))
    rows = inner.select("page_id", F.col("block.idx").alias("b"), F.col("inner.idx").alias("i")).collect()
    checked = 0
    for r in rows:
        if r["b"] is not None:
            assert r["i"] == _tighten_by_walking(parse(pages[r["page_id"]])["nodes"], r["b"])
            checked += 1
    assert checked > 30


@pytest.mark.parametrize(
    "selector, expected",
    [
        ("h1", ["one", "two"]),
        ("#x", ["box one item pic last"]),
        (".a.b", ["box one item pic last"]),
        ('[data-k="v"]', ["item"]),
        ("main h1", ["one"]),
        ("#x > ul > li", ["item", "pic", "last"]),
        ("main h1 ~ ul > li:has(> img)", ["pic"]),
        ("main h1 ~ ul > li:first-child", ["item"]),
        ('.a [data-k="v"]', ["item"]),
        ("h1.t", ["two"]),
        ("ul h1", []),
    ],
)
def test_selectors(spark, selector, expected):
    html = (
        "<main><div id=x class='a b c'><span>box </span><h1>one</h1><ul><li data-k=v> item</li>"
        "<li> pic<img src=p></li><li> last</li></ul></div></main><h1 class=t>two</h1>"
    )
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    found = selectors.query_all("dom_nodes", selector)
    texts = f"transform({found}, n -> coalesce({selectors.text_of('dom', 'n')}, ''))"
    row = dom.with_dom(df, ("data-k",)).select(F.expr(texts).alias("t")).first()
    assert row["t"] == expected


def test_a_matched_but_empty_element_wins(spark):
    df = spark.createDataFrame([(1, "<p class=a> </p><p class=b>text</p>")], "page_id int, html string")
    chain = F.expr(selectors.chain_text("dom", (".none", ".a", ".b")))
    assert dom.with_dom(df, ()).select(chain.alias("t")).first()["t"] is None


def test_selector_outside_the_dialect():
    with pytest.raises(ValueError):
        selectors.query_all("dom_nodes", "p:nth-child(2)")


def test_white_space_is_that_of_html():
    page = '<title>Senior&nbsp;Keeper \n| X</title><p class="a&nbsp;b c\td">t</p>'
    row = parse(page)
    assert row["title"] == "Senior\u00a0Keeper | X"
    classes = [n["classes"] for n in row["nodes"] if n["tag"] == "p"]
    assert classes == [["a\u00a0b", "c", "d"]]


def test_block_elements_break_out_of_foreign_content():
    page = '<body><svg><path/><g><title>no</title><div>out</div><script>var a = "<p>";</script><p>last'
    row = parse(page)
    tags = [n["tag"] for n in row["nodes"]]
    assert tags.count("p") == 1 and tags[-1] == "p"
    div = next(n for n in row["nodes"] if n["tag"] == "div")
    assert row["nodes"][div["parent"]]["tag"] == "body"


def test_linked_data_is_flattened_at_any_depth():
    inner = '{"title":"T"}'
    for depth in (300, 20_000):
        for before, after in (("[", "]"), ('{"@graph":[', "]}"), ('[{"x":2,"@graph":[', "]}]")):
            found = linked_data.flatten_json(before * depth + inner + after * depth)
            assert found[0] == {"title": "T"}
            assert len(found) == (1 if before == "[" else depth + 1)
    assert linked_data.flatten_json('[{"k":1,"k":2},[{"b":NaN}]]') == []
    assert linked_data.flatten_json('[{"k":1,"k":2},3,"x",{"n":1e999}]') == [{"k": 2.0}, {"n": None}]
    assert linked_data.flatten_json("[" * 30_000) == []


def test_members_keep_their_json_types():
    block = """{"@type": ["X", 3, "JobPosting"], "title": 5, "identifier": "id", "hiringOrganization": {"name": "N"},
      "description": "half \\ud800 pair \\ud83d\\ude00", "jobLocation": [{"address": "A"}, 7, {"address": {
      "addressLocality": "L", "addressCountry": 3}}], "baseSalary": {"currency": 1, "value": {"minValue": "1",
      "maxValue": 12345678901234567890, "value": true, "unitText": "YEAR"}}}"""
    assert linked_data.read_members(linked_data.flatten_json(block)[0]) == {
        "types": ["X", "JobPosting"],
        "title": None,
        "identifier": None,
        "employer": "N",
        "description": "half ? pair \U0001f600",
        "places": [
            {"address": "A", "parts": None},
            {"address": None, "parts": None},
            {"address": None, "parts": ["L"]},
        ],
        "pay": {
            "min": {"text": "1", "number": None},
            "max": {"text": None, "number": 12345678901234567890.0},
            "single": {"text": None, "number": None},
            "currency": None,
            "unit": "YEAR",
        },
    }
    assert linked_data.read_members(linked_data.flatten_json('{"n": ' + "9" * 6000 + "}")[0])["pay"] is None


@pytest.mark.parametrize("depth, length", [(1_500, 240), (10_000, 240), (3, 21_000_000)])
def test_deep_and_long_members_lose_no_posting(spark, depth, length):
    unread = F.concat(F.repeat(F.lit('{"a":'), depth), F.lit("1"), F.repeat(F.lit("}"), depth))
    text = F.repeat(F.lit("Keeper of long scrolls. "), length // 24)
    head = '<script type="application/ld+json">{"@type":"JobPosting","title":"T","x":'
    page = F.concat(F.lit(head), unread, F.lit(',"description":"'), text, F.lit('"}</script>'))
    df = spark.range(1).select(F.lit("https://jobs.rbc.com/q").alias("url"), page.alias("html"))
    read = extract_postings(df).select(
        "posting.detection.method", "posting.title", F.length("posting.description_text").alias("n")
    )
    assert tuple(read.first()) == ("json-ld", "T", length // 24 * 24 - 1)
