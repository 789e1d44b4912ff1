"""Scalar functions on the cases that tell them from their plain Java cousins."""

import pytest
from pyspark.sql import functions as F

from vacancia.functions import company, labels, markup, salary, text, urls


def apply(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()
    return [r["out"] for r in rows]


def test_white_space_is_ecmascript_white_space(spark):
    odd = "  a \t　\n b﻿"
    assert apply(spark, text.trim, odd) == ["a \t　\n b"]
    assert apply(spark, text.collapse, odd, "​x") == ["a b", "​x"]


def test_lengths_count_utf16_units(spark):
    assert apply(spark, text.len16, "", "abc", "😀é") == [0, 3, 3]
    assert apply(spark, lambda c: text.at_least(c, 3), "ab", "a😀", "abc") == [False, True, True]


def test_truncate_label(spark):
    long = "x" * 41
    cut = apply(spark, lambda c: text.truncate_label(c, 40), "x" * 40, long, "😀" * 20, "😀" * 21)
    assert cut == ["x" * 40, "x" * 39 + "…", "😀" * 20, "😀" * 19 + "…"]


@pytest.mark.parametrize(
    "value, expected",
    [
        (100000.0, "100000"), (17.6, "17.6"), (1e7, "10000000"), (0.5, "0.5"), (1e20, "1" + "0" * 20),
        (-3.25, "-3.25"), (0.0, "0"), (1e21, "1e+21"), (1.5e30, "1.5e+30"), (1e-6, "0.000001"),
        (1.25e-7, "1.25e-7"), (1.7976931348623157e308, "1.7976931348623157e+308"),
    ],
)
def test_number_text(spark, value, expected):
    out = spark.range(1).select(text.number_text(F.lit(value)).alias("t")).first()["t"]
    assert out == expected


def test_number_of(spark):
    given = ("", " ", "12", " 1.5 ", ".5", "5.", "1e3", "1d", "abc", "1,2", "-7", "1e999")
    assert apply(spark, text.number_of, *given) == [
        0.0, 0.0, 12.0, 1.5, 0.5, 5.0, 1000.0, None, None, None, -7.0, None,
    ]


def test_canonical_indeed_url(spark):
    k = "0b5e9d3c7a12f468"
    given = (
        f"https://za.indeed.com/jobs?what=welder&where=Knysna&vjk={k.upper()}",
        f"https://www.indeed.com/viewjob?jk={k}&x=1#y",
        "https://www.indeed.com/?r=us",
        "https://www.indeed.com/?vjk=nokey!",
        "not a url",
        f"https://www.indeed.com/?jk=&vjk={k}",
        f"https://www.indeed.com/?jk&vjk={k}",
        f" https://WWW.indeed.com:443/a b|c?x=%zz&jk={k}\n",
        f"https://www.indeed.com/?jk={k}&jk=other",
        None,
    )
    www = f"https://www.indeed.com/viewjob?jk={k}"
    za = f"https://za.indeed.com/viewjob?jk={k}"
    assert apply(spark, urls.canonical_indeed_url, *given) == [
        za, www, None, None, None, None, None, www, www, None,
    ]


def test_canonical_linkedin_url(spark):
    view = "https://www.linkedin.com/jobs/view/70152/"
    given = (
        "https://www.linkedin.com/jobs/search/?currentJobId=70152&geoId=1",
        "https://www.linkedin.com/jobs/view/tide-watcher-at-orrin-70152?trk=x",
        "https://www.linkedin.com/jobs/view/70152/",
        "https://www.linkedin.com/jobs/search/?currentJobId=abc",
        "not a url",
    )
    assert apply(spark, urls.canonical_linkedin_url, *given) == [view, view, view, given[3], given[4]]
    remote = apply(spark, urls.linkedin_remote_url, *given)
    assert remote == [view, None, None, None, None]


def test_canonical_company(spark):
    given = {
        **{alias.upper(): name for alias, name in company.ALIASES.items()},
        "208 Orrin Lamps Ltd.": "Orrin Lamps",
        "Orrin Lamps (Chile)": "Orrin Lamps",
        "Brindle Ferries": "Brindle Ferries",
        "": "",
        "Unknown company": "Unknown company",
        "UNKNOWN Company ": "UNKNOWN Company",
        "Acme Co Ltd": "Acme Co",
        "Co.": "",
        # A word boundary is ASCII there: the suffix begins behind the é.
        "Caféco": "Café",
        "Texaco": "Texaco",
        "Acme, LLC \n": "Acme",
        "7 Eleven": "7 Eleven",
    }
    assert apply(spark, company.canonical_company, *given) == list(given.values())


def test_alias_table_agrees_with_the_alias_map(spark):
    names = ["77 Orrin Inc.", *company.ALIASES, "Nobody", "Unknown company", None]
    df = spark.createDataFrame([(n,) for n in names], "raw string")
    aliases = spark.createDataFrame(list(company.ALIASES.items()), "alias_lower string, canonical string")
    by_table = company.with_canonical_company(df, "raw", aliases, "c")
    expected = df.select("raw", company.canonical_company(F.col("raw")).alias("c"))
    assert sorted(map(str, by_table.collect())) == sorted(map(str, expected.collect()))


def test_parse_salary(spark):
    given = {
        "Offered: $38 - $44 an hour, plus": (38.0, 44.0, "$38 - $44 an hour"),
        "$38 - 44 an hour": (38.0, 38.0, "$38 - 44 an hour"),
        "$73,500 annually": (73500.0, 73500.0, "$73,500 an"),
        "$19.35 - $22.80": (19.35, 22.8, "$19.35 - $22.80"),
        "$1—$2 Yr": (1.0, 2.0, "$1—$2 Yr"),
        "a $, b": (0.0, 0.0, "$,"),
        "no pay": None,
        "": None,
        None: None,
    }
    got = apply(spark, salary.parse_salary, *given)
    assert [g and tuple(g) for g in got] == list(given.values())
    indeed = apply(spark, lambda c: salary.parse_salary(c, salary.PAY_INDEED), "$1—$2 yr")
    assert tuple(indeed[0]) == (1.0, 1.0, "$1")


def test_html_to_text(spark):
    given = {
        "a  b\n c": "a b c",
        "&lt;div&gt;Salt&lt;/div&gt;&lt;b&gt;Rye &amp;amp; oats&lt;/b&gt;": "Salt Rye & oats",
        "<ol><li>Lamp</li><li>Wick</li></ol>": "Lamp Wick",
        "Rook &amp; Tern&#39;s &#x2013; fresh &nbsp;paint": "Rook & Tern's – fresh paint",
        "a<script>var x='<p>'</script>b<STYLE media='x'>p{}</style>c": "a b c",
        "north<br/>east<p>south</p>": "north east south",
        "scripted<scripts>x</scripts>": "scripted x",
        "2 < 3 and 4 > 3": "2 3",
    }
    assert apply(spark, markup.html_to_text, *given) == list(given.values())


def test_entities_are_decoded_in_one_pass(spark):
    given = {
        "&amp;lt;": "&lt;",
        "&#38;amp;": "&amp;",
        "&#1f;": "\x01",
        "&#x1F600;": "😀",
        "&bogus; &#0; &#x110000; &#xD800; &amp": "&bogus; &#0; &#x110000; &#xD800; &amp",
        "&HELLIP;&nbsp;|": "… |",
        "&#99999999999999999999;": "&#99999999999999999999;",
        "plain": "plain",
    }
    assert apply(spark, markup.decode_entities, *given) == list(given.values())


def test_compose_posting_text(spark):
    row = "struct('T' t, 'C' c, cast(null as string) l, cast(null as string) s, 'D' d)"
    df = spark.range(1).select(F.expr(row).alias("p"))
    p = F.col("p")
    out = df.select(text.compose_posting_text(p["t"], p["c"], p["l"], p["s"], p["d"]).alias("x"))
    assert out.first()["x"] == "T\nC\n\nD"


def test_application_url(spark):
    got = apply(spark, lambda c: urls.application_url(c, F.lit("7")), "https://x.org//", "https://x.org/a")
    assert got == ["https://x.org/applications/7", "https://x.org/a/applications/7"]


def test_relative_time(spark):
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    given = {
        "2026-01-10 00:00:00": "just now",
        "2026-01-11 00:00:00": "just now",
        "2026-01-09 23:59:31": "just now",
        "2026-01-09 23:59:30": "1 min ago",
        "2026-01-09 23:00:31": "59 min ago",
        # 59.5 minutes round up to 60, and those to an hour.
        "2026-01-09 23:00:30": "1 h ago",
        "2026-01-09 00:30:31": "23 h ago",
        "2026-01-09 00:30:30": "1 d ago",
        "2026-01-07T00:00:00Z": "3 d ago",
        "not a time": "",
        None: "",
    }
    got = apply(spark, lambda c: labels.relative_time(c, now), *given)
    assert got == list(given.values())


def test_health_status(spark):
    got = apply(spark, labels.health_status, "json-ld", "selector", "structural", None)
    assert got == ["dedicated", "dedicated", "fallback", "failed"]


def test_send_outcome(spark):
    cases = spark.sql(
        "SELECT * FROM VALUES (0, true, null), (1, false, true), (2, false, null), (3, null, true) t(i, ok, d)"
    )
    got = cases.select("i", labels.send_outcome(F.col("ok"), F.col("d")).alias("o")).orderBy("i")
    assert [r["o"] for r in got.collect()] == ["sent", "already-logged", "error", "error"]
