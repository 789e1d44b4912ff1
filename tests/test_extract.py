"""Whole pages through the flow: every adapter, every tier, and what must not leak.

All pages, people and places here are invented for these tests; they share only hosts,
paths and selectors with the sites.
"""

import json

import pytest
from pyspark.sql import functions as F

from vacancia.operators import adapters
from vacancia.plans.extract import extract_postings, write_parsed

# Filler of a known length: a sentence of made-up words over and over.
SENTENCE = "Brindle tovas keep the quarlow lamps lit while orrin ferries cross at noon. "
SHORT = SENTENCE * 2  # over the bar of the selector tiers
FULL = SENTENCE * 10  # over the bar of the structural tier
POST = "9d3f27c1-4b8e-4a06-b7d5-60e2f1a8c394"
VIEW = "https://www.linkedin.com/jobs/view/"


def block(value, kind="application/ld+json"):
    text = value if isinstance(value, str) else json.dumps(value)
    return f'<script type="{kind}">{text}</script>'


def posting(**fields):
    return {"@type": "JobPosting", "description": FULL} | fields


def town(*parts):
    names = ("addressLocality", "addressRegion", "addressCountry")
    return {"address": dict(zip(names, parts))}


def indeed(head, extra="", text=SHORT):
    return (
        '<ol id="mosaic-provider-jobcards"><li><h1>Card</h1>$3 an hour</li></ol>'
        f'<section class="jobsearch-ViewJobLayout">{head}'
        f'<div class="jobsearch-JobComponent-description"><h2>Tasks</h2>{text}</div>{extra}</section>'
    )


# name: (address, page, what is expected of the row and of its posting)
SITES = {
    "an untyped object with text and employer": (
        "https://bestbuycanada.wd3.myworkdayjobs.com/q/1",
        block({"title": "Lamp keeper", "hiringOrganization": {"name": "Orrin"}, "jobLocation": town("Quay 4", None, "NZ"),
               "description": FULL + "from $21.50 - $24.05 hourly"}),
        dict(title="Lamp keeper", company="Best Buy Canada", location="Quay 4, NZ", method="json-ld", confidence="high",
             salary=(21.5, 24.05, "$21.50 - $24.05 hour"), outcome="detected", adapter="bestbuy-ca"),
    ),
    "a list of types, any case, after another block": (
        "https://cibc.wd3.myworkdayjobs.com/q/2",
        block({"@type": "BreadcrumbList"}) + block(posting(**{"@type": ["Thing", "JOBPOSTING"]}, title="Ferry clerk")),
        dict(title="Ferry clerk", company="CIBC", location=None, method="json-ld"),
    ),
    "arrays nine deep": (
        "https://jobs.rbc.com/q/3",
        block("[" * 9 + json.dumps(posting(title="Nine")) + "]" * 9),
        dict(title="Nine", method="json-ld"),
    ),
    "graphs forty deep": (
        "https://jobs.rbc.com/q/4",
        block('{"@graph":[' * 40 + json.dumps(posting(title="Forty")) + "]}" * 40),
        dict(title="Forty", method="json-ld"),
    ),
    "graph members ahead of their holder": (
        "https://jobs.rbc.com/q/5",
        block(posting(title="Holder") | {"@graph": [[posting(title="Member")], posting(title="Later")]}),
        dict(title="Member"),
    ),
    "malformed blocks are passed over": (
        "https://jobs.rbc.com/q/6",
        "".join(block(b) for b in ('{"@type":"JobPosting"}}', "[1,]", "{'a':1}", "NaN", '{"a":1} {"b":2}', "", "  "))
        + block(posting(title="Sound", baseSalary={"value": {"value": 7}})),
        dict(title="Sound", salary=(7.0, 7.0, "7")),
    ),
    "markup that was escaped twice": (
        "https://jobs.rbc.com/q/7",
        block(posting(title="Cook &amp; baker",
                      description="&lt;ul&gt;&lt;li&gt;Salt &amp;amp; rye&lt;/li&gt;&lt;/ul&gt;" + FULL)),
        dict(title="Cook &amp; baker", has="Salt & rye Brindle", without=["&lt;", "<li>"]),
    ),
    "base salary with bounds and unit": (
        "https://careers.walmart.com/q/8",
        block(posting(title="T", baseSalary={"currency": "NZD", "value": {
            "minValue": 61000, "maxValue": "70,250.75", "unitText": "YEAR"}})),
        dict(company="Walmart", salary=(61000.0, 70250.75, "NZD 61000–70250.75 per year")),
    ),
    "a number beyond all bounds": (
        "https://careers.walmart.com/q/9",
        block('{"@type":"JobPosting","title":"T","description":' + json.dumps(FULL) + ',"baseSalary":{"value":{"value":2e31}}}'),
        dict(salary=(2e31, 2e31, "2e+31")),
    ),
    "embedded text too short, nodes instead": (
        "https://careers.walmart.com/q/10",
        block(posting(title="Embedded", jobLocation=town("Marl"), description="brief"))
        + f'<p class="job-description">{SHORT}</p>',
        dict(title="Embedded", location="Marl", method="selector", salary=None),
    ),
    "phenom attributes": (
        "https://jobs.rbc.com/q/11",
        f'<b data-ph-at-id="job-title">Diver</b><i data-ph-at-id="job-location">Reef</i><p data-ph-at-id="job-description">{SHORT}',
        dict(title="Diver", company="RBC", location="Reef", method="selector"),
    ),
    "phenom classes, the last of each chain": (
        "https://jobs.rbc.com/q/12",
        f'<h1 class="job-title">Welder</h1><i itemprop="jobLocation">Yard</i><p class="jd-info">{SHORT}',
        dict(title="Welder", location="Yard", method="selector"),
    ),
    "workday attributes": (
        "https://cibc.wd3.myworkdayjobs.com/q/13",
        f'<h3 data-automation-id="jobPostingHeader">Teller</h3><u data-automation-id="locations">Fen</u>'
        f'<div data-automation-id="jobPostingDescription">{SHORT}</div>',
        dict(title="Teller", company="CIBC", location="Fen", method="selector", confidence="high", salary=None),
    ),
    "nothing known but a large block": (
        "https://cibc.wd3.myworkdayjobs.com/q/14",
        f"<title>Warden - Careers</title><nav>Skip</nav><main><div><p>{FULL}Then $48,000 a year</div></main><footer>Legal</footer>",
        dict(title="Warden", company="CIBC", location=None, method="structural", confidence="low",
             outcome="detected-low-confidence", salary=(48000.0, 48000.0, "$48,000 a year"), without=["Skip", "Legal"]),
    ),
    "a page with little text": (
        "https://jobs.rbc.com/", "<main><h1>Hello</h1><p>Look around.</p></main>", dict(status="not-found"),
    ),
    "guest page": (
        VIEW + "21",
        '<h1 class="top-card-layout__title">Glazier</h1><a class="topcard__org-name-link">Pane &amp; Co</a>'
        '<div class="top-card-layout__second-subline"><i class="topcard__flavor--bullet">Weir</i>'
        f'<i class="topcard__flavor--bullet">9 others</i></div><p class="description__text--rich">{SHORT}</p>'
        '<u class="main-job-card__location">Afar</u>',
        dict(title="Glazier", company="Pane & Co", location="Weir", method="selector", source_url=VIEW + "21/"),
    ),
    "signed-in page of a search": (
        "https://www.linkedin.com/jobs/search/?currentJobId=22&f=1",
        '<p class="job-details-jobs-unified-top-card__company-name">of <a>Kiln  Works</a></p>'
        '<h2 class="job-details-jobs-unified-top-card__job-title">Potter</h2><div id="job-details">' + SHORT + "</div>",
        dict(title="Potter", company="Kiln Works", location=None, method="selector", source_url=VIEW + "22/"),
    ),
    "older signed-in page": (
        VIEW + "mason-23/",
        '<h1 class="t-24">Mason</h1><p class="jobs-unified-top-card__company-name"><a>Arch</a></p>'
        f'<b class="jobs-unified-top-card__bullet">Cairn</b><div class="jobs-description-content__text">{SHORT}</div>',
        dict(title="Mason", company="Arch", location="Cairn", source_url=VIEW + "23/"),
    ),
    "unknown layout of a site without an employer": (
        "https://www.linkedin.com/jobs/collections/a",
        f"<header>Bell</header><section><h1>Sawyer</h1><p>{FULL}</p></section>",
        dict(title="Sawyer", company="Unknown company", method="structural", without=["Bell"],
             source_url="https://www.linkedin.com/jobs/collections/a"),
    ),
    "a posting page by its address": (
        f"https://www.shopify.com/careers/tailor_{POST}",
        '<main><div itemtype="https://schema.org/JobPosting"><h1>Tailor</h1><ul><li>Cloth</li><li><img src="p.gif"> Loom</li>'
        f'</ul><div itemprop="description">{SHORT}</div><p>Benefits</p></div><h1>Share</h1></main>',
        dict(title="Tailor", company="Shopify", location="Loom", method="selector", without=["Benefits", "Share"]),
    ),
    "a list page by its address": (
        "https://www.shopify.com/careers/team", f"<main>{FULL}</main>", dict(status="hidden", outcome="hidden"),
    ),
}

INDEED = {
    "every field marked": (
        "https://ie.indeed.com/?vjk=00AA00BB00CC00DD",
        indeed('<h2 class="jobsearch-JobInfoHeader-title">Ranger - job post</h2><b data-testid="inlineHeader-companyName">Fell</b>'
               '<i data-testid="inlineHeader-companyLocation">Tarn</i>',
               '<u class="jobsearch-JobMetadataHeader-item">$30 - $35 an hour</u>'),
        dict(title="Ranger", company="Fell", location="Tarn", tier="selector", salary=(30.0, 35.0, "$30 - $35 an hour"),
             source_url="https://ie.indeed.com/viewjob?jk=00aa00bb00cc00dd", adapter="indeed", without=["Card"]),
    ),
    "no pane known": (
        "https://www.indeed.com/x",
        f'<div><ol id="mosaic-provider-jobcards"><li>{FULL}</li></ol><main><h1>Smith</h1>{SHORT}</main></div>',
        dict(title="Smith", company="Unknown company", tier="structural", source_url=None, salary=None),
    ),
    "pay in the text of the pane": (
        "https://www.indeed.com/viewjob?jk=00000000000000ef",
        '<div data-testid="viewjob-main-content"><h5 data-testid="vj-job-title">Groom</h5>'
        f'<p data-testid="company-info-metadata"><a>Mews</a></p><div class="react-native-html-content">{SHORT}</div>'
        "<i>$900 a week</i></div>",
        dict(title="Groom", company="Mews", location=None, salary=(900.0, 900.0, "$900 a week")),
    ),
    "a chip that is no amount": (
        "https://www.indeed.com/a", indeed('<h1>N</h1><i data-testid="attribute_snippet_testid">Nights</i>'),
        dict(salary=(None, None, "Nights")),
    ),
    "labels are no titles": (
        "https://www.indeed.com/b", indeed("<h3>Pay range</h3><h2>Qualifications</h2><h3>Porter</h3><h2>Late</h2>"),
        dict(title="Porter"),
    ),
    "h1 goes before h3": ("https://www.indeed.com/c", indeed("<h3>Dray</h3><h1>Carter – Job Post</h1>"), dict(title="Carter")),
    "only a heading of the text": ("https://www.indeed.com/d", indeed("<b>x</b>"), dict(title="Unknown title")),
    "still loading": (
        "https://www.indeed.com/e", indeed('<i class="jobsearch-ViewJobSkeleton"></i>'), dict(status="loading", outcome=None),
    ),
    "nothing open": ("https://www.indeed.com/", "<p>Search</p>", dict(status="not-found")),
}
PAGES = SITES | INDEED


@pytest.fixture(scope="module")
def read(spark):
    rows = [(name, url, html) for name, (url, html, _) in PAGES.items()]
    rows += [("out", u, FULL) for u in ("https://example.com/", "http://jobs.rbc.com/q", "no address", None)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    return {r["page_id"]: r for r in extract_postings(df).collect()}


def test_pages_out_of_scope_are_dropped(read):
    assert set(read) == set(PAGES)


@pytest.mark.parametrize("name", PAGES)
def test_page(read, name):
    row, expected = read[name], {"status": "ok"} | PAGES[name][2]
    got = {"status": row["status"], "outcome": row["outcome"], "adapter": row["adapter_id"]}
    p = row["posting"]
    assert (p is not None) == (row["status"] == "ok")
    if p is not None:
        d = p["detection"]
        got |= {k: p[k] for k in ("title", "company", "location", "source_url")}
        got |= {"salary": p["salary"] and tuple(p["salary"]), "tier": p["container_tier"]}
        got |= {"method": d and d["method"], "confidence": d and d["confidence"]}
        assert all(text not in p["description_text"] for text in expected.pop("without", []))
        assert expected.pop("has", "") in p["description_text"]
    assert {k: got[k] for k in expected} == expected


def test_a_registered_adapter_is_routed_and_read(spark):
    chains = adapters.SelectorChains(title=("h4",), description=('[data-guild="text"]',), location=())
    site = adapters.Adapter("guild", "Guild", "own", ["work.guild.test"], chains, "Guild")
    adapters.register_adapter(site)
    try:
        with pytest.raises(ValueError):
            adapters.register_adapter(site)
        html = f'<h4>Cooper</h4><p data-guild="text">{SHORT}</p>'
        df = spark.createDataFrame([(1, "https://work.guild.test/1", html)], "page_id int, url string, html string")
        row = extract_postings(df).first()
        assert (row["adapter_id"], row["posting"]["title"]) == ("guild", "Cooper")
        assert row["posting"]["detection"]["method"] == "selector"
    finally:
        adapters.unregister_adapter("guild")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_parses_once_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "https://x.test", "")], "page_id int, url string, html string")
    text = plan(extract_postings(df).filter(F.col("status") == "ok").select("page_id", "posting.title"))
    assert text.count("ArrowEvalPython") == 1
    assert "Exchange" not in text
    # Pages nobody claims are dropped before the parser.
    assert text.index("ArrowEvalPython") < text.index("Filter (", text.index("ArrowEvalPython"))


def test_parsed_pages_are_read_without_python(spark, tmp_path, read):
    """The same postings, page by page."""
    rows = [(name, url, html) for name, (url, html, _) in PAGES.items()]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    write_parsed(df, str(tmp_path / "parsed"))
    again = extract_postings(spark.read.parquet(str(tmp_path / "parsed")))
    assert {r["page_id"]: r for r in again.select(*again.columns).collect()} == read
    titles = again.select("page_id", "posting.title")
    assert "ArrowEvalPython" not in plan(titles) and "Exchange" not in plan(titles)


def test_a_stored_host_is_pushed_to_the_scan(spark, tmp_path):
    rows = [(k, f"https://site{k}.test/", f"site{k}.test", "x") for k in range(50)]
    rows += [(99, "https://jobs.rbc.com/q", "jobs.rbc.com", f'<p data-ph-at-id="job-description">{SHORT}')]
    df = spark.createDataFrame(rows, "page_id int, url string, host string, html string")
    df.write.parquet(str(tmp_path / "pages"))
    read = extract_postings(spark.read.parquet(str(tmp_path / "pages")))
    assert [r["page_id"] for r in read.collect()] == [99]
    assert "Or(In(host" in plan(read).split("PushedFilters: [", 1)[1]
