"""Career-site and Indeed pages built around the documents' whole texts.

The given pages are articles, so pages that carry what the sites' selectors look for are
built here, one per document, in a form chosen by its number. Each form says beside its
page what has to be read out of it, as SQL over the same document; the checks are made
from that. Dollar signs are taken out of the texts, so that the only pay on a page is the
one its form shows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.plans.tables import escape_html, fmt, pick, texts

KEY = "5b1e0c7a-93d4-4e62-8f0b-27ac61d9f3e4"


@dataclass(frozen=True)
class Form:
    """A page, and what it says: SQL for the text of the description and for each field.

    In pages ``{k}`` is the document's number, ``{z}`` its last three digits, ``{h}`` a
    key, ``{t}`` the text as markup, ``{j}`` as JSON and ``{e}`` as escaped markup in
    JSON; in SQL ``k``, ``z``, ``h`` and ``t``.
    """

    site: str
    url: str
    html: str
    title: str = "NULL"
    company: str = "NULL"
    location: str = "NULL"
    pay: tuple[str, str, str] = ("NULL", "NULL", "NULL")
    text: str = "t"
    source: str = "NULL"
    method: str = "selector"
    status: str | None = None  # where it does not depend on the text
    least: int = 100


def _ld(body: str) -> str:
    return f'<script type="application/ld+json">{body}</script>'


SITES = (
    Form(
        "cibc",
        "https://cibc.wd3.myworkdayjobs.com/en/details/{k}",
        "<!doctype html><html><head>"
        + _ld(
            '{"hiringOrganization":{"name":"Northwind Savings {k}"},"jobLocation":[{"address":'
            '{"addressLocality":"Halden {k}","addressCountry":"NO"}},{"address":"Anywhere"}],'
            '"title":" Treasury Analyst {k} ","description":{j},"@type":"JobPosting"}'
        )
        + "</head><body><p>Loading</p></body></html>",
        "'Treasury Analyst ' || k", "'CIBC'", "'Halden ' || k || ', NO · Anywhere'",
        source="'https://cibc.wd3.myworkdayjobs.com/en/details/' || k", method="json-ld",
    ),
    Form(
        "rbc",
        "https://jobs.rbc.com/posting/{k}",
        '<header>Menu</header><article><h2 data-ph-at-id="jobtitle-text">Teller\n {k}</h2>'
        '<span data-ph-at-id="job-location">Branch {k}</span>'
        '<div data-ph-at-id="jobdescription-text">{t}<p>Rate $31.{z} per hour</p></div></article>',
        "'Teller ' || k", "'RBC'", "'Branch ' || k",
        ("CAST('31.' || z AS DOUBLE)", "CAST('31.' || z AS DOUBLE)", "'$31.' || z || ' per hour'"),
        "t || 'Rate $31.' || z || ' per hour'",
        "'https://jobs.rbc.com/posting/' || k",
    ),
    Form(
        "cibc",
        "https://cibc.wd3.myworkdayjobs.com/details/{k}",
        '<main><h2 data-automation-id="jobPostingHeader">Clerk <em>{k}</em></h2>'
        '<dl><dd data-automation-id="jobPostingLocation">Depot {k}</dd></dl>'
        '<section data-automation-id="jobPostingDescription">{t}</section></main>',
        "'Clerk ' || k", "'CIBC'", "'Depot ' || k",
        source="'https://cibc.wd3.myworkdayjobs.com/details/' || k",
    ),
    Form(
        "bestbuy-ca",
        "https://bestbuycanada.wd3.myworkdayjobs.com/details/{k}",
        "<html><head><title>Stockroom Lead {k} – Hiring</title></head><body><header>Stores</header>"
        "<main><section><p>{t}</p></section></main><aside>Help</aside></body></html>",
        "'Stockroom Lead ' || k", "'Best Buy Canada'",
        source="'https://bestbuycanada.wd3.myworkdayjobs.com/details/' || k",
        method="structural", least=600,
    ),
    Form(
        "linkedin",
        "https://www.linkedin.com/jobs/view/editor-at-press-{k}/?src=feed",
        '<div><h1 class="top-card-layout__title">Editor {k}</h1>'
        '<a class="topcard__org-name-link" href="#">Press <i>{k}</i></a>'
        '<p class="top-card-layout__second-subline"><span class="topcard__flavor--bullet">Quay {k}</span></p>'
        '<div class="show-more-less-html__markup">{t}</div><p class="main-job-card__location">Not here</p></div>',
        "'Editor ' || k", "'Press ' || k", "'Quay ' || k",
        source="'https://www.linkedin.com/jobs/view/' || k || '/'",
    ),
    Form(
        "linkedin",
        "https://www.linkedin.com/jobs/search/?currentJobId={k}&sort=new",
        '<div><h1><span class="job-details-jobs-unified-top-card__job-title">Planner {k}</span></h1>'
        '<p class="job-details-jobs-unified-top-card__company-name"><a href="#">Harbour {k}</a></p>'
        '<p class="job-details-jobs-unified-top-card__primary-description-container">Dock {k}</p>'
        '<article id="job-details">{t}</article></div>',
        "'Planner ' || k", "'Harbour ' || k", "'Dock ' || k",
        source="'https://www.linkedin.com/jobs/view/' || k || '/'",
    ),
    Form(
        "linkedin",
        "https://www.linkedin.com/jobs/view/{k}",
        '<div class="jobs-unified-top-card__job-title">Courier {k}</div>'
        '<div class="jobs-unified-top-card__company-name"><b><a>Post {k}</a></b></div>'
        '<div class="jobs-unified-top-card__bullet">Gate {k}</div><div class="jobs-description__content">'
        '<div class="jobs-box__html-content">{t}</div></div>',
        "'Courier ' || k", "'Post ' || k", "'Gate ' || k",
        source="'https://www.linkedin.com/jobs/view/' || k || '/'",
    ),
    Form(
        "shopify",
        "https://www.shopify.com/careers/curator-{k}_" + KEY,
        '<main><article itemtype="https://schema.org/JobPosting"><h1>Curator {k}</h1><ul><li>Team</li>'
        '<li><img alt="" src="m.png">Zone {k}</li></ul><div itemprop="description">{t}</div><p>Perks</p>'
        "</article></main>",
        "'Curator ' || k", "'Shopify'", "'Zone ' || k",
        source=f"'https://www.shopify.com/careers/curator-' || k || '_{KEY}'",
    ),
    Form(
        "shopify",
        "https://www.shopify.com/careers/archivist-{k}_" + KEY + "/",
        "<main><header><h1>Archivist {k}</h1><ul><li>Floor {k}</li><li>Full time</li></ul></header>"
        '<section itemprop="description">{t}</section></main>',
        "'Archivist ' || k", "'Shopify'", "'Floor ' || k",
        source=f"'https://www.shopify.com/careers/archivist-' || k || '_{KEY}/'",
    ),
    Form(
        "shopify", "https://www.shopify.com/careers", "<main><h1>All roles</h1>{t}</main>", status="hidden"
    ),
    Form(
        "walmart",
        "https://careers.walmart.com/en/{k}",
        _ld('{"@graph":')
        + _ld(
            '[[[[[[[[[[{"@graph":[{"@type":"Organization"},[{"@type":["Role","JobPosting"],"identifier":'
            '{"name":"Loader {k}"},"baseSalary":{"currency":"EUR","value":{"minValue":"1,{z}.5",'
            '"maxValue":2000{z},"unitText":"MONTH"}},"description":{e}}]]}]]]]]]]]]]'
        )
        + "<p>{t}</p>",
        "'Loader ' || k", "'Walmart'", "NULL",
        ("CAST('1' || z || '.5' AS DOUBLE)", "CAST('2000' || z AS DOUBLE)",
         "'EUR 1' || z || '.5–2000' || z || ' per month'"),
        source="'https://careers.walmart.com/en/' || k", method="json-ld",
    ),
    Form(
        "walmart",
        "https://careers.walmart.com/de/{k}",
        '<div><h3 class="jd-job-title">Greeter {k}</h3><span itemprop="jobLocation">Aisle {k}</span>'
        '<div class="jd-info">{t}</div></div>',
        "'Greeter ' || k", "'Walmart'", "'Aisle ' || k",
        source="'https://careers.walmart.com/de/' || k",
    ),
    Form(
        "bestbuy-ca",
        "https://bestbuycanada.wd3.myworkdayjobs.com/fr/{k}",
        '<h1 data-automation-id="jobPostingHeader">Installer {k}</h1>'
        '<span data-automation-id="location">Bay {k}</span>'
        '<div data-automation-id="jobPostingDescription">{t}<b> $4{z} to $5{z} weekly</b></div>',
        "'Installer ' || k", "'Best Buy Canada'", "'Bay ' || k",
        ("CAST('4' || z AS DOUBLE)", "CAST('5' || z AS DOUBLE)", "'$4' || z || ' to $5' || z || ' week'"),
        "t || ' $4' || z || ' to $5' || z || ' weekly'",
        "'https://bestbuycanada.wd3.myworkdayjobs.com/fr/' || k",
    ),
    Form("none", "https://careers.example.org/{k}", "<main><h1>Elsewhere</h1>{t}</main>", status="out"),
)

# The forms that other queries build on.
RATED, GUEST = SITES[1], SITES[4]

INDEED_URLS = (
    "https://nz.indeed.com/jobs?where=Otago&vjk={h}",
    "https://www.indeed.com/advice",
    "https://www.indeed.com/m/viewjob?jk={h}&tk=1",
)
_LIST = '<div id="mosaic-provider-jobcards"><div>Card {k} card card</div></div>'
INDEED = (
    Form(
        "indeed",
        "",
        _LIST + '<div class="jobsearch-ViewJobLayout"><h2 data-testid="jobsearch-JobInfoHeader-title">'
        'Roofer {k} – job post</h2><span data-company-name="true">Slate {k}</span>'
        '<p class="jobsearch-JobInfoHeader-subtitle">Hill {k}</p>'
        '<em data-testid="jobsearch-JobMetadataHeader-item">$2{z} a month</em>'
        '<div id="jobDescriptionText">{t}</div></div>',
        "'Roofer ' || k", "'Slate ' || k", "'Hill ' || k",
        ("CAST('2' || z AS DOUBLE)", "CAST('2' || z AS DOUBLE)", "'$2' || z || ' a month'"),
    ),
    Form(
        "indeed",
        "",
        "<div>" + _LIST + "<section><h1>Glazier {k}</h1><p>{t}</p></section></div>",
        "'Glazier ' || k", "'Unknown company'", text="'Glazier ' || k || t", method="structural",
    ),
    Form(
        "indeed",
        "",
        '<div id="viewJobSSRRoot"><b data-testid="viewJob-skeleton"></b>{t}</div>',
        status="loading",
    ),
    Form("indeed", "", "<nav>Home</nav><p>{t}</p>", status="not-found"),
    Form(
        "indeed",
        "",
        '<article data-testid="viewjob-main-content"><h5 data-testid="vj-job-title-compact">Tiler {k}</h5>'
        '<p data-testid="desktop-embedded-compact-header">by <a>Stone {k}</a></p>'
        '<div class="simple-job-description-html">{t}</div><em>$6{z} - $7{z} an hour</em></article>',
        "'Tiler ' || k", "'Stone ' || k", "NULL",
        ("CAST('6' || z AS DOUBLE)", "CAST('7' || z AS DOUBLE)", "'$6' || z || ' - $7' || z || ' an hour'"),
    ),
    Form(
        "indeed",
        "",
        '<div id="viewJobSSRRoot"><h2>Qualifications</h2><h3>Night Baker {k}</h3>'
        '<div class="jobsearch-JobComponent-description"><h1>Inside</h1> {t}</div></div>',
        "'Night Baker ' || k", "'Unknown company'", text="'Inside ' || t",
    ),
)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents_of(texts(spark, sf, "documents"))


def documents_of(docs: DataFrame) -> DataFrame:
    """What the forms take from a document."""
    text = F.replace(F.col("text"), F.lit("$"), F.lit(""))
    twice = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;amp;")), F.lit("<"), F.lit("&amp;lt;"))

    def json_text(value):
        """The value as a JSON string, quotes included."""
        return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]\z", "")

    return docs.select(
        F.col("doc_id").alias("k"),
        F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0").alias("z"),
        F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16).alias("h"),
        escape_html(text).alias("t"),
        json_text(text).alias("j"),
        json_text(F.concat(F.lit("&lt;p&gt;"), twice, F.lit("&lt;/p&gt;"))).alias("e"),
    )


def _filled(docs: DataFrame, urls: tuple[str, ...], pages: tuple[str, ...]) -> DataFrame:
    values = {n: F.col(n) for n in docs.columns}
    return docs.select(
        F.col("k").alias("page_id"),
        pick(F.col("k") % len(urls), *[fmt(u, **values) for u in urls]).alias("url"),
        pick(F.col("k") % len(pages), *[fmt(p, **values) for p in pages]).alias("html"),
    )


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    return site_pages_of(texts(spark, sf, "documents"))


def site_pages_of(docs: DataFrame) -> DataFrame:
    return _filled(documents_of(docs), tuple(f.url for f in SITES), tuple(f.html for f in SITES))


def indeed_pages(spark: SparkSession, sf: str) -> DataFrame:
    return indeed_pages_of(texts(spark, sf, "documents"))


def indeed_pages_of(docs: DataFrame) -> DataFrame:
    return _filled(documents_of(docs), INDEED_URLS, tuple(f.html for f in INDEED))


def collapsed(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def form_sql(forms: tuple[Form, ...], column: str) -> str:
    """One column of the expected rows: a branch per form."""

    def value(f: Form) -> str:
        if column.startswith("pay_"):
            return f.pay[("pay_min", "pay_max", "pay_raw").index(column)]
        return getattr(f, column)

    branches = " ".join(f"WHEN {i} THEN {value(f)}" for i, f in enumerate(forms))
    return f"CASE f {branches} END"


def expected_sql(forms: tuple[Form, ...], name: str) -> str:
    """CTEs that end in ``name``: what has to be read out of the forms' pages."""
    n = len(forms)
    fixed = " ".join(f"WHEN f = {i} THEN '{f.status}'" for i, f in enumerate(forms) if f.status)
    least = " ".join(f"WHEN {i} THEN {f.least}" for i, f in enumerate(forms))
    texts_of = form_sql(forms, "text")
    method = " ".join(f"WHEN {i} THEN '{f.method}'" for i, f in enumerate(forms))
    site = " ".join(f"WHEN {i} THEN '{f.site}'" for i, f in enumerate(forms))
    fields = ("title", "company", "location", "pay_min", "pay_max", "pay_raw")
    shown = ", ".join(f"CASE WHEN status = 'ok' THEN {form_sql(forms, c)} END AS {c}" for c in fields)
    return f"""
  {name}_src AS (SELECT doc_id AS k, doc_id % {n} AS f, replace(text, '$', '') AS t,
      lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS z,
      substr(md5(CAST(doc_id AS VARCHAR)), 1, 16) AS h FROM documents),
  {name}_txt AS (SELECT *, {collapsed(texts_of)} AS d FROM {name}_src),
  {name}_st AS (SELECT *, CASE {fixed} WHEN length(d) >= CASE f {least} END THEN 'ok'
      ELSE 'not-found' END AS status FROM {name}_txt),
  {name} AS (SELECT k AS page_id, f, h, CASE f {site} END AS adapter_id, status, {shown},
      CASE WHEN status = 'ok' THEN d END AS description_text,
      CASE WHEN status = 'ok' THEN {form_sql(forms, 'source')} END AS source,
      CASE WHEN status = 'ok' THEN CASE f {method} END END AS method
    FROM {name}_st WHERE status <> 'out')"""
