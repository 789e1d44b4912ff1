"""Postings in Indeed's split view and job pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancia.functions.salary import PAY_INDEED, pay_range, pay_text
from vacancia.functions.text import WS, at_least, blank_to_null, len16, trim
from vacancia.functions.urls import canonical_indeed_url
from vacancia.operators.selectors import (
    chain_text,
    contains,
    inside,
    let,
    query_first,
    raw_text_of,
    text_of,
)
from vacancia.operators.structural import largest, raw_units, tag_in
from vacancia.schemas import MIN_DESCRIPTION, POSTING, UNKNOWN_COMPANY, UNKNOWN_TITLE

# Selector chains, the loading marks, and headings that are no titles.
LIST = ("#mosaic-provider-jobcards",)
PANE = (
    '[data-testid="viewjob-main-content"]',
    ".jobsearch-RightPane",
    ".jobsearch-ViewJobLayout",
    '[data-testid="jobsearch-ViewjobPaneWrapper"]',
    "#viewJobSSRRoot",
)
TITLE = (
    '[data-testid="vj-job-title"]',
    '[data-testid="vj-job-title-compact"]',
    ".jobsearch-JobInfoHeader-title",
    'h1[data-testid="jobsearch-JobInfoHeader-title"]',
    '[data-testid="jobsearch-JobInfoHeader-title"]',
)
COMPANY = (
    '[data-testid="company-info-metadata"] a',
    '[data-testid="desktop-embedded-compact-header"] a',
    '[data-testid="inlineHeader-companyName"]',
    ".jobsearch-CompanyInfoWithoutHeaderImage",
    '[data-company-name="true"]',
)
LOCATION = (
    '[data-testid="inlineHeader-companyLocation"]',
    '[data-testid="job-location"]',
    ".jobsearch-JobInfoHeader-subtitle",
)
SALARY = (
    '[data-testid="jobsearch-JobMetadataHeader-item"]',
    '[data-testid="attribute_snippet_testid"]',
    ".jobsearch-JobMetadataHeader-item",
)
DESCRIPTION = (
    ".react-native-html-content",
    ".simple-job-description-html",
    "#jobDescriptionText",
    ".jobsearch-JobComponent-embeddedBody",
    ".jobsearch-JobComponent-description",
)
SKELETON = (".jobsearch-ViewJobSkeleton", '[data-testid="viewJob-skeleton"]')
SECTION_LABEL = (
    r"(?i)^(job details|profile insights|full job description|job description|"
    r"benefits(?! plus)|pay(?![A-Za-z0-9_])|pay range|job type|shift and schedule|"
    r"shift(?![A-Za-z0-9_])|schedule(?![A-Za-z0-9_])|location(?![A-Za-z0-9_])|qualifications|"
    r"apply now|report job|about the company|about this job|similar jobs|employer questions?|"
    r"application questions?|company info|encouraged to apply|indeed'?s ai|help others)"
    r"(?![A-Za-z0-9_])"
)
JOB_POST_SUFFIX = rf"(?i){WS}*[-–—]{WS}*job post\z"
MAX_HEADING = 200
PANE_TAGS = ("div", "section", "main")

ALL_SELECTORS = (*LIST, *PANE, *TITLE, *COMPANY, *LOCATION, *SALARY, *DESCRIPTION, *SKELETON)


def clean_title(text: Column) -> Column:
    return blank_to_null(trim(F.regexp_replace(text, JOB_POST_SUFFIX, "")))


def detail_pane(dom: str) -> str:
    """``struct(node, tier)`` of the pane that shows the open job, else null.

    Without a known pane it is the largest block that neither lies in the list
    of jobs nor wraps it.
    """
    nodes = f"{dom}_nodes"
    touching = f"({contains('li', 'n')} OR {contains('n', 'li')})"
    apart = (
        f"filter({nodes}, n -> n.idx > {dom}_body AND {tag_in('n', PANE_TAGS)}"
        f" AND {raw_units('n')} >= {MIN_DESCRIPTION} AND (li IS NULL OR NOT {touching}))"
    )
    biggest = let("li", query_first(nodes, LIST), largest(apart, raw_units))

    def tagged(node: str, tier: str) -> str:
        return let(
            "k", node, f"CASE WHEN k IS NOT NULL THEN struct(k AS node, '{tier}' AS tier) END"
        )

    return f"coalesce({tagged(query_first(nodes, PANE), 'selector')}, {tagged(biggest, 'structural')})"


def headings(dom: str, pane: str, description: str, tags: tuple[str, ...]) -> str:
    """Texts of the pane's headings outside the description, in document order."""
    wanted = (
        f"filter({dom}_nodes, n -> {tag_in('n', tags)} AND {inside('w', 'n')}"
        f" AND (ds IS NULL OR NOT {contains('ds', 'n')}))"
    )
    texts = f"transform({wanted}, n -> {text_of(dom, 'n')})"
    return let("w", pane, let("ds", description, texts))


def first_title(texts: Column) -> Column:
    """First of the texts that can be a title: short and no section label."""
    usable = F.filter(
        F.transform(texts, clean_title),
        lambda t: t.isNotNull() & (len16(t) <= MAX_HEADING) & ~t.rlike(SECTION_LABEL),
    )
    return F.get(usable, F.lit(0))


_PANE_NODE = let("q", "_pane", "q.node")


def indeed_stages(wanted: Column) -> list[dict[str, Column]]:
    """Columns to add stage by stage to parsed pages: the pane, its text, its fields.

    The pane and the description element are found once; every field is then
    read inside the pane.
    """

    def chain(selectors: tuple[str, ...]) -> Column:
        return F.expr(chain_text("dom", selectors, within=_PANE_NODE))

    def first(selectors: tuple[str, ...]) -> Column:
        return F.expr(query_first("dom_nodes", selectors, within=_PANE_NODE))

    def title_among(*tags: str) -> Column:
        return first_title(F.expr(headings("dom", _PANE_NODE, "_body", tags)))

    is_open = F.col("_pane").isNotNull()
    text = F.coalesce(F.expr(text_of("dom", "_body")), F.expr(text_of("dom", _PANE_NODE)))
    pay = F.coalesce(chain(SALARY), pay_text(F.expr(raw_text_of("dom", _PANE_NODE)), PAY_INDEED))
    title = F.coalesce(
        clean_title(chain(TITLE)), title_among("h1"), title_among("h2", "h3"), F.lit(UNKNOWN_TITLE)
    )
    ok = _is_posting()
    return [
        {"_pane": F.when(wanted, F.expr(detail_pane("dom")))},
        {
            "_loading": is_open & first(SKELETON).isNotNull(),
            "_body": F.when(is_open, first(DESCRIPTION)),
        },
        {"_text": F.when(is_open & ~F.col("_loading"), text)},
        {
            "_title": F.when(ok, title),
            "_company": F.when(ok, F.coalesce(chain(COMPANY), F.lit(UNKNOWN_COMPANY))),
            "_location": F.when(ok, chain(LOCATION)),
            "_pay": F.when(ok, pay),
        },
    ]


def _is_posting() -> Column:
    return F.coalesce(at_least(F.col("_text"), MIN_DESCRIPTION), F.lit(False))


def indeed_status() -> Column:
    """Status of an Indeed page, from the columns of the stages."""
    return (
        F.when(F.col("_loading"), F.lit("loading"))
        .when(_is_posting(), F.lit("ok"))
        .otherwise(F.lit("not-found"))
    )


def indeed_posting(url: Column) -> Column:
    """The posting of an Indeed page, from the columns of the stages; else null."""
    posting = F.struct(
        F.col("_title").alias("title"),
        F.col("_company").alias("company"),
        F.col("_location").alias("location"),
        pay_range(F.col("_pay")).alias("salary"),
        F.col("_text").alias("description_text"),
        canonical_indeed_url(url).alias("source_url"),
        F.expr(let("q", "_pane", "q.tier")).alias("container_tier"),
        F.lit(None).alias("detection"),
    )
    return F.when(_is_posting(), posting).cast(POSTING)
