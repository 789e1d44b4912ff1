"""Site adapters: which pages they claim and which selectors they read.

``register_adapter`` adds a site; everything downstream is built from this
registry when a query is planned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.functions.urls import canonical_linkedin_url, linkedin_remote_url
from vacancia.operators.selectors import sql_text


@dataclass(frozen=True)
class SelectorChains:
    """Per field, selectors in the order they are tried."""

    title: Sequence[str]
    description: Sequence[str]
    location: Sequence[str]
    company: Sequence[str] = ()

    def all(self) -> list[str]:
        return [*self.title, *self.description, *self.location, *self.company]


# The selector chains of each platform.
WORKDAY = SelectorChains(
    title=(
        '[data-automation-id="jobPostingHeader"]',
        'h1[data-automation-id="jobPostingHeader"]',
        'h2[data-automation-id="jobPostingHeader"]',
    ),
    description=('[data-automation-id="jobPostingDescription"]',),
    location=(
        '[data-automation-id="locations"]',
        '[data-automation-id="jobPostingLocation"]',
        '[data-automation-id="location"]',
    ),
)
PHENOM = SelectorChains(
    title=(
        '[data-ph-at-id="job-title"]',
        '[data-ph-at-id="jobtitle-text"]',
        ".jd-job-title",
        '.job-title[itemprop="title"]',
        "h1.job-title",
    ),
    description=(
        '[data-ph-at-id="job-description"]',
        '[data-ph-at-id="jobdescription-text"]',
        '[itemprop="description"]',
        ".job-description",
        ".jd-info",
    ),
    location=('[data-ph-at-id="job-location"]', ".job-location", '[itemprop="jobLocation"]'),
)
LINKEDIN = SelectorChains(
    title=(
        ".job-details-jobs-unified-top-card__job-title",
        ".jobs-unified-top-card__job-title",
        "h1.top-card-layout__title",
        "h1.t-24",
    ),
    company=(
        ".job-details-jobs-unified-top-card__company-name a",
        ".jobs-unified-top-card__company-name a",
        "a.topcard__org-name-link",
    ),
    description=(
        "#job-details",
        ".jobs-description__content .jobs-box__html-content",
        ".jobs-description-content__text",
        ".show-more-less-html__markup",
        ".description__text--rich",
    ),
    location=(
        ".job-details-jobs-unified-top-card__primary-description-container",
        ".jobs-unified-top-card__bullet",
        ".top-card-layout__second-subline .topcard__flavor--bullet",
        ".main-job-card__location",
    ),
)
SHOPIFY = SelectorChains(
    title=('[itemtype="https://schema.org/JobPosting"] h1', "main h1"),
    description=(
        '[itemtype="https://schema.org/JobPosting"] [itemprop="description"]',
        '[itemprop="description"]',
    ),
    location=("main h1 ~ ul > li:has(> img)", "main h1 ~ ul > li:first-child"),
)


@dataclass(frozen=True)
class Adapter:
    """One career site.

    ``path`` narrows the claim to part of the host (exact path, or a prefix that
    ends in a slash). ``posting_path`` tells single postings from other claimed
    pages. ``remote_url`` and ``source_url`` map the page's address.
    """

    adapter_id: str
    label: str
    platform: str
    hosts: Sequence[str]
    chains: SelectorChains
    company_label: str | None = None
    paths: Sequence[str] = ()
    posting_path: str | None = None
    remote_url: Callable[[Column], Column] | None = None
    source_url: Callable[[Column], Column] = field(default=lambda url: url)

    def claims(self, host: Column, path: Column) -> Column:
        claimed = host.isin(*self.hosts)
        if not self.paths:
            return claimed
        under = F.lit(False)
        for p in self.paths:
            under = under | (F.startswith(path, F.lit(p)) if p.endswith("/") else path == p)
        return claimed & under


# The sites known from the start, in registry order.
_REGISTRY: list[Adapter] = [
    Adapter("rbc", "RBC", "phenom", ["jobs.rbc.com"], PHENOM, "RBC"),
    Adapter("walmart", "Walmart", "phenom", ["careers.walmart.com"], PHENOM, "Walmart"),
    Adapter(
        "bestbuy-ca",
        "Best Buy Canada",
        "workday",
        ["bestbuycanada.wd3.myworkdayjobs.com"],
        WORKDAY,
        "Best Buy Canada",
    ),
    Adapter("cibc", "CIBC", "workday", ["cibc.wd3.myworkdayjobs.com"], WORKDAY, "CIBC"),
    Adapter(
        "linkedin",
        "LinkedIn",
        "linkedin",
        ["www.linkedin.com"],
        LINKEDIN,
        paths=["/jobs/"],
        remote_url=linkedin_remote_url,
        source_url=canonical_linkedin_url,
    ),
    Adapter(
        "shopify",
        "Shopify",
        "shopify",
        ["www.shopify.com"],
        SHOPIFY,
        "Shopify",
        paths=["/careers", "/careers/"],
        posting_path=r"(?i)^/careers/[^/]+_[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}/?\z",
    ),
]


def adapters() -> list[Adapter]:
    return list(_REGISTRY)


def register_adapter(adapter: Adapter) -> None:
    """Add a site behind the known ones; an id can be used once."""
    if any(a.adapter_id == adapter.adapter_id for a in _REGISTRY):
        raise ValueError(f"adapter {adapter.adapter_id!r} exists already")
    _REGISTRY.append(adapter)


def unregister_adapter(adapter_id: str) -> None:
    _REGISTRY[:] = [a for a in _REGISTRY if a.adapter_id != adapter_id]


def adapters_dim(spark: SparkSession) -> DataFrame:
    """One row per adapter, in registry order."""
    rows = [
        (i, a.adapter_id, a.label, a.platform, list(a.hosts), a.company_label)
        for i, a in enumerate(_REGISTRY)
    ]
    return spark.createDataFrame(
        rows,
        "ord int, adapter_id string, label string, platform string, "
        "hosts array<string>, company_label string",
    )


def per_adapter(adapter_id: Column, value: Callable[[Adapter], Column]) -> Column:
    """``value`` of the adapter a row is routed to; only that branch is evaluated."""
    out = F.lit(None)
    for a in reversed(_REGISTRY):
        out = F.when(adapter_id == a.adapter_id, value(a)).otherwise(out)
    return out


def per_chains(
    adapter_id: str, value: Callable[[SelectorChains], str], among: Sequence[str]
) -> str:
    """As :func:`per_adapter` in SQL text, with one branch per set of selector chains."""
    ids: dict[SelectorChains, list[str]] = {}
    for a in _REGISTRY:
        if a.adapter_id in among:
            ids.setdefault(a.chains, []).append(a.adapter_id)
    branches = " ".join(
        f"WHEN {adapter_id} IN ({', '.join(map(sql_text, claimed))}) THEN {value(chains)}"
        for chains, claimed in ids.items()
    )
    return f"CASE {branches} END"


def with_remote_copies() -> list[str]:
    """Ids of the adapters whose pages can have a server-rendered copy."""
    return [a.adapter_id for a in _REGISTRY if a.remote_url]
