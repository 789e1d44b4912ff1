"""URL parts and the canonical forms of job URLs.

``parse_url`` is not used: it fails on spaces and ``|`` and keeps the host's
case. Only http and https addresses count as URLs here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancia.functions.text import let

_HOST = r"[^\x00-\x20#%/:<>?@\[\\\]^|\x7F]+"
_URL = (
    r"(?s)^([Hh][Tt][Tt][Pp][Ss]?):[/\\]*(?:[^/\\?#]*@)?(" + _HOST + r")(?::[0-9]{0,5})?"
    r"(?:([/\\][^?#]*)?)(?:\?([^#]*))?(?:#.*)?\z"
)


def url_parts(url: Column) -> Column:
    """``struct(scheme, host, path, query)``, or null when ``url`` is no URL."""

    def parts(clean: Column) -> Column:
        host = F.regexp_extract(clean, _URL, 2)
        path = F.translate(F.regexp_extract(clean, _URL, 3), "\\", "/")
        return F.when(
            host != "",
            F.struct(
                F.lower(F.regexp_extract(clean, _URL, 1)).alias("scheme"),
                F.lower(host).alias("host"),
                F.when(path == "", F.lit("/")).otherwise(path).alias("path"),
                F.regexp_extract(clean, _URL, 4).alias("query"),
            ),
        )

    return let(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]", ""), parts)


def query_param(query: Column, name: str) -> Column:
    """First value of a query parameter; '' when it has none or is undecodable."""
    named = F.filter(
        F.split(query, "&"),
        lambda p: F.try_url_decode(F.substring_index(p, "=", 1)) == F.lit(name),
    )
    return let(
        F.get(named, F.lit(0)),
        lambda p: F.when(
            p.isNotNull(),
            F.coalesce(
                F.try_url_decode(F.regexp_extract(p, r"(?s)=(.*)\z", 1)),
                F.lit(""),
            ),
        ),
    )


def canonical_indeed_url(url: Column) -> Column:
    """Stable single-job URL from ``jk`` or, where absent, ``vjk``; else null."""

    def build(u: Column) -> Column:
        query = u["query"]
        return let(
            F.coalesce(query_param(query, "jk"), query_param(query, "vjk")),
            lambda key: F.when(
                key.rlike(r"^[0-9A-Fa-f]{16}\z"),
                F.concat(F.lit("https://"), u["host"], F.lit("/viewjob?jk="), F.lower(key)),
            ),
        )

    return let(url_parts(url), build)


def linkedin_job_id(query: Column) -> Column:
    """Digits-only ``currentJobId`` of a query string, else null."""
    return let(
        query_param(query, "currentJobId"),
        lambda key: F.when(key.rlike(r"^[0-9]+\z"), key),
    )


def _linkedin_view(job_id: Column) -> Column:
    return F.concat(F.lit("https://www.linkedin.com/jobs/view/"), job_id, F.lit("/"))


def linkedin_remote_url(url: Column) -> Column:
    """Address of the server-rendered copy of the job a split view shows."""
    return _linkedin_view(linkedin_job_id(url_parts(url)["query"]))


def canonical_linkedin_url(url: Column) -> Column:
    """The job's view URL when a job id is known, else the URL unchanged."""

    def build(u: Column) -> Column:
        in_path = F.nullif(
            F.regexp_extract(u["path"], r"/jobs/view/(?:[^/]*-)?([0-9]+)/?\z", 1), F.lit("")
        )
        return F.coalesce(linkedin_job_id(u["query"]), in_path)

    return F.coalesce(_linkedin_view(let(url_parts(url), build)), url)


def application_url(base: Column, application_id: Column) -> Column:
    return F.concat(F.regexp_replace(base, r"/+\z", ""), F.lit("/applications/"), application_id)
