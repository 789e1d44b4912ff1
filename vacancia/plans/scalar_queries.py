"""Queries over the scalar functions: URLs, names, pay, labels, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.functions import company as companies
from vacancia.functions import labels, markup, salary, text, urls
from vacancia.operators import routing, submissions
from vacancia.plans.tables import fmt, pick, table, texts

NOW = "2024-06-30 12:00:00"


def canonical_indeed_url(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    key = F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 16)
    url = pick(
        F.col("c_custkey") % 7,
        fmt("https://IE.indeed.com/jobs?what=nurse&where=Cork&vjk={k}", k=F.upper(key)),
        fmt("https://www.indeed.com/viewjob?jk={k}&from=serp#top", k=key),
        "https://www.indeed.com/?r=us&vjk=not-a-key",
        fmt("not a url {k}", k=key),
        fmt("https://uk.indeed.com/viewjob?jk=&vjk={k}", k=key),
        fmt("https://u@fr.indeed.com:8443/m/a b?x=1&%6Ak={k}", k=key),
        fmt("https://de.indeed.com/viewjob?jk={k}%20", k=key),
    )
    return c.select("c_custkey", urls.canonical_indeed_url(url).alias("canonical_url"))


def canonical_linkedin_url(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    url = pick(
        k % 5,
        fmt("https://www.linkedin.com/jobs/search/?keywords=x&currentJobId={k}&geoId=1", k=k),
        fmt("https://www.linkedin.com/jobs/view/data-lead-at-acme-{k}/?trk=x", k=k),
        fmt("https://www.linkedin.com/jobs/collections/?currentJobId=a{k}", k=k),
        fmt("not a url {k}", k=k),
        fmt("https://www.linkedin.com/jobs/view/{k}", k=k),
    )
    rows = o.select("o_orderkey", url.alias("url"))
    return rows.select(
        "o_orderkey",
        urls.canonical_linkedin_url(F.col("url")).alias("canonical_url"),
        urls.linkedin_job_id(urls.url_parts(F.col("url"))["query"]).alias("job_id"),
    )


_UUID = "c07d4a19-5e2b-4f83-9a66-1d90be7f2258"
_SITE_URLS = (
    "https://jobs.rbc.com/ca/en/job/{k}/x",
    "https://careers.walmart.com/us/jobs/{k}",
    "https://bestbuycanada.wd3.myworkdayjobs.com/job/{k}",
    "https://CIBC.wd3.myworkdayjobs.com/job/{k}",
    "https://www.linkedin.com/jobs/view/{k}/",
    "https://www.linkedin.com/in/{k}/",
    "https://www.shopify.com/careers",
    "https://www.shopify.com/careers/role-{k}_" + _UUID.upper() + "/",
    "https://www.shopify.com/careers/search?page={k}",
    "https://www.shopify.com/careersfoo/{k}",
    "https://acme.wd3.myworkdayjobs.com/job/{k}",
    "https://ca.indeed.com/jobs?q={k}",
    "http://jobs.rbc.com/job/{k}",
    "https://www.linkedin.com/jobs/search-results/?currentJobId={k}&x=1",
    "https://myindeed.com/jobs?q={k}",
)


def _addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of every kind from customers, and every captured page's own."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    made = c.select(
        F.lit("customer").alias("origin"),
        k.alias("key"),
        pick(k % len(_SITE_URLS), *[fmt(u, k=k) for u in _SITE_URLS]).alias("url"),
    )
    captured = table(spark, sf, "pages").select(
        F.lit("page").alias("origin"), F.col("page_id").alias("key"), "url"
    )
    return made.unionByName(captured)


def in_scope(spark: SparkSession, sf: str) -> DataFrame:
    return _addresses(spark, sf).select(
        "origin", "key", routing.in_scope(F.col("url")).alias("in_scope")
    )


def route_adapter(spark: SparkSession, sf: str) -> DataFrame:
    return routing.route(_addresses(spark, sf)).select("origin", "key", "host", "adapter_id")


def is_posting_page(spark: SparkSession, sf: str) -> DataFrame:
    routed = routing.route(_addresses(spark, sf)).filter(F.col("adapter_id").isNotNull())
    return routed.select(
        "key",
        "adapter_id",
        routing.is_posting_page(F.col("adapter_id"), F.col("url")).alias("is_posting"),
    )


def remote_source_url(spark: SparkSession, sf: str) -> DataFrame:
    routed = routing.route(_addresses(spark, sf))
    return routed.select(
        "origin",
        "key",
        routing.remote_source_url(F.col("adapter_id"), F.col("url")).alias("remote_url"),
    )


def _company_names(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    name = F.col("c_name")
    alias = pick(
        F.col("c_nationkey") % 4,
        "Royal Bank of Canada",
        "Canadian Imperial Bank of Commerce (Canada)",
        "CIBC Bank USA",
        "best buy Inc.",
    )
    raw = pick(
        F.col("c_custkey") % 8,
        fmt("417 {n} Ltd.", n=name),
        fmt("{n}, Inc.", n=name),
        fmt("{n} (Canada)", n=name),
        alias,
        fmt("  {n} Co Ltd ", n=name),
        "Unknown company",
        "",
        name,
    )
    return c.select("c_custkey", raw.alias("raw"))


def canonical_company(spark: SparkSession, sf: str) -> DataFrame:
    names = _company_names(spark, sf)
    return names.select("c_custkey", companies.canonical_company(F.col("raw")).alias("company"))


def alias_join(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases from a table: every supplier's nation number names a company anew."""
    s = table(spark, sf, "supplier")
    aliases = s.select(
        F.lower(F.concat(F.lit("customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))).alias(
            "alias_lower"
        ),
        F.col("s_name").alias("canonical"),
    )
    names = _company_names(spark, sf)
    return companies.with_canonical_company(names, "raw", aliases, "company").select(
        "c_custkey", "company"
    )


def parse_salary(spark: SparkSession, sf: str) -> DataFrame:
    o = texts(spark, sf, "orders")
    low = F.floor("o_totalprice").cast("bigint")
    high = low + 5000
    words = pick(
        F.col("o_orderkey") % 7,
        fmt("Pay: ${a} - ${b} a year plus bonus", a=low, b=high),
        fmt("${a} an hour", a=low),
        fmt("Range ${a} to {b} per month.", a=low, b=high),
        fmt("no pay stated {a}", a=low),
        fmt("${a} annually", a=low),
        fmt("up to ${a}.50—${b} hr", a=low, b=high),
        fmt("${a} – ${b} Per Week or ${a}", a=low, b=high),
    )
    rows = o.select(
        "o_orderkey",
        salary.parse_salary(words).alias("site"),
        salary.parse_salary(words, salary.PAY_INDEED).alias("indeed"),
    )
    return rows.select(
        "o_orderkey",
        F.col("site.min").alias("pay_min"),
        F.col("site.max").alias("pay_max"),
        F.col("site.raw").alias("pay_raw"),
        F.col("indeed.max").alias("indeed_max"),
        F.col("indeed.raw").alias("indeed_raw"),
    )


def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "documents")
    body = F.col("text")
    value = pick(
        F.col("doc_id") % 3,
        body,
        fmt('<div class="x"><P>{t}</P><SCRIPT>if (a) "<p>"</SCRIPT >x</script><br/>end</div>', t=body),
        fmt(
            "&lt;p&gt;{t}&LT;/p&gt;&lt;style&gt;p {}&lt;/style&gt;&lt;b&gt;end&lt;/b&gt;",
            t=F.replace(body, F.lit("&"), F.lit("&amp;amp;")),
        ),
    )
    return d.select("doc_id", markup.html_to_text(value).alias("plain"))


def decode_entities(spark: SparkSession, sf: str) -> DataFrame:
    p = texts(spark, sf, "pages")
    given = F.concat(F.col("html"), F.lit("&#38;amp; &#x2014;&#X41;&#1f;&nbsp;&#0;&#xD800;&Hellip;&x"))
    return p.select("page_id", markup.decode_entities(given).alias("decoded"))


def compose_text(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    k = F.col("o_orderkey")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.select(
        "o_orderkey",
        text.compose_posting_text(
            F.col("o_orderpriority"),
            F.col("c_name"),
            F.when(k % 3 != 0, F.col("c_mktsegment")),
            F.when(k % 2 == 0, fmt("${k} a year", k=k)),
            fmt("Order {k}", k=k),
        ).alias("posting_text"),
    )


def application_url(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    base = pick(
        F.col("o_orderkey") % 3, "https://jobs.example.org", "https://jobs.example.org/", "https://x.org/a//"
    )
    return o.select(
        "o_orderkey",
        urls.application_url(base, F.col("o_orderkey").cast("string")).alias("application_url"),
    )


def truncate_label(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "documents")
    return d.select("doc_id", text.truncate_label(F.col("text"), 40).alias("label"))


def relative_time(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        labels.relative_time(F.col("ts"), F.lit(NOW).cast("timestamp")).alias("age"),
        labels.relative_time(F.col("ts"), F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, event_id % 3000, 0)")).alias(
            "short_age"
        ),
    )


def health_status(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    method = pick(F.col("event_id") % 4, "json-ld", "selector", "structural", None)
    rows = e.select("event_id", method.alias("method"))
    status = labels.health_status(F.col("method"))
    return rows.select(
        "event_id",
        status.alias("status"),
        labels.health_label(status).alias("badge"),
        labels.method_label(F.col("method")).alias("via"),
    )


def outcome(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    status = pick(F.col("event_id") % 3, "ok", "not-found", "loading")
    confidence = F.when(F.col("event_type") == "view", F.lit("low")).when(
        F.col("event_type") == "click", F.lit("high")
    )
    return e.select(
        "event_id",
        labels.outcome(status, confidence, F.col("event_type") != "error").alias("outcome"),
    )


def send_outcome(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ok = pick(F.col("event_id") % 3, F.lit(True), F.lit(False), F.lit(None).cast("boolean"))
    duplicate = F.when(F.col("event_type") == "view", F.lit(True))
    return e.select("event_id", labels.send_outcome(ok, duplicate).alias("outcome"))


def classify_api_response(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.col("event_id")
    endpoint = pick(k % 3, "ingest", "confirm", "lookup")
    case = F.floor(k / 3) % 6
    good = pick(
        k % 3,
        fmt('{"pendingToken":"t{k}","extraction":{p}}', k=k, p=F.col("props")),
        fmt('{"applicationId":"a{k}"}', k=k),
        fmt('{"match":{"id":"m{k}"}}', k=k),
    )
    status = pick(case, F.lit(200), F.lit(401), F.lit(410), F.lit(200), F.lit(None), F.lit(502))
    body = pick(
        case,
        good,
        fmt('{"error":"denied {k}"}', k=k),
        fmt('{"error":null,"k":{k}}', k=k),
        '{"match":null,"pendingToken":""}',
        None,
        "<html>bad gateway</html>",
    )
    read = submissions.classify_api_response(endpoint, status, body)
    return e.select("event_id", read.alias("r")).select(
        "event_id", F.col("r.ok"), F.col("r.status"), F.col("r.error"), F.col("r.value")
    )


QUERIES = {
    f.__name__: f
    for f in (
        canonical_indeed_url,
        canonical_linkedin_url,
        in_scope,
        route_adapter,
        is_posting_page,
        remote_source_url,
        canonical_company,
        alias_join,
        parse_salary,
        html_to_text,
        decode_entities,
        compose_text,
        application_url,
        truncate_label,
        relative_time,
        health_status,
        outcome,
        send_outcome,
        classify_api_response,
    )
}

_KEY = "substr(md5(CAST(c_custkey AS VARCHAR)), 1, 16)"

_SITES = """
  SELECT 'customer' AS origin, c_custkey AS key, c_custkey % 15 AS form, NULL AS url FROM customer
  UNION ALL
  SELECT 'page', page_id, 15, url FROM pages
"""

_COMPANY = """
  CASE c_custkey % 8
    WHEN 3 THEN CASE c_nationkey % 4 WHEN 0 THEN 'RBC' WHEN 1 THEN 'CIBC' WHEN 2 THEN 'CIBC'
                ELSE 'Best Buy' END
    WHEN 4 THEN c_name || ' Co'
    WHEN 5 THEN 'Unknown company'
    WHEN 6 THEN ''
    ELSE c_name END
"""

ORACLES = {
    "canonical_indeed_url": f"""
        SELECT c_custkey, CASE c_custkey % 7
            WHEN 0 THEN 'https://ie.indeed.com/viewjob?jk=' || {_KEY}
            WHEN 1 THEN 'https://www.indeed.com/viewjob?jk=' || {_KEY}
            WHEN 5 THEN 'https://fr.indeed.com/viewjob?jk=' || {_KEY} END AS canonical_url
        FROM customer""",
    "canonical_linkedin_url": """
        SELECT o_orderkey, CASE
            WHEN o_orderkey % 5 IN (0, 1, 4)
                THEN 'https://www.linkedin.com/jobs/view/' || o_orderkey || '/'
            WHEN o_orderkey % 5 = 2
                THEN 'https://www.linkedin.com/jobs/collections/?currentJobId=a' || o_orderkey
            ELSE 'not a url ' || o_orderkey END AS canonical_url,
          CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS job_id
        FROM orders""",
    "in_scope": f"""
        SELECT origin, key, form IN (0, 1, 2, 3, 4, 6, 7, 8, 11, 13) AS in_scope FROM ({_SITES})""",
    "route_adapter": f"""
        SELECT origin, key,
          CASE WHEN form = 15 THEN regexp_extract(url, '://([^/?#]+)', 1)
            WHEN form IN (0, 12) THEN 'jobs.rbc.com' WHEN form = 1 THEN 'careers.walmart.com'
            WHEN form = 2 THEN 'bestbuycanada.wd3.myworkdayjobs.com'
            WHEN form = 3 THEN 'cibc.wd3.myworkdayjobs.com'
            WHEN form IN (4, 5, 13) THEN 'www.linkedin.com'
            WHEN form BETWEEN 6 AND 9 THEN 'www.shopify.com'
            WHEN form = 10 THEN 'acme.wd3.myworkdayjobs.com'
            WHEN form = 11 THEN 'ca.indeed.com' ELSE 'myindeed.com' END AS host,
          CASE WHEN form IN (0, 12) THEN 'rbc' WHEN form = 1 THEN 'walmart'
            WHEN form = 2 THEN 'bestbuy-ca' WHEN form = 3 THEN 'cibc'
            WHEN form IN (4, 13) THEN 'linkedin' WHEN form IN (6, 7, 8) THEN 'shopify'
            WHEN form = 11 THEN 'indeed' END AS adapter_id
        FROM ({_SITES})""",
    "is_posting_page": f"""
        SELECT key, CASE WHEN form IN (0, 12) THEN 'rbc' WHEN form = 1 THEN 'walmart'
            WHEN form = 2 THEN 'bestbuy-ca' WHEN form = 3 THEN 'cibc'
            WHEN form IN (4, 13) THEN 'linkedin' WHEN form = 11 THEN 'indeed'
            ELSE 'shopify' END AS adapter_id,
          form NOT IN (6, 8) AS is_posting
        FROM ({_SITES}) WHERE form IN (0, 1, 2, 3, 4, 6, 7, 8, 11, 12, 13)""",
    "remote_source_url": f"""
        SELECT origin, key, CASE WHEN form = 13
            THEN 'https://www.linkedin.com/jobs/view/' || key || '/' END AS remote_url
        FROM ({_SITES})""",
    "canonical_company": f"SELECT c_custkey, {_COMPANY} AS company FROM customer",
    "alias_join": f"""
        SELECT c_custkey, coalesce(s_name, bare) AS company
        FROM (SELECT c_custkey, CASE WHEN c_custkey % 8 = 3
                THEN CASE c_nationkey % 4 WHEN 0 THEN 'Royal Bank of Canada'
                     WHEN 1 THEN 'Canadian Imperial Bank of Commerce' WHEN 2 THEN 'CIBC Bank USA'
                     ELSE 'best buy' END
                ELSE {_COMPANY} END AS bare FROM customer)
        LEFT JOIN supplier
          ON lower(bare) = 'customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')""",
    "parse_salary": """
        SELECT o_orderkey,
          CASE m WHEN 3 THEN NULL WHEN 5 THEN a + 0.5 ELSE a END AS pay_min,
          CASE WHEN m = 3 THEN NULL WHEN m IN (0, 5, 6) THEN b ELSE a END AS pay_max,
          CASE m WHEN 0 THEN '$' || ai || ' - $' || bi || ' a year'
            WHEN 1 THEN '$' || ai || ' an hour' WHEN 2 THEN '$' || ai || ' to ' || bi || ' per month'
            WHEN 4 THEN '$' || ai || ' an' WHEN 5 THEN '$' || ai || '.50—$' || bi || ' hr'
            WHEN 6 THEN '$' || ai || chr(160) || '–' || chr(160) || '$' || bi || ' Per Week'
            END AS pay_raw,
          CASE WHEN m = 3 THEN NULL WHEN m IN (0, 6) THEN b WHEN m = 5 THEN a + 0.5 ELSE a END
            AS indeed_max,
          CASE m WHEN 0 THEN '$' || ai || ' - $' || bi || ' a year'
            WHEN 1 THEN '$' || ai || ' an hour' WHEN 2 THEN '$' || ai || ' to ' || bi || ' per month'
            WHEN 4 THEN '$' || ai || ' an' WHEN 5 THEN '$' || ai || '.50'
            WHEN 6 THEN '$' || ai || chr(160) || '–' || chr(160) || '$' || bi || ' Per Week'
            END AS indeed_raw
        FROM (SELECT o_orderkey, o_orderkey % 7 AS m, CAST(floor(o_totalprice) AS BIGINT) AS ai,
                CAST(floor(o_totalprice) AS BIGINT) + 5000 AS bi, floor(o_totalprice) AS a,
                floor(o_totalprice) + 5000 AS b FROM orders)""",
    "html_to_text": """
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN t
            ELSE trim(t || ' end') END AS plain
        FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""",
    "decode_entities": """
        SELECT page_id, replace(replace(replace(replace(replace(html, '&middot;', '·'),
            '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')
            || '&amp; —A' || chr(1) || ' &#0;&#xD800;…&x' AS decoded
        FROM pages""",
    "compose_text": """
        SELECT o_orderkey, concat_ws(chr(10), o_orderpriority, c_name,
            CASE WHEN o_orderkey % 3 <> 0 THEN c_mktsegment END,
            CASE WHEN o_orderkey % 2 = 0 THEN '$' || o_orderkey || ' a year' END,
            '', 'Order ' || o_orderkey) AS posting_text
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "application_url": """
        SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 'https://x.org/a'
            ELSE 'https://jobs.example.org' END || '/applications/' || o_orderkey AS application_url
        FROM orders""",
    "truncate_label": """
        SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 39) || '…' ELSE text END AS label
        FROM documents""",
    "relative_time": f"""
        WITH m AS (
          SELECT event_id, floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(ts)) / 60000 + 0.5) AS a,
            event_id % 3000 AS b FROM events),
        h AS (SELECT *, floor(a / 60 + 0.5) AS ah, floor(b / 60 + 0.5) AS bh FROM m)
        SELECT event_id,
          CASE WHEN a < 1 THEN 'just now' WHEN a < 60 THEN CAST(a AS BIGINT) || ' min ago'
            WHEN ah < 24 THEN CAST(ah AS BIGINT) || ' h ago'
            ELSE CAST(floor(ah / 24 + 0.5) AS BIGINT) || ' d ago' END AS age,
          CASE WHEN b < 1 THEN 'just now' WHEN b < 60 THEN b || ' min ago'
            WHEN bh < 24 THEN CAST(bh AS BIGINT) || ' h ago'
            ELSE CAST(floor(bh / 24 + 0.5) AS BIGINT) || ' d ago' END AS short_age
        FROM h""",
    "health_status": """
        SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'fallback' WHEN 3 THEN 'failed'
            ELSE 'dedicated' END AS status,
          CASE event_id % 4 WHEN 2 THEN 'Falling back to generic' WHEN 3 THEN 'Detection failed'
            ELSE 'Dedicated adapter' END AS badge,
          CASE event_id % 4 WHEN 0 THEN 'JSON-LD' WHEN 1 THEN 'page selectors'
            WHEN 2 THEN 'generic heuristic' END AS via
        FROM events""",
    "outcome": """
        SELECT event_id, CASE WHEN event_type = 'error' THEN 'hidden'
            WHEN event_id % 3 = 1 THEN 'not-found' WHEN event_id % 3 = 2 THEN NULL
            WHEN event_type = 'view' THEN 'detected-low-confidence' ELSE 'detected' END AS outcome
        FROM events""",
    "send_outcome": """
        SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'sent'
            WHEN event_id % 3 = 1 AND event_type = 'view' THEN 'already-logged'
            ELSE 'error' END AS outcome
        FROM events""",
    "classify_api_response": """
        WITH e AS (SELECT event_id, event_id % 3 AS n, (event_id // 3) % 6 AS c FROM events)
        SELECT event_id, c = 0 OR (c = 3 AND n = 2) AS ok,
          CASE c WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 410 WHEN 3 THEN 200 WHEN 4 THEN 0
            ELSE 502 END AS status,
          CASE c WHEN 1 THEN 'denied ' || event_id WHEN 2 THEN 'Request failed (410).'
            WHEN 3 THEN CASE WHEN n < 2 THEN 'Unexpected response.' END
            WHEN 4 THEN 'The service could not be reached.'
            WHEN 5 THEN 'Request failed (502).' END AS error,
          CASE WHEN c = 0 THEN CASE n WHEN 0 THEN 't' || event_id WHEN 1 THEN 'a' || event_id
            ELSE '{"id":"m' || event_id || '"}' END END AS value
        FROM e""",
}
