"""Queries that run every event, on career sites and on Indeed, all the way."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.operators.stages import stage
from vacancia.plans import flow
from vacancia.plans.page_templates import (
    GUEST,
    INDEED,
    SITES,
    documents,
    expected_sql,
    indeed_pages,
    site_pages,
)
from vacancia.plans.table_queries import HOURS
from vacancia.plans.tables import dealt, fmt, table
from vacancia.streaming.runs import drain_to_table, new_folder, stateful
from vacancia.streaming.sending import send_stream

SITE_RULES = flow.Rules(3 * HOURS, True, ("title", "description_text"))
INDEED_RULES = flow.Rules(6 * HOURS, False, ("title", "company", "description_text"))
BASE = "https://log.example.org/"
VIEW = "https://www.linkedin.com/jobs/view/"
CAPTURES_PER_FILE = 20_000
SPLIT = 5  # the form of a split view, whose posting has a copy


def _page(spark: SparkSession, sf: str) -> Column:
    """The document whose page an event shows: events go round all of them."""
    return F.col("event_id") % F.lit(table(spark, sf, "documents").count())


def captures(spark: SparkSession, sf: str, spread: bool = False, parts: int | None = None) -> DataFrame:
    """Every event as a capture of a document's page: even tabs on sites, odd ones on Indeed.

    Where captures are to lie ``spread``, events and pages are both dealt by page ahead of their
    join, so they do however few files the tables are; over ``parts`` partitions where that is given."""
    sites, indeed = site_pages(spark, sf), indeed_pages(spark, sf)
    shown = sites.withColumn("_odd", F.lit(0)).unionByName(indeed.withColumn("_odd", F.lit(1)))
    # Behind a stage: a filter on the address goes to the pages, and not, over the join, to each event.
    shown = stage(shown.withColumn("_odd", F.col("_odd").cast("long")), url=F.col("url"))
    e = table(spark, sf, "events").withColumn("_page", _page(spark, sf)).withColumn("_kind", F.col("user_id") % 2)
    if parts:
        e, shown = e.repartition(parts, "_page", "_kind"), shown.repartition(parts, "page_id", "_odd")
    shown = shown.hint("merge") if spread else shown
    on = (e["_page"] == shown.page_id) & (e["_kind"] == shown["_odd"])
    return dealt(e.join(shown, on)).select(
        (F.col("user_id") % 40).cast("string").alias("tab_id"),
        F.col("ts").alias("captured_at"),
        F.col("event_id").alias("capture_id"),
        "url",
        "html",
        (F.col("event_type") == "signup").alias("skeleton_removed"),
    )


def copies(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to the split views: a third failed, all five hours after the page was first seen."""
    docs = documents(spark, sf).filter(F.col("k") % len(SITES) == SPLIT)
    values = {n: F.col(n) for n in docs.columns}
    e = table(spark, sf, "events").filter("user_id % 2 = 0")
    seen = e.groupBy(_page(spark, sf).alias("k")).agg(F.min("ts").alias("ts"))
    return docs.join(seen, "k").select(
        F.col("k").alias("fetch_id"),
        fmt(VIEW + "{k}/", k=F.col("k")).alias("remote_url"),
        F.lit("linkedin").alias("adapter_id"),
        (F.col("k") % 3 != 0).alias("ok"),
        fmt(GUEST.html, **values).alias("html"),
        (F.col("ts") + F.expr("INTERVAL 5 HOURS")).alias("fetched_at"),
    )


def _shuffled(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _results(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    fetched = copies(spark, sf)
    parts = max(_shuffled(spark), -(-table(spark, sf, "events").count() // CAPTURES_PER_FILE))
    stored = flow.stored_postings(captures(spark, sf, True, parts), new_folder(spark, "postings"), fetched)
    return flow.read_results(stored, SITE_RULES, INDEED_RULES, fetched), stored


def capture_flow(spark: SparkSession, sf: str) -> DataFrame:
    results, stored = _results(spark, sf)
    return flow.with_postings(results, stored).select(
        "capture_id",
        "captured_at",
        "adapter_id",
        "status",
        F.col("posting.title").alias("title"),
        "from_remote",
        "changed",
        "detected_at",
    )


def _sent(spark: SparkSession, sf: str) -> DataFrame:
    """Postings that came up, some in several tabs."""
    results, stored = _results(spark, sf)
    return flow.candidates(results, stored)


def _logged(sent: DataFrame) -> DataFrame:
    """Every seventh posting is logged already, half of them under another address."""
    k = F.col("capture_id")
    return sent.filter(k % 7 == 0).select(
        fmt("app-{k}", k=k).alias("id"),
        "company",
        F.col("title").alias("role"),
        F.lit("Applied").alias("stage"),
        F.col("detected_at").alias("date_applied"),
        F.when(k % 2 == 0, F.col("source_url")).alias("source_url"),
    )


def flow_submissions(spark: SparkSession, sf: str) -> DataFrame:
    sent = _sent(spark, sf)
    return flow.new_submissions(sent, _logged(sent)).select("capture_id", "detected_at")


REFUSED = "Request failed (503)."


def flow_send_results(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that became of each posting; every eleventh of those staged is refused."""
    sent = _sent(spark, sf)
    logged = _logged(sent)
    staged = flow.new_submissions(sent, logged).filter(F.col("capture_id") % 11 == 0)
    refused = staged.select("pending_token", F.lit(REFUSED).alias("error"))
    return flow.send_results(sent, logged, BASE, refused)


def flow_send_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream with keyed state, over postings that come in three ranges of time."""
    folder = new_folder(spark, "send-stream")
    whole = _sent(spark, sf)
    rows = whole.drop("description_text")  # what is told of it is in the token
    rows.write.parquet(f"{folder}/sent")
    sent = spark.read.schema(rows.schema).parquet(f"{folder}/sent")
    logged = _logged(sent)
    # Of what is staged only tokens are asked for, so what came up is not worked out again for its text.
    untold = sent.withColumn("description_text", F.lit(None).cast("string"))
    staged = flow.new_submissions(untold, logged).filter(F.col("capture_id") % 11 == 0)
    staged.select("pending_token", F.lit(REFUSED).alias("error")).write.parquet(f"{folder}/refused")
    refused = spark.read.schema("pending_token string, error string").parquet(f"{folder}/refused")
    at = F.unix_micros(F.col("detected_at").cast("timestamp"))
    low, high = sent.agg(F.min(at), F.max(at)).first()
    third = F.least(F.lit(2), F.floor(3 * (at - (low or 0)) / max(1, (high or 0) - (low or 0))))
    stream = stateful(spark).readStream.schema(rows.schema)
    for k in range(3):
        sent.filter(third == k).write.mode("append").parquet(f"{folder}/in")
        # The stream goes on from its checkpoint with the files that are new.
        out = drain_to_table(send_stream(stream.parquet(f"{folder}/in"), logged, BASE, refused), f"{folder}/run")
    return out


def flow_health(spark: SparkSession, sf: str) -> DataFrame:
    results, stored = _results(spark, sf)
    return flow.health_after(results, stored).select(
        "adapter_id", "status", "method", "last_seen", "sample_title"
    )


def flow_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The flow as streams, without copies, over captures that come in several files.

    They are written as they lie, by all cores, some thousands to a file, and half of the files
    are read in a micro-batch."""
    folder = new_folder(spark, "flow-stream")
    rows = captures(spark, sf, spread=True).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    rows.write.option("maxRecordsPerFile", CAPTURES_PER_FILE).parquet(f"{folder}/captures")
    files = len(spark.read.schema(rows.schema).parquet(f"{folder}/captures").inputFiles())
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // 2)))
    results, stored = flow.streamed_results(
        arriving.parquet(f"{folder}/captures"), folder, SITE_RULES, INDEED_RULES
    )
    return flow.with_postings(results, stored).select(
        "capture_id",
        F.col("captured_at").cast("timestamp_ntz").alias("captured_at"),
        "adapter_id",
        "status",
        F.col("posting.title").alias("title"),
        "changed",
        F.col("detected_at").cast("timestamp_ntz").alias("detected_at"),
    )


QUERIES = {
    f.__name__: f
    for f in (capture_flow, flow_submissions, flow_send_results, flow_send_stream, flow_health, flow_stream)
}


def _url_sql() -> str:
    """The address of each form's page, over ``k``."""
    branches = []
    for i, form in enumerate(SITES):
        parts = [f"'{p}'" if p != "{k}" else "k" for p in re.split(r"(\{k\})", form.url) if p]
        branches.append(f"WHEN {i} THEN {' || '.join(parts)}")
    return f"CASE f {' '.join(branches)} END"


_PAGES = "(SELECT count(*) FROM documents)"

# As the operators, with plain windows over whole tabs. A result counts when the answer it
# waits for is there and the tab still shows the same page.
_FLOW = f"""
  {expected_sql(SITES, 'made')},
  {expected_sql(INDEED, 'imade')},
  pages_of AS (
    SELECT 0 AS odd, page_id AS k, f, adapter_id, status, method, title, company, location, pay_raw,
      description_text AS d,
      {_url_sql().replace("k ||", "page_id ||").replace("|| k", "|| page_id")} AS url, source FROM made
    UNION ALL
    SELECT 1, page_id, f, 'indeed', status, method, title, company, location, pay_raw, description_text, NULL,
      CASE page_id % 3 WHEN 0 THEN 'https://nz.indeed.com/viewjob?jk=' || h
        WHEN 2 THEN 'https://www.indeed.com/viewjob?jk=' || h END FROM imade),
  cap AS (SELECT user_id % 40 AS tab, user_id % 2 AS odd, ts, event_id, event_type = 'signup' AS skel, p.*
      EXCLUDE (odd) FROM events JOIN pages_of p ON event_id % {_PAGES} = p.k AND user_id % 2 = p.odd),
  nb AS (SELECT *, lag(event_id) OVER w IS NULL AS is_first, lag(url) OVER w AS prev, lead(ts) OVER w AS nxt
      FROM cap WINDOW w AS (PARTITION BY tab ORDER BY ts, event_id)),
  fired AS (SELECT * FROM nb WHERE is_first OR nxt IS NULL
      OR CASE WHEN odd = 0 THEN prev <> url OR nxt - ts >= INTERVAL 3 HOUR
        ELSE skel OR nxt - ts >= INTERVAL 6 HOUR END),
  fetched AS (SELECT event_id % {_PAGES} AS k, min(ts) + INTERVAL 5 HOUR AS answered FROM events
      WHERE user_id % 2 = 0 AND (event_id % {_PAGES}) % {len(SITES)} = {SPLIT} GROUP BY 1),
  late AS (SELECT fired.*, CASE WHEN odd = 0 AND f = {SPLIT} THEN greatest(ts, coalesce(answered, ts))
      ELSE ts END AS seen FROM fired LEFT JOIN fetched ON fired.k = fetched.k AND odd = 0),
  cur AS (SELECT l.*, c.url AS on_url FROM late l
      ASOF LEFT JOIN (SELECT tab AS ctab, ts AS cts, arg_max(url, event_id) AS url FROM cap
        WHERE odd = 0 GROUP BY ALL) c
      ON l.tab = c.ctab AND l.seen >= c.cts),
  kept AS (SELECT * EXCLUDE (status, method, title, company, location, pay_raw),
      odd = 0 AND f = {SPLIT} AND k % 3 <> 0 AND d IS NOT NULL AS from_remote,
      status, method,
      CASE WHEN odd = 0 AND f = {SPLIT} AND k % 3 <> 0 AND d IS NOT NULL THEN 'Quay ' || k ELSE location
        END AS location,
      CASE WHEN odd = 0 AND f = {SPLIT} AND k % 3 <> 0 AND d IS NOT NULL THEN NULL ELSE pay_raw
        END AS pay_raw,
      CASE WHEN odd = 0 AND f = {SPLIT} AND k % 3 <> 0 AND d IS NOT NULL THEN 'Editor ' || k ELSE title
        END AS title,
      CASE WHEN odd = 0 AND f = {SPLIT} AND k % 3 <> 0 AND d IS NOT NULL THEN 'Press ' || k ELSE company
        END AS company
    FROM cur WHERE status <> 'loading' AND (odd = 1 OR on_url = url)),
  dig AS (SELECT *, CASE WHEN status = 'ok' THEN title || '/' || d || CASE odd WHEN 1 THEN company ELSE ''
      END END AS g FROM kept),
  chg AS (SELECT *, g IS NOT NULL AND g IS DISTINCT FROM lag(g) OVER (PARTITION BY tab ORDER BY seen, event_id)
    AS changed FROM dig),
  stk AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY tab ORDER BY seen, event_id)
    AS streak FROM chg),
  flow AS (SELECT *, CASE WHEN g IS NOT NULL THEN min(seen) FILTER (WHERE changed)
    OVER (PARTITION BY tab, streak) END AS detected_at FROM stk)
"""
# The same without copies: nothing is waited for.
_STREAM = _FLOW.replace(f"odd = 0 AND f = {SPLIT}", "false")
_SENT = """
  sent AS (SELECT event_id, detected_at, company, title AS role, source AS src, sha256(coalesce(source, '')
      || '|' || concat_ws(chr(10), title, company, location, pay_raw, '', d)) AS token FROM flow WHERE changed),
  logged AS (SELECT 'app-' || event_id AS id, event_id, company, role, detected_at,
      CASE WHEN event_id % 2 = 0 THEN src END AS src FROM sent WHERE event_id % 7 = 0),
  by_url AS (SELECT * FROM logged WHERE src IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY src ORDER BY detected_at, id) = 1),
  by_role AS (SELECT * FROM logged
      QUALIFY row_number() OVER (PARTITION BY company, role ORDER BY detected_at, id) = 1),
  looked AS (SELECT s.*, coalesce(u.id, r.id) AS found,
      CASE WHEN u.id IS NOT NULL THEN 'url' WHEN r.id IS NOT NULL THEN 'role' END AS matched_by
    FROM sent s LEFT JOIN by_url u ON s.src = u.src
      LEFT JOIN by_role r ON s.company = r.company AND s.role = r.role),
  f1 AS (SELECT * FROM looked WHERE found IS NULL QUALIFY src IS NULL
      OR row_number() OVER (PARTITION BY src ORDER BY detected_at, event_id) = 1),
  f2 AS (SELECT * FROM f1 QUALIFY row_number() OVER
      (PARTITION BY company, role ORDER BY detected_at, event_id) = 1)
"""

ORACLES = {
    "capture_flow": f"""
        WITH {_FLOW} SELECT event_id AS capture_id, seen AS captured_at, adapter_id, status, title,
          from_remote, changed, detected_at FROM flow""",
    "flow_stream": f"""
        WITH {_STREAM} SELECT event_id AS capture_id, seen AS captured_at, adapter_id, status, title,
          changed, detected_at FROM flow""",
    "flow_submissions": f"WITH {_FLOW}, {_SENT} SELECT event_id AS capture_id, detected_at FROM f2",
    "flow_send_results": f"""
        WITH {_FLOW}, {_SENT},
          urls AS (SELECT src, company AS c, role AS r FROM f1 WHERE src IS NOT NULL),
          won AS (SELECT company AS c, role AS r, event_id AS winner, left(token, 32) AS made,
            CASE WHEN event_id % 11 = 0 THEN '{REFUSED}' END AS error FROM f2),
          fresh AS (SELECT event_id, detected_at, coalesce(c, company) AS c, coalesce(r, role) AS r
            FROM looked l LEFT JOIN urls u ON l.src = u.src WHERE found IS NULL),
          ended AS (
            SELECT event_id, CASE WHEN error IS NOT NULL THEN 'error' WHEN event_id = winner THEN 'sent'
                ELSE 'already-logged' END AS outcome, NULL AS matched_by,
              CASE WHEN error IS NULL THEN made END AS application_id, error,
              CASE WHEN error IS NULL AND event_id = winner THEN detected_at END AS date_applied
            FROM fresh JOIN won ON fresh.c = won.c AND fresh.r = won.r
            UNION ALL
            SELECT event_id, 'already-logged', matched_by, found, NULL, NULL FROM looked WHERE found IS NOT NULL)
        SELECT event_id AS capture_id, outcome, matched_by, application_id, error, date_applied,
          CASE WHEN outcome = 'already-logged' THEN '{BASE}applications/' || application_id END AS existing_url
        FROM ended""",
    "flow_health": f"""
        WITH {_FLOW} SELECT adapter_id,
          CASE WHEN status = 'not-found' THEN 'failed' WHEN method = 'structural' THEN 'fallback'
            ELSE 'dedicated' END AS status,
          method, seen AS last_seen, title AS sample_title
        FROM flow WHERE status <> 'hidden' AND odd = 0
        QUALIFY row_number() OVER (PARTITION BY adapter_id ORDER BY seen DESC, event_id DESC) = 1""",
}

ORACLES["flow_send_stream"] = ORACLES["flow_send_results"]
