"""Queries over tables of captures, postings, applications and health rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.operators import health, lookup, remote, submissions, timeline
from vacancia.operators.adapters import adapters
from vacancia.operators.routing import route
from vacancia.plans.page_queries import flat
from vacancia.plans.page_templates import GUEST, RATED, documents
from vacancia.plans.scalar_queries import NOW
from vacancia.plans.tables import fmt, pick, table
from vacancia.streaming.runs import new_folder

HOURS = 3600 * 1_000_000
ADAPTER_IDS = ("rbc", "walmart", "bestbuy-ca", "cibc", "linkedin", "shopify")


def captures(spark: SparkSession, sf: str) -> DataFrame:
    return captures_of(table(spark, sf, "events"))


def captures_of(events: DataFrame) -> DataFrame:
    """Events as captures: a user is a tab, the kind of event its address."""
    return events.select(
        F.col("user_id").cast("string").alias("tab_id"),
        F.col("ts").alias("captured_at"),
        F.col("event_id").alias("capture_id"),
        F.concat(F.lit("https://jobs.rbc.com/"), "event_type").alias("url"),
        (F.col("event_type") == "signup").alias("skeleton_removed"),
    )


def debounce_sites(spark: SparkSession, sf: str) -> DataFrame:
    fired = timeline.debounce(captures(spark, sf), gap_us=2 * HOURS)
    return fired.select("capture_id", "immediate", "fires")


def debounce_indeed(spark: SparkSession, sf: str) -> DataFrame:
    fired = timeline.debounce(
        captures(spark, sf),
        gap_us=5 * HOURS,
        immediate=F.col("skeleton_removed"),
        on_url_change=False,
    )
    return fired.select("capture_id", "immediate", "fires")


def extractions(spark: SparkSession, sf: str) -> DataFrame:
    return extractions_of(table(spark, sf, "events"))


def extractions_of(events: DataFrame) -> DataFrame:
    """Events as results of extraction, with few distinct postings so streaks last."""
    kind, k = F.col("event_type"), F.col("event_id")
    return events.select(
        F.col("user_id").cast("string").alias("tab_id"),
        F.col("ts").alias("captured_at"),
        k.alias("capture_id"),
        F.when(kind == "signup", F.lit("loading"))
        .when(kind == "error", F.lit("not-found"))
        .otherwise(F.lit("ok"))
        .alias("status"),
        F.when(kind == "purchase", F.lit("Buyer")).otherwise(F.lit("Viewer")).alias("title"),
        fmt("Company {c}", c=k % 2).alias("company"),
        F.when(F.col("value") > 20, F.lit("long text")).otherwise(F.lit("text")).alias("description_text"),
    )


def posting_changes_sites(spark: SparkSession, sf: str) -> DataFrame:
    rows = timeline.posting_changes(extractions(spark, sf))
    return rows.select("capture_id", "status", "changed", "detected_at")


def posting_changes_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """The changes of four stretches of days, one after another; each reads its own days and
    the edges that the one before left."""
    folder = new_folder(spark, "changes-by-day")
    rows = extractions(spark, sf)
    days = F.to_date("captured_at")
    first, last = rows.agg(F.min(days), F.max(days)).first()
    n = 1 + (last - first).days if first else 1
    part = F.floor(4 * F.date_diff(days, F.lit(first)) / n)
    edges = None
    for k in range(4):
        changes, found = timeline.changes_of_day(rows.filter(part == k), edges)
        changes.write.mode("append").parquet(f"{folder}/changes")
        found.write.parquet(f"{folder}/edges-{k}")
        edges = spark.read.schema(timeline.EDGES).parquet(f"{folder}/edges-{k}")
    done = spark.read.schema(changes.schema).parquet(f"{folder}/changes")
    return done.select("capture_id", "status", "changed", "detected_at")


def posting_changes_indeed(spark: SparkSession, sf: str) -> DataFrame:
    rows = timeline.posting_changes(
        extractions(spark, sf), compare=("title", "company", "description_text")
    )
    return rows.select("capture_id", "status", "changed", "detected_at")


def stale_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that come in six hours after they were asked for."""
    seen = captures(spark, sf).select("tab_id", "captured_at", "capture_id", "url")
    asked = seen.filter(F.col("capture_id") % 2 == 0).withColumn(
        "captured_at", F.col("captured_at") + F.expr("INTERVAL 6 HOURS")
    )
    return timeline.still_current(seen, asked).select("capture_id", "captured_at", "current")


def copies(spark: SparkSession, sf: str) -> DataFrame:
    return copies_of(table(spark, sf, "events"))


def copies_of(events: DataFrame) -> DataFrame:
    """Events as fetches; a third of them fetch one and the same address."""
    job = F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("event_id") % 997)
    return events.select(
        fmt("https://www.linkedin.com/jobs/view/{j}/", j=job).alias("remote_url"),
        (F.col("event_type") != "error").alias("ok"),
        F.col("event_type").alias("html"),
        F.col("ts").alias("fetched_at"),
        F.col("event_id").alias("fetch_id"),
    )


def first_remote_copy(spark: SparkSession, sf: str) -> DataFrame:
    return remote.first_remote_copy(copies(spark, sf))


def prefer_remote(spark: SparkSession, sf: str) -> DataFrame:
    """Split views over live pages, with copies that hold, fail or hold no posting."""
    docs = documents(spark, sf)
    values = {n: F.col(n) for n in docs.columns}
    k = F.col("k")
    live = "<main><div><h1>Live {k}</h1><p>{t}</p></div></main>"
    split_view = fmt("https://www.linkedin.com/jobs/search/?currentJobId={k}&x=1", k=k)
    caught = docs.select(
        k.alias("page_id"),
        F.when(k % 4 == 3, fmt("https://jobs.rbc.com/ca/en/job/{k}", k=k))
        .otherwise(split_view)
        .alias("url"),
        F.when(k % 4 == 3, fmt(RATED.html, **values)).otherwise(fmt(live, **values)).alias("html"),
    )
    fetched = docs.filter(k % 4 != 3).select(
        fmt("https://www.linkedin.com/jobs/view/{k}/", k=k).alias("remote_url"),
        (k % 4 != 1).alias("ok"),
        F.when(k % 4 == 2, F.lit("<main><p>Sign in</p></main>"))
        .otherwise(fmt(GUEST.html, **values))
        .alias("html"),
        k.alias("fetch_id"),
        F.lit(1).alias("fetched_at"),
    )
    again = fetched.filter(~F.col("ok")).withColumn("ok", F.lit(True)).withColumn("fetched_at", F.lit(2))
    read = remote.prefer_remote(route(caught), fetched.unionByName(again))
    return flat(read, "from_remote").drop("pay_min", "pay_max", "pay_raw")


def postings(spark: SparkSession, sf: str) -> DataFrame:
    return postings_of(table(spark, sf, "orders"), table(spark, sf, "customer"))


def postings_of(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders as postings; a fifth of them name no company and share a title."""
    k = F.col("o_orderkey")
    nameless = k % 5 == 0
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("posting_id"),
        F.col("o_orderdate").alias("detected_at"),
        F.when(nameless, F.lit("Unknown company"))
        .otherwise(F.concat("c_name", F.lit(", Inc.")))
        .alias("company"),
        F.when(nameless, F.lit("Clerk")).otherwise(F.col("o_orderpriority")).alias("title"),
        F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("salary_raw"),
        fmt("Order {k}", k=k).alias("description_text"),
        F.when(k % 4 != 0, fmt("https://jobs.example.org/{j}", j=F.floor(k / 3))).alias("source_url"),
    )


def applications(spark: SparkSession, sf: str) -> DataFrame:
    """Every ninth order as a logged application."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    k = F.col("o_orderkey")
    return (
        o.filter(k % 9 == 0)
        .join(c, o.o_custkey == c.c_custkey)
        .select(
            fmt("app-{k}", k=k).alias("id"),
            F.when(k % 45 == 0, F.lit("Unknown company"))
            .otherwise(F.concat("c_name", F.lit(" Ltd.")))
            .alias("company"),
            F.when(k % 90 == 0, F.lit("Clerk")).otherwise(F.col("o_orderpriority")).alias("role"),
            F.lit("Applied").alias("stage"),
            F.col("o_orderdate").alias("date_applied"),
            F.when(k % 2 == 0, fmt("https://jobs.example.org/{j}", j=F.floor(k / 2))).alias("source_url"),
        )
    )


def lookup_existing(spark: SparkSession, sf: str) -> DataFrame:
    found = lookup.lookup_existing(postings(spark, sf), applications(spark, sf), "posting_id")
    return found.select(
        "posting_id",
        "matched_by",
        F.col("match.id").alias("application_id"),
        F.col("match.stage").alias("stage"),
        F.col("match.date_applied").alias("date_applied"),
    )


def only_new(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.only_new(postings(spark, sf), applications(spark, sf), "posting_id").select(
        "posting_id", "source_url"
    )


def only_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.only_duplicates(
        postings(spark, sf), applications(spark, sf), "posting_id"
    ).select("posting_id", "matched_by")


def first_in_batch(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.first_in_batch(postings(spark, sf), "detected_at", "posting_id").select(
        "posting_id"
    )


def stage_submissions(spark: SparkSession, sf: str) -> DataFrame:
    rows = submissions.stage_submissions(
        postings(spark, sf), applications(spark, sf), "detected_at", "posting_id"
    )
    return rows.select("pending_token", "job_posting_text", "source_url")


def not_yet_staged(spark: SparkSession, sf: str) -> DataFrame:
    """A replay: every second order has been staged before."""
    rows = submissions.staged_rows(postings(spark, sf))
    done = rows.filter(F.col("posting_id") % 2 == 0)
    return submissions.not_yet_staged(rows, done).select("posting_id")


def confirms_of(rows: DataFrame) -> DataFrame:
    """Two confirmations for every third order, one of a token never staged for each fourth."""
    third = rows.filter(F.col("posting_id") % 3 == 0).select(
        "pending_token", F.col("detected_at").alias("date_applied")
    )
    later = third.withColumn("date_applied", F.col("date_applied") + F.expr("INTERVAL 1 DAY"))
    unknown = rows.filter(F.col("posting_id") % 4 == 0).select(
        F.concat(F.lit("lost-"), "posting_id").alias("pending_token"),
        F.col("detected_at").alias("date_applied"),
    )
    return third.unionByName(later).unionByName(unknown)


def confirm_submissions(spark: SparkSession, sf: str) -> DataFrame:
    rows = submissions.staged_rows(postings(spark, sf))
    confirmed = submissions.confirm_submissions(rows, confirms_of(rows))
    return confirmed.select("posting_id", "application_id", "date_applied")


def expired_confirms(spark: SparkSession, sf: str) -> DataFrame:
    rows = submissions.staged_rows(postings(spark, sf))
    return submissions.expired_confirms(rows, confirms_of(rows)).select(
        "pending_token", "ok", "status"
    )


def health_input(spark: SparkSession, sf: str) -> DataFrame:
    return health_input_of(table(spark, sf, "events"))


def health_input_of(events: DataFrame) -> DataFrame:
    """Events as read pages of the registered adapters; one adapter is never seen."""
    k = F.col("event_id")
    method = pick(k % 3, "json-ld", "selector", "structural")
    hosts = {a.adapter_id: a.hosts[0] for a in adapters()}
    adapter_id = F.element_at(F.array(*[F.lit(a) for a in ADAPTER_IDS if a != "walmart"]), (k % 5 + 1).cast("int"))
    read = events.select(
        adapter_id.alias("adapter_id"),
        F.when(F.col("event_type") == "signup", F.lit("hidden"))
        .when(F.col("event_type") == "error", F.lit("not-found"))
        .otherwise(F.lit("ok"))
        .alias("status"),
        "ts",
        "event_id",
        F.when(
            F.col("event_type") != "error",
            F.struct(fmt("Role {k}", k=k).alias("title"), F.struct(method.alias("method")).alias("detection")),
        ).alias("posting"),
    )
    host = F.create_map(*[F.lit(x) for kv in hosts.items() for x in kv])
    return read.withColumn("host", F.element_at(host, F.col("adapter_id")))


def adapter_health(spark: SparkSession, sf: str) -> DataFrame:
    rows = health.health_rows(health_input(spark, sf), "ts", "event_id")
    return health.latest_adapter_health(rows).drop("row")


def upsert_adapter_health(spark: SparkSession, sf: str) -> DataFrame:
    """Health of the events before March, then all events written over it."""
    read = health_input(spark, sf)
    before = F.col("ts") < F.lit("2024-03-01").cast("timestamp_ntz")
    stored = health.latest_adapter_health(health.health_rows(read.filter(before), "ts", "event_id"))
    late = health.health_rows(read.filter(~before & (F.col("adapter_id") != "cibc")), "ts", "event_id")
    return health.upsert_adapter_health(stored, late).drop("row")


def health_report(spark: SparkSession, sf: str) -> DataFrame:
    return health.health_report(adapter_health(spark, sf), F.lit(NOW).cast("timestamp"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    signal = (
        F.when(F.col("event_type") == "view", F.lit("scriptStartedAt"))
        .when(F.col("event_type") == "click", F.lit("lastPortConnectedAt"))
        .otherwise(F.col("event_type"))
    )
    return e.select(signal.alias("signal"), F.col("ts").alias("at"))


def latest_signals(spark: SparkSession, sf: str) -> DataFrame:
    return health.latest_signals(signals(spark, sf))


def signal_report(spark: SparkSession, sf: str) -> DataFrame:
    return health.signal_report(latest_signals(spark, sf), F.lit(NOW).cast("timestamp"))


QUERIES = {
    f.__name__: f
    for f in (
        debounce_sites,
        debounce_indeed,
        posting_changes_sites,
        posting_changes_by_day,
        posting_changes_indeed,
        stale_guard,
        first_remote_copy,
        prefer_remote,
        lookup_existing,
        only_new,
        only_duplicates,
        first_in_batch,
        stage_submissions,
        not_yet_staged,
        confirm_submissions,
        expired_confirms,
        adapter_health,
        upsert_adapter_health,
        health_report,
        latest_signals,
        signal_report,
    )
}


def _debounce_sql(immediate: str, hours: int) -> str:
    return f"""
        SELECT event_id AS capture_id, {immediate} AS immediate,
          {immediate} OR nxt IS NULL OR nxt - ts >= INTERVAL {hours} HOUR AS fires
        FROM (SELECT *, lag(event_type) OVER w AS prev, lead(ts) OVER w AS nxt FROM events
              WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _changes_sql(compare: str) -> str:
    return f"""
        WITH e AS (SELECT event_id, user_id, ts,
            CASE WHEN event_type = 'error' THEN 'not-found' ELSE 'ok' END AS status,
            CASE WHEN event_type <> 'error' THEN concat_ws('/',
              CASE WHEN event_type = 'purchase' THEN 'Buyer' ELSE 'Viewer' END, {compare}
              CASE WHEN value > 20 THEN 'long text' ELSE 'text' END) END AS d
          FROM events WHERE event_type <> 'signup'),
        c AS (SELECT *, d IS NOT NULL AND d IS DISTINCT FROM lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id)
            AS changed FROM e),
        s AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)
            AS streak FROM c)
        SELECT event_id AS capture_id, status, changed,
          CASE WHEN d IS NOT NULL THEN min(ts) FILTER (WHERE changed) OVER (PARTITION BY user_id, streak) END
            AS detected_at
        FROM s"""


_POSTINGS = """
  p AS (SELECT o_orderkey AS posting_id, o_orderdate AS detected_at,
      CASE WHEN o_orderkey % 5 = 0 THEN 'Unknown company' ELSE c_name END AS company,
      CASE WHEN o_orderkey % 5 = 0 THEN 'Clerk' ELSE o_orderpriority END AS title,
      CASE WHEN o_orderkey % 5 = 0 THEN 'Unknown company' ELSE c_name || ', Inc.' END AS raw_company,
      CASE WHEN o_orderkey % 4 <> 0 THEN 'https://jobs.example.org/' || (o_orderkey // 3) END AS source_url
    FROM orders JOIN customer ON o_custkey = c_custkey)
"""
_APPLICATIONS = """
  a AS (SELECT 'app-' || o_orderkey AS id,
      CASE WHEN o_orderkey % 45 = 0 THEN 'Unknown company' ELSE c_name END AS company,
      CASE WHEN o_orderkey % 90 = 0 THEN 'Clerk' ELSE o_orderpriority END AS role,
      'Applied' AS stage, o_orderdate AS date_applied,
      CASE WHEN o_orderkey % 2 = 0 THEN 'https://jobs.example.org/' || (o_orderkey // 2) END AS source_url
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 9 = 0),
  u AS (SELECT * FROM a WHERE source_url IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY date_applied, id) = 1),
  r AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY company, role ORDER BY date_applied, id) = 1),
  m AS (SELECT p.*, coalesce(u.id, r.id) AS application_id, coalesce(u.stage, r.stage) AS stage,
      coalesce(u.date_applied, r.date_applied) AS date_applied,
      CASE WHEN u.id IS NOT NULL THEN 'url' WHEN r.id IS NOT NULL THEN 'role' END AS matched_by
    FROM p LEFT JOIN u ON p.source_url = u.source_url
      LEFT JOIN r ON p.company = r.company AND p.title = r.role)
"""


def _first_sql(rows: str) -> str:
    return f"""
      f1 AS (SELECT * FROM {rows} QUALIFY source_url IS NULL OR row_number() OVER
          (PARTITION BY source_url ORDER BY detected_at, posting_id) = 1),
      f2 AS (SELECT * FROM f1 QUALIFY row_number() OVER
          (PARTITION BY company, title ORDER BY detected_at, posting_id) = 1)
    """


_TEXT = "concat_ws(chr(10), title, raw_company, '', 'Order ' || posting_id)"
_TOKEN = f"sha256(concat_ws('|', coalesce(source_url, ''), {_TEXT}))"

_HEALTH = """
  h AS (SELECT event_id, ts,
      list_extract(['rbc', 'bestbuy-ca', 'cibc', 'linkedin', 'shopify'], CAST(event_id % 5 + 1 AS INTEGER))
        AS adapter_id,
      CASE WHEN event_type <> 'error' THEN list_extract(['json-ld', 'selector', 'structural'],
        CAST(event_id % 3 + 1 AS INTEGER)) END AS method,
      CASE WHEN event_type <> 'error' THEN 'Role ' || event_id END AS sample_title
    FROM events WHERE event_type <> 'signup')
"""


def _latest_health_sql(where: str = "true") -> str:
    return f"""
      l AS (SELECT adapter_id,
          CASE adapter_id WHEN 'rbc' THEN 'RBC' WHEN 'bestbuy-ca' THEN 'Best Buy Canada'
            WHEN 'cibc' THEN 'CIBC' WHEN 'linkedin' THEN 'LinkedIn' ELSE 'Shopify' END AS adapter_label,
          CASE adapter_id WHEN 'rbc' THEN 'jobs.rbc.com'
            WHEN 'bestbuy-ca' THEN 'bestbuycanada.wd3.myworkdayjobs.com'
            WHEN 'cibc' THEN 'cibc.wd3.myworkdayjobs.com' WHEN 'linkedin' THEN 'www.linkedin.com'
            ELSE 'www.shopify.com' END AS host,
          CASE WHEN method IS NULL THEN 'failed' WHEN method = 'structural' THEN 'fallback'
            ELSE 'dedicated' END AS status,
          method, ts AS last_seen, sample_title
        FROM h WHERE {where}
        QUALIFY row_number() OVER (PARTITION BY adapter_id ORDER BY ts DESC, event_id DESC) = 1)
    """


_AGE = f"floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms({{0}})) / 60000 + 0.5)"


def _relative_sql(at: str) -> str:
    mins = _AGE.format(at)
    hours = f"floor({mins} / 60 + 0.5)"
    return f"""CASE WHEN {mins} < 1 THEN 'just now' WHEN {mins} < 60 THEN CAST({mins} AS BIGINT) || ' min ago'
        WHEN {hours} < 24 THEN CAST({hours} AS BIGINT) || ' h ago'
        ELSE CAST(floor({hours} / 24 + 0.5) AS BIGINT) || ' d ago' END"""


_LATEST_SIGNALS = """
  SELECT max(CASE WHEN event_type = 'view' THEN ts END) AS "scriptStartedAt",
    max(CASE WHEN event_type = 'click' THEN ts END) AS "lastPortConnectedAt",
    CAST(NULL AS TIMESTAMP) AS "lastMessageReceivedAt" FROM events
"""

ORACLES = {
    "debounce_sites": _debounce_sql("(prev IS NULL OR prev <> event_type)", 2),
    "debounce_indeed": _debounce_sql("(prev IS NULL OR event_type = 'signup')", 5),
    "posting_changes_sites": _changes_sql(""),
    "posting_changes_by_day": _changes_sql(""),
    "posting_changes_indeed": _changes_sql("event_id % 2,"),
    "stale_guard": """
        SELECT a.event_id AS capture_id, a.at AS captured_at, c.event_type = a.event_type AS current
        FROM (SELECT *, ts + INTERVAL 6 HOUR AS at FROM events WHERE event_id % 2 = 0) a
        ASOF JOIN events c ON a.user_id = c.user_id AND a.at >= c.ts""",
    "first_remote_copy": """
        SELECT 'https://www.linkedin.com/jobs/view/' || CASE WHEN event_id % 3 = 0 THEN 0
            ELSE event_id % 997 END || '/' AS remote_url,
          event_type <> 'error' AS ok, event_type AS html, ts AS fetched_at, event_id AS fetch_id
        FROM events
        QUALIFY row_number() OVER (PARTITION BY remote_url ORDER BY ts, event_id) = 1""",
    "prefer_remote": """
        WITH s AS (SELECT doc_id AS k, doc_id % 4 AS f,
            trim(regexp_replace(replace(text, '$', ''), '\\s+', ' ', 'g')) AS t,
            trim(regexp_replace(replace(text, '$', '') || 'Rate $31.'
              || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ' per hour', '\\s+', ' ', 'g'))
              AS paid FROM documents),
        w AS (SELECT *, CASE WHEN f = 3 THEN CASE WHEN length(paid) >= 100 THEN 'selector' END
            WHEN f = 0 AND length(t) >= 100 THEN 'remote' WHEN length(t) >= 600 THEN 'live' END AS how
          FROM s)
        SELECT k AS page_id, CASE WHEN f = 3 THEN 'rbc' ELSE 'linkedin' END AS adapter_id,
          CASE WHEN how IS NULL THEN 'not-found' ELSE 'ok' END AS status,
          CASE WHEN how IS NULL THEN 'not-found' WHEN how = 'live' THEN 'detected-low-confidence'
            ELSE 'detected' END AS outcome,
          CASE how WHEN 'live' THEN 'Live ' || k WHEN 'remote' THEN 'Editor ' || k
            WHEN 'selector' THEN 'Teller ' || k END AS title,
          CASE how WHEN 'live' THEN 'Unknown company' WHEN 'remote' THEN 'Press ' || k
            WHEN 'selector' THEN 'RBC' END AS company,
          CASE how WHEN 'remote' THEN 'Quay ' || k WHEN 'selector' THEN 'Branch ' || k END AS location,
          CASE how WHEN 'selector' THEN paid WHEN 'remote' THEN t WHEN 'live' THEN t END AS description_text,
          CASE WHEN how = 'selector' THEN 'https://jobs.rbc.com/ca/en/job/' || k
            WHEN how IS NOT NULL THEN 'https://www.linkedin.com/jobs/view/' || k || '/' END AS source_url,
          coalesce(how = 'remote', false) AS from_remote
        FROM w""",
    "lookup_existing": f"""
        WITH {_POSTINGS}, {_APPLICATIONS}
        SELECT posting_id, matched_by, application_id, stage, date_applied FROM m""",
    "only_new": f"""
        WITH {_POSTINGS}, {_APPLICATIONS}
        SELECT posting_id, source_url FROM m WHERE matched_by IS NULL""",
    "only_duplicates": f"""
        WITH {_POSTINGS}, {_APPLICATIONS}
        SELECT posting_id, matched_by FROM m WHERE matched_by IS NOT NULL""",
    "first_in_batch": f"WITH {_POSTINGS}, {_first_sql('p')} SELECT posting_id FROM f2",
    "stage_submissions": f"""
        WITH {_POSTINGS}, {_APPLICATIONS}, n AS (SELECT * FROM m WHERE matched_by IS NULL), {_first_sql('n')}
        SELECT {_TOKEN} AS pending_token, {_TEXT} AS job_posting_text, source_url FROM f2""",
    "not_yet_staged": f"WITH {_POSTINGS} SELECT posting_id FROM p WHERE posting_id % 2 = 1",
    "confirm_submissions": f"""
        WITH {_POSTINGS} SELECT posting_id, substr({_TOKEN}, 1, 32) AS application_id,
          detected_at AS date_applied FROM p WHERE posting_id % 3 = 0""",
    "expired_confirms": f"""
        WITH {_POSTINGS} SELECT 'lost-' || posting_id AS pending_token, false AS ok, 410 AS status
        FROM p WHERE posting_id % 4 = 0""",
    "adapter_health": f"WITH {_HEALTH}, {_latest_health_sql()} SELECT * FROM l",
    "upsert_adapter_health": f"""
        WITH {_HEALTH}, {_latest_health_sql("adapter_id <> 'cibc' OR ts < TIMESTAMP '2024-03-01'")}
        SELECT * FROM l""",
    "health_report": f"""
        WITH {_HEALTH}, {_latest_health_sql()},
        d AS (SELECT * FROM (VALUES {', '.join(
            f"({i}, '{a.adapter_id}', '{a.label} ({a.platform})', '{a.hosts[0]}')"
            for i, a in enumerate(adapters()))}) t(ord, adapter_id, name, hosts))
        SELECT ord, adapter_id, coalesce(status, 'unseen') AS state,
          CASE status WHEN 'dedicated' THEN 'Dedicated adapter' WHEN 'fallback' THEN 'Falling back to generic'
            WHEN 'failed' THEN 'Detection failed' ELSE 'Not seen yet' END AS badge,
          name,
          CASE WHEN status IS NULL THEN hosts ELSE
            CASE method WHEN 'json-ld' THEN 'via JSON-LD · ' WHEN 'selector' THEN 'via page selectors · '
              WHEN 'structural' THEN 'via generic heuristic · ' ELSE '' END
            || {_relative_sql('last_seen')} END AS detail
        FROM d LEFT JOIN l USING (adapter_id)""",
    "latest_signals": _LATEST_SIGNALS,
    "signal_report": f"""
        WITH s AS ({_LATEST_SIGNALS}),
        t AS (SELECT 0 AS ord, 'Background script last started' AS name, "scriptStartedAt" AS ts FROM s
          UNION ALL SELECT 1, 'Last kept alive from a page', "lastPortConnectedAt" FROM s
          UNION ALL SELECT 2, 'Last send click received', "lastMessageReceivedAt" FROM s)
        SELECT ord, name, CASE WHEN ts IS NULL THEN 'Never' ELSE 'OK' END AS badge,
          CASE WHEN ts IS NULL THEN 'never recorded'
            ELSE {_relative_sql('ts')} || ' (' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ')' END AS detail
        FROM t""",
}
