"""Streaming queries over the given tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.operators import health
from vacancia.operators.submissions import staged_rows
from vacancia.plans import page_queries
from vacancia.plans import table_queries as t
from vacancia.plans.extract import extract_postings
from vacancia.plans.page_queries import with_provenance
from vacancia.plans.page_templates import site_pages_of
from vacancia.plans.tables import table
from vacancia.sources.stored import read_batches, read_snapshot
from vacancia.streaming import ordered, runs
from vacancia.streaming import tables as stored

DELAY_S = 600


def _ntz(rows: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return rows


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a stream, whether it is one file or a folder of files."""
    schema = table(spark, sf, name).schema
    return runs.stateful(spark).readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def extract_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Site pages read as they come in; nothing is kept between micro-batches."""
    pages = site_pages_of(stream_table(spark, sf, "documents"))
    read = with_provenance(extract_postings(pages))
    return runs.drain_to_table(read, runs.new_folder(spark, "extracted"))


def ended_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream that comes to an end: the last row takes all others out."""
    folder = f"{runs.new_folder(spark, 'events')}/in"
    events = table(spark, sf, "events")
    last = {"event_id": -1, "user_id": -1, "event_type": "end"}
    ordered.with_end(events, "ts", "400 DAYS", **last).write.parquet(folder)
    return runs.stateful(spark).readStream.schema(events.schema).parquet(folder)


def debounce_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = ended_events(spark, sf)
    fired = ordered.debounce_stream(t.captures_of(e), 2 * t.HOURS, f"{DELAY_S} seconds")
    out = runs.drain_to_table(fired, runs.new_folder(spark, "debounce"))
    return _ntz(out, "captured_at")


def change_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = ended_events(spark, sf)
    changed = ordered.change_stream(t.extractions_of(e), delay=f"{DELAY_S} seconds")
    out = runs.drain_to_table(changed, runs.new_folder(spark, "changes"))
    return _ntz(out, "captured_at", "detected_at")


def dedupe_remote_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The answers that come first, out of fetches in any order within two days."""
    first = ordered.first_copy_stream(t.copies_of(ended_events(spark, sf)), "2 days")
    return _ntz(runs.drain_to_table(first, runs.new_folder(spark, "copies")), "fetched_at")


def _ended(rows: DataFrame, folder: str, time: str, **last) -> DataFrame:
    """A finished table as a stream whose last row takes all others out."""
    ordered.with_end(rows, time, "400 DAYS", **last).write.parquet(folder)
    return runs.stateful(rows.sparkSession).readStream.schema(rows.schema).parquet(folder)


def stale_guard_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Reads that wait for answers, in one query of a stream-stream join and the guard behind it.

    Half of the captures are read; half of those are answered six hours later, some again two
    hours after that, the others never are and go on after twelve hours.
    """
    folder, delay = runs.new_folder(spark, "stale-guard"), f"{DELAY_S} seconds"
    e = table(spark, sf, "events")
    asked = F.col("event_id").cast("string").alias("remote_url")
    answers = [
        e.filter(f"event_id % {every} = 0").select(
            asked,
            (F.col("ts") + F.expr(f"INTERVAL {hours} HOURS")).alias("fetched_at"),
            (F.col("event_id") * 2 + hours % 3).alias("fetch_id"),
            F.lit(True).alias("ok"),
        )
        for every, hours in ((4, 6), (16, 8))
    ]
    repeated = _ended(answers[0].unionByName(answers[1]), f"{folder}/answers", "fetched_at", fetch_id=-1)
    first = runs.drain_to_table(ordered.first_copy_stream(repeated, delay), f"{folder}/first")
    first = _ended(first.filter("remote_url is not null"), f"{folder}/first-in", "fetched_at", remote_url="end")
    captures = t.captures_of(ended_events(spark, sf)).select("tab_id", "captured_at", "capture_id", "url")
    reads = captures.filter("capture_id % 2 = 0 or capture_id < 0")
    arrivals = ordered.answered_stream(
        reads, F.col("capture_id").cast("string"), first, "12 HOURS", "1 HOUR", delay
    )
    told = ordered.stale_guard_stream(captures, arrivals, delay)
    out = runs.drain_to_table(told.filter("capture_id >= 0"), f"{folder}/run")
    return _ntz(out, "captured_at").select("capture_id", "captured_at", "current")


def health_stream(spark: SparkSession, sf: str) -> DataFrame:
    read = t.health_input_of(stream_table(spark, sf, "events"))
    folder = runs.new_folder(spark, "health")
    rows = health.health_rows(read, "ts", "event_id")
    runs.drain_batches(rows, folder, stored.health_writer(f"{folder}/table"))
    return read_snapshot(spark, f"{folder}/table").drop("row")


def submit_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in four ranges of time, one micro-batch each, in as many files as they come."""
    folder = runs.new_folder(spark, "submissions")
    orders = table(spark, sf, "orders")
    cuts = F.percentile_approx("o_orderdate", [0.25, 0.5, 0.75]).alias("cuts")
    cuts = orders.agg(cuts).first()["cuts"]
    stream = runs.stateful(spark).readStream.schema(orders.schema)
    write = stored.submission_writer(
        f"{folder}/staged", lambda: t.applications(spark, sf), "detected_at", "posting_id"
    )
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = orders
        part = part if low is None else part.filter(F.col("o_orderdate") > F.lit(low))
        part = part if high is None else part.filter(F.col("o_orderdate") <= F.lit(high))
        part.write.mode("append").parquet(f"{folder}/in")
        # The stream goes on from its checkpoint with the files that are new.
        rows = t.postings_of(stream.parquet(f"{folder}/in"), table(spark, sf, "customer"))
        runs.drain_batches(rows, folder, write)
    return stored.read_staged(spark, f"{folder}/staged")


def confirm_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmations as they come in, for postings staged before."""
    rows = staged_rows(t.postings(spark, sf))
    arriving = t.confirms_of(
        staged_rows(t.postings_of(stream_table(spark, sf, "orders"), table(spark, sf, "customer")))
    )
    folder = runs.new_folder(spark, "confirmations")
    write = stored.confirmation_writer(f"{folder}/applications", lambda: rows)
    runs.drain_batches(arriving, folder, write)
    done = read_batches(spark, f"{folder}/applications")
    return done.select("posting_id", "application_id", "date_applied")


QUERIES = {
    f.__name__: f
    for f in (
        extract_stream,
        debounce_stream,
        change_stream,
        dedupe_remote_stream,
        stale_guard_stream,
        health_stream,
        submit_stream,
        confirm_stream,
    )
}

ORACLES = {
    "extract_stream": page_queries.ORACLES["tiered_extract"],
    "debounce_stream": f"""
        SELECT CAST(user_id AS VARCHAR) AS tab_id, event_id AS capture_id, ts AS captured_at, immediate
        FROM ({t.ORACLES["debounce_sites"]}) JOIN events ON capture_id = event_id
        WHERE fires""",
    "change_stream": f"""
        SELECT CAST(user_id AS VARCHAR) AS tab_id, capture_id, ts AS captured_at, status, changed, detected_at
        FROM ({t.ORACLES["posting_changes_sites"]}) JOIN events ON capture_id = event_id""",
    "dedupe_remote_stream": f"""
        SELECT remote_url, fetched_at, fetch_id, ok FROM ({t.ORACLES['first_remote_copy']})""",
    "stale_guard_stream": """
        SELECT a.event_id AS capture_id, a.at AS captured_at, c.url = a.event_type AS current
        FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 6 HOUR ELSE ts END AS at
          FROM events WHERE event_id % 2 = 0) a
        ASOF JOIN (SELECT user_id, ts, arg_max(event_type, event_id) AS url FROM events GROUP BY ALL) c
        ON a.user_id = c.user_id AND a.at >= c.ts""",
    "health_stream": t.ORACLES["adapter_health"],
    "submit_stream": t.ORACLES["stage_submissions"],
    "confirm_stream": t.ORACLES["confirm_submissions"],
}
