"""What the flow moves: postings that ask for no copy meet none, and texts stay where they lie."""

from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq

from vacancia.plans import flow, flow_queries
from vacancia.session import checkpoint_root
from vacancia.streaming.runs import new_folder

SF = "/root/testdata/sf0.001"


def test_only_postings_that_ask_meet_the_copies(spark):
    fetched = flow_queries.copies(spark, SF)
    captures = flow_queries.captures(spark, SF)
    folder = new_folder(spark, "postings")
    stored = flow.stored_postings(captures, folder, fetched)
    live, met = (spark.read.parquet(f"{folder}/{name}") for name in ("live", "met"))
    assert 0 < met.count() == live.filter("_asks is not null").count() < live.count() / 4
    whole = flow.read_captures(captures, fetched)
    assert sorted(whole.columns) == sorted(stored.columns)
    columns = sorted(whole.columns)
    got = sorted(str(r) for r in stored.select(columns).collect())
    assert got == sorted(str(r) for r in whole.select(columns).collect())
    assert met.filter("from_remote").count() > 0


def test_the_text_is_digested_ahead_of_the_join(spark):
    results, stored = flow_queries._results(spark, SF)
    sent = flow.candidates(results, stored)
    assert "pending_token" in sent.columns
    told = flow.send_results(sent, flow_queries._logged(sent), "https://x/")
    plan = told._jdf.queryExecution().optimizedPlan()

    def joined(node):
        name = node.nodeName()
        out = [a for a in str(node.output().mkString(",")).split(",")] if name in ("Join", "Window") else []
        kids = node.children()
        return out + [c for i in range(kids.size()) for c in joined(kids.apply(i))]

    columns = {c.split("#")[0] for c in joined(plan)}
    assert "pending_token" in columns and not columns & {"description_text", "posting", "job_posting_text"}


def test_captures_of_the_stream_lie_spread_over_all_cores(spark):
    """Tables of one file each: captures come in a file per partition at least, of like size, and
    the join that makes them is no broadcast."""
    rows = flow_queries.captures(spark, SF, spread=True).select("capture_id", "html")
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        flow_queries.flow_stream(spark, SF)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    root = checkpoint_root(spark).removeprefix("file://")
    folder = max(Path(root).glob("flow-stream-*"), key=lambda p: p.stat().st_mtime)
    sizes = [pq.read_metadata(f).num_rows for f in (folder / "captures").glob("*.parquet")]
    sizes = [n for n in sizes if n]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
    # Read in two micro-batches, whatever the number of files.
    assert len(list((folder / "read" / "checkpoint" / "commits").glob("[0-9]*"))) == 2


def test_captures_are_dealt_by_page_and_events_meet_no_filter_of_pages(spark, tmp_path):
    """However few files the tables are, each partition has captures to read."""
    docs = [(k, f"Text {k} " * 30, "en", "web", 240) for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(
        1
    ).write.parquet(f"{tmp_path}/documents.parquet")
    events = [(k, datetime(2024, 1, 1) + timedelta(minutes=k), k // 3, "view", 1.0, "{}") for k in range(600)]
    spark.createDataFrame(
        events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rows = flow_queries.captures(spark, str(tmp_path), True, 11)
    assert rows.count() == 600
    assert all(rows.rdd.glom().map(len).collect()) and rows.rdd.getNumPartitions() == 11
    plan = flow._routed(rows)._jdf.queryExecution().optimizedPlan()

    def of_events(node):
        """Conditions on events that have no page yet."""
        columns = {a.split("#")[0] for a in node.output().mkString(",").split(",")}
        own = node.nodeName() == "Filter" and "event_id" in columns and "url" not in columns
        kids = node.children()
        return [node.toString().split("\n")[0]] * own + [c for i in range(kids.size()) for c in of_events(kids.apply(i))]

    assert of_events(plan) and not [c for c in of_events(plan) if "regexp" in c.lower()]
