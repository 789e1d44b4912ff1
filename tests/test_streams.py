"""Streams give what the batch operators give, whatever the micro-batches."""

import random
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_tables import (
    APPLICATION,
    CAPTURE,
    EXTRACTION,
    HEALTH,
    MS,
    POSTING,
    at,
    make_captures,
    make_extractions,
    make_postings,
)
from vacancia.operators import submissions, timeline
from vacancia.operators.remote import first_fetches
from vacancia.sources import pages, stored
from vacancia.plans import flow
from vacancia.streaming import ordered, runs, sending, tables


def in_files(spark, rows, schema, folder, n_files):
    """Rows as files in arrival order, a little out of time order within and between."""
    rng = random.Random(0)
    rows = sorted(rows, key=lambda r: r[1])
    size = -(-len(rows) // n_files)
    for i in range(n_files):
        part = rows[i * size : (i + 1) * size]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return pages.stream_captures(runs.stateful(spark), folder, schema, files_per_trigger=1)


POSTING_COLUMNS = [c.split()[0] for c in POSTING.split(",")]

# A last capture far ahead moves the watermark past all others.
END = ("end", at(10**9))


@pytest.mark.parametrize("n_files", [1, 4])
def test_debounce_stream(spark, tmp_path, n_files):
    rows = make_captures(11) + [(*END, 9999, "x", False)]
    stream = in_files(spark, rows, CAPTURE, str(tmp_path / "in"), n_files)
    fired = ordered.debounce_stream(stream, 5 * MS, "10 seconds", immediate="skeleton")
    out = runs.drain_to_table(fired, str(tmp_path / "run")).collect()
    df = spark.createDataFrame(rows, CAPTURE)
    batch = timeline.debounce(df, 5 * MS, F.col("skeleton")).filter("fires and tab_id <> 'end'").collect()
    assert sorted((r["capture_id"], r["immediate"]) for r in out) == sorted(
        (r["capture_id"], r["immediate"]) for r in batch
    )


@pytest.mark.parametrize("n_files", [1, 4])
def test_change_stream(spark, tmp_path, n_files):
    rows = make_extractions(12) + [(*END, 9999, "ok", "A", "C", "d")]
    stream = in_files(spark, rows, EXTRACTION, str(tmp_path / "in"), n_files)
    out = runs.drain_to_table(
        ordered.change_stream(stream, delay="10 seconds"), str(tmp_path / "run")
    ).collect()
    batch = timeline.posting_changes(spark.createDataFrame(rows, EXTRACTION)).filter("tab_id <> 'end'")
    keep = ("capture_id", "status", "changed", "detected_at")
    assert sorted(str([r[k] for k in keep]) for r in out) == sorted(
        str([r[k] for k in keep]) for r in batch.collect()
    )


@pytest.mark.parametrize("n_files", [1, 3])
def test_first_copy_stream(spark, tmp_path, n_files):
    rows = [(f"u{i % 7}", at(i // 3), i, i % 2 == 0) for i in range(60)]
    schema = "remote_url string, fetched_at timestamp, fetch_id bigint, ok boolean"
    ended = ordered.with_end(spark.createDataFrame(rows, schema), "fetched_at", "2 DAYS", remote_url="end", fetch_id=-1, ok=True)
    everything = [tuple(r) for r in ended.collect()]
    stream = in_files(spark, everything, schema, str(tmp_path / "in"), n_files)
    out = runs.drain_to_table(ordered.first_copy_stream(stream, "1 hour"), str(tmp_path / "run"))
    want = first_fetches(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["remote_url"], r["fetch_id"]) for r in out.collect()) == sorted(
        (r["remote_url"], r["fetch_id"]) for r in want
    )


def test_the_end_takes_every_row_out(spark, tmp_path):
    rows = make_captures(11)
    df = spark.createDataFrame(rows, CAPTURE)
    ended = ordered.with_end(df, "captured_at", "2 DAYS", tab_id="end", capture_id=-1)
    ended.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pages.stream_captures(runs.stateful(spark), str(tmp_path / "in"), CAPTURE)
    fired = ordered.debounce_stream(stream, 5 * MS, "10 seconds", immediate="skeleton")
    out = runs.drain_to_table(fired, str(tmp_path / "run")).collect()
    batch = timeline.debounce(df, 5 * MS, F.col("skeleton")).filter("fires").collect()
    assert sorted(r["capture_id"] for r in out) == sorted(r["capture_id"] for r in batch)


class FakeHandle:
    """State in dictionaries, and the timers that were set."""

    def __init__(self):
        self.timers = set()

    def getMapState(self, name, key, value):
        return FakeMap()

    def getValueState(self, name, schema):
        return FakeValue()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class FakeMap(dict):
    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class FakeValue:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Times:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = lambda: at
        self.getExpiryTimeInMs = lambda: at


def test_a_busy_tab_is_taken_slot_by_slot(monkeypatch):
    """No more than one slot's rows are ever held, and state shrinks as slots are taken."""
    op = ordered._Debounce(5_000, True)
    op.slot_ms, op.forget_ms = 1_000, 10**9
    handle = FakeHandle()
    op.init(handle)
    rng = random.Random(1)
    rows = [(k * 7_919 % 60_000_000, k, rng.choice("xy"), False) for k in range(30_000)]
    frame = pd.DataFrame(rows, columns=["at", "capture_id", "url", "immediate"])
    op.handleInputRows(("t",), iter([frame[:20_000], frame[20_000:]]), Times(0))
    held, taken = [], op.take
    monkeypatch.setattr(op, "take", lambda tab, rows, *more: held.append(len(rows)) or taken(tab, rows, *more))
    out = []
    for due in sorted(handle.timers):
        before = sum(len(p) for p, in op.parts.values())
        for found in op.handleExpiredTimer(("t",), Times(due), Times(due)):
            out += found.itertuples(index=False)
        assert sum(len(p) for p, in op.parts.values()) < before
    assert not op.slots and not op.parts and sum(held) == 30_000 and max(held) < 1_000
    rows.sort()
    want = [
        r[1]
        for k, r in enumerate(rows)
        if k == 0 or r[2] != rows[k - 1][2] or k + 1 == len(rows) or rows[k + 1][0] - r[0] >= 5_000
    ]
    assert [r.capture_id for r in out] == want
    # The tab is forgotten when it has not been seen for long.
    (last,) = handle.timers - {op._due(s) for s in range(61)}
    assert list(op.handleExpiredTimer(("t",), Times(last), Times(last))) == [] and not op.last.exists()


def test_rows_without_a_place_and_ties_do_not_end_a_stream(spark, tmp_path):
    rows = [
        ("a", at(0), 1, "u", False),
        ("a", at(0), 1, None, False),
        ("a", None, 2, "v", False),
        ("a", at(5), None, "w", False),
        (None, at(1), 3, None, None),
        (*END, 9, "x", False),
    ]
    stream = in_files(spark, [r for r in rows if r[1]] , CAPTURE, str(tmp_path / "in"), 1)
    spark.createDataFrame([r for r in rows if not r[1]], CAPTURE).write.mode("append").parquet(str(tmp_path / "in"))
    fired = ordered.debounce_stream(stream, 5 * MS, "10 seconds", immediate="skeleton")
    out = runs.drain_to_table(fired, str(tmp_path / "fired")).collect()
    assert sorted((str(r["tab_id"]), r["capture_id"]) for r in out) == [("None", 3), ("a", 1), ("a", 1)]
    read = stream.select("tab_id", "captured_at", "capture_id", F.lit("ok").alias("status"), F.col("url").alias("digest"))
    changes = runs.drain_to_table(ordered.change_stream(read, delay="10 seconds"), str(tmp_path / "changes")).collect()
    assert sorted((str(r["tab_id"]), r["changed"]) for r in changes) == [("None", False), ("a", False), ("a", True)]
    fetched = stream.select(F.col("tab_id").alias("remote_url"), F.col("captured_at").alias("fetched_at"), F.col("capture_id").alias("fetch_id"), F.lit(None).cast("boolean").alias("ok"))
    first = runs.drain_to_table(ordered.first_copy_stream(fetched, "10 seconds"), str(tmp_path / "first")).collect()
    assert sorted((str(r["remote_url"]), r["fetch_id"], r["ok"]) for r in first) == [("None", 3, False), ("a", 1, False)]


@pytest.mark.parametrize("n_files", [1, 3])
def test_stale_guard_stream(spark, tmp_path, n_files):
    """Answers that come late, never or before the read, over two streams with their own pace."""
    rows = make_captures(21)
    answers = [
        (f"r{r[2]}", r[1] + timedelta(milliseconds=random.Random(r[2]).choice([-500, 0, 3, 40, 900, 5000])), r[2])
        for r in rows
        if r[2] % 3 == 0
    ]
    wait = timedelta(seconds=2)
    answered = dict((k, when) for _, when, k in answers)
    arrivals = []
    for tab, when, key, url, _ in rows:
        if key % 2 == 0:
            then = answered.get(key)
            arrivals.append((tab, max(when, then) if then is not None and then <= when + wait else when, key, url))
    schema = "tab_id string, captured_at timestamp, capture_id long, url string"
    df = spark.createDataFrame([r[:4] for r in rows], schema)
    want = timeline.still_current(df, spark.createDataFrame(arrivals, schema)).collect()
    captures = in_files(spark, [r[:4] for r in rows] + [(*END, 9_998, "x")], schema, str(tmp_path / "in"), n_files)
    told = "remote_url string, fetched_at timestamp, fetch_id long"
    first = in_files(spark, answers + [("end", END[1], 1)], told, str(tmp_path / "answers"), n_files)
    reads = captures.filter("capture_id % 2 = 0")
    asks = F.concat(F.lit("r"), F.col("capture_id"))
    arrived = ordered.answered_stream(reads, asks, first, "2 SECONDS", "1 SECOND", "10 seconds")
    out = runs.drain_to_table(ordered.stale_guard_stream(captures, arrived, "10 seconds"), str(tmp_path / "run"))
    got = sorted((r["capture_id"], r["captured_at"], r["current"]) for r in out.collect() if r["tab_id"] != "end")
    assert got == sorted((r["capture_id"], r["captured_at"], r["current"]) for r in want)
    assert 0 < sum(c for *_, c in got) < len(got)


def test_state_is_committed_by_its_changes_and_rows_come_in_large_frames(spark, tmp_path):
    """A join of streams keeps one store a partition; a bucket's rows are one frame, not many."""
    times = "tab_id string, captured_at timestamp, capture_id long, url string"
    rows = [("a", at(i), i, "u") for i in range(3_000)]
    captures = in_files(spark, [*rows, (*END, 9_998, "x")], times, str(tmp_path / "in"), 1)
    told = "remote_url string, fetched_at timestamp, fetch_id long"
    first = in_files(spark, [("1", at(1), 1), ("end", END[1], 1)], told, str(tmp_path / "answers"), 1)
    arrived = ordered.answered_stream(
        captures.filter("capture_id % 2 = 0"), F.col("capture_id").cast("string"), first, "2 SECONDS", "1 SECOND", "10 seconds"
    )
    guarded = ordered.stale_guard_stream(captures, arrived, "10 seconds")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) >= 3_000
    out = runs.drain_to_table(guarded, str(tmp_path / "run"))
    assert out.filter("tab_id = 'a'").count() == 1_500
    files = {p.relative_to(tmp_path / "run/checkpoint/state") for p in (tmp_path / "run/checkpoint/state").rglob("*.changelog")}
    assert files and not [p for p in files if "left" in str(p) or "right" in str(p)]


def test_health_stream_and_replay(spark, tmp_path):
    rows = [("rbc" if i % 3 else "cibc", "L", "h", "dedicated", "json-ld", at(i), f"T{i}", i) for i in range(30)]
    folder, path = str(tmp_path / "in"), str(tmp_path / "health")
    for i in range(3):
        part = spark.createDataFrame(rows[i * 10 : i * 10 + 10], HEALTH)
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = pages.stream_captures(spark, folder, HEALTH, files_per_trigger=1)
    write = tables.health_writer(path)
    runs.drain_batches(stream, str(tmp_path / "run"), write)

    def titles():
        return {r["adapter_id"]: r["sample_title"] for r in stored.read_snapshot(spark, path).collect()}

    assert titles() == {"cibc": "T27", "rbc": "T29"}
    # The last batch runs again.
    write(spark.createDataFrame(rows[20:], HEALTH), 2)
    assert titles() == {"cibc": "T27", "rbc": "T29"}


@pytest.mark.parametrize("seed", range(4))
def test_submissions_do_not_depend_on_the_micro_batches(spark, tmp_path, seed):
    path = str(tmp_path / "staged")
    extra = {"location": F.lit(None).cast("string"), "salary_raw": F.lit(None).cast("string"), "description_text": F.col("posting_id").cast("string")}
    rows = sorted(make_postings(13 + seed), key=lambda r: (r[POSTING_COLUMNS.index("detected_at")], r[0]))
    none = spark.createDataFrame([], APPLICATION)
    write = tables.submission_writer(path, lambda: none, "detected_at", "posting_id")

    def batch(part):
        return spark.createDataFrame(part, POSTING).withColumns(extra)

    rng = random.Random(seed)
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), rng.randrange(1, 5))), len(rows)]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    for i, part in enumerate(parts):
        write(batch(part), i)
    want = submissions.stage_submissions(batch(rows), none, "detected_at", "posting_id")
    want = sorted(r["pending_token"] for r in want.select("pending_token").collect())
    got = tables.read_staged(spark, path)
    assert sorted(r["pending_token"] for r in got.collect()) == want
    # The last batch runs again.
    write(batch(parts[-1]), len(parts) - 1)
    assert sorted(r["pending_token"] for r in tables.read_staged(spark, path).collect()) == want


def test_a_token_is_spent_once(spark, tmp_path):
    path = str(tmp_path / "applications")
    staged = spark.createDataFrame([("t1", "x"), ("t2", "y")], "pending_token string, source_url string")
    write = tables.confirmation_writer(path, lambda: staged)

    def confirms(*rows):
        return spark.createDataFrame(list(rows), "pending_token string, date_applied timestamp")

    write(confirms(("t1", at(5)), ("gone", at(1))), 0)
    write(confirms(("t1", at(3)), ("t2", at(4))), 1)
    write(confirms(("t1", at(3)), ("t2", at(4))), 1)
    done = stored.read_batches(spark, path).collect()
    assert sorted((r["pending_token"], r["date_applied"]) for r in done) == [("t1", at(5)), ("t2", at(4))]


@pytest.mark.parametrize("seed", [1, 2])
def test_send_results_as_a_stream_equal_the_batch(spark, tmp_path, seed):
    """In any split of the ordered postings, with some logged before and some refused."""
    made = sorted(make_postings(30 + seed, 120), key=lambda r: (r[1], r[0]))
    schema = POSTING.replace("posting_id", "capture_id")
    extra = {c: F.lit(None).cast("string") for c in ("location", "salary_raw", "description_text")}

    def frame(part):
        return spark.createDataFrame(part, schema).withColumns(extra)

    apps = spark.createDataFrame([("a1", "Acme", "Lead", "Applied", at(5), "u1"), ("a2", "X", "Y", "Applied", at(1), made[9][4])], APPLICATION)
    staged = submissions.stage_submissions(frame(made), apps, "detected_at", "capture_id")
    refused = staged.filter("capture_id % 3 = 0").select("pending_token", F.concat(F.lit("no "), "capture_id").alias("error"))
    refused = spark.createDataFrame(refused.collect(), "pending_token string, error string")
    want = flow.send_results(frame(made), apps, "https://x/", refused)
    rng = random.Random(seed)
    cuts = [0, *sorted(rng.sample(range(1, len(made)), 2)), len(made)]
    for a, b in zip(cuts, cuts[1:]):
        frame(made[a:b]).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = runs.stateful(spark).readStream.schema(frame([]).schema).parquet(str(tmp_path / "in"))
        got = runs.drain_to_table(sending.send_stream(stream, apps, "https://x/", refused), str(tmp_path / "run"))
    columns = sorted(want.columns)
    rows = sorted(map(str, want.select(columns).collect()))
    assert sorted(map(str, got.select(columns).collect())) == rows
    assert len({r["outcome"] for r in got.collect()}) == 3
    # What a batch looks up is state of its own keys; no table of earlier batches is read.
    assert not [p for p in (tmp_path / "run").iterdir() if p.name not in ("out", "checkpoint")]
