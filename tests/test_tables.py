"""Table operators against plain loops, on small tables with hot keys and ties."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vacancia.operators import health, lookup, remote, submissions, timeline
from vacancia.operators import adapters as adapters_of
from vacancia.operators.adapters import adapters
from vacancia.operators.routing import route
from vacancia.plans.extract import read_postings
from vacancia.sources import stored

T0 = datetime(2026, 1, 1)
MS = 1000
CHUNKS = [MS, 7 * MS, 3_600_000 * MS]


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def make_captures(seed):
    """Two thirds of all rows belong to one tab; some share their time."""
    rng = random.Random(seed)
    rows, clock = [], {}
    for i in range(400):
        tab = rng.choice(["hot", "hot", "hot", "hot", "a", "b", "c"])
        clock[tab] = clock.get(tab, 0) + rng.choice([0, 1, 2, 3, 5, 5, 20, 400])
        rows.append((tab, at(clock[tab]), i, rng.choice("xxxyz"), rng.random() < 0.1))
    return rows


CAPTURE = "tab_id string, captured_at timestamp, capture_id long, url string, skeleton boolean"


def by_tab(rows):
    tabs = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        tabs.setdefault(r[0], []).append(r)
    return tabs.values()


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("sites", [True, False])
def test_debounce(spark, chunk, sites):
    rows = make_captures(1)
    expected = {}
    for tab in by_tab(rows):
        for i, (_, when, key, url, skeleton) in enumerate(tab):
            first = i == 0
            immediate = first or (url != tab[i - 1][3] if sites else skeleton)
            quiet = i + 1 == len(tab) or tab[i + 1][1] - when >= timedelta(milliseconds=5)
            expected[key] = (immediate, immediate or quiet)
    df = spark.createDataFrame(rows, CAPTURE)
    out = timeline.debounce(df, 5 * MS, None if sites else F.col("skeleton"), sites, chunk)
    assert {r["capture_id"]: (r["immediate"], r["fires"]) for r in out.collect()} == expected
    assert out.columns[:5] != [] and not [c for c in out.columns if c.startswith("_")]


def test_debounce_as_stated(spark):
    """Captures at 0, 100, 300, 900 ms and one at 1000 ms that removed the skeleton."""
    rows = [("t", at(ms), ms, "u", ms == 1000) for ms in (0, 100, 300, 900, 1000)]
    out = timeline.debounce(spark.createDataFrame(rows, CAPTURE), 400 * MS, F.col("skeleton"), False)
    assert sorted(r["capture_id"] for r in out.filter("fires").collect()) == [0, 300, 1000]


def make_extractions(seed):
    rng = random.Random(seed)
    return [
        (tab, when, key, rng.choice(["ok"] * 6 + ["not-found", "hidden", "loading"]), rng.choice("AB"), rng.choice("CD"), "d")
        for tab, when, key, *_ in make_captures(seed)
    ]


EXTRACTION = (
    "tab_id string, captured_at timestamp, capture_id long, status string, title string, "
    "company string, description_text string"
)


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("compare", [("title", "description_text"), ("title", "company", "description_text")])
def test_posting_changes(spark, chunk, compare):
    rows = make_extractions(2)
    expected = {}
    for tab in by_tab(rows):
        current, since = None, None
        for _, when, key, status, title, company, text in tab:
            if status == "loading":
                continue
            values = {"title": title, "company": company, "description_text": text}
            posting = tuple(values[c] for c in compare) if status == "ok" else None
            changed = posting is not None and posting != current
            if changed:
                since = when
            current = posting
            expected[key] = (changed, since if posting else None)
    out = timeline.posting_changes(spark.createDataFrame(rows, EXTRACTION), compare, chunk)
    got = {r["capture_id"]: (r["changed"], r["detected_at"]) for r in out.collect()}
    assert got == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_day_by_day_equal_all_at_once(spark, seed):
    """In random splits of the ordered rows; a streak goes on over days, also over ones without its tab."""
    rng = random.Random(seed)
    rows = sorted(make_extractions(40 + seed), key=lambda r: (r[1], r[2]))
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), 3)), len(rows)]
    edges, got = None, []
    for a, b in zip(cuts, cuts[1:]):
        changes, found = timeline.changes_of_day(spark.createDataFrame(rows[a:b], EXTRACTION), edges)
        got += changes.collect()
        edges = spark.createDataFrame(found.collect(), timeline.EDGES)
    want = timeline.posting_changes(spark.createDataFrame(rows, EXTRACTION)).collect()
    keep = ("tab_id", "capture_id", "captured_at", "status", "changed", "detected_at")
    told = lambda found: sorted(str([r[k] for k in keep]) for r in found)
    assert told(got) == told(want)
    assert edges.count() == len({r[0] for r in rows if r[3] != "loading"})


def test_posting_changes_as_stated(spark):
    steps = [("ok", "A"), ("loading", "A"), ("ok", "A"), ("ok", "B"), ("not-found", ""), ("ok", "B")]
    rows = [("t", at(i), i, s, title, "c", "d") for i, (s, title) in enumerate(steps)]
    out = timeline.posting_changes(spark.createDataFrame(rows, EXTRACTION)).collect()
    changed = {r["capture_id"]: r["detected_at"] for r in out if r["changed"]}
    assert changed == {0: at(0), 3: at(3), 5: at(5)}


@pytest.mark.parametrize("chunk", CHUNKS)
def test_still_current(spark, chunk):
    rows = make_captures(3)
    rng = random.Random(4)
    asked = [(r[0], r[1] + timedelta(milliseconds=rng.choice([0, 1, 30, 900])), r[2], r[3]) for r in rows]
    expected = {}
    for tab, when, key, url in asked:
        seen = [r for r in rows if r[0] == tab and r[1] <= when]
        expected[key] = max(seen, key=lambda r: (r[1], r[2]))[3] == url
    captures = spark.createDataFrame(rows, CAPTURE)
    answers = spark.createDataFrame(asked, "tab_id string, captured_at timestamp, capture_id long, url string")
    out = timeline.still_current(captures, answers, chunk)
    assert {r["capture_id"]: r["current"] for r in out.collect()} == expected


POSTING = "posting_id long, detected_at timestamp, company string, title string, source_url string"
APPLICATION = "id string, company string, role string, stage string, date_applied timestamp, source_url string"


def make_postings(seed, n=300):
    rng = random.Random(seed)
    return [
        (
            i, at(rng.randint(0, 50)), rng.choice(["Unknown company", "Unknown company", "Acme Inc.", "312 Acme"]),
            rng.choice(["Clerk", "Lead", "Clerk "]), rng.choice([None, None, "u1", "u2", "u3", f"v{i}"]),
        )
        for i in range(n)
    ]


def test_lookup_existing(spark):
    apps = [
        ("a1", "Acme", "Lead", "Applied", at(5), "u1"),
        ("a2", "Acme Ltd.", "Lead", "Offer", at(1), None),
        ("a3", "Other", "Clerk", "Applied", at(3), "u2"),
        ("a4", "Other", "Clerk", "Applied", at(2), "u2"),
        ("a5", "unknown company", "Clerk", "Applied", at(2), None),
        ("a6", "Unknown company", "Clerk", "Applied", at(9), None),
    ]
    postings = spark.createDataFrame(make_postings(5), POSTING)
    out = lookup.lookup_existing(postings, spark.createDataFrame(apps, APPLICATION), "posting_id").collect()
    assert len(out) == 300
    for r in out:
        company = {"Acme Inc.": "Acme", "312 Acme": "Acme"}.get(r["company"], r["company"])
        by_url = {"u1": "a1", "u2": "a4"}.get(r["source_url"])
        by_role = {("Acme", "Lead"): "a2", ("Unknown company", "Clerk"): "a6"}.get((company, r["title"]))
        assert (r["match"] and r["match"]["id"]) == (by_url or by_role)
        assert r["matched_by"] == ("url" if by_url else "role" if by_role else None)


def test_a_hot_key_is_split_when_looked_up(spark):
    """A third of all postings share one company and role, and another third no URL."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 60_000, 1, 16).selectExpr(
            "id AS posting_id",
            "if(id % 3 = 0, 'Unknown company', concat('Company ', id)) AS company",
            "if(id % 3 = 0, 'Clerk', concat('Role ', id)) AS title",
            "if(id % 3 = 1, null, concat('u', id)) AS source_url",
        )
        apps = rows.selectExpr(
            "cast(posting_id AS string) id", "company", "title AS role", "'s' AS stage",
            "timestamp_seconds(posting_id) AS date_applied", "cast(null AS string) AS source_url",
        ).filter("cast(id AS int) % 2 = 0")
        found = lookup.lookup_existing(rows, apps, "posting_id")
        got = found.groupBy("matched_by").count().collect()
        assert {r["matched_by"]: r["count"] for r in got} == {"role": 40_000, None: 20_000}
        found.write.format("noop").mode("overwrite").save()
        kept = found.select("posting_id", "match")
        kept.collect()
        assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_first_in_batch(spark):
    rows = make_postings(6)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    seen, kept = set(), []
    for r in ordered:
        if r[4] is None or r[4] not in seen:
            seen.add(r[4])
            kept.append(r)
    seen, expected = set(), set()
    for r in kept:
        key = ({"Acme Inc.": "Acme", "312 Acme": "Acme"}.get(r[2], r[2]), r[3])
        if key not in seen:
            seen.add(key)
            expected.add(r[0])
    out = lookup.first_in_batch(spark.createDataFrame(rows, POSTING), "detected_at", "posting_id")
    assert {r["posting_id"] for r in out.collect()} == expected
    # Repeats are cut in each map task, ahead of the shuffle.
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_staging_again_appends_nothing(spark):
    extra = {"location": F.lit(None).cast("string"), "salary_raw": F.lit("$5"), "description_text": F.lit("text")}
    postings = spark.createDataFrame(make_postings(7), POSTING).withColumns(extra)
    none = spark.createDataFrame([], APPLICATION)
    staged = submissions.stage_submissions(postings, none, "detected_at", "posting_id")
    assert staged.count() == staged.select("pending_token").distinct().count() > 0
    assert submissions.not_yet_staged(staged, staged).count() == 0
    first = staged.first()
    assert first["job_posting_text"] == f"{first['title']}\n{first['company']}\n$5\n\ntext"


def test_confirmations(spark):
    staged = spark.createDataFrame([("t1", "x"), ("t2", "y")], "pending_token string, source_url string")
    confirms = spark.createDataFrame(
        [("t1", at(5)), ("t1", at(3)), ("gone", at(1))], "pending_token string, date_applied timestamp"
    )
    done = submissions.confirm_submissions(staged, confirms).collect()
    assert [(r["pending_token"], r["date_applied"]) for r in done] == [("t1", at(3))]
    lost = submissions.expired_confirms(staged, confirms).collect()
    assert [(r["pending_token"], r["status"]) for r in lost] == [("gone", 410)]


def test_api_responses(spark):
    cases = [
        ("ingest", 200, '{"pendingToken":"t","extraction":{"role":"x"}}', (True, 200, None, "t")),
        ("ingest", 200, '{"pendingToken":"t"}', (False, 200, submissions.UNEXPECTED, None)),
        ("ingest", 200, '{"pendingToken":"t","extraction":0}', (False, 200, submissions.UNEXPECTED, None)),
        ("ingest", 401, '{"error":"bad token"}', (False, 401, "bad token", None)),
        ("confirm", 410, '{"error":"expired"}', (False, 410, "expired", None)),
        ("confirm", 201, '{"applicationId":"a"}', (True, 201, None, "a")),
        ("confirm", 500, "oops", (False, 500, "Request failed (500).", None)),
        ("lookup", 200, '{"match":{"id":"m"}}', (True, 200, None, '{"id":"m"}')),
        ("lookup", 200, '{"match":null}', (True, 200, None, None)),
        ("lookup", 200, "not json", (True, 200, None, None)),
        ("lookup", None, None, (False, 0, submissions.UNREACHABLE, None)),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, e string, s int, b string")
    read = df.select("i", submissions.classify_api_response(F.col("e"), F.col("s"), F.col("b")).alias("r"))
    assert [tuple(r["r"]) for r in read.orderBy("i").collect()] == [c[3] for c in cases]


HEALTH = (
    "adapter_id string, adapter_label string, host string, status string, method string, "
    "last_seen timestamp, sample_title string, row long"
)


def test_adapter_health(spark):
    rows = [
        ("cibc", "CIBC", "h", "dedicated", "json-ld", at(1), "A", 1),
        ("rbc", "RBC", "h", "dedicated", "selector", at(2), "B", 2),
        ("cibc", "CIBC", "h", "fallback", "structural", at(3), "C", 3),
        ("rbc", "RBC", "h", "failed", None, at(2), None, 4),
    ]
    first = spark.createDataFrame(rows[:3], HEALTH)
    latest = {r["adapter_id"]: r for r in health.latest_adapter_health(first).collect()}
    assert set(latest) == {"cibc", "rbc"}
    assert latest["cibc"]["status"] == "fallback"
    # At the same instant the later capture wins, null method and all, whichever is stored.
    for stored, new in ((rows[:2], rows[2:]), (rows[2:], rows[:2])):
        frames = [spark.createDataFrame(part, HEALTH) for part in (stored, new)]
        after = health.upsert_adapter_health(*frames).collect()
        assert {r["adapter_id"]: (r["status"], r["method"]) for r in after} == {
            "cibc": ("fallback", "structural"), "rbc": ("failed", None),
        }


def test_health_report_lists_every_adapter_in_order(spark):
    seen = spark.createDataFrame([("cibc", "CIBC", "h", "fallback", "structural", at(0), "C", 1)], HEALTH)
    report = health.health_report(seen, F.lit(at(120_000))).collect()
    assert [r["adapter_id"] for r in report] == [a.adapter_id for a in adapters()]
    details = {r["adapter_id"]: (r["badge"], r["detail"]) for r in report}
    assert details["cibc"] == ("Falling back to generic", "via generic heuristic · 2 min ago")
    assert details["linkedin"] == ("Not seen yet", "www.linkedin.com")


def test_latest_signals(spark):
    rows = [("scriptStartedAt", at(1)), ("lastPortConnectedAt", at(5)), ("scriptStartedAt", at(3)), ("x", at(9))]
    row = health.latest_signals(spark.createDataFrame(rows, "signal string, at timestamp")).first()
    assert tuple(row) == (at(3), at(5), None)
    report = health.signal_report(
        health.latest_signals(spark.createDataFrame(rows, "signal string, at timestamp")), F.lit(at(0))
    ).collect()
    assert [r["badge"] for r in report] == ["OK", "OK", "Never"]


BODY = "The work is varied and the team is kind; we plan, build and run what customers use. " * 3
GUEST = (
    '<h1 class="top-card-layout__title">Guest title</h1><a class="topcard__org-name-link">Acme</a>'
    f'<div class="description__text--rich">{BODY}</div>'
)


def test_remote_copies(spark):
    view = "https://www.linkedin.com/jobs/view/{}/"
    copies = spark.createDataFrame(
        [
            (1, view.format(1), True, GUEST, at(2)),
            (2, view.format(1), False, None, at(2)),
            (3, view.format(2), False, None, at(1)),
            (4, view.format(2), True, GUEST, at(2)),
            (5, view.format(3), True, "<main>Sign in</main>", at(1)),
            (6, view.format(4), True, f"<main>{BODY * 4}</main>", at(1)),
        ],
        "fetch_id long, remote_url string, ok boolean, html string, fetched_at timestamp",
    )
    first = {r["remote_url"]: r["ok"] for r in remote.first_remote_copy(copies).collect()}
    assert first == {view.format(1): True, view.format(2): False, view.format(3): True, view.format(4): True}

    search = "https://www.linkedin.com/jobs/search/?q=a&currentJobId={}"
    live = f"<main><h1>Live title</h1><p>{BODY * 4}</p></main>"
    urls = [search.format(i) for i in (1, 2, 3, 4, 5)] + ["https://www.linkedin.com/jobs/", search.format(1)]
    pages = spark.createDataFrame([(i, u, live) for i, u in enumerate(urls)], "page_id int, url string, html string")
    out = {r["page_id"]: r for r in remote.prefer_remote(route(pages), copies).collect()}
    assert [out[i]["from_remote"] for i in range(7)] == [True, False, False, False, False, False, True]
    assert [out[i]["posting"]["title"] for i in (0, 1, 4, 5)] == ["Guest title"] + ["Live title"] * 3
    assert out[0]["posting"]["source_url"] == view.format(1)
    assert out[0]["outcome"] == "detected" and out[1]["outcome"] == "detected-low-confidence"


def test_extraction_feeds_health(spark):
    pages = spark.createDataFrame(
        [
            (1, "https://jobs.rbc.com/1", f'<h1>x</h1><div class="jd-info">{BODY}</div>', at(1)),
            (2, "https://jobs.rbc.com/2", "<p>nothing</p>", at(2)),
            (3, "https://www.shopify.com/careers", "", at(3)),
            (4, "https://www.indeed.com/", "", at(4)),
        ],
        "page_id int, url string, html string, seen timestamp",
    )
    rows = health.health_rows(read_postings(route(pages)), "seen", "page_id").orderBy("last_seen").collect()
    assert [(r["adapter_id"], r["status"], r["method"], r["sample_title"]) for r in rows] == [
        ("rbc", "dedicated", "selector", "Unknown title"), ("rbc", "failed", None, None),
    ]


def test_stored_snapshots_and_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored.read_snapshot(spark, path) is None
    assert stored.read_batches(spark, path) is None
    for version, n in ((0, 2), (1, 5), (2, 3), (2, 4), (4, 6), (4, 7)):
        stored.write_snapshot(spark.range(n), path, version)
        assert stored.read_snapshot(spark, path).count() == n
        # A table may be rewritten from itself.
        before = stored.read_snapshot(spark, path, before=version)
        assert (before is None) == (version == 0)
    assert stored.read_snapshot(spark, path, before=4).count() == 4
    assert stored.read_snapshot(spark, path, before=0) is None
    batches = str(tmp_path / "b")
    for batch, n in ((0, 2), (1, 5), (1, 3)):
        stored.write_batch(spark.range(n), batches, batch)
    assert stored.read_batches(spark, batches).count() == 5
    assert stored.read_batches(spark, batches, before=1).count() == 2


def test_a_copy_elsewhere_is_read_as_its_adapter_says(spark):
    """A site with list pages and with copies on another host."""
    chains = adapters_of.SelectorChains(title=("h3",), description=(".copy",), location=())
    site = adapters_of.Adapter(
        "depot", "Depot", "own", ["depot.test"], chains, "Depot", posting_path=r"^/role/",
        remote_url=lambda url: F.concat(F.lit("https://cache.test/"), F.regexp_extract(url, "([0-9]+)$", 1)),
    )
    adapters_of.register_adapter(site)
    try:
        rows = [(1, "https://depot.test/role/7", "<p>x"), (2, "https://depot.test/list/7", "<p>x")]
        pages = spark.createDataFrame(rows, "page_id int, url string, html string")
        copy = (1, "https://cache.test/7", "depot", True, f'<h3>Stevedore</h3><p class="copy">{BODY}', at(1))
        fields = "fetch_id long, remote_url string, adapter_id string, ok boolean, html string, fetched_at timestamp"
        read = remote.prefer_remote(route(pages), spark.createDataFrame([copy], fields)).collect()
        got = {r["page_id"]: (r["status"], r["from_remote"], r["posting"] and r["posting"]["title"]) for r in read}
        assert got == {1: ("ok", True, "Stevedore"), 2: ("hidden", False, None)}
        assert {r["posting"]["source_url"] for r in read if r["posting"]} == {"https://depot.test/role/7"}
    finally:
        adapters_of.unregister_adapter("depot")


def test_no_page_goes_through_a_shuffle(spark):
    page = "capture_id long, url string, html string"
    copy = "fetch_id long, remote_url string, ok boolean, html string, fetched_at timestamp"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = remote.prefer_remote(
            route(spark.createDataFrame([], page)), spark.createDataFrame([], copy), "capture_id"
        )
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 2  # captures here, copies there
        changes = timeline.posting_changes(make_frame(spark)).select("capture_id", "changed")
        narrow = changes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for text, words in ((plan, ("html", "dom_nodes")), (narrow, ("description_text", "company"))):
        lines = text.splitlines()
        for i, line in enumerate(lines):
            if "Exchange" in line or " Sort " in line:
                # What the node below hands up is what is moved or sorted.
                assert not any(w in lines[i + 1].split("Arguments")[0].split("AS")[-1] for w in words), lines[i + 1]


def make_frame(spark):
    return spark.createDataFrame(make_extractions(3), EXTRACTION)
