"""What ordered streams keep and how often they call into their state, without an engine."""

import random

import pandas as pd
import pytest

from tests.test_streams import FakeHandle, FakeMap, Times
from vacancia.streaming import ordered, sending


class CountedMap(FakeMap):
    calls = 0

    def updateValue(self, key, value):
        self.calls += 1
        super().updateValue(key, value)

    def iterator(self):
        return iter(list(self.items()))


class CountedHandle(FakeHandle):
    def getMapState(self, name, key, value):
        return CountedMap()


def ring(op, handle, key, watermark):
    """All timers the watermark has reached, as they come; rows that come out."""
    out = []
    while due := sorted(t for t in handle.timers if t <= watermark):
        for at in due:
            handle.timers.discard(at)
            timer, now = Times(at), Times(watermark)
            for found in op.handleExpiredTimer(key, now, timer):
                out += found.itertuples(index=False)
    return out


def started(op, slot_ms):
    op.slot_ms, op.forget_ms = slot_ms, 10**12
    handle = CountedHandle()
    op.init(handle)
    return handle


def test_rows_of_a_quiet_tab_share_the_calls():
    """As many slots as rows, and one run, one timer and one answer for all of them."""
    op = ordered._Changes()
    handle = started(op, 60_000)
    rows = [(k * 3_600_000_000, k, "ok", f"d{k // 3}") for k in range(200)]
    op.handleInputRows(("t",), iter([pd.DataFrame(rows, columns=["at", "capture_id", "status", "digest"])]), Times(0))
    assert len(handle.timers) == 1 and op.slots.calls == op.parts.calls == 1
    watermark = op._due(op._slot(rows[-1]))
    frames = list(op.handleExpiredTimer(("t",), Times(watermark), Times(min(handle.timers))))
    assert [len(f) for f in frames] == [200] and not op.slots and not op.parts
    assert [r.changed for r in frames[0].itertuples()] == [k % 3 == 0 for k in range(200)]
    assert frames[0]["detected_at"].tolist() == [pd.Timestamp(k // 3 * 3 * 3_600, unit="s") for k in range(200)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_give_the_order_of_time_however_rows_arrive(monkeypatch, seed):
    """In time order or in any, with the watermark close behind or far; no long list is held."""
    rng = random.Random(seed)
    monkeypatch.setattr(ordered, "PACKED", 16)
    monkeypatch.setattr(ordered, "HELD", 64)
    op = ordered._Debounce(5_000, True)
    handle = started(op, 5 if seed % 2 else 50)
    n = 3_000
    rows = [(rng.randrange(10_000_000), k, rng.choice("xy"), False) for k in range(n)]
    spread = 10_000_000 if seed < 3 else 200_000  # how far from time order rows arrive
    arriving = sorted(rows, key=lambda r: r[0] + rng.randrange(spread))
    held, taken = [], op.take
    monkeypatch.setattr(op, "take", lambda tab, rows, *more: held.append(len(rows)) or taken(tab, rows, *more))
    out = []
    cuts = [0, *sorted(rng.sample(range(n), 4)), n] if seed >= 3 else [0, n]
    for a, b in zip(cuts, cuts[1:]):
        frame = pd.DataFrame(arriving[a:b], columns=["at", "capture_id", "url", "immediate"])
        op.handleInputRows(("t",), iter([frame[k : k + 50] for k in range(0, len(frame), 50)]), Times(0))
        watermark = min((r[0] for r in arriving[b:]), default=10**12) // 1000 - 1
        out += ring(op, handle, ("t",), min(watermark, 20_000))
    rows.sort()
    want = [
        (r[1], k == 0 or r[2] != rows[k - 1][2])
        for k, r in enumerate(rows)
        if k == 0 or r[2] != rows[k - 1][2] or k + 1 == n or rows[k + 1][0] - r[0] >= 5_000
    ]
    assert [(r.capture_id, r.immediate) for r in out] == want
    assert not op.slots and not op.parts and sum(held) == n and max(held) < 300


@pytest.mark.parametrize("seed", range(4))
def test_addresses_of_a_bucket_are_answered_once(seed):
    """The first answer of each, over many micro-batches; an address with most of them stays small."""
    rng = random.Random(seed)
    op = ordered._FirstCopy()
    handle = started(op, 1_000)
    op.forget_ms = 50_000
    rows = [
        (rng.randrange(20_000_000), k, bool(k % 2), rng.choice([None, "a", "a", "a", f"u{k % 40}"]))
        for k in range(4_000)
    ]
    rows.sort(key=lambda r: r[0] + rng.randrange(100_000))
    out = []
    for a in range(0, 4_000, 1_000):
        frame = pd.DataFrame(rows[a : a + 1_000], columns=["at", "fetch_id", "ok", "remote_url"])
        op.handleInputRows((7,), iter([frame]), Times(0))
        out += ring(op, handle, (7,), min((r[0] for r in rows[a + 1_000 :]), default=40_000_000) // 1000 - 1)
    first = {}
    for row in sorted(rows, key=lambda r: r[:3]):
        first.setdefault(row[3], row[:3])
    got = {r.remote_url: (r.fetched_at.value // 1000, r.fetch_id, r.ok) for r in out}
    assert len(out) == len(first) and got == first
    assert len(op.known) == len(first) and op.known.calls < 40 * len(first)
    # Addresses are forgotten when they have not been seen for long; until then they are known.
    late = pd.DataFrame([(60_000_000, 9_000, True, "a")], columns=["at", "fetch_id", "ok", "remote_url"])
    op.handleInputRows((7,), iter([late]), Times(0))
    assert ring(op, handle, (7,), 62_000) == [] and ("=a",) in op.known
    ring(op, handle, (7,), 100_000)
    assert list(op.known) == [("=a",)]
    ring(op, handle, (7,), 200_000)
    assert not op.known and not handle.timers


def test_answers_of_one_address_in_a_slot_wait_as_one():
    op = ordered._FirstCopy()
    started(op, 60_000)
    rows = [(1_000 + (k * 7) % 500, k, True, "a") for k in range(500)]
    op.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["at", "fetch_id", "ok", "remote_url"])]), Times(0))
    assert [p for p, in op.parts.values()] and op.slots[(0,)] == (1, 1_000)
    assert len(op.thin(rows)) == 1


def test_quiet_tabs_of_a_bucket_share_the_calls():
    """As many tabs as rows, and one run, one timer and one frame for all of them."""
    op = ordered._Together(ordered._Changes())
    handle = started(op, 60_000)
    op.forget_ms = 1_000
    rows = [(k * 1_000_000, k, "ok", f"d{k}", f"t{k % 500}") for k in range(1_000)]
    frame = pd.DataFrame(rows, columns=["at", "capture_id", "status", "digest", "tab_id"])
    op.handleInputRows((7,), iter([frame[k : k + 100] for k in range(0, 1_000, 100)]), Times(0))
    assert len(handle.timers) == 1 and op.slots.calls == op.parts.calls == 1
    (out,) = op.handleExpiredTimer((7,), Times(10**9), Times(min(handle.timers)))
    assert len(out) == 1_000 and out["changed"].all()
    # What the watermark is so far past that it is forgotten is not written.
    assert not op.slots and not op.parts and not op.known and not op.known.calls


def cut(op, handle, rows, columns, cuts, far):
    """Rows in micro-batches, the watermark just behind what is to come; what comes out."""
    out = []
    for a, b in zip(cuts, cuts[1:]):
        frame = pd.DataFrame(rows[a:b], columns=columns)
        op.handleInputRows((3,), iter([frame[k : k + 50] for k in range(0, len(frame), 50)]), Times(0))
        out += ring(op, handle, (3,), min((r[0] for r in rows[b:]), default=far * 1000) // 1000 - 1)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_each_tab_of_a_bucket_is_taken_by_itself(monkeypatch, seed):
    """Whatever the micro-batches, pieces and slots; also where tab, address and time tie or are null."""
    rng = random.Random(seed)
    monkeypatch.setattr(ordered, "PACKED", 4)
    monkeypatch.setattr(ordered, "HELD", 64)
    tabs = [None, "", "busy", "busy", *(f"t{k}" for k in range(80))]
    rows = [(rng.randrange(2_000) * 1_000, k, rng.choice(["x", "y", None]), k % 9 == 0, rng.choice(tabs)) for k in range(2_000)]
    arriving = sorted(rows, key=lambda r: r[0] + rng.randrange(300_000))
    cuts = [0, *sorted(rng.sample(range(2_000), 5)), 2_000] if seed % 2 else [0, 2_000]
    by_tab = {}
    for row in sorted(rows, key=lambda r: r[:2]):
        by_tab.setdefault(row[4], []).append(row)

    op = ordered._Together(ordered._Debounce(5_000, True))
    handle = started(op, 5 if seed < 3 else 60)
    out = cut(op, handle, arriving, ["at", "capture_id", "url", "immediate", "tab_id"], cuts, 20_000)
    want = [
        (str(tab), r[1], r[3] or k == 0 or r[2] != own[k - 1][2])
        for tab, own in by_tab.items()
        for k, r in enumerate(own)
        if r[3] or k == 0 or r[2] != own[k - 1][2] or k + 1 == len(own) or own[k + 1][0] - r[0] >= 5_000
    ]
    assert sorted((str(r.tab_id), r.capture_id, r.immediate) for r in out) == sorted(want)
    assert not op.slots and not op.parts and len(op.known) == len(by_tab)

    op = ordered._Together(ordered._Changes())
    handle = started(op, 5 if seed < 3 else 60)
    read = [(at, k, "ok", url or "", tab) for at, k, url, _, tab in arriving]
    out = cut(op, handle, read, ["at", "capture_id", "status", "digest", "tab_id"], cuts, 20_000)
    want = []
    for tab, own in by_tab.items():
        since = None
        for k, r in enumerate(own):
            changed = r[2] is not None and (k == 0 or r[2] != own[k - 1][2])
            since = r[0] if changed else since
            want.append((str(tab), r[1], changed, since if r[2] else -1))
    told = [-1 if pd.isna(r.detected_at) else r.detected_at.value // 1000 for r in out]
    assert sorted((str(r.tab_id), r.capture_id, r.changed, at) for r, at in zip(out, told)) == sorted(want)


def test_tabs_of_a_bucket_are_forgotten_each_in_its_time():
    op = ordered._Together(ordered._Changes())
    handle = started(op, 1_000)
    op.forget_ms = 50_000
    columns = ["at", "capture_id", "status", "digest", "tab_id"]

    def came(at, k, tab, watermark):
        op.handleInputRows((0,), iter([pd.DataFrame([(at * 1000, k, "ok", "d", tab)], columns=columns)]), Times(0))
        return [bool(r.changed) for r in ring(op, handle, (0,), watermark)]

    assert came(1_000, 1, "a", 5_000) == [True] and came(40_000, 2, "b", 45_000) == [True]
    # A row that came in time is taken before its tab is forgotten.
    assert came(49_000, 3, "a", 60_000) == [False]
    ring(op, handle, (0,), 95_000)
    assert set(op.known) == {("=a",)}
    ring(op, handle, (0,), 200_000)
    assert not op.known and not handle.timers
    assert came(201_000, 4, "a", 203_000) == [True]


def test_addresses_that_are_forgotten_at_once_cost_no_calls():
    """The watermark is far past all answers: none is looked up, none is written."""
    op = ordered._FirstCopy()
    handle = started(op, 60_000)
    op.forget_ms = 1_000
    rows = [(k * 1_000_000, k, True, f"u{k % 900}") for k in range(1_000)]
    op.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["at", "fetch_id", "ok", "remote_url"])]), Times(0))
    op.known.getValue = None
    (out,) = op.handleExpiredTimer((7,), Times(10**9), Times(min(handle.timers)))
    assert sorted(out["fetch_id"]) == list(range(900)) and not op.known.calls and not op.slots


def test_postings_of_a_bucket_are_told_together_and_each_by_its_key():
    """A frame a bucket; texts that differ behind a zero character are different keys."""
    rng = random.Random(5)
    made, want, roles, winners = [], {}, {}, {}
    for k in range(300):
        url = rng.choice([None, f"u{rng.randrange(12)}"])
        key = url or f"\0{k}"
        made.append((key, url is not None, k, k // 3, f"Acme\0job {rng.randrange(20)}", f"t{k}"))
        role = roles.setdefault(key, made[-1][4])
        want[k] = (role, *winners.setdefault(role, (k, f"t{k}")))
    columns = ["url_key", "has_url", "capture_id", "at", "role", "token"]
    of_url, of_role = sending._FirstOfUrl(), sending._FirstOfRole()
    got = {}
    handles = [CountedHandle() for _ in range(2)]
    of_url.init(handles[0])
    of_role.init(handles[1])
    for part in (made[:90], made[90:]):
        part = rng.sample(part, len(part))
        arriving = pd.DataFrame(part, columns=columns)
        [told] = of_url.handleInputRows((0,), iter([arriving[:7], arriving[7:]]), Times(0))
        [ended] = of_role.handleInputRows((0,), iter([told]), Times(0))
        got |= {r.capture_id: (r.role, r.winner, r.token) for r in ended.itertuples()}
    assert got == want
    # What is without a URL is not asked for again.
    assert of_url.known.calls == len(of_url.known) <= 12 and of_role.known.calls == len(winners)
