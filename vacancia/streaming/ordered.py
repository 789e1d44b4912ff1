"""Per-tab streams that depend on the order of captures.

Rows of a tab wait in a state until the watermark says that nothing earlier can
come, and are then taken in order; results equal those of the batch operators.
Tabs are dealt over buckets, and those of a bucket share its state, its timers and the
frames that come out, since most have few rows and a state of their own costs more.
State holds what order needs and no page content. It is a map by slots of time: rows
that come in are added without reading what is there, those of several slots together
where there are few. Once the watermark has passed slots, their rows are read in order of
time, some at a time, sorted and taken. So a busy tab is never one list, and what later
slots have to know of a tab is one small row.

Rows without a time or without an id have no place in the order and are left out. Where
time and id are equal, the other values decide, null first.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vacancia.operators.timeline import digest_of

FIRED = "tab_id string, capture_id bigint, captured_at timestamp, immediate boolean"
# A tab unseen for this long is forgotten; its next row is taken as its first.
FORGET_MS = 90 * 24 * 3600 * 1000
SLOT_MS = 60_000
# Rows of one tab that are packed into one value of the state; of a bucket so many times that.
PACKED = 512
SHARED = 8
# Rows of one key that are held in order to be put into runs, unless one slot has more.
HELD = 64 * PACKED
# Groups that tabs and remote URLs are dealt over; what one holds is read in pieces, however large.
BUCKETS = 1 << 9
# Rows of a frame that Spark hands over; they are short, and most of a small frame is its own cost.
FRAME = 16 * PACKED
FIRST_COPIES = "remote_url string, fetched_at timestamp, fetch_id bigint, ok boolean"
CHANGES = (
    "tab_id string, capture_id bigint, captured_at timestamp, status string, "
    "changed boolean, detected_at timestamp"
)


def _in_order(rows: list[tuple]) -> list[tuple]:
    """Sorted, null first; rows without nulls where they tie compare as they are."""
    try:
        return sorted(rows)
    except TypeError:
        return sorted(rows, key=lambda row: [(v is not None, v) for v in row])


def _values(column: pd.Series, kind: type) -> list:
    """A column's plain values; a text that is missing is None."""
    values = column.tolist()
    if kind is str:
        return [v if isinstance(v, str) else None for v in values]
    return list(map(kind, values))


def _name(value: str | None) -> str:
    """A key of the state that tells null from every text."""
    return "" if value is None else f"={value}"


_NEVER = np.iinfo(np.int64).min  # no time


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as they come out; times, which are microseconds or null until here, end in ``_at``."""
    made = dict(zip(columns, zip(*rows)))
    for c in columns:
        if c.endswith("_at"):
            us = [_NEVER if v is None else v for v in made[c]]
            made[c] = np.array(us, dtype=np.int64).view("datetime64[us]")
        else:
            made[c] = pd.Series(made[c], dtype=object)
    return pd.DataFrame(made)


class _InOrder(StatefulProcessor):
    """Holds rows back until their slot is ``hold_ms`` behind the watermark, then calls ``take``.

    Waiting rows are kept in runs: rows of consecutive slots, known by the first of them, as
    many as fit into one value, or those of one slot. So what a call into the state costs is
    shared by the rows of a quiet tab.
    """

    last_schema: str
    out_columns: list[str]
    # The columns of a row that are kept, in this order, time first.
    fields: dict[str, type]
    shared: int = 1
    hold_ms: int = 0
    slot_ms: int = SLOT_MS
    forget_ms: int = FORGET_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", "parts int, first long")
        self.parts = handle.getMapState("parts", "slot long, part int", "rows binary")
        self.last = handle.getValueState("last", self.last_schema)
        self.forgets = handle.getValueState("forgets", "at long")
        # Up to which watermark the rows of a key were taken; its other timers have nothing to do.
        self.taken: dict[tuple, int] = {}

    def _due(self, slot: int) -> int:
        return (slot + 1) * self.slot_ms + self.hold_ms

    def _slot(self, row: tuple) -> int:
        return row[0] // (1000 * self.slot_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.taken.pop(key, None)
        kept: list[tuple] = []
        for pdf in rows:
            kept += self.thin(zip(*[_values(pdf[c], kind) for c, kind in self.fields.items()]))
            if len(kept) >= HELD:
                self._hold(kept)
                kept = []
        self._hold(kept)
        return iter(())

    def thin(self, rows: Iterable[tuple]) -> Iterable[tuple]:
        """Those of a key's rows that have to wait."""
        return rows

    def _hold(self, rows: list[tuple]) -> list[int]:
        """Puts rows into runs, whose first slots are returned."""
        by_slot: dict[int, list[tuple]] = {}
        slot_us, packed = 1000 * self.slot_ms, PACKED * self.shared
        for row in rows:
            by_slot.setdefault(row[0] // slot_us, []).append(row)
        runs: list[tuple[int, list[tuple]]] = []
        for slot in sorted(by_slot):
            if runs and len(runs[-1][1]) + len(by_slot[slot]) <= packed:
                runs[-1][1].extend(by_slot[slot])
            else:
                runs.append((slot, by_slot[slot]))
        for slot, kept in runs:
            parts, first = self.slots.getValue((slot,)) or (0, kept[0][0])
            if not parts:
                self.handle.registerTimer(self._due(slot))
            for begin in range(0, len(kept), packed):
                self.parts.updateValue((slot, parts), (pickle.dumps(kept[begin : begin + packed]),))
                parts += 1
            self.slots.updateValue((slot,), (parts, min(first, *(r[0] for r in kept))))
        return [slot for slot, _ in runs]

    def _due_rows(self, upto: int) -> Iterator[tuple[list[tuple], int | None]]:
        """Rows of all slots up to one in order, some at a time, with the time of the row behind them.

        Runs are read by their first slot, and rows are complete when the next run begins behind
        them. Runs that overlap so far that too much would be held are cut anew, shorter.
        """
        begins = sorted(slot for slot, in self.slots.keys())
        later = [slot for slot in begins if slot > upto]
        open_runs = [slot for slot in begins if slot <= upto]
        held: list[tuple] = []
        while open_runs:
            slot = heapq.heappop(open_runs)
            if open_runs and open_runs[0] == slot:
                continue
            parts, first = self.slots.getValue((slot,))
            done = [r for r in held if self._slot(r) < slot]
            if done:
                held = [r for r in held if self._slot(r) >= slot]
                yield _in_order(done), min(first, *(r[0] for r in held)) if held else first
            self.slots.removeKey((slot,))
            most = HELD
            for part in range(parts):
                held += pickle.loads(self.parts.getValue((slot, part))[0])
                self.parts.removeKey((slot, part))
                if len(held) > most:
                    again = [r for r in held if self._slot(r) > slot]
                    held = [r for r in held if self._slot(r) == slot]
                    for begin in self._hold(again):
                        if begin <= upto:
                            heapq.heappush(open_runs, begin)
                        else:
                            later.append(begin)
                    most = HELD + len(held)
        rest = [r for r in held if self._slot(r) > upto]
        held = [r for r in held if self._slot(r) <= upto]
        later += self._hold(rest)
        if held:
            yield _in_order(held), self.slots.getValue((min(later),))[1] if later else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expiry = expiredTimerInfo.getExpiryTimeInMs()
        slot, off = divmod(expiry - self.hold_ms, self.slot_ms)
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.taken.get(key, -1) < watermark:
            self.taken[key] = watermark
            out: list[tuple] = []
            # Whatever the watermark has passed is complete, not only the slot of this timer.
            for found in self._taken(key, max(slot, (watermark - self.hold_ms) // self.slot_ms) - 1, watermark):
                out += found
                if len(out) >= HELD:
                    yield _frame(out, self.out_columns)
                    out = []
            if out:
                yield _frame(out, self.out_columns)
        if off and self.forgets.get() == (expiry,):
            self._forget(watermark)

    def _taken(self, key: tuple, upto: int, watermark: int) -> Iterator[list[tuple]]:
        """What comes out of the rows of all slots up to one."""
        before = self.last.get()
        before = last = None if before is None else tuple(before)
        end = None
        for rows, next_at in self._due_rows(upto):
            found, last = self.take(key[0], rows, next_at, last)
            yield found
            end = rows[-1][0]
        if last != before:
            self.last.update(last)
        if end is not None:
            self._forget_at(max(end // 1000 + self.forget_ms, watermark + 1))

    def _forget(self, watermark: int) -> None:
        self.forgets.clear()
        if next(iter(self.slots.keys()), None) is None:
            self.last.clear()

    def _forget_at(self, due: int) -> None:
        """One timer per tab; none of a slot rings at that time."""
        due += (due - self.hold_ms) % self.slot_ms == 0
        if set_before := self.forgets.get():
            self.handle.deleteTimer(set_before[0])
        self.handle.registerTimer(due)
        self.forgets.update((due,))

    def close(self) -> None:
        pass


class _Together(_InOrder):
    """The tabs of a bucket, each taken as ``each`` takes its own.

    What is to be known of a tab later is a map in the state, with the time it was last seen.
    """

    last_schema = "at long"
    shared = SHARED

    def __init__(self, each: _InOrder) -> None:
        self.each = each
        self.hold_ms = each.hold_ms
        self.out_columns = each.out_columns
        self.fields = {**each.fields, "tab_id": str}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = handle.getMapState("known", "tab string", f"seen long, {self.each.last_schema}")

    def _taken(self, key, upto, watermark):
        some = next(iter(self.known.keys()), None) is not None
        # Of each tab: seen and what is known of it, in the state and by now.
        looked: dict[str | None, tuple[tuple | None, tuple | None]] = {}
        waits: dict[str | None, list[tuple]] = {}
        due = None

        def taken(by_tab: dict[str | None, list[tuple]], next_at: dict[str | None, int]) -> list[tuple]:
            out = []
            for tab, rows in by_tab.items():
                if tab not in looked:
                    stored = self.known.getValue((_name(tab),)) if some else None
                    stored = None if stored is None else tuple(stored)
                    looked[tab] = (stored, stored)
                stored, now = looked[tab]
                found, last = self.each.take(tab, rows, next_at.get(tab), now and now[1:])
                out += found
                looked[tab] = (stored, last and (rows[-1][0] // 1000, *last))
            return out

        for rows, next_at in self._due_rows(upto):
            by_tab, waits = waits, {}
            for row in rows:
                by_tab.setdefault(row[-1], []).append(row[:-1])
            if self.hold_ms and next_at is not None:
                # The last row of a tab waits for the one behind it, unless that is far enough.
                for tab, own in by_tab.items():
                    if own[-1][0] + 1000 * self.hold_ms > next_at:
                        waits[tab] = [own.pop()]
            ahead = {tab: own[0][0] for tab, own in waits.items()}
            yield taken({tab: own for tab, own in by_tab.items() if own}, ahead)
            if len(looked) >= HELD:
                due = self._write_back(looked, None, due)
                some = True
        if waits:
            yield taken(waits, self._next_of(waits, upto))
        due = self._write_back(looked, watermark, due)
        if due is not None and self.forgets.get() is None:
            self._forget_at(max(due, watermark + 1))

    def _next_of(self, tabs: Iterable[str | None], upto: int) -> dict[str | None, int]:
        """When each of some tabs is seen next behind a slot, as far as rows are held back."""
        found: dict[str | None, int] = {}
        far = upto + 1 + -(-self.hold_ms // self.slot_ms)
        for slot in [slot for slot, in self.slots.keys() if slot <= far]:
            for part in range(self.slots.getValue((slot,))[0]):
                for row in pickle.loads(self.parts.getValue((slot, part))[0]):
                    if row[-1] in tabs:
                        found[row[-1]] = min(row[0], found.get(row[-1], row[0]))
        return found

    def _write_back(self, looked: dict, watermark: int | None, due: int | None) -> int | None:
        """What is still to be known goes into the state; when the first of it is forgotten."""
        for tab, (stored, now) in looked.items():
            if now is None:
                continue
            until = now[0] + self.forget_ms
            if watermark is not None and until <= watermark:
                if stored is not None:
                    self.known.removeKey((_name(tab),))
                continue
            due = until if due is None else min(due, until)
            if now != stored:
                self.known.updateValue((_name(tab),), now)
        looked.clear()
        return due

    def _forget(self, watermark: int) -> None:
        """Tabs unseen for ``forget_ms``, with which the map is looked through now and then."""
        self.forgets.clear()
        gone, least = [], None
        for name, (seen, *_) in self.known.iterator():
            if seen + self.forget_ms <= watermark:
                gone.append(name)
            else:
                least = seen if least is None else min(least, seen)
        for name in gone:
            self.known.removeKey(name)
        if least is not None:
            self._forget_at(max(least + self.forget_ms, watermark + self.forget_ms // 32 + 1))


class _Debounce(_InOrder):
    last_schema = "url string"
    out_columns = ["tab_id", "capture_id", "captured_at", "immediate"]

    def __init__(self, gap_us: int, on_url_change: bool, carry: tuple[str, ...] = ()) -> None:
        self.gap_us = gap_us
        self.hold_ms = -(-gap_us // 1000)
        self.on_url_change = on_url_change
        self.out_columns = [*self.out_columns, *carry]
        self.fields = {"at": int, "capture_id": int, "url": str, "immediate": bool, **dict.fromkeys(carry, str)}

    def take(self, tab, rows, next_at, last):
        out = []
        for i, (at, capture_id, url, flagged, *carried) in enumerate(rows):
            at_once = flagged or last is None or (self.on_url_change and url != last[0])
            after = rows[i + 1][0] if i + 1 < len(rows) else next_at
            if at_once or after is None or after - at >= self.gap_us:
                out.append((tab, capture_id, at, at_once, *carried))
            last = (url,)
        return out, last


class _Changes(_InOrder):
    last_schema = "digest string, since long"
    out_columns = ["tab_id", "capture_id", "captured_at", "status", "changed", "detected_at"]
    fields = {"at": int, "capture_id": int, "status": str, "digest": str}

    def take(self, tab, rows, next_at, last):
        out = []
        for at, capture_id, status, digest in rows:
            changed = digest != "" and (last is None or last[0] != digest)
            since = at if changed else (last[1] if digest != "" else 0)
            out.append((tab, capture_id, at, status, changed, since if digest != "" else None))
            last = (digest, since)
        return out, last


class _FirstCopy(_InOrder):
    """Of many addresses together, since most have one answer and a state of their own costs more.

    Which addresses were answered is a map in the state, with the time until which they were seen.
    """

    last_schema = "at long"
    out_columns = ["remote_url", "fetched_at", "fetch_id", "ok"]
    shared = SHARED
    fields = {"at": int, "fetch_id": int, "ok": bool, "remote_url": str}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = handle.getMapState("known", "url string", "seen long")
        # What was looked up and is not written back yet: known before, and seen until.
        self.looked: dict[str, tuple[int | None, int]] = {}

    def thin(self, rows):
        """Of the answers of an address in one slot only the first counts."""
        first: dict[tuple, tuple] = {}
        slot_us = 1000 * self.slot_ms
        for row in rows:
            place = (row[0] // slot_us, row[3])
            if place not in first or row[:3] < first[place][:3]:
                first[place] = row
        return list(first.values())

    def _taken(self, key, upto, watermark):
        self.some = next(iter(self.known.keys()), None) is not None
        end = None
        for rows, next_at in self._due_rows(upto):
            yield self.take(key[0], rows, next_at, None)[0]
            end = rows[-1][0]
        if end is not None:
            self._write_back(watermark)
            if self.some and self.forgets.get() is None:
                self._forget_at(max(end // 1000 + self.forget_ms, watermark + 1))

    def take(self, bucket, rows, next_at, last):
        out = []
        slot_us = 1000 * self.slot_ms
        for at, fetch_id, ok, url in rows:
            name = _name(url)
            if name not in self.looked:
                if len(self.looked) >= HELD:
                    self._write_back()
                found = self.known.getValue((name,)) if self.some else None
                self.looked[name] = (found and found[0], -1)
            before, seen = self.looked[name]
            if before is None and seen < 0:
                out.append((url, at, fetch_id, ok))
            self.looked[name] = (before, (at // slot_us + 1) * self.slot_ms)
        return out, last

    def _write_back(self, watermark: int | None = None) -> None:
        """What is still to be known goes into the state, at the end of what a watermark has passed."""
        for name, (before, seen) in self.looked.items():
            if watermark is not None and seen + self.forget_ms <= watermark:
                if before is not None:
                    self.known.removeKey((name,))
            else:
                self.some = True
                if before is None or seen > before:
                    self.known.updateValue((name,), (seen,))
        self.looked.clear()

    def _forget(self, watermark: int) -> None:
        """Addresses unseen for ``forget_ms``, with which the map is looked through now and then."""
        _Together._forget(self, watermark)


class _StillCurrent(_InOrder):
    """Captures (kind 0) say where the tab is; answers (kind 1) are told whether it is there."""

    last_schema = "url string"

    def __init__(self, carry: tuple[str, ...]) -> None:
        self.out_columns = ["tab_id", "capture_id", "captured_at", "url", *carry, "current"]
        self.fields = {"at": int, "kind": int, "capture_id": int, "url": str, **dict.fromkeys(carry, str)}

    def take(self, tab, rows, next_at, last):
        out = []
        for at, kind, capture_id, url, *carried in rows:
            if kind == 0:
                last = (url,)
            else:
                current = last is not None and url is not None and last[0] == url
                out.append((tab, capture_id, at, url, *carried, current))
        return out, last


def _keyed(rows: DataFrame, delay: str, key: str = "capture_id", time: str = "captured_at") -> DataFrame:
    """Event time as a timestamp with a watermark, and as whole microseconds, of rows that have
    a place in the order."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp"))
    placed = timed.filter(F.col(time).isNotNull() & F.col(key).isNotNull())
    return placed.withColumn("at", F.unix_micros(time)).withWatermark(time, delay)


def _run(
    rows: DataFrame, by: str, processor: _InOrder, schema: str, slot_ms: int | None, forget_ms: int
) -> DataFrame:
    # By default a slot is no shorter than what is held back, so that one behind it is enough.
    processor.slot_ms = slot_ms or max(SLOT_MS, processor.hold_ms)
    processor.forget_ms = forget_ms
    # For pages, which are long, ``configure`` sets it lower again.
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(FRAME))
    rows = rows.withColumn(by, F.col(by).cast("string"))
    bucket = F.pmod(F.xxhash64(by), F.lit(BUCKETS)).alias("bucket")
    return rows.select(bucket, "*").groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def _texts(columns: Iterable[str]) -> list[str]:
    return [f"{c} string" for c in columns]


def debounce_stream(
    captures: DataFrame,
    gap_us: int,
    delay: str = "10 minutes",
    immediate: str | None = None,
    on_url_change: bool = True,
    carry: tuple[str, ...] = (),
    slot_ms: int | None = None,
    forget_ms: int = FORGET_MS,
) -> DataFrame:
    """Captures that fire, as ``timeline.debounce`` decides, once the gap has passed.

    Short texts named in ``carry`` come along."""
    flag = F.coalesce(F.col(immediate), F.lit(False)) if immediate else F.lit(False)
    rows = _keyed(captures, delay).select(
        "tab_id", "captured_at", "at", "capture_id", F.col("url").cast("string"), flag.alias("immediate"), *carry
    )
    schema = ", ".join([FIRED, *_texts(carry)])
    processor = _Together(_Debounce(gap_us, on_url_change, carry))
    return _run(rows, "tab_id", processor, schema, slot_ms, forget_ms)


def change_stream(
    extractions: DataFrame,
    compare: tuple[str, ...] = ("title", "description_text"),
    delay: str = "10 minutes",
    slot_ms: int | None = None,
    forget_ms: int = FORGET_MS,
) -> DataFrame:
    """Changes and first-seen times, as ``timeline.posting_changes`` finds them; a column
    ``digest`` is taken where there is one."""
    digest = F.col("digest")
    if "digest" not in extractions.columns:
        digest = digest_of(F.col("status"), [F.col(c) for c in compare])
    digest = F.coalesce(digest, F.lit(""))
    rows = (
        _keyed(extractions, delay)
        .filter(F.col("status") != "loading")
        .select("tab_id", "captured_at", "at", "capture_id", "status", digest.alias("digest"))
    )
    return _run(rows, "tab_id", _Together(_Changes()), CHANGES, slot_ms, forget_ms)


def first_copy_stream(
    copies: DataFrame, delay: str = "10 minutes", slot_ms: int | None = None, forget_ms: int = FORGET_MS
) -> DataFrame:
    """The key of the first answer per remote URL, as ``remote.first_fetches`` finds it, once
    no earlier one can come. Later answers are dropped while the URL is remembered, at least
    for ``forget_ms``."""
    rows = _keyed(copies, delay, "fetch_id", "fetched_at").select(
        "remote_url", "fetched_at", "at", "fetch_id", "ok"
    )
    return _run(rows, "remote_url", _FirstCopy(), FIRST_COPIES, slot_ms, forget_ms)


def answered_stream(reads: DataFrame, asks: Column, answers: DataFrame, wait: str, remembered: str, delay: str) -> DataFrame:
    """Reads at the time their answer is there, as a stream-stream join.

    ``answers(remote_url, fetched_at)`` are the first ones of their address. A read whose
    address (``asks``, null for none) was answered before, within ``remembered``, has its
    answer at once; one that is answered within ``wait`` has it then; any other goes on
    without as of its own time, as soon as the watermark of both streams says so. ``arrived``
    is that time in microseconds.
    """
    left = _keyed(reads, delay).withColumn("_asks", asks)
    right = answers.withColumn("_answered", F.col("fetched_at").cast("timestamp"))
    right = right.filter(F.col("_answered").isNotNull() & F.col("remote_url").isNotNull())
    right = right.select("remote_url", "_answered").withWatermark("_answered", delay)
    within = F.expr(
        f"_answered >= captured_at - INTERVAL {remembered} AND _answered <= captured_at + INTERVAL {wait}"
    )
    joined = left.join(right, (F.col("_asks") == F.col("remote_url")) & within, "left_outer")
    arrived = F.greatest(F.col("at"), F.unix_micros("_answered"))
    return joined.withColumn("arrived", arrived).drop("_asks", "remote_url", "_answered")


def stale_guard_stream(
    captures: DataFrame,
    arrivals: DataFrame,
    delay: str = "10 minutes",
    carry: tuple[str, ...] = (),
    slot_ms: int | None = None,
    forget_ms: int = FORGET_MS,
) -> DataFrame:
    """``arrivals`` with ``current``, as ``timeline.still_current`` decides.

    Both run through one timeline per tab. Arrivals are taken at ``captured_at``, or at
    ``arrived`` where ``answered_stream`` has set it and its watermark; ``captured_at`` of the
    result is that time.
    """
    where = _keyed(captures, delay)
    seen = where.select(
        "tab_id", "captured_at", "at", F.lit(0).alias("kind"), "capture_id", "url",
        *[F.lit(None).cast("string").alias(c) for c in carry],
    )
    if "arrived" in arrivals.columns:
        asked = arrivals.withColumn("at", F.col("arrived"))
    else:
        asked = _keyed(arrivals, delay)
    asked = asked.select("tab_id", "captured_at", "at", F.lit(1).alias("kind"), "capture_id", "url", *carry)
    schema = ", ".join(["tab_id string, capture_id bigint, captured_at timestamp, url string", *_texts(carry), "current boolean"])
    return _run(seen.unionByName(asked), "tab_id", _Together(_StillCurrent(carry)), schema, slot_ms, forget_ms)


def with_end(rows: DataFrame, time: str, ahead: str, **values) -> DataFrame:
    """A finished input with one more row, ``ahead`` of the last, that ends the stream.

    It takes the watermark past every other row, so all of them come out; it waits for
    ever itself. ``values`` are its other columns, the key among them; they must pass the
    stream's filters.
    """
    last = rows.agg(F.max(time).alias(time)).first()[time]
    kinds = {f.name: f.dataType for f in rows.schema}
    end = rows.sparkSession.range(1).select(
        *[
            (F.lit(last) + F.expr(f"INTERVAL {ahead}") if c == time else F.lit(values.get(c)))
            .cast(kinds[c])
            .alias(c)
            for c in rows.columns
        ]
    )
    return rows.unionByName(end)
