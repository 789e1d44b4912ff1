"""Status words, outcomes and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display text of the adapter report and the signal report.
HEALTH_LABELS = {
    "dedicated": "Dedicated adapter",
    "fallback": "Falling back to generic",
    "failed": "Detection failed",
}
METHOD_LABELS = {
    "json-ld": "JSON-LD",
    "selector": "page selectors",
    "structural": "generic heuristic",
}
UNSEEN_LABEL = "Not seen yet"
SIGNAL_LABELS = {
    "scriptStartedAt": "Background script last started",
    "lastPortConnectedAt": "Last kept alive from a page",
    "lastMessageReceivedAt": "Last send click received",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def health_status(method: Column) -> Column:
    return (
        F.when(method.isNull(), F.lit("failed"))
        .when(method == "structural", F.lit("fallback"))
        .otherwise(F.lit("dedicated"))
    )


def health_label(status: Column) -> Column:
    return F.coalesce(_lookup(HEALTH_LABELS, status), F.lit(UNSEEN_LABEL))


def method_label(method: Column) -> Column:
    return _lookup(METHOD_LABELS, method)


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def relative_time(then: Column, now: Column) -> Column:
    """Age as text; each unit is rounded from the already rounded smaller one."""
    seen = then.try_cast("timestamp")
    age = F.unix_millis(now.cast("timestamp")) - F.unix_millis(seen)
    mins = _half_up(age / 60000)
    hours = _half_up(mins / 60)
    days = _half_up(hours / 24)
    return (
        F.when(seen.isNull(), F.lit(""))
        .when(mins < 1, F.lit("just now"))
        .when(mins < 60, F.concat(mins.cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit(" d ago")))
    )


def outcome(status: Column, confidence: Column, is_posting_page: Column) -> Column:
    """What a capture amounts to; null while the page is still loading."""
    return (
        F.when(~is_posting_page, F.lit("hidden"))
        .when(status == "not-found", F.lit("not-found"))
        .when((status == "ok") & (confidence == "low"), F.lit("detected-low-confidence"))
        .when(status == "ok", F.lit("detected"))
    )


def send_outcome(ok: Column, duplicate: Column) -> Column:
    """What a send amounts to; no response at all is an error."""
    return (
        F.when(ok, F.lit("sent"))
        .when(F.coalesce(ok, F.lit(True)), F.lit("error"))
        .when(F.coalesce(duplicate, F.lit(False)), F.lit("already-logged"))
        .otherwise(F.lit("error"))
    )
