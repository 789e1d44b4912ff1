"""The whole way of a batch of captures, with one stored table in the middle.

Pages go from the scan to the parser without a shuffle and what the parser made is written
once. Which captures fire, which answers came too late, what changed and what is sent are
worked out on narrow rows beside that table; a posting's text moves only where it is sent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.urls import application_url
from vacancia.operators import health, lookup, remote, submissions, timeline
from vacancia.operators.keys import spread_nulls
from vacancia.operators.routing import INDEED, in_scope, remote_source_url, route
from vacancia.operators.stages import stage
from vacancia.plans.extract import read_postings
from vacancia.streaming import ordered, runs

# How long a tab has to be quiet before its page is read.
INDEED_GAP_US = 400_000
SITES_GAP_US = 500_000


@dataclass(frozen=True)
class Rules:
    """How the captures of one kind of site are timed and compared."""

    gap_us: int
    on_url_change: bool
    compare: tuple[str, ...]


INDEED_RULES = Rules(INDEED_GAP_US, False, ("title", "company", "description_text"))
SITE_RULES = Rules(SITES_GAP_US, True, ("title", "description_text"))


def _routed(captures: DataFrame) -> DataFrame:
    return route(captures.filter(in_scope(F.col("url")))).filter(F.col("adapter_id").isNotNull())


def _with_digest(read: DataFrame) -> DataFrame:
    """A column ``digest`` is what postings are compared by: as on Indeed or as elsewhere."""

    def digest(rules: Rules) -> Column:
        return timeline.digest_of(F.col("status"), [F.col(f"posting.{c}") for c in rules.compare])

    on_indeed = F.col("adapter_id") == INDEED
    return stage(read, digest=F.when(on_indeed, digest(INDEED_RULES)).otherwise(digest(SITE_RULES)))


def read_captures(captures: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """Results of all captures in scope, of a table or a stream, with their ``digest``."""
    routed = _routed(captures)
    if copies is None:
        return _with_digest(read_postings(routed).withColumn("from_remote", F.lit(False)))
    return _with_digest(remote.prefer_remote(routed, copies, timeline.ROW))


def stored_postings(
    captures: DataFrame, folder: str, copies: DataFrame | None = None
) -> DataFrame:
    """The results, from tables written in ``folder``: what the captures show, and beside it
    those that ask for a copy, as they are with it. Only the latter meet the copies."""
    spark = captures.sparkSession

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    if copies is None:
        return written(read_captures(captures), "live")
    live = written(_with_digest(remote.live_postings(_routed(captures))), "live")
    asking = live.filter(F.col("_asks").isNotNull()).drop("digest")
    met = written(_with_digest(remote.preferred(asking, remote.trusted_copies(copies), timeline.ROW)), "met")
    others = live.filter(F.col("_asks").isNull()).withColumn("from_remote", F.lit(False))
    return others.select(met.columns).unionByName(met)


def keys_of(stored: DataFrame) -> DataFrame:
    """What the steps by tab look at."""
    skeleton = F.col("skeleton_removed") if "skeleton_removed" in stored.columns else F.lit(False)
    return stored.select(
        timeline.TAB,
        timeline.AT,
        timeline.ROW,
        "url",
        "adapter_id",
        "status",
        "digest",
        skeleton.alias("skeleton_removed"),
    )


def fired(keys: DataFrame, rules: Rules) -> DataFrame:
    """The captures that are read, of one kind of site."""
    flag = None if rules.on_url_change else F.col("skeleton_removed")
    return timeline.debounce(keys, rules.gap_us, flag, rules.on_url_change).filter("fires")


def arrived(reads: DataFrame, keys: DataFrame, copies: DataFrame) -> DataFrame:
    """Reads at the time their answer is there, without those the tab no longer waits for.

    A single posting whose site keeps copies waits for the first answer to its address; an
    answer that is there already takes no time. If the tab shows another address by then,
    the read is dropped.
    """
    asks = F.when(F.col("status") != "hidden", remote_source_url(F.col("adapter_id"), F.col("url")))
    asked = reads.withColumn("_key", spread_nulls(asks, F.col(timeline.ROW)))
    answers = remote.first_fetches(copies).select(
        F.col("remote_url").alias("_key"), F.col("fetched_at").alias("_answered")
    )
    waited = asked.join(answers, "_key", "left").drop("_key")
    at = F.greatest(F.col(timeline.AT), F.col("_answered").cast(reads.schema[timeline.AT].dataType))
    waited = waited.withColumn(timeline.AT, at).drop("_answered")
    return timeline.still_current(keys, waited).filter("current").drop("current")


def read_results(
    stored: DataFrame,
    sites: Rules = SITE_RULES,
    indeed: Rules = INDEED_RULES,
    copies: DataFrame | None = None,
) -> DataFrame:
    """``capture_id, captured_at, changed, detected_at`` of the captures whose result counts.

    Debounced by the rules of their site, guarded against answers that came too late, and
    compared with what the tab showed before. Loading results change nothing.
    """
    keys = keys_of(stored)
    on_indeed = F.col("adapter_id") == INDEED
    of_sites = fired(keys.filter(~on_indeed), sites)
    if copies is not None:
        of_sites = arrived(of_sites, keys.filter(~on_indeed), copies)
    of_indeed = fired(keys.filter(on_indeed), indeed)
    changes = [
        timeline.posting_changes(rows.select(timeline.TAB, timeline.AT, timeline.ROW, "status", "digest"))
        for rows in (of_sites, of_indeed)
    ]
    return changes[0].unionByName(changes[1]).select(
        timeline.ROW, timeline.AT, "changed", "detected_at"
    )


def with_postings(results: DataFrame, stored: DataFrame) -> DataFrame:
    """Results with what was read; ``captured_at`` is when the result was there."""
    return results.join(stored.drop(timeline.AT), timeline.ROW)


def candidates(results: DataFrame, stored: DataFrame) -> DataFrame:
    """Postings that came up, as they are looked up and sent.

    Tokens are worked out where the texts lie, ahead of the join: a text moves only where the
    caller keeps it.
    """
    postings = stored.select(
        timeline.ROW,
        F.col("posting.title").alias("title"),
        F.col("posting.company").alias("company"),
        F.col("posting.description_text").alias("description_text"),
        F.col("posting.location").alias("location"),
        F.col("posting.salary.raw").alias("salary_raw"),
        F.col("posting.source_url").alias("source_url"),
    )
    changed = results.filter("changed").select(timeline.ROW, "detected_at")
    return changed.join(submissions.with_token(postings), timeline.ROW)


def new_submissions(sent: DataFrame, applications: DataFrame) -> DataFrame:
    """Rows to stage for postings that came up and are not logged yet."""
    return submissions.stage_submissions(sent, applications, "detected_at", timeline.ROW)


def ended_outcome(row: Column, winner: Column, token: Column, at: Column) -> list[Column]:
    """What became of a posting that was not logged before, told by the one sent for its role
    (``winner``) with its token, and by ``_error``, null where that one was accepted."""
    accepted, own = F.col("_error").isNull(), row == winner
    return [
        row,
        F.when(~accepted, F.lit("error")).when(own, F.lit("sent")).otherwise(F.lit("already-logged")).alias("outcome"),
        F.when(accepted, submissions.application_id(token)).alias("application_id"),
        F.lit(None).cast("string").alias("matched_by"),
        F.col("_error").alias("error"),
        F.when(accepted & own, at).alias("date_applied"),
    ]


def send_results(
    sent: DataFrame, applications: DataFrame, base_url: str, refused: DataFrame | None = None
) -> DataFrame:
    """What became of each posting that was sent: outcome, application, existing URL, error
    and the date it was applied for.

    ``already-logged`` tells the application that was found, by URL or else by role, or the
    one an earlier posting of the batch became. ``sent`` postings become applications, dated
    when they were detected, unless their token is among ``refused``; those and what repeats
    them end in ``error``, with the text in ``refused.error`` of the step that failed (the
    least, where a token was refused several times).
    """
    row, order = timeline.ROW, "detected_at"
    looked = lookup.lookup_existing(sent, applications, row)
    role = lookup.role_key(F.col("company"), F.col("title"))
    fresh = stage(looked.filter(F.col("match").isNull()), role=role)
    per_url = lookup.first_by(fresh, F.col("source_url"), order, row)
    staged = submissions.with_token(lookup.first_by(per_url, F.col("role"), order, row))
    tokens = staged.select(row, "role", "pending_token")
    if refused is not None:
        tokens = tokens.join(submissions.refusals(refused), "pending_token", "left")
    else:
        tokens = tokens.withColumn("_error", F.lit(None).cast("string"))
    made = tokens.select("role", F.col(row).alias("_winner"), "pending_token", "_error")
    # A posting repeats the first one with its URL, and that one the first of its role.
    urls = per_url.filter(F.col("source_url").isNotNull()).select(
        "source_url", F.col("role").alias("_url_role")
    )
    narrow = fresh.select(row, order, "source_url", "role")
    known = narrow.join(urls, "source_url", "left").withColumn("role", F.coalesce("_url_role", "role"))
    none = F.lit(None)
    ended = known.join(made, "role").select(
        *ended_outcome(F.col(row), F.col("_winner"), F.col("pending_token"), F.col(order))
    )
    logged = looked.filter(F.col("match").isNotNull()).select(
        row,
        F.lit("already-logged").alias("outcome"),
        F.col("match.id").alias("application_id"),
        "matched_by",
        none.cast("string").alias("error"),
        none.cast(sent.schema[order].dataType).alias("date_applied"),
    )
    found = F.col("outcome") == "already-logged"
    return logged.unionByName(ended).withColumn(
        "existing_url", F.when(found, application_url(F.lit(base_url), F.col("application_id")))
    )


def health_after(results: DataFrame, stored: DataFrame) -> DataFrame:
    """Health from the results that count."""
    told = with_postings(results.select(timeline.ROW, timeline.AT), stored)
    return health.latest_adapter_health(health.health_rows(told, timeline.AT, timeline.ROW))


def streamed_results(
    captures: DataFrame,
    folder: str,
    sites: Rules = SITE_RULES,
    indeed: Rules = INDEED_RULES,
    delay: str = "10 minutes",
) -> tuple[DataFrame, DataFrame]:
    """As ``read_results`` and the stored postings, out of a stream of captures that has ended.

    Pages are read as they come in and go into a table; debouncing and changes are streams
    over the keys of that table. Captures may come in any order within ``delay``.
    """
    spark = captures.sparkSession
    stored = runs.drain_to_table(read_captures(captures), f"{folder}/read")
    at, last = timeline.AT, {timeline.TAB: "", timeline.ROW: -1, "status": "end"}

    def stream(rows: DataFrame, name: str, ahead: str) -> DataFrame:
        ordered.with_end(rows, at, ahead, **last).write.parquet(f"{folder}/{name}-in")
        return runs.stateful(spark).readStream.schema(rows.schema).parquet(f"{folder}/{name}-in")

    found = []
    on_indeed = F.col("adapter_id") == INDEED
    keys = keys_of(stored)
    for name, rules, rows in (
        ("sites", sites, keys.filter(~on_indeed)),
        ("indeed", indeed, keys.filter(on_indeed)),
    ):
        ahead = f"{rules.gap_us // 1_000_000 + 400 * 86_400} SECONDS"
        flag = None if rules.on_url_change else "skeleton_removed"
        fires = ordered.debounce_stream(
            stream(rows, name, ahead), rules.gap_us, delay, flag, rules.on_url_change, ("status", "digest")
        )
        fired_rows = runs.drain_to_table(fires, f"{folder}/{name}-fired")
        changes = ordered.change_stream(stream(fired_rows, f"{name}-fired", ahead), delay=delay)
        found.append(runs.drain_to_table(changes, f"{folder}/{name}-changes"))
    results = found[0].unionByName(found[1])
    return results.select(timeline.ROW, at, "changed", "detected_at"), stored
