"""Order-dependent steps over a tab's captures.

A window over a whole tab would put a busy tab into one task. Each tab's time
is therefore cut into chunks: rows look at their neighbours inside a chunk, and
one small row per chunk carries what the next chunk has to know. A tab adds at
most one such row per chunk of wall-clock time, however many captures it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR = 3600 * 1_000_000
TAB, AT, ROW = "tab_id", "captured_at", "capture_id"


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def _in_chunks(rows: DataFrame, chunk_us: int) -> DataFrame:
    return rows.withColumn("_chunk", F.floor(micros(F.col(AT)) / F.lit(chunk_us)))


def _inside() -> W:
    return W.partitionBy(TAB, "_chunk").orderBy(AT, ROW)


def _across() -> W:
    return W.partitionBy(TAB).orderBy("_chunk")


def _position() -> Column:
    return F.struct(AT, ROW)


def debounce(
    captures: DataFrame,
    gap_us: int,
    immediate: Column | None = None,
    on_url_change: bool = True,
    chunk_us: int = HOUR,
) -> DataFrame:
    """Add ``immediate`` and ``fires``.

    A capture fires when it is immediate or when no later capture of its tab
    comes within the gap. A tab's first capture is immediate, as is one marked by
    ``immediate`` and, with ``on_url_change``, one on another URL than the last.
    """
    inside, across = _inside(), _across()
    local = (
        _in_chunks(captures, chunk_us)
        .withColumn("_prev", F.lag(F.struct("url")).over(inside))
        .withColumn("_next", F.lead(AT).over(inside))
    )
    edges = (
        local.groupBy(TAB, "_chunk")
        .agg(
            F.min(AT).alias("_first_at"),
            F.max_by(F.struct("url"), _position()).alias("_last"),
        )
        .select(
            TAB,
            "_chunk",
            F.lag("_last").over(across).alias("_before"),
            F.lead("_first_at").over(across).alias("_after"),
        )
    )
    prev = F.coalesce("_prev", "_before")
    follower = F.coalesce("_next", "_after")
    at_once = prev.isNull()
    if immediate is not None:
        at_once = at_once | F.coalesce(immediate, F.lit(False))
    if on_url_change:
        at_once = at_once | ~F.col("url").eqNullSafe(prev["url"])
    quiet = follower.isNull() | (micros(follower) - micros(F.col(AT)) >= gap_us)
    return (
        local.join(edges, [TAB, "_chunk"])
        .withColumn("immediate", at_once)
        .withColumn("fires", F.col("immediate") | quiet)
        .drop("_chunk", "_prev", "_next", "_before", "_after")
    )


def digest_of(status: Column, parts: Sequence[Column]) -> Column:
    """What postings are compared by; null where none was found."""
    texts = [F.coalesce(p, F.lit("")) for p in parts]
    return F.when(status == "ok", F.sha2(F.concat_ws("\0", *texts), 256))


def posting_changes(
    extractions: DataFrame,
    compare: Sequence[str] = ("title", "description_text"),
    chunk_us: int = HOUR,
) -> DataFrame:
    """``tab_id, captured_at, capture_id, status, changed, detected_at``, without ``loading`` rows.

    A posting has changed when the tab's previous result was none or differs in
    ``compare``. ``detected_at`` is when the current streak began; it is null
    where nothing is detected. Only keys and a digest go through the windows; a column
    ``digest`` is taken where there is one.
    """
    inside, across = _inside(), _across()
    digest = F.col("digest")
    if "digest" not in extractions.columns:
        digest = digest_of(F.col("status"), [F.col(c) for c in compare])
    narrow = extractions.filter(F.col("status") != "loading").select(
        TAB, AT, ROW, "status", digest.alias("_digest")
    )

    local = (
        _in_chunks(narrow, chunk_us)
        .withColumn("_now", F.struct(F.col("_digest").alias("d")))
        .drop("_digest")
        .withColumn("_prev", F.lag("_now").over(inside))
        .withColumn(
            "_turn",
            F.when(
                F.col("_prev").isNotNull()
                & F.col("_now.d").isNotNull()
                & ~F.col("_now.d").eqNullSafe(F.col("_prev.d")),
                F.col(AT),
            ),
        )
        .withColumn("_turned", F.max("_turn").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    )
    first_turn = F.when(
        F.col("_first.d").isNotNull() & ~F.col("_first.d").eqNullSafe(F.col("_before.d")),
        F.col("_first_at"),
    )
    edges = (
        local.groupBy(TAB, "_chunk")
        .agg(
            F.min(AT).alias("_first_at"),
            F.min_by("_now", _position()).alias("_first"),
            F.max_by("_now", _position()).alias("_last"),
            F.max("_turn").alias("_last_turn"),
        )
        .withColumn("_before", F.lag("_last").over(across))
        .withColumn("_first_turn", first_turn)
        .withColumn("_latest", F.coalesce("_last_turn", "_first_turn"))
        .withColumn(
            "_carried",
            F.last("_latest", ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1)),
        )
        .select(TAB, "_chunk", "_before", F.coalesce("_first_turn", "_carried").alias("_since"))
    )
    now, prev = F.col("_now.d"), F.coalesce("_prev", "_before")["d"]
    return (
        local.join(edges, [TAB, "_chunk"])
        .withColumn("changed", now.isNotNull() & ~now.eqNullSafe(prev))
        .withColumn("detected_at", F.when(now.isNotNull(), F.coalesce("_turned", "_since")))
        .drop("_chunk", "_now", "_prev", "_turn", "_turned", "_before", "_since")
    )


EDGES = f"{TAB} string, at timestamp, digest string, since timestamp"


def changes_of_day(
    extractions: DataFrame,
    edges: DataFrame | None,
    compare: Sequence[str] = ("title", "description_text"),
    chunk_us: int = HOUR,
) -> tuple[DataFrame, DataFrame]:
    """``posting_changes`` of one day after another, and the edges the next day goes on from.

    ``edges`` holds of each tab seen so far one row: when it was last seen, what it showed and
    since when. Days follow each other: no row of a day is earlier than one of a day before,
    and where times are equal across days, the earlier day's row comes first. Earlier days are
    not read again.
    """
    digest = F.col("digest")
    if "digest" not in extractions.columns:
        digest = digest_of(F.col("status"), [F.col(c) for c in compare])
    rows = extractions.filter(F.col("status") != "loading").select(
        TAB, AT, ROW, "status", digest.alias("digest")
    )
    if edges is None:
        changes = posting_changes(rows, chunk_us=chunk_us)
    else:
        # A row ahead of the day's rows, at a time that no row of the day has, says what was shown.
        kind = rows.schema[AT].dataType
        mine = edges.join(rows.select(TAB).distinct(), edges[TAB].eqNullSafe(rows[TAB]), "left_semi")
        ahead = (F.col("at") - F.expr("INTERVAL 1 MICROSECOND")).cast(kind)
        told = mine.select(
            TAB, ahead.alias(AT), F.lit(None).cast(rows.schema[ROW].dataType).alias(ROW), F.lit("before").alias("status"), "digest"
        )
        both = posting_changes(rows.unionByName(told), chunk_us=chunk_us).filter("status <> 'before'")
        since = mine.select(F.col(TAB).alias("_tab"), ahead.alias("_ahead"), F.col("since").cast(kind).alias("_since"))
        changes = both.join(since, F.col(TAB).eqNullSafe(F.col("_tab")), "left").withColumn(
            "detected_at", F.when(F.col("detected_at") == F.col("_ahead"), F.col("_since")).otherwise(F.col("detected_at"))
        ).drop("_tab", "_ahead", "_since")
    last = rows.groupBy(TAB).agg(F.max_by(F.struct("digest", AT), _position()).alias("_last"))
    began = changes.groupBy(F.col(TAB).alias("_tab")).agg(F.max_by(F.struct("detected_at"), _position()).alias("_began"))
    now = last.join(began, F.col(TAB).eqNullSafe(F.col("_tab"))).select(
        TAB,
        F.col(f"_last.{AT}").cast("timestamp").alias("at"),
        F.col("_last.digest").alias("digest"),
        F.col("_began.detected_at").cast("timestamp").alias("since"),
    )
    if edges is not None:
        now = now.unionByName(edges.join(rows.select(TAB).distinct(), edges[TAB].eqNullSafe(rows[TAB]), "left_anti"))
    return changes, now


def still_current(captures: DataFrame, arrivals: DataFrame, chunk_us: int = HOUR) -> DataFrame:
    """Add ``current`` to arrivals: the tab is on the URL that was asked for.

    ``arrivals(tab_id, captured_at, capture_id, url, …)`` are answers at the time
    they came in, for the URL they were requested for. Both tables run through
    one timeline per tab; at equal times the captures come first.
    """
    seen = captures.select(TAB, AT, ROW, F.struct("url").alias("_on"), F.lit(0).alias("_kind"))
    asked = arrivals.withColumn("_on", F.lit(None).cast("struct<url:string>")).withColumn(
        "_kind", F.lit(1)
    )
    rows = _in_chunks(asked.unionByName(seen, allowMissingColumns=True), chunk_us)
    inside = W.partitionBy(TAB, "_chunk").orderBy(AT, "_kind", ROW)
    local = rows.withColumn(
        "_local", F.last("_on", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    )
    edges = (
        rows.groupBy(TAB, "_chunk")
        .agg(F.max_by("_on", F.when(F.col("_kind") == 0, _position())).alias("_last"))
        .select(
            TAB,
            "_chunk",
            F.last("_last", ignorenulls=True)
            .over(_across().rowsBetween(W.unboundedPreceding, -1))
            .alias("_before"),
        )
    )
    on = F.coalesce("_local", "_before")["url"]
    return (
        local.filter(F.col("_kind") == 1)
        .join(edges, [TAB, "_chunk"])
        .withColumn("current", F.coalesce(on == F.col("url"), F.lit(False)))
        .drop("_chunk", "_on", "_kind", "_local", "_before")
    )
