"""Send results as a stream: what ``flow.send_results`` says of a batch, posting by posting.

History is state, keyed by what decides: of each URL the role of its first posting, of each
role the posting that was sent for it and its token. A micro-batch looks up its own keys, so
its work does not grow with what was sent before, and no text goes into the state. Postings
are expected in order from micro-batch to micro-batch; those of one micro-batch may come in
any order. Keys are dealt over buckets, and what one holds of a micro-batch, without texts, is
held together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vacancia.functions.urls import application_url
from vacancia.operators import lookup, submissions
from vacancia.operators.keys import spread_nulls
from vacancia.plans.flow import ended_outcome
from vacancia.streaming.ordered import BUCKETS, FRAME

ROW = "capture_id long, at long"
OF_URL = f"url_key string, {ROW}, role string, first boolean, token string"
OF_ROLE = f"role string, {ROW}, winner long, token string"
# Stands for a time or an id that is missing, so that columns of whole numbers stay that; comes last.
LAST = (1 << 63) - 1


class _FirstOfKey(StatefulProcessor):
    """Takes the rows that the keys of a bucket have in a micro-batch in order.

    What was decided for a key is an entry of a map in the state.
    """

    by: str
    decided: str
    # The columns of the first row that are decided.
    offered: tuple[str, ...]
    # Marks the rows that may decide for their key, and those whose decision is to be known later.
    may: str | None = None
    keeps: str | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "key string", self.decided)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "capture_id"], kind="stable", ignore_index=True)
        # By plain texts: pandas takes those that differ behind a zero character for equal.
        names: dict[str | None, int] = {}
        codes = np.array([names.setdefault(name, len(names)) for name in batch[self.by].tolist()])
        every = np.ones(len(batch), dtype=bool)
        may = every if self.may is None else batch[self.may].to_numpy(dtype=bool)
        keeps = every if self.keeps is None else batch[self.keeps].to_numpy(dtype=bool)
        # Of each key the first row, of those that may decide where there are any.
        heads = np.empty(len(names), dtype=int)
        for at in (np.arange(len(batch)), np.flatnonzero(may)):
            heads[codes[at[::-1]]] = at[::-1]
        kept = np.zeros(len(names), dtype=bool)
        kept[codes[keeps]] = True
        offers = zip(*[batch[c].to_numpy(dtype=object)[heads] for c in self.offered])
        some = next(iter(self.known.keys()), None) is not None
        found, new = [], np.ones(len(names), dtype=bool)
        for i, (name, own) in enumerate(zip(names, offers)):
            if kept[i] and isinstance(name, str):
                before = self.known.getValue((name,)) if some else None
                if before is None:
                    self.known.updateValue((name,), own)
                else:
                    own, new[i] = tuple(before), False
            found.append(own)
        first = new[codes] & (heads[codes] == np.arange(len(batch)))
        yield self.told(batch, [np.array(c, dtype=object)[codes] for c in zip(*found)], first)

    def close(self) -> None:
        pass


class _FirstOfUrl(_FirstOfKey):
    """Every posting with the role of the first one of its URL; one without is alone."""

    by, decided, keeps, offered = "url_key", "role string", "has_url", ("role",)

    def told(self, batch, found, first):
        return batch.assign(role=found[0], first=first)[["url_key", "capture_id", "at", "role", "first", "token"]]


class _FirstOfRole(_FirstOfKey):
    """Every posting with the one that is sent for its role: the first posting of a URL comes
    ahead of what repeats it."""

    by, decided, may, offered = "role", "winner long, token string", "first", ("capture_id", "token")

    def told(self, batch, found, first):
        winner = found[0].astype("int64")
        return batch.assign(winner=winner, token=found[1])[["role", "capture_id", "at", "winner", "token"]]


def _keyed_state(rows: DataFrame, processor: _FirstOfKey, schema: str) -> DataFrame:
    """Keys are dealt over buckets, which share state and frames: most have few rows, and a state
    of their own costs more."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(FRAME))
    bucket = F.pmod(F.xxhash64(processor.by), F.lit(BUCKETS)).alias("bucket")
    return rows.select(bucket, "*").groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None"
    )


def send_stream(
    sent: DataFrame,
    applications: DataFrame,
    base_url: str,
    refused: DataFrame | None = None,
    row: str = "capture_id",
    order: str = "detected_at",
) -> DataFrame:
    """The columns of ``flow.send_results`` for a stream of postings.

    ``applications`` and ``refused`` (pending_token, error) are tables, read anew per batch.
    """
    looked = lookup.lookup_existing(sent, applications, row)
    role = lookup.role_key(F.col("company"), F.col("title"))
    fresh = submissions.with_token(looked.filter(F.col("match").isNull())).select(
        spread_nulls(F.col("source_url"), F.col(row)).alias("url_key"),
        F.col("source_url").isNotNull().alias("has_url"),
        F.coalesce(F.col(row).cast("long"), F.lit(LAST)).alias("capture_id"),
        F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(LAST)).alias("at"),
        spread_nulls(role, F.col(row)).alias("role"),
        F.col("pending_token").alias("token"),
    )
    of_url = _keyed_state(fresh, _FirstOfUrl(), OF_URL)
    of_role = _keyed_state(of_url, _FirstOfRole(), OF_ROLE)
    missing = {c: F.nullif(F.col(c), F.lit(LAST)) for c in ("capture_id", "at", "winner")}
    of_role = of_role.withColumns(missing)
    if refused is None:
        told = of_role.withColumn("_error", F.lit(None).cast("string"))
    else:
        told = of_role.join(submissions.refusals(refused), F.col("token") == F.col("pending_token"), "left")
    at = F.timestamp_micros("at").cast(sent.schema[order].dataType)
    ended = told.select(*ended_outcome(F.col("capture_id").alias(row), F.col("winner"), F.col("token"), at))
    logged = looked.filter(F.col("match").isNotNull()).select(
        row,
        F.lit("already-logged").alias("outcome"),
        F.col("match.id").alias("application_id"),
        "matched_by",
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast(sent.schema[order].dataType).alias("date_applied"),
    )
    found = F.col("outcome") == "already-logged"
    return logged.unionByName(ended).withColumn(
        "existing_url", F.when(found, application_url(F.lit(base_url), F.col("application_id")))
    )
