"""Exact deduplication against immutable snapshots screened by binary-fuse filters.

Texts are equal when they are the same after each run of white space became one space.
A snapshot holds one row per distinct text with its digest, in buckets of digests, and
beside each bucket a static binary-fuse filter over the digests. An incoming batch is
grouped by digest first; a group whose digest no filter knows is new without a look at
the snapshot, and the others meet the exact buckets, where the bytes of both texts are
compared.

Null counts as empty text. Of equal texts the smallest doc_id stays (a null doc_id
comes after all others, and its text is compared by digests). Of rows repeated with their
doc_id one is kept; all count in group_size. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from vacancia.llm.common import SPACE_CLASS, partitions, stored

# ---- binary-fuse filters, three positions a key, 16-bit fingerprints

U = np.uint64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """Spread 64-bit keys."""
    with np.errstate(over="ignore"):
        x = keys + U(seed)
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


def layout(n: int) -> tuple[int, int]:
    """Segment length and number of segments for ``n`` keys."""
    if n <= 1:
        return 4, 3
    length = 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25))
    length = min(max(length, 4), 1 << 18)
    cells = int(round(max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)) * n))
    return length, max(-(-cells // length), 3)


def positions(hashes: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three cells of each hash, in neighbouring segments."""
    h = hashes.astype(np.uint64)
    first = ((h >> U(32)) * U(segments - 2)) >> U(32)
    mask = U(length - 1)
    out = np.empty((3, len(h)), dtype=np.int64)
    for k in range(3):
        inside = (h >> U(k * 11 + 3)) & mask if k else (h ^ (h >> U(20))) & mask
        out[k] = ((first + U(k)) * U(length) + inside).astype(np.int64)
    return out


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> U(32))) & U(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, segment length, segments and cells of a filter over distinct 64-bit keys.

    Cells that one key alone uses are peeled off, a whole round at a time; filling goes
    through the rounds backwards. A seed that leaves a core is replaced by the next.
    """
    keys = np.unique(keys.astype(np.uint64))
    length, segments = layout(len(keys))
    for seed in range(1, 200):
        if seed % 10 == 0:  # a tiny or unlucky set gets more room
            segments += max(1, segments // 8)
        hashes = mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        cells = positions(hashes, length, segments)
        n_cells = length * segments
        alive = np.ones(len(keys), dtype=bool)
        degree = np.bincount(cells.ravel(), minlength=n_cells)
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            left = np.flatnonzero(alive)
            if not len(left):
                break
            lonely = degree[cells[:, left]] == 1
            has = lonely.any(axis=0)
            if not has.any():
                break
            picked = left[has]
            own = cells[lonely[:, has].argmax(axis=0), picked]
            rounds.append((picked, own))
            alive[picked] = False
            np.subtract.at(degree, cells[:, picked].ravel(), 1)
        if alive.any():
            continue
        table = np.zeros(n_cells, dtype=np.uint16)
        prints = fingerprints(hashes)
        for picked, own in reversed(rounds):
            table[own] = 0
            c = cells[:, picked]
            table[own] = prints[picked] ^ table[c[0]] ^ table[c[1]] ^ table[c[2]]
        return seed, length, segments, table.tobytes()
    raise RuntimeError("no seed gives a filter")


def may_hold(keys: np.ndarray, seed: int, length: int, segments: int, cells: bytes) -> np.ndarray:
    """False only for keys the filter was not built over."""
    hashes = mix(keys.astype(np.uint64), seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    table = np.frombuffer(cells, dtype=np.uint16)
    c = positions(hashes, length, segments)
    return (table[c[0]] ^ table[c[1]] ^ table[c[2]]) == fingerprints(hashes)


# ---- snapshots and batches

FILTER = "bucket int, seed long, segment_length long, segments long, cells binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One narrow row per document: doc_id, SHA-256 and a second, shorter identity."""
    clean = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("t"))
    return clean.select(
        "doc_id",
        F.sha2("t", 256).alias("digest"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.xxhash64("t").alias("second"),
    )


IDENTITY = ("digest", "n_bytes", "second")


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct text: its smallest doc_id and the number of its rows."""
    return rows.groupBy(*IDENTITY).agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )


def bucket_of(n_buckets: int) -> Column:
    return F.pmod(F.col("second"), F.lit(n_buckets)).cast("int")


def filters(snapshot: DataFrame, n_buckets: int) -> DataFrame:
    """One static filter per bucket of the snapshot's digests.

    A bucket holds distinct texts, so no group of copies makes it larger; choose
    ``n_buckets`` so that one bucket's digests, eight bytes each, fit a task.
    """
    rows = snapshot.select(bucket_of(n_buckets).alias("bucket"), "second")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        made = build_filter(frame["second"].to_numpy().view(np.uint64))
        names = ["seed", "segment_length", "segments", "cells"]
        return pd.DataFrame([[frame["bucket"].iloc[0], *made]], columns=["bucket", *names])

    return rows.groupBy("bucket").applyInPandas(build, FILTER)


def screened(batch: DataFrame, filter_rows: DataFrame, n_buckets: int) -> DataFrame:
    """Adds ``maybe``: whether the snapshot may hold the digest."""
    keyed = batch.withColumn("bucket", bucket_of(n_buckets))
    names = ["bucket", *batch.columns]

    def screen(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if len(known):
            row = known.iloc[0]
            maybe = may_hold(
                frame["second"].to_numpy().view(np.uint64),
                int(row["seed"]),
                int(row["segment_length"]),
                int(row["segments"]),
                row["cells"],
            )
        else:
            maybe = np.zeros(len(frame), dtype=bool)
        return frame.assign(maybe=maybe)[[*names, "maybe"]]

    ordered = keyed.select(*names)
    return (
        ordered.groupBy("bucket")
        .cogroup(filter_rows.groupBy("bucket"))
        .applyInPandas(screen, StructType([*ordered.schema.fields, StructField("maybe", BooleanType())]))
        .drop("bucket")
    )


def _texts_of(ids: DataFrame, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The normalised texts of the documents whose ids are given, one row per id."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return source.join(ids, "doc_id", "left_semi").select("doc_id", normalised(F.col("t")).alias("t"))


def first_seen(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    n_buckets: int | None = None,
    name: str = "exact",
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every document.

    The documents up to the middle doc_id are the snapshot, the rest the incoming batch,
    so the snapshot's copy always has the smaller id. Only narrow rows are grouped; texts
    move for the byte checks alone, one per distinct text and side.
    """
    spark = docs.sparkSession
    rows = stored(digests(docs, text, doc_id), f"{name}-digests")
    middle = rows.agg(F.percentile_approx("doc_id", 0.5, 10_000).alias("m")).first()["m"]
    old = F.col("doc_id") <= F.lit(middle)
    early = rows.filter(old)
    late = rows.filter(~F.coalesce(old, F.lit(False)))
    n_buckets = n_buckets or max(partitions(spark), 1)
    snapshot = stored(groups(early), f"{name}-snapshot")
    screen = stored(
        screened(groups(late), filters(snapshot, n_buckets), n_buckets), f"{name}-batch"
    )

    met = (
        screen.filter("maybe")
        .select(*IDENTITY, F.col("keep_id").alias("batch_id"))
        .join(snapshot.select(*IDENTITY, F.col("keep_id").alias("old_id")), list(IDENTITY))
    )
    met = stored(met, f"{name}-met")
    wanted = met.select(F.explode(F.array("batch_id", "old_id")).alias("doc_id")).distinct()
    texts = _texts_of(wanted, docs, text, doc_id)
    sides = (
        met.select(
            *IDENTITY,
            F.explode(
                F.array(F.col("batch_id").alias("doc_id"), F.col("old_id").alias("doc_id"))
            ).alias("doc_id"),
            "batch_id",
            "old_id",
        )
        .join(texts, "doc_id")
        .filter(F.xxhash64("t") == F.col("second"))
    )
    # Both sides' bytes lie side by side under the pair they belong to.
    checked = (
        sides.groupBy(*IDENTITY, "batch_id", "old_id")
        .agg(
            F.max(F.when(F.col("doc_id") == F.col("batch_id"), F.col("t"))).alias("a"),
            F.max(F.when(F.col("doc_id") == F.col("old_id"), F.col("t"))).alias("b"),
        )
        .filter(F.col("a") == F.col("b"))
        .select(*IDENTITY, F.lit(True).alias("same"))
    )
    no_id = met.filter(F.col("batch_id").isNull() | F.col("old_id").isNull())
    checked = checked.unionByName(no_id.select(*IDENTITY, F.lit(True).alias("same")))
    checked = stored(checked, f"{name}-checked")

    # A digest that both sides know under different bytes is two texts: the era tells which.
    era = F.when(F.col("late") & F.col("same").isNull(), F.lit(1)).otherwise(F.lit(0))
    fresh = screen.withColumn("late", F.lit(True)).join(checked, list(IDENTITY), "left")
    both = snapshot.withColumn("era", F.lit(0)).unionByName(
        fresh.withColumn("era", era).select(*snapshot.columns, "era")
    )
    merged = both.groupBy(*IDENTITY, "era").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")
    )
    merged = stored(merged, f"{name}-merged")
    again = Window.partitionBy("doc_id", *IDENTITY).orderBy("doc_id")
    labelled = (
        rows.withColumn("late", ~F.coalesce(old, F.lit(False)))
        .withColumn("nth", F.row_number().over(again))
        .join(checked, list(IDENTITY), "left")
        .withColumn("era", era)
    )
    return labelled.join(merged, [*IDENTITY, "era"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
