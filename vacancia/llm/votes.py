"""SimHash votes as DataFrame operations: hashed terms add up per bit, without Python.

A term's 64-bit hash votes with the term's weight on each bit it has set. Two bits share
one long column (32 bits of counter each), so 32 sums per document hold all votes, and they
are partial sums in the task that reads the document: what is shuffled is one narrow row
per document and task, however many terms there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 32
LOW = 0xFFFFFFFF


def shingle_rows(rows: DataFrame, keys: list[str], words: Column, n: int) -> DataFrame:
    """``keys`` with ``at`` and ``w1..wn``, a row per shingle of ``n`` neighbouring words.

    Fewer than ``n`` words are one shingle, whose last words are null; no words are one row
    of nulls. The words are laid side by side as shifted arrays and exploded at once.
    """
    rows = rows.select(*keys, words.alias("__w"))
    shifted = [F.col("__w")] + [
        F.slice("__w", k + 1, F.greatest(F.size("__w") - k, F.lit(0))) for k in range(1, n)
    ]
    zipped = F.arrays_zip(*[s.alias(f"w{k + 1}") for k, s in enumerate(shifted)])
    named = rows.select(*keys, F.posexplode_outer(zipped).alias("at", "__s"))
    flat = named.select(
        *keys, F.coalesce("at", F.lit(0)).alias("at"), *[
            F.col("__s").getField(f"w{k + 1}").alias(f"w{k + 1}") for k in range(n)
        ]
    )
    return flat.filter((F.col("at") == 0) | F.col(f"w{n}").isNotNull())


def vote_sums(h: Column, weight: Column) -> list[Column]:
    """The sums, and the whole weight. ``h`` null votes for nothing."""
    both = F.lit((1 << 32) | 1)
    used = F.when(h.isNull(), F.lit(0)).otherwise(weight).cast("long")
    lanes = [
        F.sum(F.shiftrightunsigned(F.coalesce(h, F.lit(0)), k).bitwiseAND(both) * used).alias(f"v{k}")
        for k in range(LANES)
    ]
    return [*lanes, F.sum(used).alias("whole")]


def majority() -> Column:
    """The fingerprint of the sums: bits that won more than half of the whole weight."""
    out = F.lit(0).cast("long")
    for k in range(LANES):
        lane = F.col(f"v{k}")
        low = lane.bitwiseAND(F.lit(LOW))
        high = F.shiftrightunsigned(lane, 32)
        for votes, bit in ((low, k), (high, k + 32)):
            value = (1 << bit) if bit < 63 else -(1 << 63)
            out = out.bitwiseOR(
                F.when(votes * 2 > F.col("whole"), F.lit(value)).otherwise(F.lit(0)).cast("long")
            )
    return out


def hex16(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
