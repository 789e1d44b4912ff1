"""Connected components of a table of links, by alternating stars.

A large star hangs every larger neighbour of a node on its smallest neighbour, a small star
every smaller one; repeated, each component becomes one star around its smallest node.
Minima are partial aggregates joined back, so a node with very many links is spread over
tasks. Each round is stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    lower = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return lower.unionByName(own).filter("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 31)).alias("h")
    ).first()
    return row["n"], row["h"]


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` for every node with a link; the component is its smallest node.

    ``links`` has long columns ``a`` and ``b``, in any order, repeated or not.
    """
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(down.filter("a <> b").distinct(), "links")
    before = None
    for _ in range(rounds):
        mark = _mark(now)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = mark
        now = stored(_small_star(_large_star(now)), "links")
    raise RuntimeError("components did not settle")
