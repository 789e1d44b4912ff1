"""Join and grouping keys that stay balanced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.operators.stages import stage


def spread_nulls(key: Column, row_id: Column) -> Column:
    """The key, or where it is null a text of the row's own that matches no key.

    Rows without a key would otherwise all meet in one partition.
    """
    return F.coalesce(key, F.concat(F.lit("\0"), row_id.cast("string")))


def shuffled_anew(one_per_key: DataFrame, key: str) -> DataFrame:
    """The same rows, for the unique side of a join on ``key``.

    A hot key of the other side is split at run time only when both sides are
    shuffled for the join itself. The result of an aggregate by the key is not: its
    partitioning is taken over. Passing the key through a stage gives that up, for
    one more shuffle of the side that has a single row per key.
    """
    return stage(one_per_key, **{key: F.col(key)})
