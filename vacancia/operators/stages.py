"""Columns that are worked out once, wherever they are used afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns, as ``withColumns`` does, behind a one-row generator.

    The optimizer moves filters below a projection by copying the projected
    expressions into them, and derives constraints from each. With expressions
    the size of a page's, both repeat the work and multiply the plan. A generator
    is left in place, costs no shuffle, and its columns are plain attributes to
    whatever follows.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.inline_outer(F.array(made)))
