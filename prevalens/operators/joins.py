"""Equi-joins on shared keys.

Strategy is left to Catalyst / AQE: a side whose measured size is under the
broadcast threshold is broadcast, anything else is a sort-merge join, and AQE
splits skewed partitions.  Chained joins on the same keys reuse one hash
partitioning (one exchange per input, none between the joins).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_measures(frames: list, keys: list, how: str = "inner",
                  drop_incomplete: bool = True) -> DataFrame:
    """Join (frame, [measures]) pairs on ``keys``; optionally drop rows with any NULL.

    Each side is projected to keys + its measures first, so only those columns
    are scanned and shuffled.
    """
    sides = [f.select(*keys, *cols) for f, cols in frames]
    out = reduce(lambda a, b: a.join(b, on=keys, how=how), sides)
    return out.na.drop(how="any") if drop_incomplete else out


def attach_group_mean(df: DataFrame, keys: list, value_col: str, name: str) -> DataFrame:
    """Group mean attached to every row: a partial+final aggregate (one row per
    group, NULL keys forming their own group as in a window) joined back on the
    keys, so no group is ever gathered into a single task."""
    renamed = [f"_gk{i}" for i in range(len(keys))]
    means = (df.groupBy(*keys).agg(F.avg(value_col).alias(name))
             .select(*[F.col(k).alias(r) for k, r in zip(keys, renamed)], name))
    cond = reduce(lambda a, b: a & b,
                  [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, renamed)])
    return df.join(means, cond, "left").drop(*renamed)
