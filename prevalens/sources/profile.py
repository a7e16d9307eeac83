"""Source profiling: one aggregate pass over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sorted_distinct(col: str):
    # collect_set is partially aggregated; its size is the column's domain
    # (classes, years), not the row count.
    return F.array_join(F.array_sort(F.collect_set(F.col(col).cast("string"))), ",")


def profile_source(df: DataFrame, *, class_col: str, location_col: str,
                   year_col: str, approx: bool = False) -> DataFrame:
    """Row and column counts, distinct classes, distinct locations, sorted years."""
    n_loc = (F.approx_count_distinct(location_col) if approx
             else F.countDistinct(location_col))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        _sorted_distinct(class_col).alias("classes"),
        n_loc.alias("n_locations"),
        _sorted_distinct(year_col).alias("years"),
    )
