"""Aggregations: weighted national roll-up, summaries, counts, crosstabs.

Every operator is a single ``groupBy().agg()`` (partial + final aggregation,
whole-stage codegen) or a union of such; no Python loop over groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import round_half_even, row_mean, safe_divide


# -- national roll-up --------------------------------------------------------------

def weighted_mean(value_col: str, weight_col: str) -> Column:
    """Sum(v*w)/sum(w) over pairs where both are present (NaN is missing); none -> NULL."""
    nan = F.lit(float("nan"))
    v, w = (F.nullif(F.col(c).cast("double"), nan) for c in (value_col, weight_col))
    both = v.isNotNull() & w.isNotNull()
    return safe_divide(F.sum(F.when(both, v * w)), F.sum(F.when(both, w)))


def aggregate_national(df: DataFrame, keys: list, measures: list, *, location_col: str,
                       weight_col: str, n_locations: str = "N_States",
                       total_weight: str = "Total_Sample_Size",
                       exclude_locations=None) -> DataFrame:
    """Weighted national aggregate per key: distinct locations, total weight
    (rows with a NULL measure included), and the weighted mean of each measure.
    NULL keys are dropped, as a pandas groupby does."""
    rows = df.na.drop(how="any", subset=keys)
    if exclude_locations:
        rows = rows.where(~F.col(location_col).isin(list(exclude_locations)))
    aggs = [F.countDistinct(location_col).alias(n_locations),
            F.sum(weight_col).cast("long").alias(total_weight)]
    aggs += [weighted_mean(m, weight_col).alias(m) for m in measures if m in df.columns]
    return rows.groupBy(*keys).agg(*aggs)


def add_row_mean(df: DataFrame, name: str, parts: list) -> DataFrame:
    """Derived score: null-skipping mean of its parts (e.g. a habit score)."""
    return df.withColumn(name, row_mean(*parts))


# -- descriptive summaries ----------------------------------------------------------

def yearly_mean(df: DataFrame, year_col: str, value_col: str, name: str | None = None) -> DataFrame:
    return df.groupBy(year_col).agg(F.avg(value_col).alias(name or value_col))


def group_mean(df: DataFrame, keys: list, value_col: str, name: str | None = None) -> DataFrame:
    return (df.na.drop(how="any", subset=keys)
            .groupBy(*keys).agg(F.avg(value_col).alias(name or value_col)))


def category_spread(df: DataFrame, group_col: str, value_col: str, digits: int = 2) -> DataFrame:
    """mean / sample std / min / max by group, half-even rounded."""
    return (df.na.drop(subset=[group_col]).groupBy(group_col).agg(
        round_half_even(F.avg(value_col), digits).alias("mean"),
        round_half_even(F.stddev_samp(value_col), digits).alias("std"),
        round_half_even(F.min(value_col), digits).alias("min"),
        round_half_even(F.max(value_col), digits).alias("max")))


def category_summary(df: DataFrame, group_col: str, value_col: str, digits: int = 2,
                     group_name: str = "Category") -> DataFrame:
    """N (all rows, NULL values included) / Mean / Std / Min / Max by group."""
    return (df.na.drop(subset=[group_col]).groupBy(F.col(group_col).alias(group_name)).agg(
        F.count(F.lit(1)).alias("N"),
        round_half_even(F.avg(value_col), digits).alias("Mean"),
        round_half_even(F.stddev_samp(value_col), digits).alias("Std"),
        round_half_even(F.min(value_col), digits).alias("Min"),
        round_half_even(F.max(value_col), digits).alias("Max")))


_QUARTILES = {"Q1": 0.25, "Median": 0.5, "Q3": 0.75}


def _with_quantiles(stats: DataFrame, rows: DataFrame, value_col: str, key: str, qs: dict, exact: bool) -> DataFrame:
    """``stats`` (one row per ``key``) with the quantiles of ``rows``; a key without values gets NULLs.

    Exact ones are spread over tasks (``windows.exact_quantiles``): no task holds a group."""
    from .windows import exact_quantiles
    found = (exact_quantiles(rows, value_col, qs, [key]) if exact else rows.groupBy(key).agg(*[
        F.percentile_approx(value_col, q, 10000).alias(name) for name, q in qs.items()]))
    return stats.join(found, key, "left")


def column_summary(df: DataFrame, value_col: str, label: str, digits: int = 2,
                   exact: bool = True) -> DataFrame:
    """One summary row: N, Mean, Median, Std, Min, Max, Q1, Q3 (NULLs skipped).

    Quantiles are exact and linearly interpolated (pandas default);
    ``exact=False`` switches to ``percentile_approx``.
    """
    return indicator_summary([(label, df, value_col)], digits, exact)


def indicator_summary(items: list, digits: int = 2, exact: bool = True) -> DataFrame:
    """One ``column_summary`` row per (label, frame, column) item, labels different.

    The columns are stacked as (label, value) rows, so all summaries are one aggregate
    and one quantile pass.  A column without values keeps its row with N = 0.
    """
    spark = items[0][1].sparkSession
    rows = spark.createDataFrame([(label, None) for label, _, _ in items], "Indicator string, _x double")
    for label, df, c in items:
        rows = rows.unionByName(df.where(F.col(c).isNotNull()).select(
            F.lit(label).alias("Indicator"), F.col(c).cast("double").alias("_x")))
    stats = rows.groupBy("Indicator").agg(
        F.count("_x").alias("N"), F.avg("_x").alias("Mean"), F.stddev_samp("_x").alias("Std"),
        F.min("_x").alias("Min"), F.max("_x").alias("Max"))
    out = _with_quantiles(stats, rows, "_x", "Indicator", _QUARTILES, exact)
    return out.select("Indicator", "N", *[round_half_even(F.col(c), digits).alias(c) for c in
                                          ("Mean", "Median", "Std", "Min", "Max", "Q1", "Q3")])


def describe(df: DataFrame, cols: list, digits: int = 2) -> DataFrame:
    """count/mean/std/min/25%/50%/75%/max per column, exact quantiles, as rows."""
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    names = df.sparkSession.createDataFrame([(c, None) for c in cols], "_column string, _x double")
    rows = names.unionByName(df.selectExpr(f"stack({len(cols)}, {stack}) AS (_column, _x)"))
    stats = rows.groupBy("_column").agg(
        F.count("_x").cast("double").alias("count"), F.avg("_x").alias("mean"),
        F.stddev_samp("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"))
    full = _with_quantiles(stats, rows, "_x", "_column", {"25%": 0.25, "50%": 0.5, "75%": 0.75}, True)
    order = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    long = full.select("_column", F.explode(F.array(*[
        F.struct(F.lit(n).alias("statistic"), round_half_even(F.col(f"`{n}`"), digits).alias("_v"))
        for n in order])).alias("_s")).select("_column", "_s.*")
    return long.groupBy("statistic").pivot("_column", cols).agg(F.first("_v"))     # 8 x cols values


def global_moments(df: DataFrame, value_col: str, *, category_col: str, total_value: str,
                   digits: int = 2) -> DataFrame:
    """mean / median / std / min / max over all rows and over the total rows, one row."""
    is_total = F.col(category_col) == F.lit(total_value)
    tags = F.array_compact(F.array(F.lit("all"), F.when(is_total, F.lit("total"))))
    rows = df.select(F.explode(tags).alias("_tag"), F.col(value_col).cast("double").alias("_x"))
    stats = rows.groupBy("_tag").agg(
        F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"),
        F.min("_x").alias("min"), F.max("_x").alias("max"))
    full = _with_quantiles(stats, rows, "_x", "_tag", {"median": 0.5}, True)
    return full.agg(*[                                    # two rows become one
        round_half_even(F.max(F.when(F.col("_tag") == tag, F.col(c))), digits).alias(f"{tag}_{c}")
        for tag in ("all", "total") for c in ("mean", "median", "std", "min", "max")])


def group_median_order(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """Groups with their median, plus a rank by median descending (ties by name)."""
    from pyspark.sql.window import Window
    rows = df.na.drop(subset=[group_col])
    med = _with_quantiles(rows.select(group_col).distinct(), rows, value_col, group_col, {"median": 0.5}, True)
    # one row per group: the window's single partition holds the group domain only
    w = Window.orderBy(F.desc("median"), F.col(group_col))
    return med.withColumn("rank", F.row_number().over(w))


def value_counts(df: DataFrame, col: str, *, count_name: str = "count",
                 share_name: str = "share", digits: int = 4) -> DataFrame:
    """Count per value and its share of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias(count_name))
            .withColumn(share_name, round_half_even(F.col(count_name) / total, digits)))


def crosstab_normalized(df: DataFrame, row_col: str, col_col: str, col_values: list,
                        digits: int = 3, prefix: str = "") -> DataFrame:
    """Row proportions of a two-way table; missing combinations are 0.

    The column domain is passed in (no distinct job); counts are one
    ``groupBy().pivot()`` and the row total comes from the same row.
    """
    counts = (df.na.drop(subset=[row_col, col_col])
              .groupBy(row_col).pivot(col_col, col_values).count().na.fill(0))
    names = [str(v) for v in col_values]
    total = None
    for n in names:
        total = F.col(f"`{n}`") if total is None else total + F.col(f"`{n}`")
    return counts.select(row_col, *[
        round_half_even(F.col(f"`{n}`") / total, digits).alias(f"{prefix}{n}") for n in names])


def missing_report(df: DataFrame, cols: list, digits: int = 4) -> DataFrame:
    """NULL count and fraction per column (one pass), as rows."""
    aggs = []
    for c in cols:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"n__{c}"),
                 round_half_even(F.avg(F.col(c).isNull().cast("double")), digits).alias(f"f__{c}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `n__{c}`, `f__{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column, n_missing, frac_missing)")


def class_balance(df: DataFrame, label_col: str, digits: int = 4) -> DataFrame:
    """Positives / negatives and their shares for a 0/1 label."""
    y = F.col(label_col).cast("double")
    return df.agg(
        F.sum(y).cast("long").alias("n_positive"),
        F.sum(1 - y).cast("long").alias("n_negative"),
        round_half_even(F.avg(y), digits).alias("share_positive"),
        round_half_even(F.avg(1 - y), digits).alias("share_negative"))


def distinct_sorted(df: DataFrame, cols: list) -> DataFrame:
    return df.select(*cols).distinct().orderBy(*cols)


def first_last_change(df: DataFrame, period_col: str, value_col: str, digits: int = 4) -> DataFrame:
    """Value at the first and last period and the change (``min_by`` / ``max_by``)."""
    first = F.min_by(value_col, period_col)
    last = F.max_by(value_col, period_col)
    return df.agg(F.min(period_col).alias("first_period"), F.max(period_col).alias("last_period"),
                  round_half_even(first, digits).alias("first_value"),
                  round_half_even(last, digits).alias("last_value"),
                  round_half_even(last - first, digits).alias("change"))
