"""Projections, row filters, guards and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col, contains_ci


# -- projections ---------------------------------------------------------------

def drop_columns(df: DataFrame, names) -> tuple:
    """Drop the listed columns that exist; returns (frame, dropped, absent)."""
    present = [c for c in names if c in df.columns]
    absent = [c for c in names if c not in df.columns]
    return df.drop(*present), present, absent


def complete_cases(df: DataFrame, subset: list | None = None) -> DataFrame:
    """Drop rows with a NULL (or NaN) in any / the named columns."""
    return df.na.drop(how="any", subset=subset)


# -- predicates -----------------------------------------------------------------

def filter_min_sample(df: DataFrame, sample_col: str, minimum: float) -> DataFrame:
    """Keep rows with ``sample >= minimum``; NULL samples are dropped."""
    return df.where(F.col(sample_col) >= F.lit(minimum))


def class_contains(df: DataFrame, class_col: str, pattern: str) -> DataFrame:
    return df.where(contains_ci(class_col, pattern))


def class_split_counts(df: DataFrame, class_col: str, patterns: dict) -> DataFrame:
    """Row count of each class subset in one pass (``count_if`` per pattern)."""
    return df.agg(*[F.count_if(contains_ci(class_col, p)).alias(f"n_{name}")
                    for name, p in patterns.items()],
                  F.count(F.lit(1)).alias("n_total"))


def equals(df: DataFrame, c: str, value) -> DataFrame:
    """``total_only`` / ``strat_only``: equality filter on one column."""
    return df.where(F.col(c) == F.lit(value))


def latest_period(df: DataFrame, period_col: str) -> DataFrame:
    """Rows at the maximum period (a scalar subquery, evaluated once)."""
    latest = df.agg(F.max(period_col)).scalar()
    return df.where(F.col(period_col) == latest)


def median_value(df: DataFrame, value_col: str, *, exact: bool = True) -> Column:
    """Scalar-subquery median.  Exact (interpolated, like pandas) by default, spread over
    tasks; ``exact=False`` uses ``percentile_approx``.  No values: NULL."""
    if exact:
        from .windows import exact_quantiles
        return exact_quantiles(df, value_col, {"median": 0.5}).select("median").scalar()
    return df.agg(F.percentile_approx(value_col, 0.5, 10000)).scalar()


def binary_label(df: DataFrame, value_col: str, label_col: str,
                 threshold: Column | None = None, *, exact: bool = True) -> DataFrame:
    """``label = value > median`` (ties go low)."""
    thr = median_value(df, value_col, exact=exact) if threshold is None else threshold
    return df.withColumn(label_col, (F.col(value_col) > thr).cast("int"))


def min_rows(df: DataFrame, n: int) -> DataFrame:
    """Empty (same schema) unless the frame has at least ``n`` rows."""
    return df.where(df.agg(F.count(F.lit(1))).scalar() >= F.lit(n))


# -- validation -----------------------------------------------------------------

class ValidationError(ValueError):
    pass


def violation_rules(df: DataFrame, *, value_col: str, sample_col: str, year_col: str, required: list,
                    value_range=(0.0, 100.0), year_range=(2000, 2030)) -> list:
    """(rule, aggregate counting its violations); rules of absent columns are left out."""
    # Column presence is checked first: the other rules need the columns.
    missing = [c for c in required if c not in df.columns]
    rules = [("columns_present", F.lit(len(missing)))]
    if value_col in df.columns:
        rules.append(("value_in_range",
                      F.count_if(~F.col(value_col).between(*value_range))))
    if sample_col in df.columns:
        rules.append(("sample_non_negative", F.count_if(F.col(sample_col) < 0)))
    if year_col in df.columns:
        rules.append(("year_in_range", F.count_if(~F.col(year_col).between(*year_range))))
    return rules


def validation_report(df: DataFrame, *, value_col: str, sample_col: str, year_col: str,
                      required: list, value_range=(0.0, 100.0),
                      year_range=(2000, 2030)) -> DataFrame:
    """One aggregate pass: violation count per rule (NULLs are ignored, as in pandas)."""
    rules = violation_rules(df, value_col=value_col, sample_col=sample_col, year_col=year_col,
                            required=required, value_range=value_range, year_range=year_range)
    counts = df.agg(*[e.cast("long").alias(name) for name, e in rules])
    stack_items = ", ".join(f"'{name}', `{name}`" for name, _ in rules)
    report = counts.selectExpr(f"stack({len(rules)}, {stack_items}) AS (rule, violations)")
    return report.withColumn("passed", F.col("violations") == 0)


def validate_table(df: DataFrame, **kwargs) -> DataFrame:
    """Run the report and raise naming every failed rule; returns the report."""
    rows = validation_report(df, **kwargs).collect()   # one row per rule: bounded
    failed = [r["rule"] for r in rows if not r["passed"]]
    if failed:
        raise ValidationError("validation failed: " + ", ".join(failed))
    return df
