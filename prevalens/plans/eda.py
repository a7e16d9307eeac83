"""EDA job: distributions, trends, group comparisons, correlations, VIF, normality.

Inputs are the three national tables.  Their size is bounded by the domain
(years x strata), so the analyses below are small aggregates; every one is
still written as a distributed DataFrame plan (no collect-and-loop).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SurveySpec
from ..functions import stats
from ..functions.scalar import round_half_even, vif_band
from ..operators import aggregates as agg
from ..operators import filters as flt
from ..operators.joins import join_measures
from ..operators.ordering import ordered_categories
from . import charts


# -- datasets -----------------------------------------------------------------------

def join_two(outcome: DataFrame, driver: DataFrame, spec: SurveySpec) -> DataFrame:
    """Outcome and driver on the national key, complete cases."""
    return join_measures([(outcome, [spec.outcome_col]), (driver, [spec.driver_col])],
                         spec.national_keys)


def join_three(outcome: DataFrame, driver: DataFrame, habit: DataFrame, spec: SurveySpec,
               habit_cols: list | None = None) -> DataFrame:
    """Outcome, driver and habit measures on the national key, complete cases."""
    habit_cols = habit_cols or [spec.habit_score]
    return join_measures([(outcome, [spec.outcome_col]), (driver, [spec.driver_col]),
                          (habit, habit_cols)], spec.national_keys)


def join_left(outcome: DataFrame, driver: DataFrame, habit: DataFrame, spec: SurveySpec) -> DataFrame:
    """Inner outcome x driver, then left join of the habit score (gaps stay NULL)."""
    od = join_measures([(outcome, [spec.outcome_col]), (driver, [spec.driver_col])],
                       spec.national_keys, drop_incomplete=False)
    return od.join(habit.select(*spec.national_keys, spec.habit_score),
                   on=spec.national_keys, how="left")


def total_rows(df: DataFrame, spec: SurveySpec) -> DataFrame:
    return flt.equals(df, spec.category, spec.total_category)


# -- analyses -----------------------------------------------------------------------

def yearly_trend(national: DataFrame, spec: SurveySpec, measure: str) -> DataFrame:
    yearly = agg.yearly_mean(total_rows(national, spec), spec.year, measure)
    return charts.trend_series(yearly, spec.year, measure)


def change_over_period(national: DataFrame, spec: SurveySpec, measure: str) -> DataFrame:
    yearly = agg.yearly_mean(total_rows(national, spec), spec.year, measure)
    return agg.first_last_change(yearly, spec.year, measure)


def spread_latest(national: DataFrame, spec: SurveySpec, measure: str) -> DataFrame:
    latest = flt.latest_period(national, spec.year)
    return agg.category_spread(latest, spec.category, measure)


def dual_series(outcome: DataFrame, driver: DataFrame, spec: SurveySpec) -> DataFrame:
    """Two yearly series on Total rows joined by year, with their correlation."""
    a = agg.yearly_mean(total_rows(outcome, spec), spec.year, spec.outcome_col)
    b = agg.yearly_mean(total_rows(driver, spec), spec.year, spec.driver_col)
    joined = a.join(b, spec.year)
    r = joined.agg(F.corr(spec.outcome_col, spec.driver_col)).scalar()
    return joined.select(spec.year,
                         round_half_even(F.col(spec.outcome_col), 4).alias(spec.outcome_col),
                         round_half_even(F.col(spec.driver_col), 4).alias(spec.driver_col),
                         round_half_even(r, 4).alias("r"))


def habit_rates(habit: DataFrame, spec: SurveySpec) -> DataFrame:
    cols = spec.habit_parts + [spec.habit_score]
    return total_rows(habit, spec).select(
        spec.year, *[round_half_even(F.col(c), 4).alias(c) for c in cols])


def habit_vs_outcome(habit: DataFrame, outcome: DataFrame, spec: SurveySpec) -> DataFrame:
    """Total habit score vs Total outcome by year: points, fit and r."""
    h = total_rows(habit, spec).select(spec.year, spec.habit_score)
    o = total_rows(outcome, spec).select(spec.year, spec.outcome_col)
    pts = h.join(o, spec.year)
    x, y = spec.habit_score, spec.outcome_col
    fit = pts.agg(F.regr_slope(y, x).alias("b1"), F.regr_intercept(y, x).alias("b0"),
                  F.corr(x, y).alias("r"))
    return pts.select(spec.year, round_half_even(F.col(x), 4).alias(x),
                      round_half_even(F.col(y), 4).alias(y),
                      round_half_even(fit.select("b1").scalar(), 4).alias("slope"),
                      round_half_even(fit.select("b0").scalar(), 4).alias("intercept"),
                      round_half_even(fit.select("r").scalar(), 4).alias("r"))


def indicator_summary(outcome, driver, habit, spec: SurveySpec) -> DataFrame:
    items = [(spec.outcome_col, outcome, spec.outcome_col),
             (spec.driver_col, driver, spec.driver_col),
             (spec.habit_score, habit, spec.habit_score)]
    items += [(c, habit, c) for c in spec.habit_parts]
    return agg.indicator_summary(items)


def time_trend_tests(od: DataFrame, spec: SurveySpec, min_rows: int = 5) -> DataFrame:
    total = flt.min_rows(total_rows(od, spec), min_rows)
    return stats.pairwise_tests(total, [(spec.year, spec.outcome_col),
                                        (spec.year, spec.driver_col),
                                        (spec.outcome_col, spec.driver_col)])


def combined_pairs(spec: SurveySpec) -> list:
    a, b = spec.habit_parts[0], spec.habit_parts[-1]
    o, d, h = spec.outcome_col, spec.driver_col, spec.habit_score
    return [(o, d), (o, h), (o, a), (o, b), (d, h), (a, b)]


def vif_report(odh: DataFrame, spec: SurveySpec, centered: bool = False) -> DataFrame:
    cols = [spec.driver_col, spec.habit_score]
    guarded = flt.min_rows(odh, len(cols) + 1)
    return stats.vif(guarded, cols, centered=centered).withColumn("band", vif_band("VIF"))


def normality(outcome, driver, habit, spec: SurveySpec, sample_size: int = 500,
              seed: int = 42) -> DataFrame:
    parts = [stats.shapiro_wilk(outcome, spec.outcome_col, spec.outcome_col,
                                sample_size=sample_size, seed=seed),
             stats.shapiro_wilk(driver, spec.driver_col, spec.driver_col,
                                sample_size=sample_size, seed=seed),
             stats.shapiro_wilk(habit, spec.habit_score, spec.habit_score,
                                sample_size=sample_size, seed=seed)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def strata_boxes(national: DataFrame, spec: SurveySpec, measure: str) -> DataFrame:
    """Box statistics per stratum, ordered inside each category (fixed order or by median)."""
    boxes = charts.box_stats(national, [spec.category, spec.stratum], measure)
    return ordered_categories(boxes, national, spec.category, spec.stratum, measure,
                              spec.strat_order)


def eda_job(outcome: DataFrame, driver: DataFrame, habit: DataFrame, spec: SurveySpec) -> dict:
    """All EDA tables (lazy); a caller writes them as report CSVs."""
    od = join_two(outcome, driver, spec)
    odh = join_three(outcome, driver, habit, spec, [spec.habit_score] + spec.habit_parts)
    o, d = spec.outcome_col, spec.driver_col
    return {
        "outcome_trend": yearly_trend(outcome, spec, o),
        "driver_trend": yearly_trend(driver, spec, d),
        "outcome_change": change_over_period(outcome, spec, o),
        "outcome_spread_latest": spread_latest(outcome, spec, o),
        "outcome_histogram": charts.histogram(outcome, o, 35),
        "outcome_total_histogram": charts.histogram(total_rows(outcome, spec), o, 20),
        "outcome_kde": charts.kde(outcome, o),
        "outcome_boxes": strata_boxes(outcome, spec, o),
        "outcome_outliers": charts.box_outliers(
            outcome.select(*spec.national_keys, o), [spec.category, spec.stratum], o),
        "driver_histogram": charts.histogram(driver, d, 35),
        "driver_total_histogram": charts.histogram(total_rows(driver, spec), d, 20),
        "driver_kde": charts.kde(driver, d),
        "driver_boxes": strata_boxes(driver, spec, d),
        "habit_boxes": strata_boxes(habit, spec, spec.habit_score),
        "outcome_moments": agg.global_moments(outcome, o, category_col=spec.category, total_value=spec.total_category),
        "driver_moments": agg.global_moments(driver, d, category_col=spec.category, total_value=spec.total_category),
        "scatter_matrix": odh.select(*spec.national_keys, o, d, spec.habit_score),
        "dual_series": dual_series(outcome, driver, spec),
        "habit_rates": habit_rates(habit, spec),
        "habit_vs_outcome": habit_vs_outcome(habit, outcome, spec),
        "describe_combined": agg.describe(odh, [o, d, spec.habit_score]),
        "corr_matrix": stats.corr_matrix(odh, [o, d, spec.habit_score]),
        "vif": vif_report(odh, spec),
        "stats_summary": indicator_summary(outcome, driver, habit, spec),
        "stats_outcome_by_strat": agg.category_summary(outcome, spec.category, o),
        "stats_corr_outcome_driver": stats.grouped_pearson_test(od, spec.category, o, d),
        "pearson_overall": stats.pearson_test(od, o, d),
        "time_trend_tests": time_trend_tests(od, spec),
        "stats_corr_combined": stats.pairwise_tests(odh, combined_pairs(spec)),
        "normality": normality(outcome, driver, habit, spec),
    }
