"""The operators on row-grain tables, whose size follows the scale factor.

The survey view has a row per key combination whatever the input; these queries
run the statistics, charts, folds and scores on rows: parts, order lines,
orders and labelled documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import windows
from ..sources.tables import read_table
from . import charts, regression
from .registry import SPEC, datasets, nationals, register, rounded


def _scored(spark, sf_dir):
    """Labelled documents: quality as the label, the length as a score."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.join(docs, "doc_id")


@register("row_pearson_part")
def q_pearson_part(spark, sf_dir):
    return stats.pearson_test(read_table(spark, sf_dir, "part"), "p_partkey", "p_retailprice")


@register("row_pairwise_lineitem")
def q_pairwise_lineitem(spark, sf_dir):
    return stats.pairwise_tests(read_table(spark, sf_dir, "lineitem"),
                                [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"),
                                 ("l_discount", "l_tax")])


@register("row_ols_part")
def q_ols_part(spark, sf_dir):
    return regression.ols(read_table(spark, sf_dir, "part"), "p_retailprice", ["p_partkey"], "price ~ key")


@register("row_histogram_quantity")
def q_histogram_quantity(spark, sf_dir):
    return charts.histogram(read_table(spark, sf_dir, "lineitem"), "l_quantity", 35)


@register("row_kde_price")
def q_kde_price(spark, sf_dir):
    return charts.kde(read_table(spark, sf_dir, "part"), "p_retailprice")


@register("row_kde_binned_lineitem")
def q_kde_binned_lineitem(spark, sf_dir):
    """Density of the extended prices of all order lines, binned linearly; x1000 for digits that tell."""
    lines = read_table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("price"))
    return charts.kde_binned(lines, "price")


@register("row_box_stats_orders")
def q_box_stats_orders(spark, sf_dir):
    return charts.box_stats(read_table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@register("row_quantiles_lineitem")
def q_quantiles_lineitem(spark, sf_dir):
    """Exact quantiles per return flag; the values of a flag are spread over many tasks."""
    return rounded(windows.exact_quantiles(
        read_table(spark, sf_dir, "lineitem"), "l_extendedprice",
        {"p01": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}, ["l_returnflag"]))


@register("row_auc_length_quality")
def q_auc_length_quality(spark, sf_dir):
    return rounded(windows.auc_by_group(_scored(spark, sf_dir), "label", "score"), 6)


@register("row_roc_length_quality")
def q_roc_length_quality(spark, sf_dir):
    return rounded(windows.roc_curve(_scored(spark, sf_dir), "label", "score"), 6)


@register("row_stratified_folds")
def q_stratified_folds_labels(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return windows.stratified_folds(labels, "quality", ["doc_id"], 5, 42)


@register("row_contiguous_folds")
def q_contiguous_folds_orders(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return (windows.contiguous_folds(orders, ["o_orderkey"], 7).groupBy("fold")
            .agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")))


@register("row_qq_price")
def q_qq_price(spark, sf_dir):
    return charts.qq_points(read_table(spark, sf_dir, "part"), "p_retailprice")


# -- the second model and the other two measures, which the national tables hold too -----------

@register("fit_line_habit")
def q_fit_line_habit(spark, sf_dir):
    return charts.fit_line(datasets(spark, sf_dir)["odh"], SPEC.habit_score, SPEC.outcome_col)


@register("residual_points_habit")
def q_residual_points_habit(spark, sf_dir):
    return charts.residual_points(datasets(spark, sf_dir)["odh"], SPEC.habit_score, SPEC.outcome_col,
                                  SPEC.national_keys)


@register("histogram_driver")
def q_histogram_driver(spark, sf_dir):
    return charts.histogram(nationals(spark, sf_dir)[1], SPEC.driver_col, 35)


@register("box_stats_driver")
def q_box_stats_driver(spark, sf_dir):
    return charts.box_stats(nationals(spark, sf_dir)[1], [SPEC.category, SPEC.stratum], SPEC.driver_col)


@register("box_stats_habit")
def q_box_stats_habit(spark, sf_dir):
    return charts.box_stats(nationals(spark, sf_dir)[2], [SPEC.category, SPEC.stratum], SPEC.habit_score)
