"""Ordering operators: fixed domain orders, ranks, top-1 selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import exact_quantiles


def order_table(spark, order: dict, category_col: str, stratum_col: str) -> DataFrame:
    """(category, stratum, rank) rows for categories with a fixed order."""
    rows = [(cat, s, i) for cat, strata in order.items() if strata for i, s in enumerate(strata)]
    return spark.createDataFrame(rows, f"`{category_col}` string, `{stratum_col}` string, rank int")


def ordered_categories(df: DataFrame, source: DataFrame, category_col: str, stratum_col: str,
                       value_col: str, order: dict) -> DataFrame:
    """Attach a display rank per (category, stratum).

    Categories with a fixed order keep only the listed strata (others vanish,
    as in the reference charts); categories mapped to ``None`` are ranked by
    their median ``value_col`` descending; categories not in ``order`` are
    left out.  The order table is tiny (the configured domain); the medians
    are exact and spread over tasks, so a hot stratum is not gathered.
    """
    spark = df.sparkSession
    fixed = order_table(spark, order, category_col, stratum_col)
    by_median = [c for c, v in order.items() if v is None]
    ranked = fixed
    if by_median:
        rows = source.where(F.col(category_col).isin(by_median))
        found = exact_quantiles(rows, value_col, {"_med": 0.5}, [category_col, stratum_col])
        # strata without values keep their place at the end
        med = rows.select(category_col, stratum_col).distinct().join(found, [category_col, stratum_col], "left")
        # one row per stratum: the window partition is one category's strata
        w = Window.partitionBy(category_col).orderBy(F.desc("_med"), F.col(stratum_col))
        ranked = ranked.unionByName(
            med.select(category_col, stratum_col,
                       (F.row_number().over(w) - 1).cast("int").alias("rank")))
    return df.join(ranked, [category_col, stratum_col], "inner")


def best_by(df: DataFrame, score_col: str, tie_col: str, higher: bool = True) -> DataFrame:
    """Top row by score (first ``tie_col`` wins ties): an ordered limit(1) (top-k plan)."""
    order = F.desc(score_col) if higher else F.asc(score_col)
    return df.orderBy(order, F.asc(tie_col)).limit(1)
