"""Report tables behind the dashboard (computed here, static text in the reference)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import percent_text, plus_minus_text, round_half_even


def classifier_display(results: DataFrame) -> DataFrame:
    """Select, rename, and format the CV columns of a classifier results table."""
    return results.select(
        "Classifier",
        percent_text("CV_Accuracy").alias("CV Accuracy"),
        plus_minus_text("CV_Acc_Std").alias("CV Acc Std"),
        round_half_even("CV_F1", 3).alias("CV F1"),
        round_half_even("CV_AUC", 3).alias("CV AUC"))


def profile_display(labels: DataFrame, spec) -> DataFrame:
    """Cluster profiles with their canonical names and '%' column headers."""
    return labels.select(F.col("label").alias("Cluster"),
                         *[F.col(c).alias(f"{c} %") for c in
                           (spec.outcome_col, spec.driver_col, spec.habit_score)])


def years_text(year_col: str):
    """'a–b' when the years are contiguous, else a comma list (sorted)."""
    ys = F.array_sort(F.collect_set(F.col(year_col)))
    contiguous = (F.array_max(ys) - F.array_min(ys) + 1) == F.size(ys)
    return F.when(contiguous, F.concat_ws("–", F.array_min(ys).cast("string"),
                                          F.array_max(ys).cast("string"))
                  ).otherwise(F.array_join(F.transform(ys, lambda y: y.cast("string")), ", "))


def dataset_catalog(tables: list, year_col: str) -> DataFrame:
    """Rows, year coverage and variables of each (name, frame, variables) entry."""
    parts = [df.agg(F.lit(name).alias("Dataset"), F.count(F.lit(1)).alias("Rows"),
                    years_text(year_col).alias("Years"),
                    F.lit(", ".join(variables)).alias("Variables"))
             for name, df, variables in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def results_overview(spark, ols_tables: list, ridge, class_results: list, sweep_best,
                     n_clustered: int | None = None) -> DataFrame:
    """Model, n, headline result and finding for every fitted model (union of fits)."""
    rows = []
    for tab in ols_tables:
        r = tab.where(F.col("term") != "Intercept").first()
        rows.append((f"OLS: {r['model']}", int(r["n"]), f"R²={r['r2']:.3f}",
                     f"β={r['coef']:.3f}, p={r['p_value']:.6f}"))
    rows.append(("Ridge (combined)", ridge.n, f"R²={ridge.r2:.3f}, CV R²={ridge.cv_r2_mean:.3f}",
                 f"alpha={ridge.alpha:.3f}"))
    for tag, res, n in class_results:
        best = res.orderBy(F.desc("CV_Accuracy"), "Classifier").first()
        rows.append((f"Classification ({tag}) — Best CV", n,
                     f"{best['Classifier']} {best['CV_Accuracy'] * 100:.1f}% CV accuracy", ""))
    if sweep_best is not None:
        rows.append(("K-Means Clustering", n_clustered,
                     f"k={sweep_best['k']}, silhouette={sweep_best['silhouette']:.2f}", ""))
    return spark.createDataFrame(rows, "Model string, n long, Result string, Finding string")


def headline_kpis(change: DataFrame, model_r2: DataFrame, class_results: DataFrame, sweep_best) -> DataFrame:
    """First/last value and change, best R^2, best CV accuracy with its classifier and
    dataset (``class_results`` of all datasets, tagged), chosen k and its silhouette."""
    best_r2 = model_r2.agg(F.max("r2").alias("best_r2"), F.max_by("model", "r2").alias("best_r2_model"))
    best_acc = class_results.agg(F.max("CV_Accuracy").alias("best_cv_accuracy"),
                                 F.max_by("Classifier", "CV_Accuracy").alias("best_classifier"),
                                 F.max_by("dataset", "CV_Accuracy").alias("best_dataset"))
    first = change.first()
    extra = best_r2.first().asDict() | best_acc.first().asDict()
    row = first.asDict() | extra | {"k": sweep_best["k"], "silhouette": sweep_best["silhouette"]}
    return change.sparkSession.createDataFrame([row])
