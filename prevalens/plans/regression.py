"""Regression job: OLS with inference, ridge with cross-validated alpha.

Both models are fitted from sufficient statistics: one aggregate pass gives
n, sums, cross-products X'X, X'y and y'y (per fold when cross-validating).
That is a partial+final aggregation of p^2 numbers, whatever the row count;
only the (p+1) x (p+1) systems are solved on the driver.  Every fold / alpha
combination of the ridge search reuses the same per-fold statistics, so the
whole search costs a single Spark job.
"""

from __future__ import annotations

import math

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import t_two_sided_p
from ..functions.scalar import round_half_even, significance_stars
from ..operators import windows
from . import charts


# -- sufficient statistics -------------------------------------------------------------

def moments(df: DataFrame, y: str, features: list, group_col: str | None = None) -> DataFrame:
    """n, sum x_j, sum y, sum x_j x_k, sum x_j y, sum y^2 (optionally per group)."""
    rows = df.na.drop(subset=[y, *features])
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"),
            F.sum(F.col(y) * F.col(y)).alias("syy")]
    for i, a in enumerate(features):
        aggs += [F.sum(a).alias(f"sx{i}"), F.sum(F.col(a) * F.col(y)).alias(f"sxy{i}")]
        for j in range(i, len(features)):
            aggs.append(F.sum(F.col(a) * F.col(features[j])).alias(f"sxx{i}_{j}"))
    return (rows.groupBy(group_col) if group_col else rows).agg(*aggs)


@dataclass
class Stats:
    n: float
    sx: np.ndarray        # (p,)
    sy: float
    sxx: np.ndarray       # (p, p)
    sxy: np.ndarray       # (p,)
    syy: float

    @classmethod
    def from_row(cls, row, p: int) -> "Stats":
        sxx = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                sxx[i, j] = sxx[j, i] = row[f"sxx{i}_{j}"]
        return cls(float(row["n"]), np.array([row[f"sx{i}"] for i in range(p)], float),
                   float(row["sy"]), sxx, np.array([row[f"sxy{i}"] for i in range(p)], float),
                   float(row["syy"]))

    def __sub__(self, o: "Stats") -> "Stats":
        return Stats(self.n - o.n, self.sx - o.sx, self.sy - o.sy, self.sxx - o.sxx,
                     self.sxy - o.sxy, self.syy - o.syy)

    def centered(self):
        """(Sxx, Sxy, Syy) about the means."""
        mx = self.sx / self.n
        my = self.sy / self.n
        return (self.sxx - self.n * np.outer(mx, mx), self.sxy - self.n * mx * my,
                self.syy - self.n * my * my, mx, my)


# -- OLS ------------------------------------------------------------------------------

def ols_fit(st: Stats) -> dict:
    """Coefficients with standard errors from centred normal equations."""
    p = len(st.sx)
    cxx, cxy, cyy, mx, my = st.centered()
    inv = np.linalg.pinv(cxx)
    beta = inv @ cxy
    b0 = my - mx @ beta
    ssr = max(cyy - beta @ cxy, 0.0)
    dof = st.n - p - 1
    s2 = ssr / dof if dof > 0 else float("nan")
    se_beta = np.sqrt(np.clip(np.diag(inv) * s2, 0, None))
    se_b0 = float(np.sqrt(max(s2 * (1.0 / st.n + mx @ inv @ mx), 0.0)))
    r2 = 1.0 - ssr / cyy if cyy > 0 else float("nan")
    adj = 1.0 - (1.0 - r2) * (st.n - 1) / dof if dof > 0 else float("nan")
    return {"coef": np.concatenate([[b0], beta]), "se": np.concatenate([[se_b0], se_beta]),
            "r2": r2, "adj_r2": adj, "n": int(st.n), "dof": int(dof), "ssr": ssr, "tss": cyy}


def f_upper_p(f: float, d1: int, d2: int) -> float:
    """P(F > f) of the F distribution: the incomplete beta function by its continued fraction."""
    if not f > 0 or d2 < 1:
        return float("nan")
    a, b, x = d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a if 0 < x < 1 else 0.0
    value = 1.0     # evaluated backwards from a fixed depth
    for m in range(int(60 + 6 * math.sqrt(a + b)), 0, -1):
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1 + odd / (1 + even / value)
    p = front / value
    return 1 - p if flip else p


def ols(df: DataFrame, y: str, features: list, model: str) -> DataFrame:
    """statsmodels-style coefficient table: term, coef, std_err, t, p_value, stars,
    plus n, R^2, adjusted R^2 and the F-test p (one-feature models: the slope p)."""
    row = moments(df, y, features).first()   # one row of p^2 sums
    fit = ols_fit(Stats.from_row(row, len(features)))
    spark = df.sparkSession
    terms = ["Intercept", *features]
    rows = [(model, i, t, float(c), float(s), fit["n"], fit["dof"], float(fit["r2"]),
             float(fit["adj_r2"])) for i, (t, c, s) in enumerate(zip(terms, fit["coef"], fit["se"]))]
    tab = spark.createDataFrame(rows, "model string, idx int, term string, coef double, "
                                      "se double, n long, dof long, r2 double, adj_r2 double")
    tab = tab.withColumn("t", F.try_divide(F.col("coef"), F.nullif(F.col("se"), F.lit(0.0))))
    tab = tab.withColumn("p", t_two_sided_p(F.col("t"), F.col("dof")))
    slope_p = F.max(F.when(F.col("idx") == 1, F.col("p"))).over(Window.partitionBy("model"))
    tab = tab.withColumn("f_p", slope_p if len(features) == 1 else F.lit(f_upper_p(
        (fit["tss"] - fit["ssr"]) / len(features) / (fit["ssr"] / fit["dof"]), len(features), fit["dof"])
        if fit["dof"] > 0 and fit["ssr"] > 0 else None).cast("double"))
    return tab.select("model", "term", round_half_even("coef", 4).alias("coef"),
                      round_half_even("se", 4).alias("std_err"),
                      round_half_even("t", 3).alias("t"),
                      round_half_even("p", 6).alias("p_value"),
                      significance_stars(F.col("p")).alias("stars"), "n",
                      round_half_even("r2", 4).alias("r2"),
                      round_half_even("adj_r2", 4).alias("adj_r2"),
                      round_half_even("f_p", 6).alias("f_pvalue"))


# -- standardisation ---------------------------------------------------------------------

def standardize(df: DataFrame, cols: list, suffix: str = "") -> DataFrame:
    """(x - mean) / population std, fitted on all rows; a constant column divides by 1."""
    st = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = df
    for i, c in enumerate(cols):
        sd = st[f"s{i}"] or 1.0
        out = out.withColumn(c + suffix, (F.col(c) - F.lit(st[f"m{i}"])) / F.lit(sd if sd > 0 else 1.0))
    return out


# -- ridge -----------------------------------------------------------------------------

def _ridge_solve(train: Stats, alpha: float):
    cxx, cxy, _, mx, my = train.centered()
    w = np.linalg.solve(cxx + alpha * np.eye(len(mx)), cxy)
    return my - mx @ w, w


def _fold_r2(test: Stats, b0: float, w: np.ndarray) -> float:
    """R^2 on a fold from its sums: SSE = syy - 2 sum(y yhat) + sum(yhat^2)."""
    s_yhat2 = test.n * b0 * b0 + 2 * b0 * (w @ test.sx) + w @ test.sxx @ w
    s_y_yhat = b0 * test.sy + w @ test.sxy
    sse = test.syy - 2 * s_y_yhat + s_yhat2
    sst = test.syy - test.sy * test.sy / test.n
    return 1.0 - sse / sst if sst > 0 else float("nan")


def fold_stats(df: DataFrame, y: str, features: list, fold_col: str) -> tuple:
    rows = moments(df, y, features, fold_col).collect()   # k rows of p^2 sums
    per = {r[fold_col]: Stats.from_row(r, len(features)) for r in rows}
    total = None
    for s in per.values():
        total = s if total is None else Stats(total.n + s.n, total.sx + s.sx, total.sy + s.sy,
                                              total.sxx + s.sxx, total.sxy + s.sxy,
                                              total.syy + s.syy)
    return per, total


def cv_scores(per: dict, total: Stats, alpha: float) -> list:
    out = []
    for f in sorted(per):
        b0, w = _ridge_solve(total - per[f], alpha)
        out.append(_fold_r2(per[f], b0, w))
    return out


def log_alphas(lo: float = -3, hi: float = 3, num: int = 100) -> list:
    return list(np.logspace(lo, hi, num))


@dataclass
class RidgeResult:
    alpha: float
    coef: np.ndarray
    intercept: float
    r2: float
    rmse: float
    cv_r2_mean: float
    cv_r2_std: float
    alpha_path: list          # (alpha, mean fold R^2) of the search
    n: int


def ridge_cv(df: DataFrame, y: str, features: list, key_cols: list, *, alphas=None,
             k: int = 5, seed: int = 42) -> RidgeResult:
    """Standardise, pick alpha by contiguous k-fold mean R^2 (first best wins),
    refit on all rows, then score with hash-shuffled k-fold R^2 (mean, pop std)."""
    alphas = alphas or log_alphas()
    z = [f"{c}__z" for c in features]
    scaled = standardize(df.na.drop(subset=[y, *features]), features, "__z")
    contiguous = windows.contiguous_folds(scaled, key_cols, k, "fold")
    per, total = fold_stats(contiguous, y, z, "fold")
    path = [(float(a), float(np.mean(cv_scores(per, total, a)))) for a in alphas]
    best_alpha = max(path, key=lambda t: t[1])[0]     # max() keeps the first maximum
    b0, w = _ridge_solve(total, best_alpha)
    r2 = _fold_r2(total, b0, w)
    sse = (1.0 - r2) * (total.syy - total.sy ** 2 / total.n)
    rmse = float(np.sqrt(max(sse, 0.0) / total.n))
    shuffled = windows.hash_folds(scaled, key_cols, k, seed, "fold")
    per_s, total_s = fold_stats(shuffled, y, z, "fold")
    scores = cv_scores(per_s, total_s, best_alpha)
    return RidgeResult(best_alpha, w, b0, r2, rmse, float(np.mean(scores)),
                       float(np.std(scores)), path, int(total.n))


def ridge_table(spark, res: RidgeResult, features: list, model: str) -> DataFrame:
    rows = [(model, f, float(c)) for f, c in zip(features, res.coef)]
    rows.append((model, "Intercept", float(res.intercept)))
    coefs = spark.createDataFrame(rows, "model string, term string, coef double")
    lit = lambda v: round_half_even(F.lit(float(v)), 4)
    return coefs.select("model", "term", round_half_even("coef", 4).alias("coef"),
                        lit(res.alpha).alias("alpha"), lit(res.r2).alias("r2_train"),
                        lit(res.rmse).alias("rmse"), lit(res.cv_r2_mean).alias("cv_r2"),
                        lit(res.cv_r2_std).alias("cv_r2_std"),
                        F.lit(res.n).cast("long").alias("n"))


def model_compare(df: DataFrame, y: str, features: list, ridge_r2: float) -> DataFrame:
    """R^2 of each single-feature OLS on the same rows vs the ridge fit."""
    rows = df.na.drop(subset=[y, *features])
    parts = [rows.agg(F.lit(f"OLS {f} only").alias("model"),
                      round_half_even(F.regr_r2(y, f), 4).alias("r2")) for f in features]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ridge = df.sparkSession.range(1).select(F.lit("Ridge combined").alias("model"),
                                            round_half_even(F.lit(float(ridge_r2)), 4).alias("r2"))
    return out.unionByName(ridge)


def model_summary(ols_tables: list, ridge, ridge_name: str) -> DataFrame:
    """One row per model: rows, R2 and the headline finding as text."""
    slopes = ols_tables[0]
    for t in ols_tables[1:]:
        slopes = slopes.unionByName(t)
    slopes = slopes.where(F.col("term") != "Intercept").select(
        "model", "n", "r2", F.concat(F.lit("b="), F.format_number(F.bround("coef", 3), 3),
                                     F.lit(", p="), F.format_number("p_value", 6)).alias("finding"))
    last = slopes.sparkSession.range(1).select(
        F.lit(ridge_name).alias("model"), F.lit(ridge.n).cast("long").alias("n"),
        F.bround(F.lit(float(ridge.r2)), 4).alias("r2"),
        F.concat(F.lit("CV R2="), F.format_number(F.bround(F.lit(float(ridge.cv_r2_mean)), 4), 4)).alias("finding"))
    return slopes.unionByName(last)


def regression_job(od: DataFrame, odh: DataFrame, spec, key_cols: list) -> dict:
    """The three models and their report tables."""
    o, d, h = spec.outcome_col, spec.driver_col, spec.habit_score
    m1 = ols(od, o, [d], f"{o} ~ {d}")
    m2 = ols(odh, o, [h], f"{o} ~ {h}")
    rid = ridge_cv(odh, o, [d, h], key_cols)
    spark = od.sparkSession
    # fit line, residuals and Q-Q points of both one-feature models
    diagnostics = {}
    for name, rows, x in (("driver", od, d), ("habit", odh, h)):
        diagnostics[f"fit_line_{name}"] = charts.fit_line(rows, x, o)
        diagnostics[f"residuals_{name}"] = charts.residual_points(rows, x, o, key_cols)
        diagnostics[f"qq_{name}"] = charts.qq_points(
            charts.residual_points(rows, x, o, key_cols, digits=None), "residual")
    return {"ols_driver": m1, "ols_habit": m2, **diagnostics,
            "ridge": ridge_table(spark, rid, [d, h], f"Ridge {o} ~ {d} + {h}"),
            "ridge_alpha_path": spark.createDataFrame(rid.alpha_path, "alpha double, cv_r2 double"),
            "model_compare": model_compare(odh, o, [d, h], rid.r2),
            "model_summary": model_summary([m1, m2], rid, f"Ridge {o} ~ {d} + {h}"),
            "ridge_result": rid}
