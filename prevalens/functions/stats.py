"""Statistics as aggregates: correlation tests, VIF, linear trend, normality.

Every test is one aggregate pass (moments / cross-products), followed by
closed-form column expressions for the statistic and its p-value.  Grouped
versions are the same expressions under ``groupBy`` - no Python per group.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .distributions import normal_sf, pearson_p, with_normal_ppf
from .scalar import round_half_even, significance_stars


def _pair_n(x: str, y: str) -> Column:
    return F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """r and pairwise-complete n."""
    return df.agg(F.corr(x, y).alias("r"), _pair_n(x, y).alias("n"))


def _with_test(df: DataFrame, keep: list, r_digits: int, p_digits: int) -> DataFrame:
    """r, two-sided p, n, stars.  p is computed in its own projection first:
    a later ``r`` alias in the same select would otherwise be picked up by
    lateral column alias resolution and feed the rounded r into p."""
    with_p = df.withColumn("_p", pearson_p(F.col("r"), F.col("n")))
    return with_p.select(*keep, round_half_even(F.col("r"), r_digits).alias("r"),
                         round_half_even(F.col("_p"), p_digits).alias("p_value"),
                         F.col("n"), significance_stars(F.col("_p")).alias("stars"))


def pearson_test(df: DataFrame, x: str, y: str, r_digits: int = 4, p_digits: int = 6) -> DataFrame:
    """One row: r, two-sided p, n, significance stars."""
    return _with_test(pearson(df, x, y), [], r_digits, p_digits)


def grouped_pearson_test(df: DataFrame, group_col: str, x: str, y: str, *, min_n: int = 5,
                         group_name: str = "Category", r_digits: int = 4,
                         p_digits: int = 6) -> DataFrame:
    """Per-group test for groups with at least ``min_n`` rows (HAVING)."""
    per = (df.na.drop(subset=[group_col]).groupBy(F.col(group_col).alias(group_name))
           .agg(F.corr(x, y).alias("r"), _pair_n(x, y).alias("n"),
                F.count(F.lit(1)).alias("_rows"))
           .where(F.col("_rows") >= min_n))
    return _with_test(per, [group_name], r_digits, p_digits)


def pairwise_tests(df: DataFrame, pairs: list, r_digits: int = 4, p_digits: int = 6,
                   names: tuple = ("Var1", "Var2")) -> DataFrame:
    """Tests for named column pairs from one aggregate pass, one row per pair."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs += [F.corr(a, b).alias(f"r{i}"), _pair_n(a, b).alias(f"n{i}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{a}', '{b}', r{i}, n{i}" for i, (a, b) in enumerate(pairs))
    long = wide.selectExpr(f"stack({len(pairs)}, {stack}) AS ({names[0]}, {names[1]}, r, n)")
    return _with_test(long, [names[0], names[1]], r_digits, p_digits)


def corr_matrix(df: DataFrame, cols: list, digits: int = 3) -> DataFrame:
    """Long-form correlation matrix (pairwise complete), diagonal included."""
    pairs = list(combinations(cols, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = [f"'{c}', '{c}', CAST(1.0 AS DOUBLE)" for c in cols]
    for i, (a, b) in enumerate(pairs):
        entries += [f"'{a}', '{b}', c{i}", f"'{b}', '{a}', c{i}"]
    long = wide.selectExpr(f"stack({len(entries)}, {', '.join(entries)}) AS (var1, var2, r)")
    return long.withColumn("r", round_half_even(F.col("r"), digits))


def linear_trend(df: DataFrame, x: str, y: str, digits: int = 6) -> DataFrame:
    """Least-squares line y = intercept + slope * x (degree-1 polyfit) and R^2."""
    return df.agg(round_half_even(F.regr_slope(y, x), digits).alias("slope"),
                  round_half_even(F.regr_intercept(y, x), digits).alias("intercept"),
                  round_half_even(F.regr_r2(y, x), digits).alias("r2"),
                  F.regr_count(y, x).alias("n"))


def gram(df: DataFrame, cols: list, centered: bool = False) -> DataFrame:
    """One-row cross-product sums sum(x_i x_j) (and n, sums when centered)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(cols):
        aggs.append(F.sum(a).alias(f"s_{i}"))
        for j in range(i, len(cols)):
            aggs.append(F.sum(F.col(a) * F.col(cols[j])).alias(f"g_{i}_{j}"))
    return df.na.drop(subset=cols).agg(*aggs)


def vif(df: DataFrame, cols: list, *, centered: bool = False, digits: int = 2) -> DataFrame:
    """Variance inflation factor of each column.

    Uncentred by default: the design has no constant, so R^2 of x_i on the
    others is the uncentred one and VIF_i = (G^-1)_ii * G_ii with G = X'X.
    ``centered=True`` uses the covariance Gram instead.  Two columns are done
    lazily in closed form; more columns solve the p x p Gram on the driver
    (p is the feature count, not the data size).
    """
    g = gram(df, cols)

    def entry(i, j):
        i, j = min(i, j), max(i, j)
        e = F.col(f"g_{i}_{j}")
        if centered:
            e = e - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n")
        return e

    if len(cols) == 2:
        r2 = entry(0, 1) * entry(0, 1) / (entry(0, 0) * entry(1, 1))
        v = F.try_divide(F.lit(1.0), F.nullif(1.0 - r2, F.lit(0.0)))
        stack = ", ".join(f"'{c}', v" for c in cols)
        return (g.select(v.alias("v"))
                .selectExpr(f"stack({len(cols)}, {stack}) AS (Feature, VIF)")
                .withColumn("VIF", round_half_even(F.col("VIF"), digits)))
    import numpy as np
    row = g.select(*[entry(i, j).alias(f"e_{i}_{j}") for i in range(len(cols))
                     for j in range(len(cols))]).first()
    p = len(cols)
    G = np.array([[row[f"e_{i}_{j}"] for j in range(p)] for i in range(p)], dtype=float)
    inv = np.linalg.pinv(G)
    vals = [(c, float(round(inv[i, i] * G[i, i], digits))) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(vals, "Feature string, VIF double")


# -- Shapiro-Wilk ---------------------------------------------------------------

# --- fixed values: Royston (1995, AS R94) coefficients ------------------------
_SW_C1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_SW_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SW_SMALL_GAMMA = (-2.273, 0.459)
_SW_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
_SW_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_SW_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_SW_LARGE_SD = (-0.4803, -0.082676, 0.0030302)
# --- end of fixed values --------------------------------------------------------


def _poly_asc(coefs, x: Column) -> Column:
    out = F.lit(float(coefs[-1]))
    for c in reversed(coefs[:-1]):
        out = out * x + F.lit(float(c))
    return out


def bounded_sample(df: DataFrame, size: int, seed: int, cols: list) -> DataFrame:
    """Deterministic sample of at most ``size`` rows (all rows when fewer):
    the rows with the smallest seeded hash.  A top-k per partition, so memory
    is bounded by ``size``; the cap is the operator's feature (the test is
    defined on a sample of at most ``size`` points)."""
    key = F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])
    return df.withColumn("_h", key).orderBy("_h").limit(size).drop("_h")


def shapiro_wilk(df: DataFrame, value_col: str, label: str, *, sample_size: int = 500,
                 seed: int = 42, digits_w: int = 4, digits_p: int = 6) -> DataFrame:
    """Shapiro-Wilk W and p (Royston's approximation) on <= ``sample_size`` rows.

    Each intermediate (expected normal order statistics, end weights, W, the
    normalising transform) is its own projection so no expression is copied
    into its consumers.
    """
    x = df.where(F.col(value_col).isNotNull()).select(F.col(value_col).alias("x"))
    x = bounded_sample(x, sample_size, seed, ["x"])
    # The windows below see at most ``sample_size`` rows.
    w_all = Window.partitionBy()
    ranked = (x.withColumn("i", F.row_number().over(Window.orderBy("x")))
              .withColumn("n", F.count(F.lit(1)).over(w_all)))
    ranked = ranked.withColumn("_pp", (F.col("i") - 0.375) / (F.col("n") + 0.25))
    ranked = with_normal_ppf(ranked, "_pp", "m")
    ranked = (ranked.withColumn("mm", F.sum(F.col("m") * F.col("m")).over(w_all))
              .withColumn("m_n", F.max(F.when(F.col("i") == F.col("n"), F.col("m"))).over(w_all))
              .withColumn("m_n1", F.max(F.when(F.col("i") == F.col("n") - 1, F.col("m"))).over(w_all)))
    u = 1.0 / F.sqrt(F.col("n").cast("double"))
    ranked = (ranked.withColumn("a_n", F.col("m_n") / F.sqrt(F.col("mm")) + _poly_asc(_SW_C1, u))
              .withColumn("a_n1", F.col("m_n1") / F.sqrt(F.col("mm")) + _poly_asc(_SW_C2, u)))
    i, n = F.col("i"), F.col("n")
    big = n > 5
    a_n, a_n1, m_n, m_n1 = F.col("a_n"), F.col("a_n1"), F.col("m_n"), F.col("m_n1")
    ranked = ranked.withColumn("phi", F.when(
        big, (F.col("mm") - 2 * m_n * m_n - 2 * m_n1 * m_n1) / (1 - 2 * a_n * a_n - 2 * a_n1 * a_n1))
        .otherwise((F.col("mm") - 2 * m_n * m_n) / (1 - 2 * a_n * a_n)))
    coef = (F.when(n == 3, F.when(i == 1, -F.sqrt(F.lit(0.5))).when(i == 3, F.sqrt(F.lit(0.5)))
                   .otherwise(F.lit(0.0)))
            .when(i == n, a_n).when(i == 1, -a_n)
            .when(big & (i == n - 1), a_n1).when(big & (i == 2), -a_n1)
            .otherwise(F.col("m") / F.sqrt(F.col("phi"))))
    st = ranked.withColumn("a", coef).agg(
        F.first("n").alias("n"),
        F.sum(F.col("a") * F.col("x")).alias("ax"),
        F.var_pop("x").alias("vp"))
    st = st.withColumn("W", F.least(F.col("ax") * F.col("ax") / (F.col("vp") * F.col("n")),
                                    F.lit(1.0)))
    nn = F.col("n").cast("double")
    ln_n = F.log(nn)
    w1 = F.log1p(-F.col("W"))
    small_z = ((-F.log(_poly_asc(_SW_SMALL_GAMMA, nn) - w1) - _poly_asc(_SW_SMALL_MEAN, nn))
               / F.exp(_poly_asc(_SW_SMALL_SD, nn)))
    large_z = (w1 - _poly_asc(_SW_LARGE_MEAN, ln_n)) / F.exp(_poly_asc(_SW_LARGE_SD, ln_n))
    st = st.withColumn("z", F.when(F.col("n") <= 11, small_z).otherwise(large_z))
    st = st.withColumn("p_tail", normal_sf(F.col("z")))
    p3 = 6.0 / 3.141592653589793 * (F.asin(F.sqrt(F.col("W"))) - F.asin(F.sqrt(F.lit(0.75))))
    st = st.withColumn("p", F.when(F.col("n") < 3, F.lit(None).cast("double"))
                       .when(F.col("n") == 3, F.greatest(p3, F.lit(0.0)))
                       .otherwise(F.col("p_tail")))
    return st.select(F.lit(label).alias("Indicator"), F.col("n"),
                     round_half_even(F.col("W"), digits_w).alias("W"),
                     round_half_even(F.col("p"), digits_p).alias("p_value"),
                     (F.col("p") > 0.05).alias("normal"))
