"""Chart-data operators: the table behind each chart, aggregated in Spark.

Drawing is out of scope; every function returns a small DataFrame (bins,
grid points, quantiles, fitted lines) whose size is set by its parameters
(bins, grid size, groups), not by the number of input rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import with_normal_ppf
from ..functions.scalar import round_half_even, lin_space


def histogram(df: DataFrame, value_col: str, bins: int, digits: int = 6) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed; empty bins are 0."""
    x = F.col(value_col)
    vals = df.where(x.isNotNull())
    lo = vals.agg(F.min(value_col)).scalar()
    hi = vals.agg(F.max(value_col)).scalar()
    width = (hi - lo) / bins
    idx = F.least(F.floor(F.try_divide(x - lo, F.nullif(width, F.lit(0.0)))),
                  F.lit(bins - 1)).cast("int")
    counts = (vals.select(F.coalesce(idx, F.lit(0)).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")      # bins x 1 rows: bounded by ``bins``
            .select("bin",
                    round_half_even(lo + F.col("bin") * width, digits).alias("bin_lo"),
                    round_half_even(lo + (F.col("bin") + 1) * width, digits).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def kde(df: DataFrame, value_col: str, gridsize: int = 200, cut: float = 0.0,
        digits: int = 6) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott bandwidth (std * n^-1/5).

    Every row adds its kernel value to every grid point: the grid is exploded
    inside the scan's generated loop and summed map-side, so only ``gridsize``
    partial sums per task are shuffled, whatever the number of rows or points.
    """
    vals = df.where(F.col(value_col).isNotNull())
    # n / std / min / max: one bounded row, fetched once and used as literals
    # in all grid sums (a scalar subquery per grid column would re-plan the
    # input lineage ``gridsize`` times).
    s = vals.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(value_col).alias("sd"),
                 F.min(value_col).alias("lo"), F.max(value_col).alias("hi")).first()
    n = s["n"]
    if not n or s["sd"] is None:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    bw = F.lit(s["sd"]) * F.pow(F.lit(float(n)), F.lit(-0.2))
    lo = F.lit(s["lo"]) - F.lit(cut) * bw
    hi = F.lit(s["hi"]) + F.lit(cut) * bw
    step = (hi - lo) / (gridsize - 1)
    x = F.col(value_col)
    long = (vals.select(x.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("point"))
            .groupBy("point")
            .agg(F.sum(F.exp(-0.5 * F.pow((lo + F.col("point") * step - F.col("v")) / bw, 2))).alias("ksum")))
    norm = F.lit(float(n)) * bw * math.sqrt(2 * math.pi)
    return long.select(F.col("point").cast("int").alias("point"),
                       round_half_even(lo + F.col("point") * step, digits).alias("x"),
                       round_half_even(F.col("ksum") / norm, digits).alias("density"))


def kde_binned(df: DataFrame, value_col: str, gridsize: int = 200, cut: float = 0.0,
               cells_per_bandwidth: int = 32, digits: int = 6) -> DataFrame:
    """``kde`` over linearly binned values: no row is multiplied by the grid.

    Cells are ``bandwidth / cells_per_bandwidth`` wide; a value shares its weight between the two
    ends of its cell in proportion to its place, so a cell is one count and one sum, taken
    map-side.  Only the cells that hold values meet the grid.  Linear interpolation of the kernel
    is off by at most (cell width)^2 / 8 times its second derivative, so a density differs from
    the exact one by at most ``1 / (8 cells_per_bandwidth^2)`` of a kernel's peak
    ``1 / (bandwidth sqrt(2 pi))``: 1.2e-4 of it at 32.

    Null values are left out, as in ``kde``; with fewer than two values, or no spread, no rows.
    """
    x = F.col(value_col).cast("double")
    vals = df.where(F.col(value_col).isNotNull()).select(x.alias("v"))
    s = vals.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"),
                 F.min("v").alias("lo"), F.max("v").alias("hi")).first()      # one row
    if not s["n"] or not s["sd"]:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    bw = s["sd"] * math.pow(float(s["n"]), -0.2)
    width = bw / cells_per_bandwidth
    place = (F.col("v") - F.lit(s["lo"])) / F.lit(width)
    cells = (vals.select(F.floor(place).alias("cell"), place.alias("place"))
             .groupBy("cell").agg(F.count(F.lit(1)).alias("n"),
                                  F.sum(F.col("place") - F.col("cell")).alias("right")))
    lo = s["lo"] - cut * bw
    step = (s["hi"] + cut * bw - lo) / (gridsize - 1)
    at = F.lit(lo) + F.col("point") * F.lit(step)
    left = F.lit(s["lo"]) + F.col("cell") * F.lit(width)

    def kernel(node: Column) -> Column:
        return F.exp(-0.5 * F.pow((at - node) / F.lit(bw), 2))

    ksum = (cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("point"))
            .groupBy("point")
            .agg(F.sum((F.col("n") - F.col("right")) * kernel(left)
                       + F.col("right") * kernel(left + F.lit(width))).alias("ksum")))
    norm = float(s["n"]) * bw * math.sqrt(2 * math.pi)
    return ksum.select(F.col("point").cast("int").alias("point"), round_half_even(at, digits).alias("x"),
                       round_half_even(F.col("ksum") / F.lit(norm), digits).alias("density"))


def _quartiles(vals: DataFrame, value_col: str, keys: list, names: dict, exact: bool) -> DataFrame:
    """Quantiles per group: exact ones spread over tasks, or ``percentile_approx``."""
    if exact:
        from ..operators.windows import exact_quantiles
        return exact_quantiles(vals, value_col, names, keys)
    return vals.groupBy(*keys).agg(*[F.percentile_approx(value_col, q, 10000).alias(n)
                                     for n, q in names.items()])


def box_stats(df: DataFrame, group_cols, value_col: str, *, whisker: float = 1.5,
              exact: bool = True, digits: int = 4) -> DataFrame:
    """Per group: Q1, median, Q3, whiskers (extreme points within whisker*IQR), outlier count."""
    keys = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    vals = df.where(F.col(value_col).isNotNull()).na.drop(subset=keys)
    q = _quartiles(vals, value_col, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75}, exact)
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
         .withColumn("fence_lo", F.col("q1") - whisker * F.col("iqr"))
         .withColumn("fence_hi", F.col("q3") + whisker * F.col("iqr")))
    # one row per group joins back (AQE broadcasts it when the group domain is small)
    x = F.col(value_col)
    inside = (x >= F.col("fence_lo")) & (x <= F.col("fence_hi"))
    out = (vals.join(q, keys).groupBy(*keys, "q1", "median", "q3")
           .agg(F.min(F.when(inside, x)).alias("whisker_lo"),
                F.max(F.when(inside, x)).alias("whisker_hi"),
                F.count_if(~inside).alias("n_outliers"),
                F.count(F.lit(1)).alias("n")))
    return out.select(*keys, *[round_half_even(F.col(c), digits).alias(c) for c in
                               ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                      "n_outliers", "n")


def trend_series(yearly: DataFrame, year_col: str, value_col: str, digits: int = 4) -> DataFrame:
    """Series plus its least-squares trend line evaluated at each year."""
    slope = yearly.agg(F.regr_slope(value_col, year_col)).scalar()
    icpt = yearly.agg(F.regr_intercept(value_col, year_col)).scalar()
    return yearly.select(year_col, round_half_even(F.col(value_col), digits).alias(value_col),
                         round_half_even(icpt + slope * F.col(year_col), digits).alias("trend"),
                         round_half_even(slope, digits).alias("slope"))


def fit_line(df: DataFrame, x: str, y: str, points: int = 100, digits: int = 4) -> DataFrame:
    """``points`` evenly spaced x from min to max with the fitted OLS y and R^2."""
    stats = df.na.drop(subset=[x, y]).agg(
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.regr_slope(y, x).alias("b1"),
        F.regr_intercept(y, x).alias("b0"), F.regr_r2(y, x).alias("r2"))
    line = stats.select(F.posexplode(lin_space(F.col("lo"), F.col("hi"), points)).alias("point", "x"),
                        "b0", "b1", "r2")
    return line.select("point", round_half_even(F.col("x"), digits).alias("x"),
                       round_half_even(F.col("b0") + F.col("b1") * F.col("x"), digits).alias("y_hat"),
                       round_half_even(F.col("b1"), digits).alias("slope"),
                       round_half_even(F.col("r2"), digits).alias("r2"))


def residual_points(df: DataFrame, x: str, y: str, keys: list, digits: int | None = 4) -> DataFrame:
    """Fitted value and residual of a one-feature OLS for every row (``digits`` None: not rounded)."""
    rows = df.na.drop(subset=[x, y])
    b1 = rows.agg(F.regr_slope(y, x)).scalar()
    b0 = rows.agg(F.regr_intercept(y, x)).scalar()
    fitted = b0 + b1 * F.col(x)
    shown = (lambda c: c) if digits is None else (lambda c: round_half_even(c, digits))
    return rows.select(*keys, shown(fitted).alias("fitted"), shown(F.col(y) - fitted).alias("residual"))


#: ranks that one row unfolds to in one step of ``unfold_ranks``
RANK_CHUNK = 1 << 16


def unfold_ranks(ranked: DataFrame, last_col: str, count_col: str, chunk: int = RANK_CHUNK) -> DataFrame:
    """One row per rank ``i`` (long) in (last - count, last] of every row.

    The interval is cut into chunks, the chunks are dealt over tasks, and each is
    unfolded where it lands: a value that a third of all rows share is spread like
    any other, and no array is longer than ``chunk`` (or than the number of chunks).
    """
    first = F.col(last_col) - F.col(count_col) + 1
    parts = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = (ranked.withColumn("_start", F.explode(F.sequence(first, F.col(last_col), F.lit(chunk).cast("long"))))
           .repartition(parts, F.col("_start")))     # a set number: not coalesced while the rows are still few
    end = F.least(F.col("_start") + F.lit(chunk - 1), F.col(last_col))
    return cut.withColumn("i", F.explode(F.sequence(F.col("_start"), end))).drop("_start")


def qq_points(df: DataFrame, value_col: str, digits: int = 4) -> DataFrame:
    """Normal Q-Q points: theoretical quantile at i/(n+1) vs the i-th smallest value,
    with the standardised reference line mean + std * theoretical.

    Values are counted first and the rank of a distinct value is a bucketed prefix
    count (no single-task global window, and a value that many rows share is one
    row there); the ranks of its copies are unfolded afterwards in chunks dealt over
    tasks.  n, mean and the population std are one aggregate.
    """
    from ..operators.windows import prefix_sums
    vals = df.where(F.col(value_col).isNotNull()).select(F.col(value_col).alias("v"))
    st = vals.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mu"),
                  F.stddev_pop("v").alias("sd"))
    n, mu, sd = (st.select(c).scalar() for c in ("n", "mu", "sd"))
    counted = vals.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    ranked = prefix_sums(counted, "v", ["c"], prefix="_to_", inclusive=True)
    ranked = unfold_ranks(ranked.select("v", "c", "_to_c"), "_to_c", "c").withColumn("_pp", F.col("i") / (n + 1))
    ranked = with_normal_ppf(ranked, "_pp", "theo")
    theo = F.col("theo")
    return ranked.select("i",
                         round_half_even(theo, digits).alias("theoretical"),
                         round_half_even(F.col("v"), digits).alias("sample"),
                         round_half_even(mu + sd * theo, digits).alias("line"))


def box_outliers(df: DataFrame, group_cols, value_col: str, *, whisker: float = 1.5,
                 exact: bool = True, digits: int = 4) -> DataFrame:
    """The rows drawn as outlier points: values outside [Q1 - w IQR, Q3 + w IQR]
    of their group (group quartiles joined back, one row per group)."""
    keys = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    vals = df.where(F.col(value_col).isNotNull()).na.drop(subset=keys)
    q = _quartiles(vals, value_col, keys, {"_q1": 0.25, "_q3": 0.75}, exact)
    x = F.col(value_col)
    lo = F.col("_q1") - whisker * (F.col("_q3") - F.col("_q1"))
    hi = F.col("_q3") + whisker * (F.col("_q3") - F.col("_q1"))
    return (vals.join(q, keys).where((x < lo) | (x > hi))
            .select(*[c for c in df.columns if c != value_col],
                    round_half_even(x, digits).alias(value_col)))
