"""Window-shaped operators: fold assignment, group-mean imputation, ROC sweep.

Two kinds of folds:

* ``hash_folds`` - a pure row expression of the key (md5 of seed|key), so
  it runs at any scale with no shuffle and identical results in DuckDB.
* ``contiguous_folds`` / ``stratified_folds`` - exact sizes (KFold-style /
  balanced per label) need a rank.  Both compute it distributed: a range-
  partitioned rank with per-partition offsets, and a bucketed prefix count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def key_hash(key_cols: list, seed: int = 42) -> Column:
    """First 28 bits of md5('<seed>|k1|k2...') as a non-negative bigint."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("bigint")


def hash_folds(df: DataFrame, key_cols: list, k: int = 5, seed: int = 42,
               fold_col: str = "fold") -> DataFrame:
    """Deterministic shuffled folds: hash(seed|key) mod k (no shuffle, any scale)."""
    return df.withColumn(fold_col, (key_hash(key_cols, seed) % k).cast("int"))


def global_rank(df: DataFrame, order_cols: list, rank_col: str = "_rank",
                partitions: int | None = None) -> DataFrame:
    """0-based position of every row in ``order_cols`` order, computed without
    a single-task window.

    Rows are range-partitioned and sorted within partitions; a monotonically
    increasing id then carries the partition index (high bits) and the row's
    position inside its partition (low 33 bits).  The ranged table is
    checkpointed so both passes below see the same placement.  Per-partition
    counts (one row per partition) give each partition its offset.  Rows with
    equal order keys share a range partition, so the keys should be unique
    (true for the table keys this is used with).
    """
    from ..session import materialize
    spark = df.sparkSession
    n_parts = partitions or max(spark.sparkContext.defaultParallelism, 1)
    ranged = materialize(df.repartitionByRange(n_parts, *order_cols)
                         .sortWithinPartitions(*order_cols)
                         .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = (ranged.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
              .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    return (ranged.join(offsets, "_pid")
            .withColumn(rank_col, F.col("_off") + F.col("_local"))
            .drop("_mid", "_pid", "_local", "_off"))


def contiguous_folds(df: DataFrame, order_cols: list, k: int = 5,
                     fold_col: str = "fold") -> DataFrame:
    """Unshuffled K-fold in key order: the first n % k folds get one extra row."""
    ranked = global_rank(df, order_cols, "_i")
    n = df.agg(F.count(F.lit(1))).scalar()
    q = F.floor(n / k)
    r = n % k
    big = r * (q + 1)
    fold = F.when(F.col("_i") < big, F.floor(F.col("_i") / (q + 1))).otherwise(
        r + F.floor((F.col("_i") - big) / q))
    return ranked.withColumn(fold_col, fold.cast("int")).drop("_i")


def stratified_folds(df: DataFrame, label_col: str, key_cols: list, k: int = 5,
                     seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """Balanced folds per label: rank the rows of each label by hash(seed|key)
    (keys break ties) and deal the ranks round-robin, fold = (rank - 1) mod k.

    The rank is a bucketed prefix count, so a label holding most of the rows
    is spread over many tasks instead of one window partition per label.
    Rows with a null label are dealt among themselves and stay.
    """
    tagged = df.withColumn("_h", key_hash(key_cols, seed)).withColumn("_one", F.lit(1))
    ranked = prefix_sums(tagged, "_h", ["_one"], group_cols=[label_col], tie_cols=key_cols,
                         prefix="_rank")
    return (ranked.withColumn(fold_col, ((F.col("_rank_one") - 1) % k).cast("int"))
            .drop("_h", "_one", "_rank_one"))


def impute_group_mean(df: DataFrame, value_col: str, group_cols: list, *,
                      fallback: Column | None = None, flag_col: str | None = None,
                      required: list | None = None) -> DataFrame:
    """Fill NULLs from the group mean over the same rows, then ``fallback``;
    flag imputed rows; drop rows still missing any ``required`` column.

    The group means are a partial+final aggregate joined back on the group
    keys (one row per group: AQE broadcasts it when small), so a group that
    holds a third of the rows is never gathered into one task.
    """
    v = F.col(value_col)
    out = df
    if flag_col:
        out = out.withColumn(flag_col, v.isNull())
    means = df.groupBy(*group_cols).agg(F.avg(value_col).alias("_group_mean"))
    out = out.join(means, group_cols, "left")
    filled = F.coalesce(v, F.col("_group_mean"))
    if fallback is not None:
        filled = F.coalesce(filled, fallback)
    out = out.withColumn(value_col, filled).drop("_group_mean")
    return out.na.drop(subset=required or [value_col])


def prefix_sums(df: DataFrame, order_col: str, sum_cols: list, *, group_cols: list | None = None,
                descending: bool = False, inclusive: bool = True, buckets: int | None = None,
                prefix: str = "cum_", tie_cols: list | None = None) -> DataFrame:
    """Running sums of ``sum_cols`` in ``order_col`` order (per ``group_cols``),
    without a single-task global window.

    Rows are bucketed by approximate quantiles of ``order_col`` (a
    ``buckets``-long array from one small aggregate; equal values share a
    bucket), bucket totals give each bucket its starting offset (a table of
    groups x buckets rows), and the running sum inside each bucket is a window
    partitioned by (group, bucket), so the work spreads over ``buckets`` tasks
    per group.  Callers pass one row per distinct order value (e.g. per score),
    so a heavily repeated value is a single row here.

    ``buckets`` only sets how far the work spreads (default: twice the shuffle
    partitions, at least 256); results do not depend on it.  Rows with a null
    order value come first (last when descending), a null group is a group.
    """
    groups = list(group_cols or [])
    if buckets is None:
        buckets = max(256, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    qs = [i / buckets for i in range(1, buckets)]
    # ``buckets - 1`` numbers, fetched once and inlined as literals: the bucket
    # is the count of bounds below x, a flat sum of comparisons in codegen.
    row = df.agg(F.percentile_approx(order_col, qs, 10 * buckets).alias("b")).first()
    x = F.col(order_col)
    bounds = sorted(set(float(v) for v in row["b"] or []))
    if len(bounds) <= 256:
        b = F.lit(0)
        for v in bounds:
            b = b + (x > F.lit(v)).cast("int")
    else:              # too many comparisons for one generated method
        b = F.size(F.filter(F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>"),
                            lambda v: v < x))
    if descending:
        b = F.lit(buckets) - b
    b = F.when(x.isNull(), F.lit(buckets + 1 if descending else -1)).otherwise(b)
    tagged = df.withColumn("_bucket", b)
    totals = tagged.groupBy(*groups, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_bucket", *[
        F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    order = F.desc_nulls_last(order_col) if descending else F.asc_nulls_first(order_col)
    within = Window.partitionBy(*groups, "_bucket").orderBy(order, *(tie_cols or [])).rowsBetween(
        Window.unboundedPreceding, 0)
    # null-safe: a null group keeps its rows
    keyed = offsets.select(*[F.col(c).alias(f"_g_{i}") for i, c in enumerate([*groups, "_bucket"])],
                           *[f"_o_{c}" for c in sum_cols])
    match = F.lit(True)
    for i, c in enumerate([*groups, "_bucket"]):
        match = match & F.col(c).eqNullSafe(F.col(f"_g_{i}"))
    out = tagged.join(keyed, match).drop(*[f"_g_{i}" for i in range(len(groups) + 1)])
    for c in sum_cols:
        run = F.col(f"_o_{c}") + F.sum(c).over(within)
        out = out.withColumn(f"{prefix}{c}", run if inclusive else run - F.col(c))
    return out.drop("_bucket", *[f"_o_{c}" for c in sum_cols])


def exact_quantiles(df: DataFrame, value_col: str, qs: dict, group_cols: list | None = None) -> DataFrame:
    """Exact interpolated quantiles (``qs``: column name -> probability) per group, spread over tasks.

    Distinct values are counted (map-side combined), bucketed prefix sums give the
    rank that each value reaches, and the two neighbours of a quantile's position
    are minima over the values that reach it.  No task ever holds a whole group,
    so a group with a third of the rows is no hot spot.  NULL and NaN are skipped.
    """
    groups = list(group_cols or [])
    v = F.nullif(F.col(value_col).cast("double"), F.lit(float("nan")))
    counted = (df.select(*groups, v.alias("_v")).where(F.col("_v").isNotNull())
               .groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_c")))
    ranked = prefix_sums(counted, "_v", ["_c"], group_cols=groups, prefix="_to")
    total = counted.groupBy(*groups).agg(F.sum("_c").alias("_n"))
    if groups:
        match = F.lit(True)
        keyed = total.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(groups)], "_n")
        for i, c in enumerate(groups):
            match = match & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        ranked = ranked.join(keyed, match)
    else:
        ranked = ranked.withColumn("_n", total.select("_n").scalar())
    at = {name: (F.col("_n") - 1) * F.lit(float(q)) for name, q in qs.items()}
    found = ranked.groupBy(*groups, "_n").agg(*[
        F.min(F.when(F.col("_to_c") > edge(h), F.col("_v"))).alias(f"_{side}_{name}")
        for name, h in at.items() for side, edge in (("lo", F.floor), ("hi", F.ceil))])
    part = {name: h - F.floor(h) for name, h in at.items()}
    return found.select(*groups, *[
        (F.col(f"_lo_{name}") * (1 - part[name]) + F.col(f"_hi_{name}") * part[name]).alias(name) for name in qs])


def roc_curve(scored: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """ROC points: thresholds at each distinct score (descending), cumulative TPR/FPR.

    Rows are first reduced to one row per distinct score (ties grouped, as
    the step function requires); the cumulative counts are bucketed prefix
    sums, and the class totals a scalar subquery.
    """
    per = (scored.groupBy(F.col(score_col).alias("threshold"))
           .agg(F.sum(F.col(label_col).cast("long")).alias("tp"),
                F.sum((1 - F.col(label_col)).cast("long")).alias("fp")))
    tot = per.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"))
    P, N = tot.select("P").scalar(), tot.select("N").scalar()
    cum = prefix_sums(per, "threshold", ["tp", "fp"], descending=True)
    return cum.select("threshold",
                      F.try_divide(F.col("cum_tp").cast("double"), F.nullif(P, F.lit(0))).alias("tpr"),
                      F.try_divide(F.col("cum_fp").cast("double"), F.nullif(N, F.lit(0))).alias("fpr"))


def auc_by_group(scored: DataFrame, label_col: str, score_col: str,
                 group_cols: list | None = None) -> DataFrame:
    """AUC per group, Mann-Whitney form with mid-ranks for ties: positives at a
    score beat every negative at a lower score and tie with those at the same
    score.  One row per (group, distinct score) feeds a bucketed prefix sum."""
    groups = list(group_cols or [])
    y = F.col(label_col)
    per = scored.groupBy(*groups, F.col(score_col).alias("s")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(y == 0, 1).otherwise(0)).alias("neg"))
    below = prefix_sums(per, "s", ["neg"], group_cols=groups, inclusive=False, prefix="below_")
    return below.groupBy(*groups).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("below_neg") + 0.5 * F.col("neg"))),
                     F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def auc_rank(scored: DataFrame, label_col: str, score_col: str) -> Column:
    """AUC of the whole frame as a scalar subquery (see ``auc_by_group``)."""
    return auc_by_group(scored, label_col, score_col).select("auc").scalar()
