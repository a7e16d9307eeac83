"""Nothing is lost or switched silently: nulls, NaN, ties, sizes, scans and scratch paths."""

import math
import os

import pytest
from pyspark.sql import functions as F

from data_dirs import SF_SMALL

from prevalens.config import FIXTURE_SURVEY as SPEC
from prevalens.functions.distributions import t_two_sided_p
from prevalens.operators import aggregates as agg
from prevalens.operators import windows
from prevalens.operators.aggregates import weighted_mean
from prevalens.plans import charts, clean
from prevalens.plans.regression import f_upper_p
from prevalens.session import scratch_path
from prevalens.sources.fixture import survey_view
from prevalens.sources.survey_csv import read_survey_csv, write_survey_csv
from prevalens.sources.tables import nan_as_null


def test_prefix_sums_keep_null_order_and_groups(spark):
    df = spark.createDataFrame([(1.0, "a", 1), (None, "a", 2), (3.0, None, 4), (None, None, 8)],
                               "x double, g string, v int")
    rows = {(r["x"], r["g"]): r["cum_v"] for r in windows.prefix_sums(df, "x", ["v"], group_cols=["g"]).collect()}
    assert rows == {(None, "a"): 2, (1.0, "a"): 3, (None, None): 8, (3.0, None): 12}
    down = {r["x"]: r["cum_v"] for r in windows.prefix_sums(
        df.where("g = 'a'"), "x", ["v"], descending=True).collect()}
    assert down == {1.0: 1, None: 3}


def test_prefix_sums_do_not_depend_on_buckets(spark):
    df = spark.range(500).select((F.col("id") * 7 % 331).cast("double").alias("x"), F.lit(1).alias("v"))
    df = df.groupBy("x").agg(F.sum("v").alias("v"))
    a, b, c = (sorted(map(tuple, windows.prefix_sums(df, "x", ["v"], buckets=n).collect())) for n in (2, 64, 400))
    assert a == b == c


def test_stratified_folds_keep_null_labels(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(60)], "k int, y int")
    out = windows.stratified_folds(df, "y", ["k"], 5)
    assert out.count() == 60 and out.where("fold is null").count() == 0
    assert {r["n"] for r in out.where("y is null").groupBy("fold").agg(F.count("*").alias("n")).collect()} == {4}


def test_exact_quantiles_of_a_hot_group(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 37 % 101).cast("double").alias("x"))
    df = df.unionByName(spark.createDataFrame([("hot", None), ("hot", float("nan")), (None, 5.0)], "g string, x double"))
    qs = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}
    got = {r["g"]: [r[n] for n in qs] for r in windows.exact_quantiles(df, "x", qs, ["g"]).collect()}
    clean_rows = df.where("x is not null and not isnan(x)")
    want = {r["g"]: r["p"] for r in clean_rows.groupBy("g").agg(
        F.percentile("x", list(qs.values())).alias("p")).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-9)


def tail_area(t, n, steps=200_000):
    """Twice the area of the t density beyond t, by Simpson's rule in u = 1 / x."""
    front = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)

    def f(u):
        return 0.0 if u == 0 else front * math.exp(-(n + 1) / 2 * math.log1p(1 / (u * u * n))) / (u * u)

    h = 1 / t / steps
    inner = sum((4 if i % 2 else 2) * f(i * h) for i in range(1, steps))
    return 2 * h / 3 * (f(0) + inner + f(1 / t))


def test_t_tail_is_one_formula(spark):
    """Published and exact values; no jump where a formula used to change."""
    cases = [(2.228138852, 10, 0.05), (12.706204736, 1, 0.05), (1.0, 1, 0.5), (0.0, 7, 1.0),
             (3.0, 2, 0.09546596626670912), (1.959963985, 10**7, 0.05)]
    # and the tail area of the density, integrated numerically
    cases += [(t, n, tail_area(t, n)) for t, n in ((6.0, 300), (1.2, 33), (2.5, 30_000), (9.0, 50))]
    got = spark.createDataFrame([(t, n) for t, n, _ in cases], "t double, n long").select(
        t_two_sided_p(F.col("t"), F.col("n")).alias("p")).collect()
    for (t, n, p), r in zip(cases, got):
        assert r["p"] == pytest.approx(p, rel=1e-6), (t, n)
    near = [r["p"] for r in spark.createDataFrame([(9.0, n) for n in (19_999, 20_000, 20_001)], "t double, n long")
            .select(t_two_sided_p(F.col("t"), F.col("n")).alias("p")).collect()]
    assert max(near) / min(near) - 1 < 1e-2 and near[0] == pytest.approx(2.4e-19, rel=0.1)
    deep = spark.range(1).select(t_two_sided_p(F.lit(12.0), F.lit(300))).first()[0]
    assert 0 < deep < 1e-25


def test_f_test_matches_squared_t(spark):
    for t, n in ((0.3, 5), (2.0, 12), (5.0, 40)):
        p = spark.range(1).select(t_two_sided_p(F.lit(t), F.lit(n))).first()[0]
        assert f_upper_p(t * t, 1, n) == pytest.approx(p, rel=1e-9)
    assert f_upper_p(4.2565, 2, 9) == pytest.approx(0.05, abs=1e-4)


def test_weighted_mean_skips_nan(spark):
    df = spark.createDataFrame([(10.0, 1.0), (float("nan"), 9.0), (20.0, None), (30.0, float("nan"))], "v double, w double")
    assert df.agg(weighted_mean("v", "w")).first()[0] == 10.0
    assert nan_as_null(df).where("v is null or w is null").count() == 3


def test_view_counts_rows_with_a_null_quantity(spark, tmp_path):
    for t in ("orders", "customer", "nation"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    lines.withColumn("l_quantity", F.when(F.col("l_orderkey") % 3 > 0, F.col("l_quantity"))).write.parquet(
        str(tmp_path / "lineitem.parquet"))
    full, holed = (survey_view(spark, d).agg(F.count("*"), F.sum("Sample_Size")).first()
                   for d in (SF_SMALL, str(tmp_path)))
    assert tuple(full) == tuple(holed)


def test_clean_job_scans_its_input_once(spark, tmp_path):
    view = survey_view(spark, SF_SMALL)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = view.mapInArrow(count, view.schema)
    clean.clean_job(counted, SPEC, str(tmp_path / "out"), min_sample=2.0)
    assert seen.value == view.count()


def test_one_csv_file_is_read_by_several_tasks(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 30).alias("YearStart"), F.lit("x").alias("Class"),
                                      F.col("id").cast("double").alias("Data_Value"))
    path = write_survey_csv(rows.coalesce(1), str(tmp_path / "csv"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        back = read_survey_csv(spark, path, rows.columns)
        assert back.select(F.spark_partition_id()).distinct().count() > 1 and back.count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_scratch_paths_never_meet(spark):
    a, b = scratch_path(spark, "t"), scratch_path(spark, "t")
    assert a != b and os.path.dirname(a) == os.path.dirname(b)


def test_qq_points_with_a_hot_value(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    out = charts.qq_points(df, "v").orderBy("i").collect()
    assert [r["i"] for r in out] == list(range(1, 901))
    assert [r["sample"] for r in out] == sorted(r["v"] for r in df.collect())
    assert all(math.isfinite(r["line"]) for r in out)


def test_ranks_of_a_hot_value_unfold_in_chunks(spark):
    ranked = spark.createDataFrame([("a", 1, 1), ("b", 1000, 1001), ("c", 3, 1004)], "v string, c long, to long")
    out = charts.unfold_ranks(ranked, "to", "c", chunk=64)
    rows = sorted((r["i"], r["v"]) for r in out.collect())
    assert [i for i, _ in rows] == list(range(1, 1005))
    assert [v for _, v in rows] == ["a"] + ["b"] * 1000 + ["c"] * 3
    assert dict(out.dtypes)["i"] == "bigint"
    # the hot value's chunks do not end in one task
    per_task = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in per_task) < 900


def test_summaries_keep_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (2.0, None, "a"), (4.0, None, None)], "x double, y double, g string")
    rows = {r["Indicator"]: r for r in agg.indicator_summary([("x", df, "x"), ("y", df, "y")]).collect()}
    assert rows["x"]["N"] == 3 and rows["x"]["Median"] == 2.0 and rows["x"]["Q3"] == 3.0
    assert rows["y"]["N"] == 0 and rows["y"]["Median"] is None
    told = {r["statistic"]: r for r in agg.describe(df, ["x", "y"]).collect()}
    assert told["count"]["y"] == 0 and told["50%"]["y"] is None and told["25%"]["x"] == 1.5
    order = agg.group_median_order(df, "g", "y").collect()
    assert [(r["g"], r["median"], r["rank"]) for r in order] == [("a", None, 1)]
    one = agg.global_moments(df, "x", category_col="g", total_value="no such").first()
    assert one["all_median"] == 2.0 and one["total_median"] is None


def test_no_summary_holds_a_group_in_one_state(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("g"))
    for out in (agg.column_summary(df, "x", "x"), agg.describe(df, ["x"]), agg.group_median_order(df, "g", "x"),
                agg.global_moments(df, "x", category_col="g", total_value="0")):
        plan = out._jdf.queryExecution().toString().lower()
        assert "percentile(" not in plan and "median(" not in plan
