"""pandas-semantics edge cases (FIXTURES.md section 4) on tiny frames."""

import pytest
from pyspark.sql import functions as F

from prevalens.functions.scalar import round_half_even, row_mean
from prevalens.operators import aggregates as agg
from prevalens.operators import filters as flt
from prevalens.operators import windows
from prevalens.operators.pivot import pivot_mean
from prevalens.plans import classification as clf


def test_pivot_drops_all_null_rows_and_null_keys(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, 10.0), (1, "b", 3.0, 20.0),
         (2, "a", None, 5.0), (2, "b", None, 5.0),      # all pivoted values null -> gone
         (None, "a", 9.0, 5.0),                         # null key -> gone
         (3, "a", 4.0, 7.0)],                           # only 'a' -> b is null, kept
        "k int, q string, v double, s double")
    out = {r["k"]: r for r in pivot_mean(df, ["k"], "q", "v", {"a": "A", "b": "B"},
                                         sample_col="s").collect()}
    assert set(out) == {1, 3}
    assert out[1]["A"] == 1.0 and out[1]["B"] == 3.0 and out[1]["s"] == 15
    assert out[3]["B"] is None


def test_weighted_mean_skips_null_pairs(spark):
    df = spark.createDataFrame([(1, "x", 10.0, 1), (1, "y", None, 9), (2, "x", None, 4)],
                               "k int, loc string, v double, w long")
    out = {r["k"]: r for r in agg.aggregate_national(df, ["k"], ["v"], location_col="loc",
                                                     weight_col="w").collect()}
    assert out[1]["v"] == 10.0 and out[1]["Total_Sample_Size"] == 10 and out[1]["N_States"] == 2
    assert out[2]["v"] is None


def test_row_mean_null_skipping(spark):
    df = spark.createDataFrame([(2.0, None), (3.0, 5.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(row_mean("a", "b")).collect()] == [2.0, 4.0, None]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (0.125,)], "x double")
    r0 = [r[0] for r in df.select(round_half_even("x", 0)).collect()]
    assert r0[:3] == [0.0, 2.0, 2.0]
    assert df.select(round_half_even("x", 2)).collect()[3][0] == 0.12


def test_single_row_std_is_null(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    assert agg.category_spread(df, "g", "v").first()["std"] is None


def test_median_ties_go_low(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    labels = sorted((r["v"], r["y"]) for r in flt.binary_label(df, "v", "y").collect())
    assert labels == [(1.0, 0), (2.0, 0), (2.0, 0), (3.0, 1)]


def test_contiguous_fold_sizes(spark):
    df = spark.range(11).withColumnRenamed("id", "k")
    sizes = sorted((r["fold"], r["count"]) for r in
                   windows.contiguous_folds(df, ["k"], 5).groupBy("fold").count().collect())
    assert [c for _, c in sizes] == [3, 2, 2, 2, 2]
    first = windows.contiguous_folds(df, ["k"], 5).where("k < 3").select("fold").distinct().collect()
    assert [r[0] for r in first] == [0]


def test_stratified_folds_balanced(spark):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    folds = windows.stratified_folds(df, "y", ["k"], 5)
    counts = folds.groupBy("y", "fold").count().collect()
    by_label = {}
    for r in counts:
        by_label.setdefault(r["y"], []).append(r["count"])
    for sizes in by_label.values():
        assert max(sizes) - min(sizes) <= 1


def test_dummies_drop_first_level(spark):
    df = spark.createDataFrame([("Age",), ("Edu",), ("Sex",), ("Total",)], "c string")
    out, names = clf.one_hot_drop_first(df, "c", "Strat")
    assert names == ["Strat_Edu", "Strat_Sex", "Strat_Total"]
    age = out.where("c = 'Age'").first()
    assert all(age[n] == 0.0 for n in names)


def test_auc_all_scores_tied(spark):
    df = spark.createDataFrame([(1, 0.3), (0, 0.3), (1, 0.3), (0, 0.3)], "y int, s double")
    assert spark.range(1).select(windows.auc_rank(df, "y", "s")).first()[0] == 0.5


def test_no_predicted_positives_zero_precision(spark):
    pred = spark.createDataFrame([(1.0, 0.0, 0.1), (0.0, 0.0, 0.2)],
                                 "label double, prediction double, score double")
    row = clf.fold_metrics(pred.withColumn("g", F.lit(0)), ["g"]).first()
    assert row["precision"] == 0.0 and row["f1"] == 0.0 and row["recall"] == 0.0


def test_validation_names_failed_rule(spark):
    df = spark.createDataFrame([(2020, 101.0, 10.0, "c")],
                               "YearStart int, Data_Value double, Sample_Size double, Class string")
    with pytest.raises(flt.ValidationError, match="value_in_range"):
        flt.validate_table(df, value_col="Data_Value", sample_col="Sample_Size",
                           year_col="YearStart", required=["Class"])
    missing = flt.validation_report(df.drop("Class"), value_col="Data_Value",
                                    sample_col="Sample_Size", year_col="YearStart",
                                    required=["Class"])
    assert {r["rule"]: r["passed"] for r in missing.collect()}["columns_present"] is False


def test_class_contains_null_is_false(spark):
    df = spark.createDataFrame([("Obesity / Weight",), (None,), ("fruits and veg",)], "c string")
    assert flt.class_contains(df, "c", "FRUITS").count() == 1


def test_impute_group_then_global(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "g string, v double")
    out = sorted(((r["g"], r["v"], r["imp"]) for r in windows.impute_group_mean(
        df, "v", ["g"], fallback=F.lit(7.0), flag_col="imp").collect()),
        key=lambda t: (t[0], t[2]))
    assert out == [("a", 1.0, False), ("a", 1.0, True), ("b", 7.0, True)]


def test_crosstab_rows_sum_to_one(spark):
    df = spark.createDataFrame([("x", 0), ("x", 1), ("x", 1), ("y", 0)], "g string, c int")
    rows = {r["g"]: r for r in agg.crosstab_normalized(df, "g", "c", [0, 1, 2]).collect()}
    assert rows["x"]["0"] == 0.333 and rows["x"]["1"] == 0.667 and rows["x"]["2"] == 0.0
    assert rows["y"]["0"] == 1.0
