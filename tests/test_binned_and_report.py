"""Binned density within its stated bound; the clean step's report from the pass that writes."""

import dataclasses
import math
import os
import tempfile

import numpy as np
import pytest

from prevalens.config import FIXTURE_SURVEY
from prevalens.operators.filters import ValidationError
from prevalens.plans import charts, clean


def test_binned_density_keeps_its_bound(spark):
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(0, 1, 3000), rng.exponential(4, 2000), np.full(2500, 2.5)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(7)
    bw = v.std(ddof=1) * len(v) ** -0.2
    for cells in (4, 32):
        got = charts.kde_binned(df, "v", gridsize=101, cells_per_bandwidth=cells, digits=12).orderBy("point").collect()
        grid = np.linspace(v.min(), v.max(), 101)
        exact = np.exp(-0.5 * ((grid[:, None] - v) / bw) ** 2).sum(axis=1) / (len(v) * bw * math.sqrt(2 * math.pi))
        assert [r["point"] for r in got] == list(range(101))
        off = np.abs(np.array([r["density"] for r in got]) - exact).max()
        assert off <= 1 / (8 * cells ** 2) / (bw * math.sqrt(2 * math.pi)) + 1e-11


def test_binned_density_of_few_values(spark):
    for rows in ([], [(1.0,)], [(2.0,), (2.0,)], [(None,)]):
        assert charts.kde_binned(spark.createDataFrame(rows, "v double"), "v").count() == 0


def test_binned_density_multiplies_cells_only(spark):
    plan = charts.kde_binned(spark.range(1000).selectExpr("id / 7.0D AS v"), "v")._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    # the tree is printed top down: the grid is unfolded above the aggregate over cells
    assert text.index("Generate") < text.rindex("Aggregate")


SPEC = dataclasses.replace(FIXTURE_SURVEY, min_sample_size=2.0)
ROW = "YearStart int, LocationDesc string, Class string, Question string, Data_Value double, Sample_Size double, " \
      "StratificationCategory1 string, Stratification1 string, Datasource string"


def survey(spark, value):
    rows = [(2000, "a", "Outcome", "outcome", value, 5.0, "Total", "Overall", "x"),
            (2000, "b", "Outcome", "outcome", 50.0, 1.0, "Total", "Overall", "x"),
            (2000, "b", "Driver", "driver", None, None, "Total", "Overall", "x")]
    return spark.createDataFrame(rows, ROW).repartition(3)


def test_report_counts_what_the_pass_saw(spark):
    long, report = clean.written_long(survey(spark, 120.0), SPEC)
    assert long.count() == 3 and "Datasource" not in long.columns
    found = {(r["section"], r["item"]): r["n"] for r in report.collect()}
    assert found["dropped_column", "Datasource"] == 1
    absent = {item for section, item in found if section == "absent_column"}
    assert absent == set(SPEC.drop_columns) - {"Datasource"}
    assert found["violations", "value_in_range"] == 1 and found["violations", "year_in_range"] == 0
    assert (found["rows", "read"], found["rows", "kept"]) == (3, 1)


def test_job_writes_its_report_and_stops_on_violations(spark):
    good, bad = (tempfile.mkdtemp(prefix="prevalens-report-") for _ in range(2))
    clean.clean_job(survey(spark, 40.0), SPEC, good)
    with pytest.raises(ValidationError, match="value_in_range"):
        clean.clean_job(survey(spark, 120.0), SPEC, bad)
    for folder, n in ((good, "0"), (bad, "1")):
        rows = spark.read.option("header", True).csv(os.path.join(folder, "clean_report")).collect()
        assert [r["n"] for r in rows if r["item"] == "value_in_range"] == [n]
    assert not os.path.exists(os.path.join(bad, "outcome_state.parquet"))


def test_report_of_an_empty_table(spark):
    _, report = clean.written_long(survey(spark, 1.0).where("false"), SPEC)
    found = {(r["section"], r["item"]): r["n"] for r in report.collect()}
    assert found["rows", "read"] == 0 and found["violations", "value_in_range"] == 0
