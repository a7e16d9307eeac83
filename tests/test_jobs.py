"""The five batch jobs end to end: raw CSV -> clean tables -> reports."""

import dataclasses
import os
import tempfile

from data_dirs import SF_SMALL

from prevalens.config import FIXTURE_SURVEY
from prevalens.plans import jobs
from prevalens.sources.fixture import survey_view
from prevalens.sources.survey_csv import write_survey_csv

SPEC = dataclasses.replace(FIXTURE_SURVEY, min_sample_size=2.0)   # sf0.001 threshold


def test_jobs_end_to_end(spark):
    base = tempfile.mkdtemp(prefix="prevalens-jobs-")
    raw = survey_view(spark, SF_SMALL, raw_columns=True)
    csv = write_survey_csv(raw, os.path.join(base, "raw_csv"))
    clean_dir = os.path.join(base, "clean")
    written = jobs.run_clean(spark, csv, clean_dir, SPEC)
    assert set(written) == {"outcome_state", "driver_state", "habit_state",
                            "outcome_national", "driver_national", "habit_national"}
    habit = spark.read.parquet(written["habit_national"])
    assert habit.count() == 33 and "Habit" in habit.columns

    eda = jobs.run_eda(spark, clean_dir, os.path.join(base, "eda"), SPEC)
    assert {"stats_summary", "stats_corr_combined", "vif", "normality"} <= set(eda)
    summary = spark.read.option("header", True).csv(eda["stats_summary"])
    assert summary.count() == 5

    model = jobs.run_model(spark, clean_dir, os.path.join(base, "model"), SPEC)
    assert {"ols_driver", "ols_habit", "ridge", "model_compare"} <= set(model)

    cluster = jobs.run_cluster(spark, clean_dir, os.path.join(base, "cluster"), SPEC, k=3)
    prof = spark.read.option("header", True).csv(cluster["profiles"])
    assert prof.count() == 3
    ds = spark.read.parquet(os.path.join(base, "cluster", "clustered_dataset.parquet"))
    assert {"Cluster", "PCA1", "PCA2", "Habit_imputed"} <= set(ds.columns)


def test_classify_job(spark):
    base = tempfile.mkdtemp(prefix="prevalens-classify-")
    raw = survey_view(spark, SF_SMALL)
    from prevalens.plans import clean
    tables = clean.clean_tables(raw, SPEC)
    clean_dir = os.path.join(base, "clean")
    for n in jobs.NATIONAL:
        tables[n].write.parquet(os.path.join(clean_dir, f"{n}.parquet"))
    out = jobs.run_classify(spark, clean_dir, os.path.join(base, "classify"), SPEC)
    res = spark.read.option("header", True).csv(out["results_A"])
    assert res.count() == 4
    imp = spark.read.option("header", True).csv(out["importance_B"]).collect()
    assert abs(sum(float(r["importance"]) for r in imp) - 1.0) < 1e-3
