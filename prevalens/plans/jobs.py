"""The five batch jobs (clean, eda, model, classify, cluster) and a small CLI.

Jobs talk through tables, as in the reference: ``clean`` writes the six
parquet tables, the others read the three national tables and write report
CSVs (one folder per report).  Usage::

    python -m prevalens.plans.jobs clean    --input raw.csv --output_dir clean_outputs
    python -m prevalens.plans.jobs eda      --input_dir clean_outputs --output_dir eda_outputs
    python -m prevalens.plans.jobs model    --input_dir clean_outputs --output_dir model_outputs
    python -m prevalens.plans.jobs classify --input_dir clean_outputs --output_dir classify_outputs
    python -m prevalens.plans.jobs cluster  --input_dir clean_outputs --output_dir cluster_outputs [--k 4]
"""

from __future__ import annotations

import argparse
import os

from ..config import NUTRITION_SURVEY, SurveySpec
from ..sources.survey_csv import read_survey_csv
from ..sources.tables import read_tables, write_report_csv, write_table
from . import classification, clean, clustering, eda, regression

NATIONAL = ("outcome_national", "driver_national", "habit_national")


def _nationals(spark, input_dir):
    t = read_tables(spark, input_dir, NATIONAL)
    return t["outcome_national"], t["driver_national"], t["habit_national"]


def _write_reports(tables: dict, output_dir: str) -> dict:
    from pyspark.sql import DataFrame
    return {n: write_report_csv(df, os.path.join(output_dir, n))
            for n, df in tables.items() if isinstance(df, DataFrame)}


def run_clean(spark, input_path: str, output_dir: str, spec: SurveySpec = NUTRITION_SURVEY,
              columns: list | None = None):
    if columns is None:   # header row: one line, read by Spark (no local file access)
        columns = spark.read.option("header", True).csv(input_path).columns
    raw = read_survey_csv(spark, input_path, columns)
    return clean.clean_job(raw, spec, output_dir)


def run_eda(spark, input_dir, output_dir, spec=NUTRITION_SURVEY):
    return _write_reports(eda.eda_job(*_nationals(spark, input_dir), spec), output_dir)


def run_model(spark, input_dir, output_dir, spec=NUTRITION_SURVEY):
    o, d, h = _nationals(spark, input_dir)
    od, odh = eda.join_two(o, d, spec), eda.join_three(o, d, h, spec)
    return _write_reports(regression.regression_job(od, odh, spec, spec.national_keys), output_dir)


def run_classify(spark, input_dir, output_dir, spec=NUTRITION_SURVEY):
    return _write_reports(classification.classification_job(*_nationals(spark, input_dir), spec),
                          output_dir)


def run_cluster(spark, input_dir, output_dir, spec=NUTRITION_SURVEY, k: int | None = None):
    res = clustering.cluster_job(*_nationals(spark, input_dir), spec, k=k)
    write_table(res["clustered"], output_dir, "clustered_dataset")
    return _write_reports(res, output_dir)


def main(argv=None):
    from ..session import get_session
    ap = argparse.ArgumentParser(prog="prevalens")
    ap.add_argument("job", choices=["clean", "eda", "model", "classify", "cluster"])
    ap.add_argument("--input")
    ap.add_argument("--input_dir", default="clean_outputs")
    ap.add_argument("--output_dir", required=True)
    ap.add_argument("--k", type=int, default=None)
    a = ap.parse_args(argv)
    spark = get_session()
    if a.job == "clean":
        run_clean(spark, a.input, a.output_dir)
    elif a.job == "eda":
        run_eda(spark, a.input_dir, a.output_dir)
    elif a.job == "model":
        run_model(spark, a.input_dir, a.output_dir)
    elif a.job == "classify":
        run_classify(spark, a.input_dir, a.output_dir)
    else:
        run_cluster(spark, a.input_dir, a.output_dir, k=a.k)


if __name__ == "__main__":
    main()
