"""Clean job: long survey table -> state pivots -> weighted national tables.

Plan shape (one scan feeding three branches):

    scan -> validate (1 aggregate) -> drop columns -> filter sample size
         -> [class filter -> question filter -> pivot (1 groupBy per class)]
         -> national weighted roll-up (1 groupBy per class) -> derived score

The national keys are a subset of the state keys, so each class costs two
small shuffles; all row-level work (filters, casts, CASE) runs in codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SurveySpec
from ..operators import aggregates as agg
from ..operators import filters as flt
from ..operators.pivot import pivot_classes


def prepare(raw: DataFrame, spec: SurveySpec, *, min_sample: float | None = None,
            validate: bool = True) -> DataFrame:
    """Validate, drop the documented columns, keep rows with enough sample."""
    if validate:
        flt.validate_table(raw, value_col=spec.value, sample_col=spec.sample_size,
                           year_col=spec.year, required=[spec.klass],
                           value_range=spec.value_range, year_range=spec.year_range)
    kept, _, _ = flt.drop_columns(raw, spec.drop_columns)
    threshold = spec.min_sample_size if min_sample is None else min_sample
    return flt.filter_min_sample(kept, spec.sample_size, threshold)


def national_table(state: DataFrame, spec: SurveySpec, measures: list) -> DataFrame:
    return agg.aggregate_national(state, spec.national_keys, measures,
                                  location_col=spec.location, weight_col=spec.sample_size)


def clean_tables(raw: DataFrame, spec: SurveySpec, *, min_sample: float | None = None,
                 validate: bool = True) -> dict:
    """All six outputs of the clean step, lazily (nothing runs until written).

    The three class pivots come out of one tagged aggregate (``pivot_classes``)
    so the input is computed once however many tables a plan uses.
    """
    filtered = prepare(raw, spec, min_sample=min_sample, validate=validate)
    roles = (("outcome", spec.outcome), ("driver", spec.driver), ("habit", spec.habit))
    states = pivot_classes(filtered, spec.state_keys, spec.klass, spec.question, spec.value,
                           {role: (g.class_pattern, g.questions) for role, g in roles},
                           sample_col=spec.sample_size)
    out = {}
    for role, group in roles:
        state = states[role]
        nat = national_table(state, spec, group.measures)
        if role == "habit":
            nat = agg.add_row_mean(nat, spec.habit_score, spec.habit_parts)
        out[f"{role}_state"] = state
        out[f"{role}_national"] = nat
    return out


def written_long(raw: DataFrame, spec: SurveySpec, *, min_sample: float | None = None) -> tuple:
    """(long table without the dropped columns, report): one pass writes the one and counts the other.

    The report has a row per dropped column, absent column and validation rule, and the rows
    read and kept by the sample filter: ``section, item, n`` (columns count 1; null where a rule's
    column is absent from the input).  The counts are metrics observed while the table is written
    by the last stage of one job: the input is read once, and a task that ran again counts once.
    """
    from pyspark.sql import Observation
    from ..session import scratch_path
    spark = raw.sparkSession
    threshold = spec.min_sample_size if min_sample is None else min_sample
    kept, dropped, absent = flt.drop_columns(raw, spec.drop_columns)
    rules = flt.violation_rules(raw, value_col=spec.value, sample_col=spec.sample_size, year_col=spec.year,
                                required=[spec.klass], value_range=spec.value_range, year_range=spec.year_range)
    large = (F.count_if(F.col(spec.sample_size) >= F.lit(threshold)) if spec.sample_size in raw.columns
             else F.lit(None))
    seen = Observation(f"clean-{spec.value}")
    path = scratch_path(spark, "clean-long")
    # the column rule is a literal, which no metric can be
    counted = [(name, e) for name, e in rules if name != "columns_present"]
    missing = sum(c not in raw.columns for c in [spec.klass])
    kept.observe(seen, F.count(F.lit(1)).alias("rows_read"), large.cast("long").alias("rows_kept"),
                 *[e.cast("long").alias(name) for name, e in counted]).write.parquet(path)
    found = seen.get
    rows = ([("dropped_column", c, 1) for c in dropped] + [("absent_column", c, 1) for c in absent]
            + [("violations", "columns_present", missing)]
            + [("violations", name, found[name]) for name, _ in counted]
            + [("rows", "read", found["rows_read"]), ("rows", "kept", found["rows_kept"])])
    return spark.read.parquet(path), spark.createDataFrame(rows, "section string, item string, n long")


def clean_job(raw: DataFrame, spec: SurveySpec, output_dir: str, *,
              min_sample: float | None = None) -> dict:
    """Run the clean step and write the six parquet tables (sorted by key).

    The long table without the dropped columns is written first, and the same pass counts the
    report (``clean_report``, a CSV folder beside the tables); a violated rule stops the job
    after the report is written.  The six writes read that long table.
    """
    import os
    from ..sources.tables import write_report_csv, write_tables
    long, report = written_long(raw, spec, min_sample=min_sample)
    write_report_csv(report, os.path.join(output_dir, "clean_report"))
    failed = [r["item"] for r in report.where((F.col("section") == "violations") & (F.col("n") > 0)).collect()]
    if failed:                                                    # one row per rule
        raise flt.ValidationError("validation failed: " + ", ".join(failed))
    tables = clean_tables(long, spec, min_sample=min_sample, validate=False)
    ordered = {}
    for name, df in tables.items():
        keys = spec.state_keys if name.endswith("_state") else spec.national_keys
        ordered[name] = df.orderBy(*[F.col(k) for k in keys])
    return write_tables(ordered, output_dir)
