"""Spark queries vs their DuckDB oracle SQL on the driver's tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from data_dirs import SF_MID, SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

FAST = ["survey_view", "min_sample_filter", "state_habit", "national_outcome", "national_habit",
        "validation_report", "join_left_habit", "indicator_summary", "grouped_pearson",
        "pairwise_tests", "vif", "ols_outcome_driver", "stratified_folds", "imputed_dataset",
        "histogram_outcome", "box_stats_outcome", "dataset_catalog", "roc_driver_score"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_MID}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=repr)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_MID)
    rel = duck.sql(E.oracle_sql()[name])
    types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString()) for f in sdf.schema.fields}
    assert types == dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert _rows(sdf.toPandas()) == _rows(rel.df())


def test_contract(spark):
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 80


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "Habit" in df.columns and dict(df.dtypes)["YearStart"] == "int"


def test_all_oracle_sql_runs(duck):
    for name, sql in E.oracle_sql().items():
        duck.sql(sql).limit(1).fetchall()


def test_view_counts_small_scale(spark):
    # FIXTURES.md section 3: 3,444 view rows at sf0.001
    assert E.queries()["survey_view"](spark, SF_SMALL).count() == 3444


SCALE_CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
              "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}


@pytest.mark.parametrize("name", ["national_habit", "join_three", "imputed_dataset", "ridge_cv"])
def test_cluster_scale_plans_same_results(spark, duck, name):
    """Sort-merge joins with AQE skew splits (the cluster-scale plans) give the oracle's rows."""
    old = {k: spark.conf.get(k, None) for k in SCALE_CONF}
    try:
        for k, v in SCALE_CONF.items():
            spark.conf.set(k, v)
        got = E.queries()[name](spark, SF_MID).toPandas()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert _rows(got) == _rows(duck.sql(E.oracle_sql()[name]).df())
