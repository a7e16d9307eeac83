"""Physical-plan properties that matter at scale (checked with explain output)."""

import pytest

import __spark_entry__ as E
from data_dirs import SF_MID

from prevalens.sources.fixture import survey_view


def _plan(df):
    df.collect()   # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_view_prunes_columns_and_preaggregates(spark):
    df = survey_view(spark, SF_MID)
    text = df._jdf.queryExecution().executedPlan().toString()
    lineitem_scan = [ln for ln in text.splitlines() if "lineitem" in ln and "FileScan" in ln]
    assert lineitem_scan, text
    schema = lineitem_scan[0].split("ReadSchema: ")[1]
    assert schema.count(":") == 4          # l_orderkey, l_partkey, l_quantity, l_returnflag
    # map-side partial aggregate on lineitem before its first exchange
    lines = text.splitlines()
    scan_at = next(i for i, ln in enumerate(lines) if "lineitem" in ln and "FileScan" in ln)
    above = "\n".join(lines[max(0, scan_at - 6):scan_at])
    assert "HashAggregate" in above and "partial_sum" in above


@pytest.mark.parametrize("name", ["join_three", "pairwise_tests", "box_stats_outcome",
                                  "roc_driver_score", "imputed_dataset", "kde_outcome",
                                  "histogram_outcome", "stratified_folds"])
def test_no_cartesian_or_nested_loop_joins(spark, name):
    text = _plan(E.queries()[name](spark, SF_MID))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_checkpointed_view_feeds_every_branch(spark):
    # the three national tables of one query read the single checkpointed view
    text = _plan(E.queries()["join_three"](spark, SF_MID))
    assert "lineitem" not in text          # raw joins ran once, in the checkpoint job


def test_lineitem_shuffled_once_when_joins_shuffle(spark):
    """With broadcast off (cluster-scale sizes), the per-order pre-aggregate's
    partitioning is reused by the orders join: one exchange of lineitem."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        text = _plan(survey_view(spark, SF_MID))
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    final = text.split("== Initial Plan ==")[0]        # AQE prints final and initial plans
    assert "SortMergeJoin" in final
    assert final.count("Exchange hashpartitioning(l_orderkey") == 1
