"""Long -> wide pivot with pandas ``pivot_table`` semantics, in one aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_mean(df: DataFrame, keys: list, pivot_col: str, value_col: str,
               values: dict, *, sample_col: str | None = None,
               sample_name: str | None = None) -> DataFrame:
    """Pivot ``value_col`` by ``pivot_col`` (mean per cell), one column per entry
    of ``values`` (pivot value -> output name).

    pandas semantics kept: rows with a NULL key are dropped, key rows whose
    pivoted values are all NULL are dropped.  The sample size of each key is
    the half-even rounded mean over the *question-filtered* rows (the same
    respondents answer every question of a class), attached in the same
    aggregate instead of a join back.  The value list is always given, so no
    extra distinct job runs.
    """
    questions = list(values)
    rows = df.where(F.col(pivot_col).isin(questions))
    rows = rows.na.drop(how="any", subset=keys)
    aggs = [F.avg(F.when(F.col(pivot_col) == q, F.col(value_col))).alias(name)
            for q, name in values.items()]
    if sample_col:
        aggs.append(F.bround(F.avg(sample_col), 0).cast("long")
                    .alias(sample_name or sample_col))
    wide = rows.groupBy(*keys).agg(*aggs)
    any_value = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in values.values()])
    return wide.where(any_value)


def pivot_classes(df: DataFrame, keys: list, class_col: str, pivot_col: str, value_col: str,
                  groups: dict, *, sample_col: str | None = None) -> dict:
    """``pivot_mean`` for several classes sharing one scan and one aggregate.

    ``groups`` maps a role to (class pattern, {question: measure}).  Each row
    is tagged with the roles whose class pattern and question list it matches
    (``explode`` of the matching tags, so overlapping classes are handled),
    one ``groupBy(role, keys)`` computes every measure, and each role's table
    is a filter of that result.  The role filter cannot move below the
    ``explode``, so every role reads the same upstream plan and Spark reuses
    its exchanges instead of recomputing the input once per class.
    """
    from ..functions.scalar import contains_ci
    tags = [F.when(contains_ci(class_col, pat) & F.col(pivot_col).isin(list(qs)), F.lit(role))
            for role, (pat, qs) in groups.items()]
    tagged = (df.na.drop(how="any", subset=keys)
              .withColumn("_role", F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull()))))
    aggs, seen = [], set()
    for _, (_, qs) in groups.items():
        for q, name in qs.items():
            if name not in seen:
                seen.add(name)
                aggs.append(F.avg(F.when(F.col(pivot_col) == q, F.col(value_col))).alias(name))
    if sample_col:
        aggs.append(F.bround(F.avg(sample_col), 0).cast("long").alias(sample_col))
    wide = tagged.groupBy("_role", *keys).agg(*aggs)
    out = {}
    for role, (_, qs) in groups.items():
        names = list(qs.values())
        any_value = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names])
        extra = [sample_col] if sample_col else []
        out[role] = (wide.where((F.col("_role") == role) & any_value)
                     .select(*keys, *names, *extra))
    return out
