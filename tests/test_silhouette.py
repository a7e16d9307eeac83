"""Plain-Euclidean silhouette against all pairs in numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from prevalens.plans.silhouette import silhouettes


def brute(x, labels):
    """Mean silhouette over all rows from the whole distance matrix."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(labels):
        same = [j for j, v in enumerate(labels) if v == own and j != i]
        if not same:
            scores.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, [j for j, v in enumerate(labels) if v == other]].mean() for other in set(labels) - {own})
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 1.0, (60, 3)) for c in (0.0, 3.0, 7.0)])
    x = np.vstack([x, np.repeat(x[:1], 90, axis=0)])                 # a third of all rows are one point
    return x, rng.integers(0, 4, len(x)).tolist(), ["far" if p[0] > 3 else "near" for p in x]


def frame(spark, x, a, b, parts):
    data = [([float(v) for v in p], u, v) for p, u, v in zip(x, a, b)]
    return (spark.createDataFrame(data, "x array<double>, a int, b string").repartition(parts)
            .withColumn("features", array_to_vector("x")))


@pytest.mark.parametrize("block,parts", [(2_048, 1), (37, 9), (8, 32)])
def test_equals_brute_force_for_any_blocks(spark, rows, block, parts):
    x, a, b = rows
    got = {r["labelling"]: r for r in silhouettes(frame(spark, x, a, b, parts), ["a", "b"], block=block).collect()}
    assert abs(got["a"]["silhouette"] - brute(x, a)) < 1e-9
    assert abs(got["b"]["silhouette"] - brute(x, b)) < 1e-9
    assert (got["a"]["clusters"], got["b"]["clusters"], got["a"]["n"]) == (4, 2, len(x))


def test_singles_equal_points_and_one_cluster(spark):
    x = np.array([[0.0], [0.0], [0.0], [5.0]])
    got = {r["labelling"]: r["silhouette"] for r in
           silhouettes(frame(spark, x, [0, 0, 1, 2], ["s"] * 4, 2), ["a", "b"], features="x").collect()}
    assert abs(got["a"] - brute(x, [0, 0, 1, 2])) < 1e-12
    assert got["b"] is None


def test_unusable_rows_and_no_rows(spark):
    data = [([0.0], 0), ([0.5], 0), ([4.0], 1), ([float("nan")], 1), ([float("inf")], 0), ([1.0], None), (None, 1)]
    df = spark.createDataFrame(data, "x array<double>, a int")
    row = silhouettes(df, ["a"], features="x").first()
    assert row["n"] == 3 and abs(row["silhouette"] - brute(np.array([[0.0], [0.5], [4.0]]), [0, 0, 1])) < 1e-12
    none = silhouettes(df.where(F.lit(False)), ["a"], features="x").first()
    assert (none["n"], none["clusters"], none["silhouette"]) == (0, 0, None)
