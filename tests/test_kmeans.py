"""K-Means: equal models for any layout, numbers equal to numpy's."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from prevalens.plans import kmeans


def frame(spark, points, partitions):
    rows = spark.createDataFrame([([float(v) for v in p],) for p in points], "x array<double>")
    return rows.repartition(partitions).select("x", array_to_vector("x").alias("features"))


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    out = np.vstack([rng.normal(c, 1.0, (40, 3)) for c in (0.0, 4.0, 9.0)])
    return np.vstack([out, np.repeat(out[:1], 60, axis=0)])          # a third of all rows are one point


def test_models_do_not_depend_on_the_layout(spark, points):
    fits = []
    for order, parts in ((slice(None), 1), (slice(None, None, -1), 32)):
        data = frame(spark, points[order], parts)
        fits.append(kmeans.fit_starts(kmeans.weighted_points(data), [2, 3], 2))
    for a, b in zip(*fits):
        assert (a.k, a.seed, a.cost, a.steps) == (b.k, b.seed, b.cost, b.steps)
        assert np.array_equal(a.centers, b.centers)


def test_costs_and_labels_equal_numpy(spark, points):
    data = frame(spark, points, 5)
    best = kmeans.best_starts(kmeans.fit_starts(kmeans.weighted_points(data), [3], 3))[3]
    d = ((points[:, None] - best.centers[None]) ** 2).sum(axis=2)
    assert abs(best.cost - d.min(axis=1).sum()) < 1e-5
    labels = {tuple(r["x"]): r["c"] for r in kmeans.assign(data, best.centers, "c").collect()}
    assert [labels[tuple(p)] for p in points.tolist()] == d.argmin(axis=1).tolist()
    # no centre moves further than the tolerance: each is the mean of its rows
    for c in range(3):
        assert np.abs(points[d.argmin(axis=1) == c].mean(axis=0) - best.centers[c]).max() <= 1e-4


def test_fewer_points_than_clusters_and_none(spark):
    data = frame(spark, [[1.0, 2.0]] * 3 + [[5.0, 5.0]], 2)
    start = kmeans.fit_starts(kmeans.weighted_points(data), [4], 1)[0]
    assert start.cost == 0 and {tuple(c) for c in start.centers.tolist()} == {(1.0, 2.0), (5.0, 5.0)}
    with pytest.raises(ValueError):
        kmeans.fit_starts(kmeans.weighted_points(data.where(F.lit(False))), [2], 1)


def test_sums_of_large_numbers_stay_exact():
    values, w = np.array([[3.0e12], [1.0]]), np.array([10 ** 6, 1])
    got = kmeans._whole(values, w)
    assert [int(v[0]) for v in got] == [3 * 10 ** 12 * kmeans.UNIT * 10 ** 6, kmeans.UNIT]
