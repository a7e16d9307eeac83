"""Newton fits and exact trees against numpy, for any layout of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prevalens.plans import exact_trees, linear_fits


def points(n=240, p=3, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)).round(2)
    y = (x @ np.array([1.5, -1.0, 0.3])[:p] + rng.normal(size=n) > 0.2).astype(float)
    return x, y, np.arange(n) % 5


def frame(spark, x, y, fold, parts):
    rows = [(i, [float(v) for v in a], float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, "id long, x array<double>, label double, fold int").repartition(parts)


def objective(w, x, y, loss):
    z = w[0] + x @ w[1:]
    if loss == "logistic":
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * w[1:] @ w[1:]
    return (np.maximum(0, 1 - (2 * y - 1) * z) ** 2).sum() + 0.5 * w @ w


def optimum(x, y, loss):
    """Plain gradient descent with backtracking."""
    w, step = np.zeros(x.shape[1] + 1), 1.0
    one = np.column_stack([np.ones(len(x)), x])
    for _ in range(20_000):
        z = one @ w
        t = 2 * y - 1
        d = 1 / (1 + np.exp(-z)) - y if loss == "logistic" else -2 * t * np.maximum(0, 1 - t * z)
        g = one.T @ d + w * (np.arange(len(w)) > 0 if loss == "logistic" else 1)
        if np.abs(g).max() < 1e-9:
            break
        step *= 2
        while objective(w - step * g, x, y, loss) > objective(w, x, y, loss) - 0.3 * step * g @ g and step > 1e-18:
            step /= 2
        w = w - step * g
    return w


@pytest.mark.parametrize("loss", linear_fits.LOSSES)
def test_newton_reaches_the_optimum_of_every_fold(spark, loss):
    x, y, fold = points()
    coefs, report = linear_fits.fit(frame(spark, x, y, fold, 4), 4, loss)
    for m in range(6):
        use = fold != m
        best = optimum(x[use], y[use], loss)
        assert objective(coefs[m], x[use], y[use], loss) <= objective(best, x[use], y[use], loss) + 1e-6
        assert np.allclose(coefs[m], best, atol=1e-5)
    assert [r[0] for r in report] == list(range(6)) and all(r[5] for r in report)
    assert [r[2] for r in report] == [int((fold != m).sum()) for m in range(6)]
    other, _ = linear_fits.fit(frame(spark, x, y, fold, 8), 4, loss)
    assert all(np.allclose(coefs[m], other[m], atol=1e-12) for m in range(6))


def test_newton_separable_and_single_class(spark):
    x, _, fold = points(60)
    for y in ((x[:, 0] > 0).astype(float), np.ones(60)):
        coefs, report = linear_fits.fit(frame(spark, x, y, fold, 3), 4, "squared_hinge")
        best = optimum(x, y, "squared_hinge")
        assert objective(coefs[5], x, y, "squared_hinge") <= objective(best, x, y, "squared_hinge") + 1e-6
        coefs, _ = linear_fits.fit(frame(spark, x[:, :3], y, fold, 3), 4, "logistic", max_steps=30)
        assert np.isfinite(coefs[5]).all()


def gini_tree(x, y, w, depth, node=1, level=0):
    """node -> (n, ones, feature, threshold) by brute force."""
    n, ones = w.sum(), (w * y).sum()
    out = {node: (n, ones, None, None)}
    if level == depth or ones in (0, n):
        return out
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[w > 0, f])
        for a, b in zip(values[:-1], values[1:]):
            left = x[:, f] <= a
            gain = sum((o * o + (k - o) * (k - o)) / k for k, o in (
                (w[left].sum(), (w * y)[left].sum()), (w[~left].sum(), (w * y)[~left].sum())))
            if best is None or gain > best[0]:
                best = (gain, f, (a + b) / 2)
    if best is None:
        return out
    _, f, t = best
    out[node] = (n, ones, f, t)
    left = x[:, f] <= t
    for side, child in ((left, 2 * node), (~left, 2 * node + 1)):
        out |= gini_tree(x[side], y[side], w[side], depth, child, level + 1)
    return out


def as_dict(nodes, model):
    return {r.node: (r.n, r.ones, r.feature, r.threshold) for r in nodes.where(F.col("model") == model).collect()}


def test_trees_equal_brute_force_for_any_layout(spark):
    x, y, fold = points(90)
    x = x.round(1)                            # repeated values
    for parts in (1, 8):
        nodes, routed = exact_trees.grow(exact_trees.fold_rows(frame(spark, x, y, fold, parts)), 3)
        for m in range(6):
            want = gini_tree(x, y, (fold != m).astype(float), 3)
            assert as_dict(nodes, m) == want
    found = {(r.model, r.id): r.prob for r in exact_trees.leaf_scores(nodes, routed).collect()}
    tree = gini_tree(x, y, (fold != 2).astype(float), 3)
    for i in range(len(x)):
        at = 1
        while tree[at][2] is not None:
            at = 2 * at + int(x[i, tree[at][2]] > tree[at][3])
        assert found[2, i] == tree[at][1] / tree[at][0]


def test_forest_depends_on_the_rows_alone(spark):
    x, y, fold = points(40)
    made = []
    for parts in (1, 8):
        rows = exact_trees.forest_rows(frame(spark, x, y, fold, parts), F.col("id"), 3, k=1)
        nodes, _ = exact_trees.grow(rows, None, 1)
        made.append({(r.model, r.node): (r.n, r.ones, r.feature, r.threshold) for r in nodes.collect()})
        share = exact_trees.importances(nodes, ["a", "b", "c"]).collect()
        assert abs(sum(r.importance for r in share) - 1) < 1e-9
    assert made[0] == made[1]
    assert len({n for m, n in made[0] if m == 0}) > 3


def test_bootstrap_weights_are_poisson(spark):
    w = spark.range(200_000).select(exact_trees.poisson_weight(F.col("id"), F.lit(7), 1).alias("w"))
    share = {r.w: r["count"] / 200_000 for r in w.groupBy("w").count().collect()}
    for k, p in ((0, 0.3679), (1, 0.3679), (2, 0.1839), (3, 0.0613)):
        assert abs(share[k] - p) < 0.005


def test_tree_edges(spark):
    schema = "id long, x array<double>, label double, fold int"
    nothing = spark.createDataFrame([], schema)
    nodes, routed = exact_trees.grow(exact_trees.fold_rows(nothing))
    assert nodes.count() == 0 and routed.count() == 0
    same = spark.createDataFrame([(1, [1.0, None], 0.0, 0), (2, [1.0, None], 1.0, 1), (3, [float("nan"), 2.0], 1.0, None)], schema)
    nodes, routed = exact_trees.grow(exact_trees.fold_rows(same, 2))
    # nulls and NaN lie right of every value
    cut = nodes.where("model = 2 and feature is not null").collect()
    assert [(r.node, r.feature, r.threshold) for r in cut] == [(1, 0, 1.0)]
    assert exact_trees.leaf_scores(nodes, routed).count() == 9


def test_report_has_a_row_per_node(spark):
    x, y, fold = points(80)
    nodes, _ = exact_trees.grow(exact_trees.fold_rows(frame(spark, x, y, fold, 2)), 3)
    table = exact_trees.node_table(nodes.where("model = 5"), ["a", "b", "c"])
    rows = {r.id: r for r in table.collect()}
    for r in rows.values():
        assert r.n == r.n_0 + r.n_1 and r.parent == r.id // 2
        if r.feature:
            assert r.n == rows[2 * r.id].n + rows[2 * r.id + 1].n


def test_small_nodes_grow_in_tasks_as_by_levels(spark, monkeypatch):
    rng = np.random.default_rng(8)
    values = [None, float("nan"), -0.0, 0.0, 1.0, 2.0]
    rows = []
    for i in range(60):
        x = [values[rng.integers(6)] if i % 3 else float(rng.random()), float(rng.integers(2)), float(rng.random())]
        rows.append((i, float(rng.integers(2)), (None, x[:2], x)[min(i, 2)], int(rng.integers(2))))
    data = spark.createDataFrame(rows, "id long, label double, x array<double>, fold int")
    data = exact_trees.forest_rows(data.select("label", "x", "fold", data.id.alias("key"), data.id.alias("key2")),
                                   F.col("key"), 2, k=2)

    def grown(in_task, depth):
        nodes, routed = exact_trees.grow(data, depth, 1, 5, in_task)
        return [sorted(repr(tuple(r)) for r in t.collect()) for t in (nodes, routed)]

    assert grown(10_000, 3) == grown(0, 3) == grown(20, 3)
    # the jobs do not follow the depth of the trees
    written = []
    plain = exact_trees.materialize
    monkeypatch.setattr(exact_trees, "materialize", lambda df: written.append(1) or plain(df))
    nodes, _ = exact_trees.grow(data, None, 1, 5)
    assert nodes.agg(F.max("depth")).first()[0] >= 6
    assert len(written) <= 5


def test_draws_in_tasks_are_those_of_the_levels(spark):
    rows = [(m, n, f) for m in (0, 5, 605) for n in (1, 77, 1 << 40) for f in (0, 1, 7)]
    df = spark.createDataFrame(rows, "model int, node long, feature int")
    for r in df.select("*", F.xxhash64(F.lit(42), "model", "node", "feature").alias("h")).collect():
        assert exact_trees._draw(42, np.array([r.model], np.int32), r.node, np.array([r.feature]))[0] == r.h
