"""Closed forms and brute force in numpy vs the Spark operators (small frames)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prevalens.functions import distributions as D
from prevalens.functions import stats
from prevalens.operators import windows
from prevalens.plans import charts, regression


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(7)
    x1 = rng.normal(10, 2, 60)
    x2 = 0.8 * x1 + rng.normal(0, 0.5, 60)
    y = 3 + 0.5 * x1 - 0.2 * x2 + rng.normal(0, 1, 60)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))]
    return spark.createDataFrame(rows, "k long, x1 double, x2 double, y double"), x1, x2, y


def test_t_p_values_at_critical_points(spark):
    crit = [(12.706204736, 1), (4.30265273, 2), (2.228138852, 10), (2.20098516, 11)]
    df = spark.createDataFrame(crit, "t double, nu long")
    for r in df.select(D.t_two_sided_p(F.col("t"), F.col("nu")).alias("p")).collect():
        assert abs(r["p"] - 0.05) < 2e-6


def test_normal_cdf_and_ppf(spark):
    from statistics import NormalDist
    nd = NormalDist()
    df = spark.createDataFrame([(x / 10,) for x in range(-60, 61, 7)], "x double")
    for r in df.select("x", D.normal_cdf(F.col("x")).alias("c")).collect():
        assert abs(r["c"] - nd.cdf(r["x"])) < 1e-14
    ps = spark.createDataFrame([(p / 97,) for p in range(1, 97)], "p double")
    for r in D.with_normal_ppf(ps, "p", "z").collect():
        assert abs(r["z"] - nd.inv_cdf(r["p"])) < 1e-9


def test_ols_matches_numpy(spark, xy):
    df, x1, x2, y = xy
    tab = {r["term"]: r for r in regression.ols(df, "y", ["x1", "x2"], "m").collect()}
    X = np.column_stack([np.ones_like(x1), x1, x2])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    s2 = resid @ resid / (len(y) - 3)
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * s2)
    for name, b, s in zip(["Intercept", "x1", "x2"], beta, se):
        assert abs(tab[name]["coef"] - round(b, 4)) < 1e-4
        assert abs(tab[name]["std_err"] - round(s, 4)) < 1e-4
    r2 = 1 - resid @ resid / ((y - y.mean()) @ (y - y.mean()))
    assert abs(tab["x1"]["r2"] - r2) < 1e-4


def _ridge_np(X, y, alpha):
    mx, my = X.mean(0), y.mean()
    w = np.linalg.solve((X - mx).T @ (X - mx) + alpha * np.eye(X.shape[1]), (X - mx).T @ (y - my))
    return my - mx @ w, w


def test_ridge_cv_matches_brute_force(spark, xy):
    df, x1, x2, y = xy
    res = regression.ridge_cv(df, "y", ["x1", "x2"], ["k"], alphas=[0.01, 1.0, 10.0, 100.0])
    X = np.column_stack([x1, x2])
    Z = (X - X.mean(0)) / X.std(0)
    n = len(y)
    folds = np.zeros(n, int)
    q, r = divmod(n, 5)
    start = 0
    for f in range(5):
        size = q + (1 if f < r else 0)
        folds[start:start + size] = f
        start += size
    means = []
    for a in [0.01, 1.0, 10.0, 100.0]:
        scores = []
        for f in range(5):
            tr, te = folds != f, folds == f
            b0, w = _ridge_np(Z[tr], y[tr], a)
            pred = b0 + Z[te] @ w
            scores.append(1 - ((y[te] - pred) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum())
        means.append(np.mean(scores))
    for (a, m), m_np in zip(res.alpha_path, means):
        assert abs(m - m_np) < 1e-9
    best = [0.01, 1.0, 10.0, 100.0][int(np.argmax(means))]
    assert res.alpha == best
    b0, w = _ridge_np(Z, y, best)
    assert np.allclose(res.coef, w) and abs(res.intercept - b0) < 1e-9


def test_vif_uncentered(spark, xy):
    df, x1, x2, _ = xy
    out = {r["Feature"]: r["VIF"] for r in stats.vif(df, ["x1", "x2"]).collect()}
    r2 = (x1 @ x2) ** 2 / ((x1 @ x1) * (x2 @ x2))
    assert abs(out["x1"] - round(1 / (1 - r2), 2)) < 1e-9
    three = {r["Feature"]: r["VIF"] for r in stats.vif(df, ["x1", "x2", "y"]).collect()}
    X = np.column_stack([x1, x2, _])
    G = X.T @ X
    assert abs(three["x1"] - round(np.linalg.inv(G)[0, 0] * G[0, 0], 2)) < 1e-9


def _swilk_np(x):
    """Royston's algorithm, written independently with numpy (for n > 11)."""
    from statistics import NormalDist
    nd = NormalDist()
    x = np.sort(np.asarray(x, float))
    n = len(x)
    m = np.array([nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = m @ m
    u = 1 / math.sqrt(n)
    an = m[-1] / math.sqrt(mm) + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
    an1 = m[-2] / math.sqrt(mm) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
    a = m / math.sqrt(phi)
    a[-1], a[0], a[-2], a[1] = an, -an, an1, -an1
    w = (a @ x) ** 2 / ((x - x.mean()) @ (x - x.mean()))
    ln = math.log(n)
    mu = 0.0038915 * ln ** 3 - 0.083751 * ln ** 2 - 0.31082 * ln - 1.5861
    sd = math.exp(0.0030302 * ln ** 2 - 0.082676 * ln - 0.4803)
    return w, 1 - nd.cdf((math.log(1 - w) - mu) / sd)


def test_shapiro_wilk_matches_numpy(spark):
    rng = np.random.default_rng(3)
    for n, gen in ((40, rng.normal), (120, rng.exponential)):
        x = gen(size=n)
        df = spark.createDataFrame([(float(v),) for v in x], "v double")
        r = stats.shapiro_wilk(df, "v", "v").first()
        w, p = _swilk_np(x)
        assert r["n"] == n
        assert abs(r["W"] - round(w, 4)) < 1e-9
        assert abs(r["p_value"] - round(p, 6)) < 2e-6


def test_histogram_matches_numpy(spark, xy):
    df, x1, _, _ = xy
    counts = [r["count"] for r in charts.histogram(df, "x1", 7).orderBy("bin").collect()]
    np_counts, _ = np.histogram(x1, bins=7)
    assert counts == list(np_counts)


def test_kde_matches_brute_force(spark, xy):
    df, x1, _, _ = xy
    out = charts.kde(df, "x1", gridsize=25).orderBy("point").collect()
    bw = x1.std(ddof=1) * len(x1) ** (-0.2)
    grid = np.linspace(x1.min(), x1.max(), 25)
    dens = np.exp(-0.5 * ((grid[:, None] - x1[None, :]) / bw) ** 2).sum(1) / (len(x1) * bw * math.sqrt(2 * math.pi))
    assert np.allclose([r["density"] for r in out], np.round(dens, 6), atol=2e-6)


def test_auc_equals_mann_whitney(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 80)
    s = np.round(rng.normal(size=80) + y, 1)          # rounding creates ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    auc = spark.range(1).select(windows.auc_rank(df, "y", "s")).first()[0]
    pos, neg = s[y == 1], s[y == 0]
    mw = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(auc - mw) < 1e-12
    roc = windows.roc_curve(df, "y", "s").orderBy(F.desc("threshold")).collect()
    assert roc[-1]["tpr"] == 1.0 and roc[-1]["fpr"] == 1.0


def test_pearson_test_matches_formula(spark, xy):
    df, x1, _, y = xy
    r = stats.pearson_test(df, "x1", "y").first()
    rr = np.corrcoef(x1, y)[0, 1]
    assert abs(r["r"] - round(rr, 4)) < 1e-9 and r["n"] == 60
    t = rr * math.sqrt(58 / (1 - rr * rr))
    p = spark.range(1).select(D.t_two_sided_p(F.lit(t), F.lit(58))).first()[0]
    assert abs(r["p_value"] - round(p, 6)) < 1e-12


def test_kmeans_and_pca_on_blobs(spark):
    from prevalens.plans import clustering as clu
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(11)
    centers = np.array([[0, 0, 0], [8, 8, 0], [0, 8, 8]], float)
    pts = np.vstack([c + rng.normal(0, 0.3, (30, 3)) for c in centers])
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "a double, b double, c double")
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    sweep = {r["k"]: r for r in clu.kmeans_sweep(data, ks=range(2, 5), n_init=3).collect()}
    assert sweep[2]["inertia"] > sweep[3]["inertia"] > sweep[4]["inertia"]
    assert clu.best_k(clu.kmeans_sweep(data, ks=range(2, 5), n_init=3)).first()["k"] == 3
    clustered = clu.fit_clusters(data, 3, n_init=3)
    sizes = sorted(r["count"] for r in clustered.groupBy("Cluster").count().collect())
    assert sizes == [30, 30, 30]
    _, explained = clu.pca2(clustered)
    assert explained[0] >= explained[1] and sum(explained) > 0.99


def test_prefix_sums_match_cumsum(spark):
    rng = np.random.default_rng(9)
    g = rng.integers(0, 3, 400)
    s = rng.normal(size=400)
    v = rng.integers(0, 5, 400)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(g, s, v)],
                               "g int, s double, v long")
    for desc in (False, True):
        out = windows.prefix_sums(df, "s", ["v"], group_cols=["g"], descending=desc,
                                  buckets=16).collect()
        got = {(r["g"], r["s"]): r["cum_v"] for r in out}
        for grp in range(3):
            idx = np.where(g == grp)[0]
            order = idx[np.argsort(-s[idx] if desc else s[idx])]
            cum = np.cumsum(v[order])
            for i, c in zip(order, cum):
                assert got[(grp, float(s[i]))] == c


def test_global_rank_matches_sort(spark):
    rng = np.random.default_rng(13)
    a = rng.integers(0, 50, 5000)
    b = rng.permutation(5000)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long").repartition(7)
    ranked = windows.global_rank(df, ["a", "b"], "r", partitions=6).collect()
    got = {(r["a"], r["b"]): r["r"] for r in ranked}
    expected = sorted(zip(a.tolist(), b.tolist()))
    assert [got[k] for k in expected] == list(range(5000))


def test_approx_switches_close_to_exact(spark):
    from prevalens.operators import aggregates as agg
    from prevalens.sources.profile import profile_source
    df = spark.range(20000).select((F.col("id") % 997).cast("double").alias("x"),
                                   (F.col("id") % 7).cast("string").alias("g"),
                                   (F.col("id") % 3).cast("string").alias("c"),
                                   (F.col("id") % 5 + 2000).cast("int").alias("y"))
    exact = agg.column_summary(df, "x", "x", exact=True).first()
    approx = agg.column_summary(df, "x", "x", exact=False).first()
    for q in ("Q1", "Median", "Q3"):
        assert abs(exact[q] - approx[q]) <= 2.0          # within a couple of ranks of 997 values
    boxes = charts.box_stats(df, "g", "x", exact=False).collect()
    assert len(boxes) == 7 and all(b["n"] > 0 for b in boxes)
    prof = profile_source(df, class_col="c", location_col="g", year_col="y", approx=True).first()
    assert prof["n_rows"] == 20000 and prof["n_locations"] == 7 and prof["years"].startswith("2000")
