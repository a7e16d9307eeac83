"""Clean step vs a pandas brute force on random frames with NULL keys and NaN values."""

import numpy as np
import pandas as pd
import pytest

from prevalens.operators.aggregates import add_row_mean, aggregate_national
from prevalens.operators.pivot import pivot_classes

KEYS = ["y", "loc", "cat", "st"]
NAT = ["y", "cat", "st"]
QS = {"qa": "A", "qb": "B"}


def _frame(seed, n=400):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({
        "y": rng.integers(2000, 2004, n).astype(float),
        "loc": rng.choice(["l1", "l2", "l3", "l4", None], n, p=[.3, .3, .2, .15, .05]),
        "cat": rng.choice(["c1", "c2"], n),
        "st": rng.choice(["s1", "s2", "s3"], n),
        "q": rng.choice(["qa", "qb", "other"], n, p=[.45, .45, .1]),
        "v": np.where(rng.random(n) < .15, np.nan, rng.uniform(0, 100, n).round(3)),
        "w": rng.integers(50, 500, n).astype(float),
    })
    df.loc[rng.random(n) < .03, "y"] = np.nan
    return df


def _pandas_clean(df):
    sub = df[df["q"].isin(list(QS))]
    ss = sub.groupby(KEYS)["w"].mean().round(0).astype(int).reset_index()
    piv = sub.pivot_table(index=KEYS, columns="q", values="v", aggfunc="mean").reset_index()
    piv.columns.name = None
    piv = piv.rename(columns=QS).merge(ss, on=KEYS, how="left")
    rows = []
    for key, g in piv.groupby(NAT):
        row = dict(zip(NAT, key), n_loc=g["loc"].nunique(), tot=g["w"].sum())
        for m in QS.values():
            ok = g[["w", m]].dropna()
            row[m] = (ok[m] * ok["w"]).sum() / ok["w"].sum() if len(ok) else None
        rows.append(row)
    nat = pd.DataFrame(rows)
    nat["S"] = nat[list(QS.values())].mean(axis=1)
    return piv, nat


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clean_matches_pandas(spark, seed):
    pdf = _frame(seed)
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                "y double, loc string, cat string, st string, q string, v double, w double")
    states = pivot_classes(sdf, KEYS, "cat", "q", "v", {"all": (".", QS)}, sample_col="w")
    nat = aggregate_national(states["all"], NAT, list(QS.values()), location_col="loc",
                             weight_col="w", n_locations="n_loc", total_weight="tot")
    nat = add_row_mean(nat, "S", list(QS.values()))
    want_piv, want_nat = _pandas_clean(pdf)

    def rows(df, cols):
        out = []
        for r in df[cols].itertuples(index=False):
            out.append(tuple(None if (isinstance(x, float) and np.isnan(x)) or x is None
                             else (round(float(x), 9) if isinstance(x, (float, np.floating)) else x)
                             for x in r))
        return sorted(out, key=repr)

    pcols = KEYS + ["A", "B", "w"]
    assert rows(states["all"].toPandas(), pcols) == rows(want_piv, pcols)
    ncols = NAT + ["n_loc", "tot", "A", "B", "S"]
    got = nat.toPandas()
    got["tot"] = got["tot"].astype(float)
    want_nat["tot"] = want_nat["tot"].astype(float)
    assert rows(got, ncols) == rows(want_nat, ncols)


def _r(x, d):
    return None if x is None or (isinstance(x, float) and np.isnan(x)) else round(float(x), d)


@pytest.mark.parametrize("seed", [4, 5])
def test_summaries_match_pandas(spark, seed):
    from prevalens.functions.stats import grouped_pearson_test
    from prevalens.operators import aggregates as agg
    rng = np.random.default_rng(seed)
    n = 300
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c", "d"], n, p=[.4, .3, .25, .05]),
                        "x": rng.normal(30, 5, n).round(2), "y": rng.normal(20, 3, n).round(2),
                        "k": rng.integers(0, 3, n)})
    pdf.loc[rng.random(n) < .1, "x"] = np.nan
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                "g string, x double, y double, k long")

    # category summary: N counts every row (NaN included), stats skip NaN, 2 dp
    got = {r["Category"]: r for r in agg.category_summary(sdf, "g", "x").collect()}
    for cat, grp in pdf.groupby("g"):
        s = grp["x"]
        assert got[cat]["N"] == len(s)
        assert got[cat]["Mean"] == _r(round(s.mean(), 2), 2)
        assert got[cat]["Max"] == _r(round(s.max(), 2), 2)
        if s.count() > 1:
            assert abs(got[cat]["Std"] - s.std()) <= 0.005 + 1e-9

    # column summary with linear quantiles (pandas default interpolation)
    row = agg.column_summary(sdf, "x", "x", digits=6).first()
    s = pdf["x"].dropna()
    assert row["N"] == len(s)
    for name, q in (("Q1", .25), ("Median", .5), ("Q3", .75)):
        assert abs(row[name] - s.quantile(q)) < 1e-6

    # crosstab row proportions and value-count shares
    ct = pd.crosstab(pdf["g"], pdf["k"], normalize="index")
    got = {r["g"]: r for r in agg.crosstab_normalized(sdf, "g", "k", [0, 1, 2]).collect()}
    for cat in ct.index:
        for k in (0, 1, 2):
            want = ct.loc[cat, k] if k in ct.columns else 0.0
            assert abs(got[cat][str(k)] - want) <= 0.0005 + 1e-12
    vc = pdf["g"].value_counts(normalize=True)
    got = {r["g"]: r["share"] for r in agg.value_counts(sdf, "g").collect()}
    assert all(abs(got[c] - vc[c]) <= 0.00005 + 1e-12 for c in vc.index)

    # grouped Pearson r on complete cases, groups with >= 5 rows
    cc = pdf.dropna(subset=["x", "y"])
    got = {r["Category"]: r for r in grouped_pearson_test(
        sdf.na.drop(subset=["x", "y"]), "g", "x", "y").collect()}
    for cat, grp in cc.groupby("g"):
        if len(grp) >= 5:
            assert abs(got[cat]["r"] - grp["x"].corr(grp["y"])) <= 0.00005 + 1e-12
            assert got[cat]["n"] == len(grp)
        else:
            assert cat not in got


def test_imputation_matches_pandas(spark):
    from prevalens.operators.windows import impute_group_mean
    rng = np.random.default_rng(8)
    n = 120
    base = pd.DataFrame({"y": rng.integers(2000, 2010, n), "c": rng.choice(["c1", "c2", "c3"], n),
                         "s": rng.choice(["s1", "s2"], n), "o": rng.normal(30, 4, n).round(2)})
    base = base.drop_duplicates(["y", "c", "s"]).reset_index(drop=True)
    habit = base.sample(frac=0.3, random_state=1)[["y", "c", "s"]].copy()
    habit["h"] = rng.normal(25, 3, len(habit)).round(2)
    habit = habit[~((habit["c"] == "c3") & (habit["s"] == "s2"))]     # a group with no habit data
    # pandas: left join, group mean over the joined rows, global mean of the habit table
    pj = base.merge(habit, on=["y", "c", "s"], how="left")
    gm = pj.groupby(["c", "s"])["h"].mean().rename("gm").reset_index()
    pj = pj.merge(gm, on=["c", "s"], how="left")
    pj["flag"] = pj["h"].isna()
    pj["h"] = pj["h"].fillna(pj["gm"]).fillna(habit["h"].mean())
    want = sorted((int(r.y), r.c, r.s, round(r.h, 9), bool(r.flag)) for r in pj.itertuples())

    sb = spark.createDataFrame(base)
    sh = spark.createDataFrame(habit)
    left = sb.join(sh, ["y", "c", "s"], "left")
    from pyspark.sql import functions as F
    out = impute_group_mean(left, "h", ["c", "s"], fallback=sh.agg(F.avg("h")).scalar(),
                            flag_col="flag", required=["o", "h"])
    got = sorted((int(r["y"]), r["c"], r["s"], round(r["h"], 9), r["flag"]) for r in out.collect())
    assert got == want


def test_fold_metrics_match_numpy(spark):
    from prevalens.plans.classification import fold_metrics
    rng = np.random.default_rng(21)
    rows = []
    for f in range(3):
        y = rng.integers(0, 2, 60)
        score = np.round(rng.random(60) * 0.6 + 0.4 * y, 2)
        pred = (score > 0.5).astype(int)
        rows += [(f, float(a), float(b), float(c)) for a, b, c in zip(y, pred, score)]
    pdf = pd.DataFrame(rows, columns=["fold", "label", "prediction", "score"])
    got = {r["fold"]: r for r in fold_metrics(spark.createDataFrame(pdf), ["fold"]).collect()}
    for f, g in pdf.groupby("fold"):
        y, p, s = g["label"].values, g["prediction"].values, g["score"].values
        tp, fp = ((y == 1) & (p == 1)).sum(), ((y == 0) & (p == 1)).sum()
        fn = ((y == 1) & (p == 0)).sum()
        prec, rec = tp / (tp + fp), tp / (tp + fn)
        assert abs(got[f]["accuracy"] - (y == p).mean()) < 1e-12
        assert abs(got[f]["precision"] - prec) < 1e-12 and abs(got[f]["recall"] - rec) < 1e-12
        assert abs(got[f]["f1"] - 2 * prec * rec / (prec + rec)) < 1e-12
        pos, neg = s[y == 1], s[y == 0]
        auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) \
            / (len(pos) * len(neg))
        assert abs(got[f]["auc"] - auc) < 1e-12


def test_hash_folds_match_python_md5(spark):
    import hashlib
    from prevalens.operators.windows import hash_folds
    keys = [(1996 + i % 5, f"cat{i % 3}", f"s{i}") for i in range(200)]
    df = spark.createDataFrame(keys, "y int, c string, s string")
    got = {(r["y"], r["c"], r["s"]): r["fold"] for r in hash_folds(df, ["y", "c", "s"], 5, 42).collect()}
    for y, c, s in keys:
        h = int(hashlib.md5(f"42|{y}|{c}|{s}".encode()).hexdigest()[:7], 16)
        assert got[(y, c, s)] == h % 5
