"""Logistic regression and linear SVM as Newton steps over sufficient statistics.

A step needs the loss, its gradient and its second derivatives at the current
coefficients: sums over the rows.  One aggregate gives them for the models of all
folds and of the whole data at once (a row belongs to every model but its own
fold's), so a step is one job whatever the number of folds, nothing depends
on the layout of the rows, and what reaches the driver is models x features**2
numbers.

* Logistic: half the squared coefficients without the intercept plus C times the
  log loss.
* SVM: half the squared coefficients, intercept included, plus C times the
  squared hinge.

Both are convex with a positive definite second derivative.  A step that raises
the objective is halved.  A model is done when no component of the gradient
exceeds ``tol`` times the number of its rows (or steps no longer change the
objective); the report says whether that was reached.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSSES = ("logistic", "squared_hinge")
MAX_STEPS = 100
TOL = 1e-10


def _dot(w: Column, p: int) -> Column:
    out = w[0]
    for i in range(1, p):
        out = out + w[i] * F.col("x")[i - 1]
    return out


def _terms(loss: str, z: Column, y: Column) -> tuple:
    """(loss, first, second derivative by the margin) of a row."""
    if loss == "logistic":
        prob = 1 / (1 + F.exp(-z))
        return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - y * z, prob - y, prob * (1 - prob)
    t = 2 * y - 1
    q = F.greatest(1 - t * z, F.lit(0.0))
    return q * q, -2 * t * q, F.when(q > 0, 2.0).otherwise(0.0)


def _sums(data: DataFrame, coefs: dict, loss: str, p: int) -> dict:
    """model -> (rows, loss, gradient, second derivatives), one job for all models."""
    every = F.array(*[F.struct(F.lit(m).alias("m"), F.array(*[F.lit(float(v)) for v in w]).alias("w"))
                      for m, w in coefs.items()])
    rows = (data.select("x", F.col("label").alias("y"), "fold", F.explode(every).alias("of"))
            .where(F.col("of.m") != F.coalesce("fold", F.lit(-1)))
            .select("x", "y", F.col("of.m").alias("m"), _dot(F.col("of.w"), p).alias("z")))
    value, first, second = _terms(loss, F.col("z"), F.col("y"))
    rows = rows.select("m", "x", value.alias("v"), first.alias("d"), second.alias("h"))
    x = [F.lit(1.0)] + [F.col("x")[i] for i in range(p - 1)]
    found = rows.groupBy("m").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"),
        *[F.sum(F.col("d") * x[i]).alias(f"g{i}") for i in range(p)],
        *[F.sum(F.col("h") * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i + 1)]).collect()
    out = {}
    for r in found:
        h = np.zeros((p, p))
        for i in range(p):
            for j in range(i + 1):
                h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        out[r["m"]] = (r["n"], r["v"], np.array([r[f"g{i}"] for i in range(p)]), h)
    return out


def fit(data: DataFrame, p: int, loss: str = "logistic", k: int = 5, C: float = 1.0, tol: float = TOL,
        max_steps: int = MAX_STEPS) -> tuple:
    """(model -> coefficients, report rows); model 0 ... k - 1 leaves out that fold, model k nothing.

    ``data`` has ``x`` (array of p - 1 numbers), ``label`` (0.0 or 1.0) and ``fold``.
    The first coefficient is the intercept.  A report row is (model, steps, rows,
    objective, largest gradient component, converged).  A model without rows has
    zero coefficients.
    """
    if loss not in LOSSES:
        raise ValueError(loss)
    ridge = np.ones(p)
    if loss == "logistic":
        ridge[0] = 0.0
    best = {m: (np.zeros(p), np.inf, None, None) for m in range(k + 1)}       # w, objective, step, gradient
    trial = {m: np.zeros(p) for m in best}
    report = {m: (m, 0, 0, 0.0, 0.0, True) for m in best}
    for step in range(1, max_steps + 1):
        if not trial:
            break
        found = _sums(data, trial, loss, p)
        following = {}
        for m, w in trial.items():
            if m not in found:
                continue
            n, value, g, h = found[m]
            objective = C * value + 0.5 * float(ridge @ (w * w))
            gradient = C * g + ridge * w
            old_w, old, move, _ = best[m]
            if objective > old:
                move = move / 2
                if np.abs(move).max() > 1e-14 * (1 + np.abs(old_w).max()):
                    best[m] = (old_w, old, move, best[m][3])
                    following[m] = old_w + move
                else:
                    size = float(np.abs(best[m][3]).max())
                    report[m] = (m, step, n, old, size, size <= max(tol, 1e-9) * n)
                continue
            size = float(np.abs(gradient).max())
            report[m] = (m, step, n, objective, size, size <= tol * n)
            move = -np.linalg.solve(C * h + np.diag(ridge) + 1e-300 * np.eye(p), gradient)
            best[m] = (w, objective, move, gradient)
            if size > tol * n:
                following[m] = w + move
        trial = following
    return {m: b[0] for m, b in best.items()}, [report[m] for m in sorted(report)]


def margin(coefs: np.ndarray) -> Column:
    """Intercept plus coefficients times ``x``."""
    return _dot(F.array(*[F.lit(float(v)) for v in coefs]), len(coefs))


def score(loss: str, z: Column) -> Column:
    """Probability of label 1, or the margin itself for the SVM."""
    return 1 / (1 + F.exp(-z)) if loss == "logistic" else z


def scored(data: DataFrame, coefs: dict, loss: str, k: int = 5) -> tuple:
    """(held-out rows, all rows), each with fold, label, prediction and score."""
    def with_(z: Column) -> DataFrame:
        return data.select("fold", "label", (z > 0).cast("double").alias("prediction"),
                           score(loss, z).alias("score"))

    own = F.lit(None).cast("double")
    for m in range(k):
        own = F.when(F.col("fold") == m, margin(coefs[m])).otherwise(own)
    return with_(own).where("fold is not null"), with_(margin(coefs[k]))
