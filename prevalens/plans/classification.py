"""Classification job: high/low label by median, four classifiers, stratified CV.

Design:

* the labelled table (national keys, features, label) is built with joins and
  a scalar-subquery median, then checkpointed once: every fit and metric job
  reads that small table instead of re-running the joins;
* the fits are order-free sums over the rows: logistic regression and linear SVM
  by Newton steps (``linear_fits``), decision tree and random forest level by level
  (``exact_trees``).  A step or level serves the models of all folds and of the whole
  data in one pass, and the same rows give the same models whatever their layout;
* held-out predictions of all classifiers are unioned with ``classifier`` and ``fold``
  columns and scored in one aggregate (accuracy / F1 / AUC per fold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import round_half_even
from ..operators import filters as flt
from ..operators import windows
from ..session import materialize
from . import eda, exact_trees, linear_fits
from .regression import standardize

CLASSIFIERS = ("Logistic Regression", "Decision Tree", "Random Forest", "Linear SVM")


# -- dataset ---------------------------------------------------------------------------

def one_hot_drop_first(df: DataFrame, col: str, prefix: str, levels: list | None = None) -> tuple:
    """0/1 columns ``<prefix>_<level>`` for every sorted level but the first.

    The level list is the category domain (a handful of values); it is read
    with one small distinct job when not given.
    """
    if levels is None:
        levels = sorted(r[0] for r in df.select(col).distinct().collect() if r[0] is not None)
    names = []
    for lv in levels[1:]:
        name = f"{prefix}_{lv}"
        df = df.withColumn(name, (F.col(col) == F.lit(lv)).cast("double"))
        names.append(name)
    return df, names


def build_labeled(outcome, driver, habit, spec, *, with_habit: bool) -> tuple:
    """(table, feature names): joined complete cases, label = outcome > median, dummies."""
    df = (eda.join_three(outcome, driver, habit, spec) if with_habit
          else eda.join_two(outcome, driver, spec))
    # checkpoint the labelled rows once: the category domain, the scaling
    # statistics and the folds below then read this small table instead of
    # re-running the joins and the median subquery for each of them
    df = materialize(flt.binary_label(df, spec.outcome_col, spec.label))
    df, dummies = one_hot_drop_first(df, spec.category, "Strat")
    behaviour = [spec.driver_col] + ([spec.habit_score] if with_habit else [])
    return df, behaviour + dummies


def prepare(df: DataFrame, features: list, spec, k: int = 5, seed: int = 42) -> DataFrame:
    """Standardise features (population std, all rows) into the array ``x``, add stratified
    folds, and checkpoint the small result."""
    scaled = standardize(df, features, "__z")
    scaled = windows.stratified_folds(scaled, spec.label, spec.national_keys, k, seed)
    return materialize(scaled.select(
        *spec.national_keys, spec.category, F.array(*[F.col(f"{c}__z") for c in features]).alias("x"),
        F.col(spec.label).cast("double").alias("label"), "fold"))


# -- fits --------------------------------------------------------------------------------

TREE_DEPTH = 5
FOREST_TREES = 100
_LOSS = {"Logistic Regression": "logistic", "Linear SVM": "squared_hinge"}


def fit_predict(name: str, data: DataFrame, n_features: int, keys: list, k: int = 5, seed: int = 42,
                C: float = 1.0) -> dict:
    """One classifier on all folds and on all rows: held-out and training predictions with
    fold, label, prediction, score, and what was learnt (coefficients or nodes)."""
    if name in _LOSS:
        loss = _LOSS[name]
        coefs, report = linear_fits.fit(data, n_features + 1, loss, k, C)
        held, full = linear_fits.scored(data, coefs, loss, k)
        return {"cv_pred": held, "pred": full, "coefs": coefs, "report": report}
    if name == "Decision Tree":
        nodes, routed = exact_trees.grow(exact_trees.fold_rows(data, k), TREE_DEPTH)
        found = exact_trees.leaf_scores(nodes, routed).select(
            F.col("model").alias("of"), "fold", "label", F.col("prob").alias("score"))
        own = nodes.where(F.col("model") == k)
    elif name == "Random Forest":
        some = max(1, int(n_features ** 0.5))
        rows = exact_trees.forest_rows(data, F.concat_ws("|", *keys), FOREST_TREES, k, seed)
        nodes, routed = exact_trees.grow(rows, None, some, seed)
        found = exact_trees.leaf_scores(nodes, routed).groupBy("of", *keys, "fold", "label").agg(
            F.avg("prob").alias("score"))
        own = nodes.where(F.col("model") >= k * FOREST_TREES)
    else:
        raise ValueError(name)
    # label 1 needs more than half, as a majority among the classes in order does
    found = materialize(found.withColumn("prediction", (F.col("score") > 0.5).cast("double")))
    cols = ["fold", "label", "prediction", "score"]
    return {"cv_pred": found.where(F.col("of") == F.col("fold")).select(*cols),
            "pred": found.where(F.col("of") == k).select(*cols), "nodes": own}


# -- metrics ---------------------------------------------------------------------------

def fold_metrics(pred: DataFrame, group_cols: list) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on zero division) and AUC per group, one pass."""
    y, p = F.col("label"), F.col("prediction")
    counts = pred.groupBy(*group_cols).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))
    auc = windows.auc_by_group(pred, "label", "score", group_cols)
    z = lambda num, den: F.coalesce(F.try_divide(num, F.nullif(den, F.lit(0))), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    prec, rec = z(tp, tp + fp), z(tp, tp + fn)
    return counts.join(auc, group_cols).select(
        *group_cols, "tp", "fp", "tn", "fn",
        z(tp + tn, tp + tn + fp + fn).alias("accuracy"), prec.alias("precision"),
        rec.alias("recall"), z(2 * tp, 2 * tp + fp + fn).alias("f1"), "auc")


def run_dataset(data: DataFrame, n_features: int, keys: list, classifiers=CLASSIFIERS, k: int = 5,
                seed: int = 42) -> list:
    """All classifiers with cross-validation and on all rows; two scoring jobs for all of them."""
    fits = {c: fit_predict(c, data, n_features, keys, k, seed) for c in classifiers}

    def tagged(which: str) -> DataFrame:
        parts = [fits[c][which].select(F.lit(c).alias("classifier"), "fold", "label", "prediction", "score")
                 for c in classifiers]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return materialize(out)

    per_fold = fold_metrics(tagged("cv_pred"), ["classifier", "fold"])
    cv_rows = {r["classifier"]: r for r in per_fold.groupBy("classifier").agg(
        *[f(c).alias(f"{c}_{s}") for c in ("accuracy", "f1", "auc")
          for s, f in (("mean", F.avg), ("std", F.stddev_pop))]).collect()}
    train_rows = {r["classifier"]: r for r in fold_metrics(tagged("pred"), ["classifier"]).collect()}
    return [{"name": c, **fits[c], "cv": cv_rows[c], "train": train_rows[c]} for c in classifiers]


def linear_models(results: list, features: list, spark) -> DataFrame:
    """(classifier, model, term, coef): coefficients of every fold's model and of all rows (``full``)."""
    rows = [(r["name"], "full" if m == max(r["coefs"]) else f"without fold {m}", term, float(v))
            for r in results if "coefs" in r for m, w in r["coefs"].items()
            for term, v in zip(["Intercept", *features], w)]
    return spark.createDataFrame(rows, "classifier string, model string, term string, coef double")


def convergence(results: list, spark) -> DataFrame:
    """(classifier, model, steps, n_rows, objective, gradient, converged) of the linear fits."""
    rows = [(r["name"], "full" if m == max(r["coefs"]) else f"without fold {m}", steps, n, float(obj), float(g), bool(ok))
            for r in results if "coefs" in r for m, steps, n, obj, g, ok in r["report"]]
    return spark.createDataFrame(rows, "classifier string, model string, steps int, n_rows long, objective double, "
                                       "gradient double, converged boolean")


def results_table(spark, results: list) -> DataFrame:
    """One row per classifier: CV mean/std of accuracy, F1, AUC; train metrics (4 dp)."""
    rows = []
    for r in results:
        cv, tr = r["cv"], r["train"]
        rows.append((r["name"], cv["accuracy_mean"], cv["accuracy_std"], cv["f1_mean"],
                     cv["f1_std"], cv["auc_mean"], cv["auc_std"], tr["accuracy"],
                     tr["precision"], tr["recall"], tr["f1"]))
    cols = ["Classifier", "CV_Accuracy", "CV_Acc_Std", "CV_F1", "CV_F1_Std", "CV_AUC",
            "CV_AUC_Std", "Train_Acc", "Precision", "Recall", "F1"]
    df = spark.createDataFrame(rows, "Classifier string, " + ", ".join(f"{c} double" for c in cols[1:]))
    return df.select("Classifier", *[round_half_even(c, 4).alias(c) for c in cols[1:]])


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """2 x 2 counts, actual label rows x predicted columns, fixed label order."""
    return (pred.groupBy(F.col("label").cast("int").alias("actual"))
            .pivot("prediction", [0.0, 1.0]).count().na.fill(0)
            .withColumnRenamed("0.0", "pred_0").withColumnRenamed("1.0", "pred_1"))


def confusion_matrices(results: list, tag: str) -> DataFrame:
    """Confusion matrices of all classifiers of a data set, tagged, from one aggregate."""
    tagged = _tagged(results, tag)
    return (tagged.groupBy("dataset", "classifier", F.col("label").cast("int").alias("actual"))
            .agg(F.count_if(F.col("prediction") == 0).alias("pred_0"),
                 F.count_if(F.col("prediction") == 1).alias("pred_1")))


def roc_curves(results: list, tag: str) -> DataFrame:
    """ROC points of all classifiers of a data set, tagged."""
    parts = [windows.roc_curve(r["pred"], "label", "score").select(
        F.lit(tag).alias("dataset"), F.lit(r["name"]).alias("classifier"), "*") for r in results]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tagged(results: list, tag: str) -> DataFrame:
    parts = [r["pred"].select(F.lit(tag).alias("dataset"), F.lit(r["name"]).alias("classifier"),
                              "label", "prediction", "score") for r in results]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_importance(nodes: DataFrame, features: list) -> DataFrame:
    """Gini importances of a tree or forest (sum to 1)."""
    return exact_trees.importances(nodes, features).select(
        "feature", round_half_even("importance", 4).alias("importance"))


def tree_rules(nodes: DataFrame, features: list, max_depth: int = 3) -> DataFrame:
    """The decision tree as a table of nodes down to ``max_depth``."""
    return exact_trees.node_table(nodes, features, max_depth)


def classification_job(outcome, driver, habit, spec) -> dict:
    spark = outcome.sparkSession
    out = {}
    for tag, with_habit in (("A", False), ("B", True)):
        labeled, feats = build_labeled(outcome, driver, habit, spec, with_habit=with_habit)
        data = prepare(labeled, feats, spec)
        res = run_dataset(data, len(feats), spec.national_keys)
        out[f"results_{tag}"] = results_table(spark, res)
        byname = {r["name"]: r for r in res}
        out[f"confusion_{tag}"] = confusion_matrices(res, tag)
        out[f"importance_{tag}"] = feature_importance(byname["Random Forest"]["nodes"], feats)
        out[f"tree_{tag}"] = tree_rules(byname["Decision Tree"]["nodes"], feats)
        out[f"convergence_{tag}"] = convergence(res, spark)
        out[f"roc_{tag}"] = roc_curves(res, tag)
    return out
