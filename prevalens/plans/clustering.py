"""Clustering job: imputation, K-Means sweep, PCA, profiles, crosstabs, labels.

* imputation is the group mean over the joined rows (an aggregate joined back
  on the strata keys, so no stratum is gathered into one task) plus a scalar
  fallback;
* the feature table is standardised, assembled and checkpointed once; its distinct
  points feed every K-Means start;
* K-Means is ``plans/kmeans.py``: hash-seeded starts and whole-number sums, so a model
  depends on the rows and not on their layout; "best of n starts" = lowest cost over
  ``n_init`` seeds, all starts sharing each pass;
* the sweep reports two silhouettes: the plain-Euclidean one (``plans/silhouette.py``, pairwise
  distances summed inside tasks, all k in one pass), which chooses k, and
  ``ClusteringEvaluator``'s squared-Euclidean one, an exact O(n k) aggregate.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import round_half_even
from ..operators import aggregates as agg
from ..operators import windows
from ..session import materialize
from . import eda, kmeans
from .regression import standardize
from .silhouette import silhouettes

# --- fixed values: display names of the canonical cluster types ---
LABEL_HIGH, LABEL_LOW, LABEL_MODERATE, LABEL_PARADOX = "High Risk", "Low Risk", "Moderate", "Paradox"
# --- end of fixed values ------------------------------------------


def build_imputed(outcome, driver, habit, spec) -> DataFrame:
    """Outcome x driver (inner) left-joined with the habit score; missing habit is
    filled from its (category, stratum) mean over the joined rows, then from the
    habit table's global mean; ``<habit>_imputed`` flags filled rows."""
    left = eda.join_left(outcome, driver, habit, spec)
    global_mean = habit.agg(F.avg(spec.habit_score)).scalar()
    return windows.impute_group_mean(
        left, spec.habit_score, spec.strata_keys, fallback=global_mean,
        flag_col=f"{spec.habit_score}_imputed",
        required=[spec.outcome_col, spec.driver_col, spec.habit_score])


def features_of(spec) -> list:
    return [spec.outcome_col, spec.driver_col, spec.habit_score]


def prepare(imputed: DataFrame, spec) -> DataFrame:
    """Standardised feature vector (population std), checkpointed."""
    feats = features_of(spec)
    scaled = standardize(imputed, feats, "__z")
    asm = VectorAssembler(inputCols=[f"{c}__z" for c in feats], outputCol="features")
    return materialize(asm.transform(scaled).drop(*[f"{c}__z" for c in feats]))


def silhouette_squared(pred: DataFrame) -> float:
    """Silhouette with squared Euclidean distances (not comparable with the plain one)."""
    return ClusteringEvaluator(featuresCol="features", predictionCol="prediction",
                               distanceMeasure="squaredEuclidean").evaluate(pred)


def kmeans_sweep(data: DataFrame, ks=range(2, 9), n_init: int = 10, seed: int = 42) -> DataFrame:
    """k, inertia (within-cluster SS of the best start), silhouette, silhouette_squared."""
    ks = list(ks)
    best = kmeans.best_starts(kmeans.fit_starts(kmeans.weighted_points(data), ks, n_init, seed))
    labelled = data
    for k in ks:
        labelled = kmeans.assign(labelled, best[k].centers, f"__k{k}")
    plain = {r["labelling"]: r["silhouette"]                      # one row per k
             for r in silhouettes(labelled, [f"__k{k}" for k in ks]).collect()}
    rows = [(int(k), float(best[k].cost), plain[f"__k{k}"],
             float(silhouette_squared(kmeans.assign(data, best[k].centers, "prediction"))))
            for k in ks]
    df = data.sparkSession.createDataFrame(
        rows, "k int, inertia double, silhouette double, silhouette_squared double")
    return df.select("k", *[round_half_even(c, 4).alias(c) for c in df.columns[1:]])


def best_k(sweep: DataFrame) -> DataFrame:
    """The k with the best plain silhouette (smallest k on ties)."""
    from ..operators.ordering import best_by
    return best_by(sweep, "silhouette", "k")


def fit_clusters(data: DataFrame, k: int, n_init: int = 20, seed: int = 42) -> DataFrame:
    """``data`` with its ``Cluster`` (numbered by the centres' coordinates)."""
    best = kmeans.best_starts(kmeans.fit_starts(kmeans.weighted_points(data), [k], n_init, seed))[k]
    return kmeans.assign(data, best.centers, "Cluster")


def pca2(clustered: DataFrame) -> tuple:
    """Two principal components of the standardised features; each component's
    sign is fixed so its largest-magnitude loading is positive."""
    model = PCA(k=2, inputCol="features", outputCol="pcs").fit(clustered)
    loadings = model.pc.toArray()                       # p x 2
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] >= 0 else -1.0
             for j in range(2)]
    arr = vector_to_array(F.col("pcs"))
    out = (model.transform(clustered)
           .withColumn("PCA1", arr[0] * F.lit(signs[0]))
           .withColumn("PCA2", arr[1] * F.lit(signs[1])).drop("pcs"))
    return out, [float(v) for v in model.explainedVariance.toArray()]


def model_table(spark, k: int, explained: list) -> DataFrame:
    """One row per component: the chosen k and the component's explained variance ratio."""
    rows = [(int(k), i + 1, float(v)) for i, v in enumerate(explained)]
    return spark.createDataFrame(rows, "k int, component int, explained_ratio double")


def profiles(clustered: DataFrame, spec, digits: int = 2) -> DataFrame:
    return clustered.groupBy("Cluster").agg(
        *[round_half_even(F.avg(c), digits).alias(c) for c in features_of(spec)])


def canonical_labels(profile: DataFrame, spec) -> DataFrame:
    """Name clusters by their profile instead of by arbitrary id: highest
    outcome = high risk; lowest outcome = paradox when its habit score is above
    the lowest cluster's, else low risk; lowest driver = low risk; rest moderate.
    The profile has one row per cluster (k rows)."""
    o, d, h = spec.outcome_col, spec.driver_col, spec.habit_score
    w = Window.partitionBy()
    p = (profile.withColumn("max_o", F.max(o).over(w)).withColumn("min_o", F.min(o).over(w))
         .withColumn("min_d", F.min(d).over(w)).withColumn("min_h", F.min(h).over(w)))
    name = (F.when(F.col(o) == F.col("max_o"), LABEL_HIGH)
            .when((F.col(o) == F.col("min_o")) & (F.col(h) > F.col("min_h")), LABEL_PARADOX)
            .when((F.col(o) == F.col("min_o")) | (F.col(d) == F.col("min_d")), LABEL_LOW)
            .otherwise(LABEL_MODERATE))
    return p.select("Cluster", o, d, h, name.alias("label"))


def crosstab(clustered: DataFrame, spec, k: int) -> DataFrame:
    """Share of each category's rows in each cluster (rows sum to 1)."""
    return agg.crosstab_normalized(clustered, spec.category, "Cluster", list(range(k)),
                                   prefix="cluster_")


def composition(clustered: DataFrame, spec, categories: list) -> DataFrame:
    """Share of each cluster's rows coming from each category."""
    return agg.crosstab_normalized(clustered, "Cluster", spec.category, categories)


def cluster_job(outcome, driver, habit, spec, *, k: int | None = None,
                ks=range(2, 9)) -> dict:
    data = prepare(build_imputed(outcome, driver, habit, spec), spec)
    out = {}
    if k is None:
        sweep = kmeans_sweep(data, ks)
        out["sweep"] = sweep
        k = best_k(sweep).first()["k"]
    clustered = fit_clusters(data, k)
    clustered, explained = pca2(clustered)
    clustered = materialize(clustered.drop("features"))
    prof = profiles(clustered, spec)
    cats = sorted(r[0] for r in clustered.select(spec.category).distinct().collect())
    out.update({"k": k, "clustered": clustered, "profiles": prof,
                "labels": canonical_labels(prof, spec),
                "sizes": agg.value_counts(clustered, "Cluster"),
                "crosstab": crosstab(clustered, spec, k),
                "composition": composition(clustered, spec, cats),
                "explained": explained, "model": model_table(data.sparkSession, k, explained)})
    return out
