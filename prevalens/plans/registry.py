"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query starts from the TPC-H-style tables of ``sf_dir`` through the
survey view, so its work grows with them.  Final double columns are rounded
half-even (4 dp unless the operator itself rounds) so the DuckDB oracle and
Spark agree regardless of summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FIXTURE_SURVEY as SPEC
from ..operators import aggregates as agg
from ..operators import filters as flt
from ..sources.fixture import survey_view
from ..sources.profile import profile_source
from . import clean

MIN_SAMPLE = 10.0   # documented sf0.01 threshold of the fixture (FIXTURES.md section 3)

QUERIES: dict = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Half-even round every double column (presentation for the oracle compare)."""
    return df.select(*[F.bround(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


# -- shared inputs ------------------------------------------------------------------

def raw_survey(spark: SparkSession, sf_dir: str, raw_columns: bool = False) -> DataFrame:
    return survey_view(spark, sf_dir, raw_columns=raw_columns)


def tables(spark: SparkSession, sf_dir: str) -> dict:
    """The clean step's six tables over a checkpointed survey view.

    The long survey table is the output of the grouping-sets aggregate, so its
    size is set by the key domain, not by lineitem.  Writing it once to the
    shared checkpoint folder means every branch of a plan (three classes,
    joins back, model fits) reads that small table: the raw-table joins run
    exactly once per query, and a lost executor never re-runs them.
    """
    from ..session import materialize
    return clean.clean_tables(materialize(raw_survey(spark, sf_dir)), SPEC, min_sample=MIN_SAMPLE,
                              validate=False)


def nationals(spark: SparkSession, sf_dir: str) -> tuple:
    t = tables(spark, sf_dir)
    return t["outcome_national"], t["driver_national"], t["habit_national"]


# -- A: sources ----------------------------------------------------------------------

@register("survey_view")
def q_survey_view(spark, sf_dir):
    return rounded(raw_survey(spark, sf_dir))


@register("profile_source")
def q_profile_source(spark, sf_dir):
    return profile_source(raw_survey(spark, sf_dir), class_col=SPEC.klass,
                          location_col=SPEC.location, year_col=SPEC.year)


# -- B: filters ----------------------------------------------------------------------

@register("validation_report")
def q_validation_report(spark, sf_dir):
    return flt.validation_report(raw_survey(spark, sf_dir), value_col=SPEC.value,
                                 sample_col=SPEC.sample_size, year_col=SPEC.year,
                                 required=[SPEC.klass], value_range=SPEC.value_range,
                                 year_range=SPEC.year_range)


@register("min_sample_filter")
def q_min_sample_filter(spark, sf_dir):
    kept, _, _ = flt.drop_columns(raw_survey(spark, sf_dir, raw_columns=True), SPEC.drop_columns)
    return rounded(flt.filter_min_sample(kept, SPEC.sample_size, MIN_SAMPLE))


@register("clean_report")
def q_clean_report(spark, sf_dir):
    """What the clean step drops, misses and finds at fault, counted in the pass that writes its long table."""
    return clean.written_long(raw_survey(spark, sf_dir, raw_columns=True), SPEC, min_sample=MIN_SAMPLE)[1]


@register("class_split_counts")
def q_class_split_counts(spark, sf_dir):
    kept = flt.filter_min_sample(raw_survey(spark, sf_dir), SPEC.sample_size, MIN_SAMPLE)
    patterns = {g.label.lower(): g.class_pattern for g in (SPEC.outcome, SPEC.driver, SPEC.habit)}
    return flt.class_split_counts(kept, SPEC.klass, patterns)


# -- D: pivots and national roll-ups -------------------------------------------------

@register("state_outcome")
def q_state_outcome(spark, sf_dir):
    return rounded(tables(spark, sf_dir)["outcome_state"])


@register("state_driver")
def q_state_driver(spark, sf_dir):
    return rounded(tables(spark, sf_dir)["driver_state"])


@register("state_habit")
def q_state_habit(spark, sf_dir):
    return rounded(tables(spark, sf_dir)["habit_state"])


@register("national_outcome")
def q_national_outcome(spark, sf_dir):
    return rounded(nationals(spark, sf_dir)[0])


@register("national_driver")
def q_national_driver(spark, sf_dir):
    return rounded(nationals(spark, sf_dir)[1])


@register("national_habit")
def q_national_habit(spark, sf_dir):
    return rounded(nationals(spark, sf_dir)[2])


# -- C: joins -----------------------------------------------------------------------

from . import charts, eda  # noqa: E402
from ..functions import stats  # noqa: E402
from ..operators import joins  # noqa: E402


def datasets(spark, sf_dir, nat=None):
    o, d, h = nat or nationals(spark, sf_dir)
    return {
        "od": eda.join_two(o, d, SPEC),
        "odh": eda.join_three(o, d, h, SPEC),
        "odhx": eda.join_three(o, d, h, SPEC, [SPEC.habit_score] + SPEC.habit_parts),
        "left": eda.join_left(o, d, h, SPEC),
        "o": o, "d": d, "h": h,
    }


@register("join_outcome_driver")
def q_join_outcome_driver(spark, sf_dir):
    return rounded(datasets(spark, sf_dir)["od"])


@register("join_three")
def q_join_three(spark, sf_dir):
    return rounded(datasets(spark, sf_dir)["odh"])


@register("join_left_habit")
def q_join_left_habit(spark, sf_dir):
    return rounded(datasets(spark, sf_dir)["left"])


@register("join_yearly")
def q_join_yearly(spark, sf_dir):
    return eda.dual_series(*nationals(spark, sf_dir)[:2], SPEC)


@register("attach_group_mean")
def q_attach_group_mean(spark, sf_dir):
    left = datasets(spark, sf_dir)["left"]
    return rounded(joins.attach_group_mean(left, SPEC.strata_keys, SPEC.habit_score, "GroupMean"))


# -- D / F / I / J: EDA ---------------------------------------------------------------

@register("yearly_trend_outcome")
def q_yearly_trend_outcome(spark, sf_dir):
    return eda.yearly_trend(nationals(spark, sf_dir)[0], SPEC, SPEC.outcome_col)


@register("yearly_trend_driver")
def q_yearly_trend_driver(spark, sf_dir):
    return eda.yearly_trend(nationals(spark, sf_dir)[1], SPEC, SPEC.driver_col)


@register("first_last_change")
def q_first_last_change(spark, sf_dir):
    return eda.change_over_period(nationals(spark, sf_dir)[0], SPEC, SPEC.outcome_col)


@register("latest_period")
def q_latest_period(spark, sf_dir):
    return rounded(flt.latest_period(nationals(spark, sf_dir)[0], SPEC.year))


@register("category_spread_latest")
def q_category_spread_latest(spark, sf_dir):
    return eda.spread_latest(nationals(spark, sf_dir)[0], SPEC, SPEC.outcome_col)


@register("category_summary")
def q_category_summary(spark, sf_dir):
    return agg.category_summary(nationals(spark, sf_dir)[0], SPEC.category, SPEC.outcome_col)


@register("indicator_summary")
def q_indicator_summary(spark, sf_dir):
    return eda.indicator_summary(*nationals(spark, sf_dir), SPEC)


@register("describe_combined")
def q_describe_combined(spark, sf_dir):
    return agg.describe(datasets(spark, sf_dir)["odh"],
                        [SPEC.outcome_col, SPEC.driver_col, SPEC.habit_score])


@register("global_moments")
def q_global_moments(spark, sf_dir):
    return agg.global_moments(nationals(spark, sf_dir)[0], SPEC.outcome_col,
                              category_col=SPEC.category, total_value=SPEC.total_category)


@register("group_median_order")
def q_group_median_order(spark, sf_dir):
    seg = flt.equals(nationals(spark, sf_dir)[0], SPEC.category, "Segment")
    return rounded(agg.group_median_order(seg, SPEC.stratum, SPEC.outcome_col))


@register("group_mean_habit")
def q_group_mean_habit(spark, sf_dir):
    return rounded(agg.group_mean(nationals(spark, sf_dir)[2], SPEC.strata_keys, SPEC.habit_score))


@register("value_counts_category")
def q_value_counts_category(spark, sf_dir):
    return agg.value_counts(datasets(spark, sf_dir)["od"], SPEC.category)


@register("missing_report")
def q_missing_report(spark, sf_dir):
    return agg.missing_report(datasets(spark, sf_dir)["left"],
                              [SPEC.outcome_col, SPEC.driver_col, SPEC.habit_score])


@register("distinct_years")
def q_distinct_years(spark, sf_dir):
    return agg.distinct_sorted(nationals(spark, sf_dir)[2], [SPEC.year])


@register("histogram_outcome")
def q_histogram_outcome(spark, sf_dir):
    return charts.histogram(nationals(spark, sf_dir)[0], SPEC.outcome_col, 35)


@register("histogram_outcome_total")
def q_histogram_outcome_total(spark, sf_dir):
    return charts.histogram(eda.total_rows(nationals(spark, sf_dir)[0], SPEC), SPEC.outcome_col, 20)


@register("kde_outcome")
def q_kde_outcome(spark, sf_dir):
    return charts.kde(nationals(spark, sf_dir)[0], SPEC.outcome_col)


@register("box_stats_outcome")
def q_box_stats_outcome(spark, sf_dir):
    return eda.strata_boxes(nationals(spark, sf_dir)[0], SPEC, SPEC.outcome_col)


@register("habit_rates_total")
def q_habit_rates_total(spark, sf_dir):
    return eda.habit_rates(nationals(spark, sf_dir)[2], SPEC)


@register("habit_vs_outcome")
def q_habit_vs_outcome(spark, sf_dir):
    o, _, h = nationals(spark, sf_dir)
    return eda.habit_vs_outcome(h, o, SPEC)


@register("corr_matrix")
def q_corr_matrix(spark, sf_dir):
    return stats.corr_matrix(datasets(spark, sf_dir)["odh"],
                             [SPEC.outcome_col, SPEC.driver_col, SPEC.habit_score])


@register("pearson_overall")
def q_pearson_overall(spark, sf_dir):
    return stats.pearson_test(datasets(spark, sf_dir)["od"], SPEC.outcome_col, SPEC.driver_col)


@register("grouped_pearson")
def q_grouped_pearson(spark, sf_dir):
    return stats.grouped_pearson_test(datasets(spark, sf_dir)["od"], SPEC.category,
                                      SPEC.outcome_col, SPEC.driver_col)


@register("time_trend_tests")
def q_time_trend_tests(spark, sf_dir):
    return eda.time_trend_tests(datasets(spark, sf_dir)["od"], SPEC)


@register("pairwise_tests")
def q_pairwise_tests(spark, sf_dir):
    return stats.pairwise_tests(datasets(spark, sf_dir)["odhx"], eda.combined_pairs(SPEC))


@register("vif")
def q_vif(spark, sf_dir):
    return eda.vif_report(datasets(spark, sf_dir)["odh"], SPEC)


@register("linear_trend")
def q_linear_trend(spark, sf_dir):
    yearly = agg.yearly_mean(eda.total_rows(nationals(spark, sf_dir)[0], SPEC), SPEC.year,
                             SPEC.outcome_col)
    return stats.linear_trend(yearly, SPEC.year, SPEC.outcome_col)


@register("shapiro_wilk")
def q_shapiro_wilk(spark, sf_dir):
    return eda.normality(*nationals(spark, sf_dir), SPEC)


@register("scatter_matrix")
def q_scatter_matrix(spark, sf_dir):
    return rounded(datasets(spark, sf_dir)["odh"].select(
        SPEC.outcome_col, SPEC.driver_col, SPEC.habit_score))


@register("fit_line")
def q_fit_line(spark, sf_dir):
    return charts.fit_line(datasets(spark, sf_dir)["od"], SPEC.driver_col, SPEC.outcome_col)


@register("residual_points")
def q_residual_points(spark, sf_dir):
    return charts.residual_points(datasets(spark, sf_dir)["od"], SPEC.driver_col,
                                  SPEC.outcome_col, SPEC.national_keys)


@register("qq_points")
def q_qq_points(spark, sf_dir):
    res = charts.residual_points(datasets(spark, sf_dir)["od"], SPEC.driver_col,
                                 SPEC.outcome_col, SPEC.national_keys, digits=None)
    return charts.qq_points(res, "residual")


# -- E / K: folds and regression ------------------------------------------------------

from . import regression  # noqa: E402
from ..operators import windows  # noqa: E402


@register("contiguous_folds")
def q_contiguous_folds(spark, sf_dir):
    folds = windows.contiguous_folds(datasets(spark, sf_dir)["odh"], SPEC.national_keys, 5)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@register("hash_folds")
def q_hash_folds(spark, sf_dir):
    od = datasets(spark, sf_dir)["od"]
    return windows.hash_folds(od, SPEC.national_keys, 5, 42).select(*SPEC.national_keys, "fold")


@register("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    od = flt.binary_label(datasets(spark, sf_dir)["od"], SPEC.outcome_col, SPEC.label)
    return windows.stratified_folds(od, SPEC.label, SPEC.national_keys, 5, 42).select(
        *SPEC.national_keys, SPEC.label, "fold")


@register("ols_outcome_driver")
def q_ols_outcome_driver(spark, sf_dir):
    return regression.ols(datasets(spark, sf_dir)["od"], SPEC.outcome_col, [SPEC.driver_col],
                          "Outcome ~ Driver")


@register("ols_outcome_habit")
def q_ols_outcome_habit(spark, sf_dir):
    return regression.ols(datasets(spark, sf_dir)["odh"], SPEC.outcome_col, [SPEC.habit_score],
                          "Outcome ~ Habit")


def _ridge(spark, sf_dir, nat=None):
    from ..session import materialize
    odh = materialize(datasets(spark, sf_dir, nat)["odh"])
    return odh, regression.ridge_cv(odh, SPEC.outcome_col, [SPEC.driver_col, SPEC.habit_score],
                                    SPEC.national_keys)


@register("ridge_cv")
def q_ridge_cv(spark, sf_dir):
    _, res = _ridge(spark, sf_dir)
    return regression.ridge_table(spark, res, [SPEC.driver_col, SPEC.habit_score],
                                  "Ridge Outcome ~ Driver + Habit")


@register("ridge_alpha_path")
def q_ridge_alpha_path(spark, sf_dir):
    _, res = _ridge(spark, sf_dir)
    path = spark.createDataFrame(res.alpha_path, "alpha double, cv_r2 double")
    return path.select(F.bround("alpha", 6).alias("alpha"), F.bround("cv_r2", 6).alias("cv_r2"))


@register("model_compare")
def q_model_compare(spark, sf_dir):
    odh, res = _ridge(spark, sf_dir)
    return regression.model_compare(odh, SPEC.outcome_col, [SPEC.driver_col, SPEC.habit_score],
                                    res.r2)


# -- L: classification ------------------------------------------------------------------

from . import classification as clf  # noqa: E402


def labeled(spark, sf_dir, with_habit: bool, nat=None):
    o, d, h = nat or nationals(spark, sf_dir)
    return clf.build_labeled(o, d, h, SPEC, with_habit=with_habit)


@register("labeled_dataset_a")
def q_labeled_dataset_a(spark, sf_dir):
    df, feats = labeled(spark, sf_dir, False)
    return rounded(df.select(*SPEC.national_keys, *feats, SPEC.label))


@register("labeled_dataset_b")
def q_labeled_dataset_b(spark, sf_dir):
    df, feats = labeled(spark, sf_dir, True)
    return rounded(df.select(*SPEC.national_keys, *feats, SPEC.label))


@register("class_balance")
def q_class_balance(spark, sf_dir):
    return agg.class_balance(labeled(spark, sf_dir, False)[0], SPEC.label)


@register("crosstab_category_label")
def q_crosstab_category_label(spark, sf_dir):
    return agg.crosstab_normalized(labeled(spark, sf_dir, False)[0], SPEC.category, SPEC.label,
                                   [0, 1], prefix="label_")


@register("roc_driver_score")
def q_roc_driver_score(spark, sf_dir):
    df = labeled(spark, sf_dir, False)[0]
    return rounded(windows.roc_curve(df, SPEC.label, SPEC.driver_col), 6)


@register("auc_driver_score")
def q_auc_driver_score(spark, sf_dir):
    df = labeled(spark, sf_dir, False)[0]
    return spark.range(1).select(
        F.bround(windows.auc_rank(df, SPEC.label, SPEC.driver_col), 6).alias("auc"))


def _classify(spark, sf_dir, with_habit, classifiers=clf.CLASSIFIERS, nat=None):
    df, feats = labeled(spark, sf_dir, with_habit, nat)
    data = clf.prepare(df, feats, SPEC)
    return data, feats, clf.run_dataset(data, len(feats), SPEC.national_keys, classifiers)


@register("classifier_report_a")
def q_classifier_report_a(spark, sf_dir):
    return clf.results_table(spark, _classify(spark, sf_dir, False)[2])


@register("classifier_report_b")
def q_classifier_report_b(spark, sf_dir):
    return clf.results_table(spark, _classify(spark, sf_dir, True)[2])


@register("confusion_matrix_logistic")
def q_confusion_matrix_logistic(spark, sf_dir):
    res = _classify(spark, sf_dir, False, ("Logistic Regression",))[2]
    return clf.confusion_matrix(res[0]["pred"])


@register("roc_curve_logistic")
def q_roc_curve_logistic(spark, sf_dir):
    res = _classify(spark, sf_dir, False, ("Logistic Regression",))[2]
    return rounded(windows.roc_curve(res[0]["pred"], "label", "score"), 6)


@register("confusion_matrices")
def q_confusion_matrices(spark, sf_dir):
    """All four classifiers on both data sets."""
    nat = nationals(spark, sf_dir)
    a, b = (clf.confusion_matrices(_classify(spark, sf_dir, habit, nat=nat)[2], tag)
            for tag, habit in (("A", False), ("B", True)))
    return a.unionByName(b)


@register("roc_curves")
def q_roc_curves(spark, sf_dir):
    """All four classifiers on both data sets."""
    nat = nationals(spark, sf_dir)
    a, b = (clf.roc_curves(_classify(spark, sf_dir, habit, nat=nat)[2], tag)
            for tag, habit in (("A", False), ("B", True)))
    return rounded(a.unionByName(b), 6)


@register("feature_importance_forest")
def q_feature_importance_forest(spark, sf_dir):
    _, feats, res = _classify(spark, sf_dir, False, ("Random Forest",))
    return clf.feature_importance(res[0]["nodes"], feats)


def _only(spark, sf_dir, with_habit, name, nat=None):
    """One classifier: (its result, feature names)."""
    _, feats, res = _classify(spark, sf_dir, with_habit, (name,), nat)
    return res[0], feats


def _both(spark, sf_dir, part):
    """``part`` of data sets A and B under a ``dataset`` column."""
    nat = nationals(spark, sf_dir)
    a, b = (part(habit, nat).select(F.lit(tag).alias("dataset"), "*") for tag, habit in (("A", False), ("B", True)))
    return a.unionByName(b)


@register("tree_rules")
def q_tree_rules(spark, sf_dir):
    tree, feats = _only(spark, sf_dir, False, "Decision Tree")
    return rounded(clf.tree_rules(tree["nodes"], feats), 6)


@register("tree_nodes")
def q_tree_nodes(spark, sf_dir):
    """All nodes of the decision trees of both data sets."""
    def part(habit, nat):
        tree, feats = _only(spark, sf_dir, habit, "Decision Tree", nat)
        return clf.tree_rules(tree["nodes"], feats, clf.TREE_DEPTH)
    return rounded(_both(spark, sf_dir, part), 6)


@register("tree_importance")
def q_tree_importance(spark, sf_dir):
    def part(habit, nat):
        tree, feats = _only(spark, sf_dir, habit, "Decision Tree", nat)
        return clf.feature_importance(tree["nodes"], feats)
    return _both(spark, sf_dir, part)


@register("tree_report")
def q_tree_report(spark, sf_dir):
    return _both(spark, sf_dir, lambda habit, nat: clf.results_table(
        spark, _classify(spark, sf_dir, habit, ("Decision Tree",), nat)[2]))


@register("logistic_report")
def q_logistic_report(spark, sf_dir):
    return _both(spark, sf_dir, lambda habit, nat: clf.results_table(
        spark, _classify(spark, sf_dir, habit, ("Logistic Regression",), nat)[2]))


@register("logistic_models")
def q_logistic_models(spark, sf_dir):
    """Coefficients of every fold's model and of all rows."""
    def part(habit, nat):
        model, feats = _only(spark, sf_dir, habit, "Logistic Regression", nat)
        return clf.linear_models([model], feats, spark).drop("classifier")
    return rounded(_both(spark, sf_dir, part), 6)


@register("linear_convergence")
def q_linear_convergence(spark, sf_dir):
    """Steps, objective and gradient of all linear fits."""
    def part(habit, nat):
        return clf.convergence(_classify(spark, sf_dir, habit, ("Logistic Regression", "Linear SVM"), nat)[2], spark)
    return rounded(_both(spark, sf_dir, part), 6)


# -- E1 / M: imputation and clustering ----------------------------------------------------

from . import clustering as clu  # noqa: E402
from .silhouette import silhouettes  # noqa: E402

CLUSTER_K = 4   # the reference's chosen k; the sweep query searches k = 2..8


def imputed(spark, sf_dir, nat=None):
    return clu.build_imputed(*(nat or nationals(spark, sf_dir)), SPEC)


@register("imputed_dataset")
def q_imputed_dataset(spark, sf_dir):
    return rounded(imputed(spark, sf_dir))


def _clustered(spark, sf_dir, k=CLUSTER_K):
    data = clu.prepare(imputed(spark, sf_dir), SPEC)
    clustered, explained = clu.pca2(clu.fit_clusters(data, k))
    return clustered.drop("features"), explained


@register("kmeans_sweep")
def q_kmeans_sweep(spark, sf_dir):
    return clu.kmeans_sweep(clu.prepare(imputed(spark, sf_dir), SPEC))


@register("silhouette_strata")
def q_silhouette_strata(spark, sf_dir):
    """How far categories and years part the standardised measures: plain silhouettes of given labels."""
    return rounded(silhouettes(clu.prepare(imputed(spark, sf_dir), SPEC), [SPEC.category, SPEC.year]))


@register("cluster_profiles")
def q_cluster_profiles(spark, sf_dir):
    return clu.profiles(_clustered(spark, sf_dir)[0], SPEC)


@register("cluster_labels")
def q_cluster_labels(spark, sf_dir):
    return clu.canonical_labels(clu.profiles(_clustered(spark, sf_dir)[0], SPEC), SPEC)


@register("cluster_sizes")
def q_cluster_sizes(spark, sf_dir):
    return agg.value_counts(_clustered(spark, sf_dir)[0], "Cluster")


@register("cluster_crosstab")
def q_cluster_crosstab(spark, sf_dir):
    return clu.crosstab(_clustered(spark, sf_dir)[0], SPEC, CLUSTER_K)


@register("cluster_composition")
def q_cluster_composition(spark, sf_dir):
    return clu.composition(_clustered(spark, sf_dir)[0], SPEC, ["Priority", "Segment", "Total"])


@register("pca_points")
def q_pca_points(spark, sf_dir):
    c, _ = _clustered(spark, sf_dir)
    return rounded(c.select(*SPEC.national_keys, "Cluster", "PCA1", "PCA2"))


@register("pca_explained")
def q_pca_explained(spark, sf_dir):
    data = clu.prepare(imputed(spark, sf_dir), SPEC)
    _, ev = clu.pca2(data)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(ev)],
                                 "component int, explained_ratio double").select(
        "component", F.bround("explained_ratio", 4).alias("explained_ratio"))


# -- A: sources and sinks (round trips through the shared scratch folder) -------------------

from ..session import scratch_path  # noqa: E402
from ..sources import survey_csv, tables as tbl  # noqa: E402


@register("read_survey_csv")
def q_read_survey_csv(spark, sf_dir):
    """Raw long table -> CSV (with droppable columns, empty fields for NULL) -> scan."""
    raw = raw_survey(spark, sf_dir, raw_columns=True)
    path = scratch_path(spark, "survey_raw_csv")
    survey_csv.write_survey_csv(raw, path)
    back = survey_csv.read_survey_csv(spark, path, raw.columns)
    kept, _, _ = flt.drop_columns(back, SPEC.drop_columns)
    return rounded(kept)


@register("national_tables_parquet")
def q_national_tables_parquet(spark, sf_dir):
    """Clean job sink (six parquet tables) and the downstream scan of one of them."""
    out = scratch_path(spark, "clean_outputs")
    clean.clean_job(raw_survey(spark, sf_dir), SPEC, out, min_sample=MIN_SAMPLE)
    return rounded(tbl.read_table(spark, out, "habit_national"))


@register("report_csv_roundtrip")
def q_report_csv_roundtrip(spark, sf_dir):
    rep = eda.indicator_summary(*nationals(spark, sf_dir), SPEC)
    path = scratch_path(spark, "stats_summary_csv")
    tbl.write_report_csv(rep, path)
    return tbl.read_report_csv(spark, path, rep.schema)


# -- N / F: reports -----------------------------------------------------------------------------

from . import reports  # noqa: E402


@register("dataset_catalog")
def q_dataset_catalog(spark, sf_dir):
    o, d, h = nat = nationals(spark, sf_dir)      # one survey-view pass for all six entries
    ds = datasets(spark, sf_dir, nat)
    oc, dc, hc = SPEC.outcome_col, SPEC.driver_col, SPEC.habit_score
    return reports.dataset_catalog([
        ("outcome_national", o, [oc]), ("driver_national", d, [dc]),
        ("habit_national", h, SPEC.habit_parts + [hc]),
        ("modeling_two_way", ds["od"], [oc, dc]), ("modeling_three_way", ds["odh"], [oc, dc, hc]),
        ("clustering", imputed(spark, sf_dir, nat), [oc, dc, hc])], SPEC.year)


@register("classifier_display")
def q_classifier_display(spark, sf_dir):
    return reports.classifier_display(q_classifier_report_a(spark, sf_dir))


@register("profile_display")
def q_profile_display(spark, sf_dir):
    return reports.profile_display(q_cluster_labels(spark, sf_dir), SPEC)


@register("kmeans_best_k")
def q_kmeans_best_k(spark, sf_dir):
    return clu.best_k(q_kmeans_sweep(spark, sf_dir))


@register("importance_rank")
def q_importance_rank(spark, sf_dir):
    imp = q_feature_importance_forest(spark, sf_dir)
    from pyspark.sql.window import Window
    return imp.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


@register("results_overview")
def q_results_overview(spark, sf_dir):
    nat = nationals(spark, sf_dir)        # one survey-view pass shared by every model
    ds = datasets(spark, sf_dir, nat)
    m1 = regression.ols(ds["od"], SPEC.outcome_col, [SPEC.driver_col], "Outcome ~ Driver")
    m2 = regression.ols(ds["odh"], SPEC.outcome_col, [SPEC.habit_score], "Outcome ~ Habit")
    _, rid = _ridge(spark, sf_dir, nat)
    res_a = clf.results_table(spark, _classify(spark, sf_dir, False, nat=nat)[2])
    res_b = clf.results_table(spark, _classify(spark, sf_dir, True, nat=nat)[2])
    data = clu.prepare(clu.build_imputed(*nat, SPEC), SPEC)
    best = clu.best_k(clu.kmeans_sweep(data)).first()
    return reports.results_overview(
        spark, [m1, m2], rid, [("A", res_a, ds["od"].count()), ("B", res_b, ds["odh"].count())],
        best, data.count())


@register("headline_kpis")
def q_headline_kpis(spark, sf_dir):
    nat = nationals(spark, sf_dir)
    change = eda.change_over_period(nat[0], SPEC, SPEC.outcome_col)
    odh, rid = _ridge(spark, sf_dir, nat)
    r2 = regression.model_compare(odh, SPEC.outcome_col, [SPEC.driver_col, SPEC.habit_score], rid.r2)
    both = [clf.results_table(spark, _classify(spark, sf_dir, habit, nat=nat)[2])
            .withColumn("dataset", F.lit(tag)) for tag, habit in (("A", False), ("B", True))]
    sweep = clu.kmeans_sweep(clu.prepare(clu.build_imputed(*nat, SPEC), SPEC))
    return reports.headline_kpis(change, r2, both[0].unionByName(both[1]), clu.best_k(sweep).first())


# -- remaining inventory: H6/H8, K4, J14, K10, M10, N3, N5 ---------------------------------

from ..functions.scalar import map_values, slug  # noqa: E402


@register("strata_slugs")
def q_strata_slugs(spark, sf_dir):
    """File-name slug and display label of every (category, stratum) of the outcome table."""
    o = nationals(spark, sf_dir)[0]
    labels = {"Segment": "Market segment", "Priority": "Order priority", "Total": "All orders"}
    return (o.select(SPEC.category, SPEC.stratum).distinct()
            .select(SPEC.category, SPEC.stratum,
                    F.concat(F.lit("outcome_q3_"), slug(F.col(SPEC.category))).alias("slug"),
                    map_values(SPEC.category, labels, "Other").alias("label")))


@register("standardized_features")
def q_standardized_features(spark, sf_dir):
    odh = datasets(spark, sf_dir)["odh"]
    z = regression.standardize(odh, [SPEC.driver_col, SPEC.habit_score], "_z")
    return rounded(z.select(*SPEC.national_keys, f"{SPEC.driver_col}_z", f"{SPEC.habit_score}_z"), 6)


@register("ridge_predictions")
def q_ridge_predictions(spark, sf_dir):
    """Predicted vs actual of the chosen ridge model on the standardised features."""
    odh, res = _ridge(spark, sf_dir)
    feats = [SPEC.driver_col, SPEC.habit_score]
    z = regression.standardize(odh, feats, "__z")
    pred = F.lit(float(res.intercept))
    for f, w in zip(feats, res.coef):
        pred = pred + F.lit(float(w)) * F.col(f"{f}__z")
    return z.select(*SPEC.national_keys, F.bround(SPEC.outcome_col, 4).alias("actual"),
                    F.bround(pred, 4).alias("predicted"))


@register("model_summary")
def q_model_summary(spark, sf_dir):
    nat = nationals(spark, sf_dir)
    ds = datasets(spark, sf_dir, nat)
    m1 = regression.ols(ds["od"], SPEC.outcome_col, [SPEC.driver_col], "M1: Outcome ~ Driver")
    m2 = regression.ols(ds["odh"], SPEC.outcome_col, [SPEC.habit_score], "M2: Outcome ~ Habit")
    odh, res = _ridge(spark, sf_dir, nat)
    return regression.model_summary([m1, m2], res, "M3: Ridge (Driver + Habit)")


@register("clustered_dataset")
def q_clustered_dataset(spark, sf_dir):
    """Clustering sink: the labelled, projected table written as parquet and read back."""
    c, _ = _clustered(spark, sf_dir)
    out = scratch_path(spark, "cluster_outputs")
    tbl.write_table(c, out, "clustered_dataset")
    return rounded(tbl.read_table(spark, out, "clustered_dataset"))


@register("kde_diagonal")
def q_kde_diagonal(spark, sf_dir):
    """Scatter-matrix diagonal: a KDE of each combined measure on the drawn 1000 points."""
    odh = datasets(spark, sf_dir)["odh"]
    parts = [charts.kde(odh, c, gridsize=1000).select(F.lit(c).alias("measure"), "*")
             for c in (SPEC.outcome_col, SPEC.driver_col, SPEC.habit_score)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("box_outliers")
def q_box_outliers(spark, sf_dir):
    """Outlier points of the per-stratum outcome box plots."""
    o = nationals(spark, sf_dir)[0].select(*SPEC.national_keys, SPEC.outcome_col)
    return charts.box_outliers(o, [SPEC.category, SPEC.stratum], SPEC.outcome_col)


@register("pca_scores")
def q_pca_scores(spark, sf_dir):
    """PCA projection of the standardised clustering features (sign-fixed components)."""
    data = clu.prepare(imputed(spark, sf_dir), SPEC)
    scored, _ = clu.pca2(data)
    return rounded(scored.select(*SPEC.national_keys, "PCA1", "PCA2"))
