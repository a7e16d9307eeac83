"""Oracle SQL bodies, keyed like ``registry.QUERIES``."""

from __future__ import annotations

from ..config import NUTRITION_DROP_COLUMNS
from .oracle import sql


def r(expr: str, alias: str, d: int = 4) -> str:
    return f"round_even({expr}, {d}) AS {alias}"


ORACLE: dict = {}


def oracle(name, body):
    ORACLE[name] = sql(body)


# -- A ------------------------------------------------------------------------------
oracle("survey_view", f"""
SELECT CAST(YearStart AS INTEGER) AS YearStart, LocationDesc, Class, Question,
       {r('Data_Value', 'Data_Value')}, {r('Sample_Size', 'Sample_Size')},
       StratificationCategory1, Stratification1
FROM survey""")

oracle("profile_source", """
SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_columns,
       array_to_string(list_sort(list_distinct(list(Class))), ',') AS classes,
       count(DISTINCT LocationDesc) AS n_locations,
       array_to_string(list_sort(list_distinct(list(CAST(YearStart AS VARCHAR)))), ',') AS years
FROM survey""")

# -- B ------------------------------------------------------------------------------
oracle("validation_report", """
SELECT rule, violations, violations = 0 AS passed FROM (
  SELECT 'columns_present' AS rule, CAST(0 AS BIGINT) AS violations
  UNION ALL SELECT 'value_in_range', count(*) FILTER (WHERE NOT (Data_Value BETWEEN 0 AND 100)) FROM survey
  UNION ALL SELECT 'sample_non_negative', count(*) FILTER (WHERE Sample_Size < 0) FROM survey
  UNION ALL SELECT 'year_in_range', count(*) FILTER (WHERE NOT (YearStart BETWEEN 1990 AND 2030)) FROM survey
) v""")

oracle("min_sample_filter", f"""
SELECT CAST(YearStart AS INTEGER) AS YearStart, LocationDesc, Class, Question,
       {r('Data_Value', 'Data_Value')}, {r('Sample_Size', 'Sample_Size')},
       StratificationCategory1, Stratification1
FROM kept""")

_RAW_EXTRA = ("YearEnd", "Datasource", "Topic", "Data_Value_Unit", "Data_Value_Type", "Data_Value_Alt",
              "Data_Value_Footnote", "Low_Confidence_Limit", "High_Confidence_Limit")
oracle("clean_report", "".join(
    f"SELECT '{'dropped' if c in _RAW_EXTRA else 'absent'}_column' AS section, '{c}' AS item, CAST(1 AS BIGINT) AS n UNION ALL\n"
    for c in NUTRITION_DROP_COLUMNS) + """SELECT 'violations' AS section, 'columns_present' AS item, CAST(0 AS BIGINT) AS n
UNION ALL SELECT 'violations', 'value_in_range', count(*) FILTER (WHERE NOT (Data_Value BETWEEN 0 AND 100)) FROM survey
UNION ALL SELECT 'violations', 'sample_non_negative', count(*) FILTER (WHERE Sample_Size < 0) FROM survey
UNION ALL SELECT 'violations', 'year_in_range', count(*) FILTER (WHERE NOT (YearStart BETWEEN 1990 AND 2030)) FROM survey
UNION ALL SELECT 'rows', 'read', count(*) FROM survey
UNION ALL SELECT 'rows', 'kept', count(*) FROM kept""")

oracle("class_split_counts", """
SELECT count(*) FILTER (WHERE regexp_matches(Class, '(?i)Outcome')) AS n_outcome,
       count(*) FILTER (WHERE regexp_matches(Class, '(?i)Driver')) AS n_driver,
       count(*) FILTER (WHERE regexp_matches(Class, '(?i)Habit')) AS n_habit,
       count(*) AS n_total
FROM kept""")

# -- D ------------------------------------------------------------------------------
for _name, _m in (("outcome", ["Outcome"]), ("driver", ["Driver"]), ("habit", ["HabitA", "HabitB"])):
    _cols = ", ".join(r(m, m) for m in _m)
    oracle(f"state_{_name}", f"""
SELECT CAST(YearStart AS INTEGER) AS YearStart, LocationDesc, StratificationCategory1,
       Stratification1, {_cols}, Sample_Size
FROM {_name}_state""")
    _extra = ", " + r("Habit", "Habit") if _name == "habit" else ""
    oracle(f"national_{_name}", f"""
SELECT CAST(YearStart AS INTEGER) AS YearStart, StratificationCategory1, Stratification1,
       N_States, Total_Sample_Size, {_cols}{_extra}
FROM {_name}_national""")


# -- C ------------------------------------------------------------------------------
from ..functions.distributions import pearson_p_sql, normal_cdf_sql  # noqa: E402
from ..functions.distributions import _ACKLAM_A, _ACKLAM_B, _ACKLAM_C, _ACKLAM_D, _ACKLAM_SPLIT, _horner  # noqa: E402

KEYS = "CAST(YearStart AS INTEGER) AS YearStart, StratificationCategory1, Stratification1"


def stars(p: str) -> str:
    return (f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' "
            f"WHEN {p} < 0.05 THEN '*' ELSE '' END")


def test_cols(r_col="r", n_col="n") -> str:
    p = pearson_p_sql(r_col, n_col, "duckdb")
    return (f"round_even({r_col}, 4) AS r, round_even({p}, 6) AS p_value, {n_col} AS n, "
            f"{stars(p)} AS stars")


oracle("join_outcome_driver", f"SELECT {KEYS}, {r('Outcome','Outcome')}, {r('Driver','Driver')} FROM od")
oracle("join_three", f"SELECT {KEYS}, {r('Outcome','Outcome')}, {r('Driver','Driver')}, {r('Habit','Habit')} FROM odh")
oracle("join_left_habit", f"""
SELECT {KEYS}, {r('o.Outcome','Outcome')}, {r('d.Driver','Driver')}, {r('h.Habit','Habit')}
FROM outcome_national o JOIN driver_national d USING (YearStart, StratificationCategory1, Stratification1)
LEFT JOIN habit_national h USING (YearStart, StratificationCategory1, Stratification1)""")

_YEARLY_OD = """
yo AS (SELECT YearStart, avg(Outcome) AS Outcome FROM outcome_national WHERE StratificationCategory1 = 'Total' GROUP BY YearStart),
yd AS (SELECT YearStart, avg(Driver) AS Driver FROM driver_national WHERE StratificationCategory1 = 'Total' GROUP BY YearStart),
yj AS (SELECT * FROM yo JOIN yd USING (YearStart))"""
oracle("join_yearly", f""", {_YEARLY_OD}
SELECT CAST(YearStart AS INTEGER) AS YearStart, {r('Outcome','Outcome')}, {r('Driver','Driver')},
       round_even((SELECT corr(Outcome, Driver) FROM yj), 4) AS r
FROM yj""")

oracle("attach_group_mean", f"""
SELECT {KEYS}, {r('o.Outcome','Outcome')}, {r('d.Driver','Driver')}, {r('h.Habit','Habit')},
       round_even(avg(h.Habit) OVER (PARTITION BY StratificationCategory1, Stratification1), 4) AS GroupMean
FROM outcome_national o JOIN driver_national d USING (YearStart, StratificationCategory1, Stratification1)
LEFT JOIN habit_national h USING (YearStart, StratificationCategory1, Stratification1)""")

# -- D / I / J ----------------------------------------------------------------------
for _n, _t, _m in (("outcome", "outcome_national", "Outcome"), ("driver", "driver_national", "Driver")):
    oracle(f"yearly_trend_{_n}", f""",
y AS (SELECT YearStart, avg({_m}) AS v FROM {_t} WHERE StratificationCategory1 = 'Total' GROUP BY YearStart),
f AS (SELECT regr_slope(v, YearStart) AS b1, regr_intercept(v, YearStart) AS b0 FROM y)
SELECT CAST(YearStart AS INTEGER) AS YearStart, round_even(v, 4) AS {_m},
       round_even(b0 + b1 * YearStart, 4) AS trend, round_even(b1, 4) AS slope
FROM y, f""")

oracle("first_last_change", """,
y AS (SELECT YearStart, avg(Outcome) AS v FROM outcome_national WHERE StratificationCategory1 = 'Total' GROUP BY YearStart)
SELECT CAST(min(YearStart) AS INTEGER) AS first_period, CAST(max(YearStart) AS INTEGER) AS last_period,
       round_even(arg_min(v, YearStart), 4) AS first_value, round_even(arg_max(v, YearStart), 4) AS last_value,
       round_even(arg_max(v, YearStart) - arg_min(v, YearStart), 4) AS change
FROM y""")

oracle("latest_period", f"""
SELECT {KEYS}, N_States, Total_Sample_Size, {r('Outcome','Outcome')}
FROM outcome_national WHERE YearStart = (SELECT max(YearStart) FROM outcome_national)""")

oracle("category_spread_latest", """
SELECT StratificationCategory1, round_even(avg(Outcome), 2) AS mean, round_even(stddev_samp(Outcome), 2) AS std,
       round_even(min(Outcome), 2) AS min, round_even(max(Outcome), 2) AS max
FROM outcome_national WHERE YearStart = (SELECT max(YearStart) FROM outcome_national)
GROUP BY StratificationCategory1""")

oracle("category_summary", """
SELECT StratificationCategory1 AS Category, count(*) AS N, round_even(avg(Outcome), 2) AS Mean,
       round_even(stddev_samp(Outcome), 2) AS Std, round_even(min(Outcome), 2) AS Min,
       round_even(max(Outcome), 2) AS Max
FROM outcome_national GROUP BY StratificationCategory1""")


def _summary(label, table, col):
    return f"""SELECT '{label}' AS Indicator, count(*) AS N, round_even(avg({col}), 2) AS Mean,
  round_even(quantile_cont({col}, 0.5), 2) AS Median, round_even(stddev_samp({col}), 2) AS Std,
  round_even(min({col}), 2) AS Min, round_even(max({col}), 2) AS Max,
  round_even(quantile_cont({col}, 0.25), 2) AS Q1, round_even(quantile_cont({col}, 0.75), 2) AS Q3
FROM {table} WHERE {col} IS NOT NULL"""


oracle("indicator_summary", "\nUNION ALL ".join([
    _summary("Outcome", "outcome_national", "Outcome"), _summary("Driver", "driver_national", "Driver"),
    _summary("Habit", "habit_national", "Habit"), _summary("HabitA", "habit_national", "HabitA"),
    _summary("HabitB", "habit_national", "HabitB")]))


def _describe_row(name, fn):
    return (f"SELECT '{name}' AS statistic, " +
            ", ".join(f"round_even(CAST({fn.format(c=c)} AS DOUBLE), 2) AS {c}"
                      for c in ("Outcome", "Driver", "Habit")) + " FROM odh")


oracle("describe_combined", "\nUNION ALL ".join([
    _describe_row("count", "count({c})"), _describe_row("mean", "avg({c})"),
    _describe_row("std", "stddev_samp({c})"), _describe_row("min", "min({c})"),
    _describe_row("25%", "quantile_cont({c}, 0.25)"), _describe_row("50%", "quantile_cont({c}, 0.5)"),
    _describe_row("75%", "quantile_cont({c}, 0.75)"), _describe_row("max", "max({c})")]))

oracle("global_moments", """
SELECT round_even(avg(Outcome), 2) AS all_mean, round_even(median(Outcome), 2) AS all_median,
       round_even(stddev_samp(Outcome), 2) AS all_std, round_even(min(Outcome), 2) AS all_min,
       round_even(max(Outcome), 2) AS all_max,
       round_even(avg(Outcome) FILTER (WHERE StratificationCategory1 = 'Total'), 2) AS total_mean,
       round_even(median(Outcome) FILTER (WHERE StratificationCategory1 = 'Total'), 2) AS total_median,
       round_even(stddev_samp(Outcome) FILTER (WHERE StratificationCategory1 = 'Total'), 2) AS total_std,
       round_even(min(Outcome) FILTER (WHERE StratificationCategory1 = 'Total'), 2) AS total_min,
       round_even(max(Outcome) FILTER (WHERE StratificationCategory1 = 'Total'), 2) AS total_max
FROM outcome_national""")

oracle("group_median_order", """
SELECT Stratification1, round_even(median, 4) AS median,
       CAST(row_number() OVER (ORDER BY median DESC, Stratification1) AS INTEGER) AS rank
FROM (SELECT Stratification1, median(Outcome) AS median FROM outcome_national
      WHERE StratificationCategory1 = 'Segment' GROUP BY Stratification1)""")

oracle("group_mean_habit", """
SELECT StratificationCategory1, Stratification1, round_even(avg(Habit), 4) AS Habit
FROM habit_national GROUP BY StratificationCategory1, Stratification1""")

oracle("value_counts_category", """
SELECT StratificationCategory1, count(*) AS count,
       round_even(count(*) / (SELECT count(*) FROM od), 4) AS share
FROM od GROUP BY StratificationCategory1""")

oracle("missing_report", """,
lj AS (SELECT o.Outcome, d.Driver, h.Habit
  FROM outcome_national o JOIN driver_national d USING (YearStart, StratificationCategory1, Stratification1)
  LEFT JOIN habit_national h USING (YearStart, StratificationCategory1, Stratification1))
SELECT 'Outcome' AS column, count(*) FILTER (WHERE Outcome IS NULL) AS n_missing,
       round_even(avg(CAST(Outcome IS NULL AS DOUBLE)), 4) AS frac_missing FROM lj
UNION ALL SELECT 'Driver', count(*) FILTER (WHERE Driver IS NULL), round_even(avg(CAST(Driver IS NULL AS DOUBLE)), 4) FROM lj
UNION ALL SELECT 'Habit', count(*) FILTER (WHERE Habit IS NULL), round_even(avg(CAST(Habit IS NULL AS DOUBLE)), 4) FROM lj""")

oracle("distinct_years", "SELECT DISTINCT CAST(YearStart AS INTEGER) AS YearStart FROM habit_national")


def _hist(name, where, bins):
    oracle(name, f""",
v AS (SELECT Outcome AS x FROM outcome_national WHERE Outcome IS NOT NULL {where}),
s AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
c AS (SELECT CAST(coalesce(least(floor((x - lo) / nullif((hi - lo) / {bins}, 0)), {bins - 1}), 0) AS INTEGER) AS bin,
             count(*) AS cnt FROM v, s GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round_even(lo + g.bin * ((hi - lo) / {bins}), 6) AS bin_lo,
       round_even(lo + (g.bin + 1) * ((hi - lo) / {bins}), 6) AS bin_hi, coalesce(cnt, 0) AS count
FROM (SELECT range AS bin FROM range({bins})) g CROSS JOIN s LEFT JOIN c ON c.bin = g.bin""")


_hist("histogram_outcome", "", 35)
_hist("histogram_outcome_total", "AND StratificationCategory1 = 'Total'", 20)

oracle("kde_outcome", """,
v AS (SELECT Outcome AS x FROM outcome_national WHERE Outcome IS NOT NULL),
s AS (SELECT count(*) AS n, stddev_samp(x) * pow(CAST(count(*) AS DOUBLE), -0.2) AS bw,
             min(x) AS lo, max(x) AS hi FROM v),
g AS (SELECT range AS k, lo + range * ((hi - lo) / 199) AS gx FROM range(200), s),
d AS (SELECT k, sum(exp(-0.5 * pow((gx - x) / bw, 2))) AS ks FROM g, v, s GROUP BY k)
SELECT CAST(g.k AS INTEGER) AS point, round_even(g.gx, 6) AS x,
       round_even(d.ks / (n * bw * sqrt(2 * pi())), 6) AS density
FROM g JOIN d USING (k), s""")

oracle("box_stats_outcome", """,
q AS (SELECT StratificationCategory1, Stratification1, quantile_cont(Outcome, 0.25) AS q1,
             quantile_cont(Outcome, 0.5) AS median, quantile_cont(Outcome, 0.75) AS q3
      FROM outcome_national WHERE Outcome IS NOT NULL GROUP BY 1, 2),
b AS (SELECT q.*, min(Outcome) FILTER (WHERE Outcome BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS wlo,
             max(Outcome) FILTER (WHERE Outcome BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whi,
             count(*) FILTER (WHERE NOT (Outcome BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_out,
             count(*) AS n
      FROM outcome_national o JOIN q USING (StratificationCategory1, Stratification1)
      WHERE Outcome IS NOT NULL GROUP BY ALL),
ord AS (SELECT * FROM (VALUES ('Priority', '1-URGENT', 0), ('Priority', '2-HIGH', 1), ('Priority', '3-MEDIUM', 2),
                              ('Priority', '4-NOT SPECIFIED', 3), ('Priority', '5-LOW', 4)) t(StratificationCategory1, Stratification1, rank)
        UNION ALL
        SELECT StratificationCategory1, Stratification1,
               row_number() OVER (PARTITION BY StratificationCategory1 ORDER BY m DESC, Stratification1) - 1
        FROM (SELECT StratificationCategory1, Stratification1, median(Outcome) AS m FROM outcome_national
              WHERE StratificationCategory1 = 'Segment' GROUP BY 1, 2))
SELECT StratificationCategory1, Stratification1, round_even(q1, 4) AS q1, round_even(median, 4) AS median,
       round_even(q3, 4) AS q3, round_even(wlo, 4) AS whisker_lo, round_even(whi, 4) AS whisker_hi,
       n_out AS n_outliers, n, CAST(rank AS INTEGER) AS rank
FROM b JOIN ord USING (StratificationCategory1, Stratification1)""")

oracle("habit_rates_total", """
SELECT CAST(YearStart AS INTEGER) AS YearStart, round_even(HabitA, 4) AS HabitA, round_even(HabitB, 4) AS HabitB,
       round_even(Habit, 4) AS Habit
FROM habit_national WHERE StratificationCategory1 = 'Total'""")

oracle("habit_vs_outcome", """,
p AS (SELECT h.YearStart, h.Habit, o.Outcome FROM
      (SELECT YearStart, Habit FROM habit_national WHERE StratificationCategory1 = 'Total') h
      JOIN (SELECT YearStart, Outcome FROM outcome_national WHERE StratificationCategory1 = 'Total') o USING (YearStart)),
f AS (SELECT regr_slope(Outcome, Habit) AS b1, regr_intercept(Outcome, Habit) AS b0, corr(Habit, Outcome) AS r FROM p)
SELECT CAST(YearStart AS INTEGER) AS YearStart, round_even(Habit, 4) AS Habit, round_even(Outcome, 4) AS Outcome,
       round_even(b1, 4) AS slope, round_even(b0, 4) AS intercept, round_even(r, 4) AS r
FROM p, f""")

oracle("corr_matrix", """,
c AS (SELECT corr(Outcome, Driver) AS od, corr(Outcome, Habit) AS oh, corr(Driver, Habit) AS dh FROM odh)
SELECT var1, var2, round_even(r, 3) AS r FROM (
  SELECT 'Outcome' AS var1, 'Outcome' AS var2, 1.0::DOUBLE AS r UNION ALL SELECT 'Driver', 'Driver', 1.0
  UNION ALL SELECT 'Habit', 'Habit', 1.0
  UNION ALL SELECT 'Outcome', 'Driver', od FROM c UNION ALL SELECT 'Driver', 'Outcome', od FROM c
  UNION ALL SELECT 'Outcome', 'Habit', oh FROM c UNION ALL SELECT 'Habit', 'Outcome', oh FROM c
  UNION ALL SELECT 'Driver', 'Habit', dh FROM c UNION ALL SELECT 'Habit', 'Driver', dh FROM c)""")

oracle("pearson_overall", f"""
SELECT {test_cols()} FROM (SELECT corr(Outcome, Driver) AS r, count(*) AS n FROM od)""")

oracle("grouped_pearson", f"""
SELECT Category, {test_cols()} FROM (
  SELECT StratificationCategory1 AS Category, corr(Outcome, Driver) AS r, count(*) AS n
  FROM od GROUP BY StratificationCategory1 HAVING count(*) >= 5)""")


def _pairs_sql(table, pairs, where=""):
    parts = [f"SELECT '{a}' AS Var1, '{b}' AS Var2, corr({a}, {b}) AS r, "
             f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {table} {where}"
             for a, b in pairs]
    return f"SELECT Var1, Var2, {test_cols()} FROM ({' UNION ALL '.join(parts)})"


oracle("time_trend_tests", """,
tt AS (SELECT * FROM od WHERE StratificationCategory1 = 'Total'
       AND (SELECT count(*) FROM od WHERE StratificationCategory1 = 'Total') >= 5)
""" + _pairs_sql("tt", [("YearStart", "Outcome"), ("YearStart", "Driver"), ("Outcome", "Driver")]))

oracle("pairwise_tests", _pairs_sql("odhx", [("Outcome", "Driver"), ("Outcome", "Habit"), ("Outcome", "HabitA"),
                                            ("Outcome", "HabitB"), ("Driver", "Habit"), ("HabitA", "HabitB")]))

oracle("vif", """,
g AS (SELECT sum(Driver * Driver) AS s11, sum(Habit * Habit) AS s22, sum(Driver * Habit) AS s12 FROM odh
      WHERE (SELECT count(*) FROM odh) >= 3),
v AS (SELECT round_even(1.0 / nullif(1.0 - s12 * s12 / (s11 * s22), 0), 2) AS VIF FROM g)
SELECT Feature, VIF, CASE WHEN VIF > 10 THEN 'problem' WHEN VIF > 5 THEN 'warning' ELSE 'ok' END AS band
FROM (SELECT 'Driver' AS Feature, VIF FROM v UNION ALL SELECT 'Habit', VIF FROM v)""")

oracle("linear_trend", """,
y AS (SELECT YearStart, avg(Outcome) AS v FROM outcome_national WHERE StratificationCategory1 = 'Total' GROUP BY YearStart)
SELECT round_even(regr_slope(v, YearStart), 6) AS slope, round_even(regr_intercept(v, YearStart), 6) AS intercept,
       round_even(regr_r2(v, YearStart), 6) AS r2, CAST(regr_count(v, YearStart) AS BIGINT) AS n FROM y""")

oracle("scatter_matrix", f"SELECT {r('Outcome','Outcome')}, {r('Driver','Driver')}, {r('Habit','Habit')} FROM odh")

oracle("fit_line", """,
s AS (SELECT min(Driver) AS lo, max(Driver) AS hi, regr_slope(Outcome, Driver) AS b1,
             regr_intercept(Outcome, Driver) AS b0, regr_r2(Outcome, Driver) AS r2 FROM od),
l AS (SELECT range AS point, lo + (hi - lo) * range / 99 AS x, b0, b1, r2 FROM range(100), s)
SELECT CAST(point AS INTEGER) AS point, round_even(x, 4) AS x, round_even(b0 + b1 * x, 4) AS y_hat,
       round_even(b1, 4) AS slope, round_even(r2, 4) AS r2 FROM l""")

oracle("residual_points", f""",
f AS (SELECT regr_slope(Outcome, Driver) AS b1, regr_intercept(Outcome, Driver) AS b0 FROM od)
SELECT {KEYS}, round_even(b0 + b1 * Driver, 4) AS fitted, round_even(Outcome - (b0 + b1 * Driver), 4) AS residual
FROM od, f""")


def _ppf_x0(p: str) -> str:
    tail = lambda q: f"({_horner(_ACKLAM_C, q)} / ({_horner(_ACKLAM_D, q)} * ({q}) + 1.0))"
    rr = f"(({p}) - 0.5) * (({p}) - 0.5)"
    central = f"({_horner(_ACKLAM_A, rr)} * (({p}) - 0.5) / ({_horner(_ACKLAM_B, rr)} * ({rr}) + 1.0))"
    return (f"(CASE WHEN {p} < {_ACKLAM_SPLIT} THEN {tail(f'sqrt(-2.0 * ln({p}))')} "
            f"WHEN {p} <= {1 - _ACKLAM_SPLIT!r} THEN {central} "
            f"ELSE -{tail(f'sqrt(-2.0 * ln(1.0 - {p}))')} END)")


oracle("qq_points", f""",
f AS (SELECT regr_slope(Outcome, Driver) AS b1, regr_intercept(Outcome, Driver) AS b0 FROM od),
res AS (SELECT Outcome - (b0 + b1 * Driver) AS v FROM od, f),
rk AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n, avg(v) OVER () AS mu,
              stddev_pop(v) OVER () AS sd FROM res),
p0 AS (SELECT *, CAST(i AS DOUBLE) / (n + 1) AS p FROM rk),
p1 AS (SELECT *, {_ppf_x0('p')} AS x0 FROM p0),
p2 AS (SELECT *, ({normal_cdf_sql('x0')} - p) * 2.5066282746310002 * exp(x0 * x0 / 2.0) AS u FROM p1),
p3 AS (SELECT *, x0 - u / (1.0 + x0 * u / 2.0) AS theo FROM p2)
SELECT CAST(i AS BIGINT) AS i, round_even(theo, 4) AS theoretical, round_even(v, 4) AS sample,
       round_even(mu + sd * theo, 4) AS line FROM p3""")


# -- E / K ----------------------------------------------------------------------------
from ..functions.distributions import t_two_sided_p_sql  # noqa: E402

oracle("contiguous_folds", """,
rk AS (SELECT row_number() OVER (ORDER BY YearStart, StratificationCategory1, Stratification1) - 1 AS i,
              count(*) OVER () AS n FROM odh),
fd AS (SELECT CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
                   ELSE (n % 5) + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM rk)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n FROM fd GROUP BY fold""")

_HASH = ("CAST(('0x' || substr(md5('42|' || CAST(YearStart AS VARCHAR) || '|' || StratificationCategory1"
         " || '|' || Stratification1), 1, 7)) AS BIGINT)")
oracle("hash_folds", f"SELECT {KEYS}, CAST({_HASH} % 5 AS INTEGER) AS fold FROM od")
oracle("stratified_folds", f""",
lab AS (SELECT *, CAST(Outcome > (SELECT median(Outcome) FROM od) AS INTEGER) AS HighRisk FROM od)
SELECT {KEYS}, HighRisk,
       CAST((row_number() OVER (PARTITION BY HighRisk ORDER BY {_HASH}, YearStart, StratificationCategory1,
                                Stratification1) - 1) % 5 AS INTEGER) AS fold
FROM lab""")


def _ols_sql(table, y, x, model):
    t_int = "b0 / se0"
    t_sl = "b1 / se1"
    p_int = t_two_sided_p_sql(t_int, "(n - 2)", "duckdb")
    p_sl = t_two_sided_p_sql(t_sl, "(n - 2)", "duckdb")
    return f""",
s AS (SELECT regr_intercept({y}, {x}) AS b0, regr_slope({y}, {x}) AS b1, CAST(regr_count({y}, {x}) AS BIGINT) AS n,
             regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_avgx({y}, {x}) AS mx,
             regr_r2({y}, {x}) AS r2 FROM {table}),
e AS (SELECT *, (syy - b1 * b1 * sxx) / (n - 2) AS s2 FROM s),
f AS (SELECT *, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS se0, sqrt(s2 / sxx) AS se1 FROM e),
g AS (SELECT *, {p_int} AS p0, {p_sl} AS p1 FROM f)
SELECT '{model}' AS model, 'Intercept' AS term, round_even(b0, 4) AS coef, round_even(se0, 4) AS std_err,
       round_even(b0 / se0, 3) AS t, round_even(p0, 6) AS p_value, {stars('p0')} AS stars, n,
       round_even(r2, 4) AS r2, round_even(1 - (1 - r2) * (n - 1) / (n - 2), 4) AS adj_r2,
       round_even(p1, 6) AS f_pvalue FROM g
UNION ALL
SELECT '{model}', '{x}', round_even(b1, 4), round_even(se1, 4), round_even(b1 / se1, 3), round_even(p1, 6),
       {stars('p1')}, n, round_even(r2, 4), round_even(1 - (1 - r2) * (n - 1) / (n - 2), 4),
       round_even(p1, 6) FROM g"""


oracle("ols_outcome_driver", _ols_sql("od", "Outcome", "Driver", "Outcome ~ Driver"))
oracle("ols_outcome_habit", _ols_sql("odh", "Outcome", "Habit", "Outcome ~ Habit"))


# -- L ------------------------------------------------------------------------------
_LAB_A = """lab AS (SELECT *, CAST(Outcome > (SELECT median(Outcome) FROM od) AS INTEGER) AS HighRisk,
                 CAST(StratificationCategory1 = 'Segment' AS DOUBLE) AS Strat_Segment,
                 CAST(StratificationCategory1 = 'Total' AS DOUBLE) AS Strat_Total FROM od)"""
_LAB_B = """labb AS (SELECT *, CAST(Outcome > (SELECT median(Outcome) FROM odh) AS INTEGER) AS HighRisk,
                 CAST(StratificationCategory1 = 'Segment' AS DOUBLE) AS Strat_Segment,
                 CAST(StratificationCategory1 = 'Total' AS DOUBLE) AS Strat_Total FROM odh)"""
oracle("labeled_dataset_a", f""", {_LAB_A}
SELECT {KEYS}, round_even(Driver, 4) AS Driver, Strat_Segment, Strat_Total, HighRisk FROM lab""")
oracle("labeled_dataset_b", f""", {_LAB_B}
SELECT {KEYS}, round_even(Driver, 4) AS Driver, round_even(Habit, 4) AS Habit, Strat_Segment, Strat_Total,
       HighRisk FROM labb""")
oracle("class_balance", f""", {_LAB_A}
SELECT CAST(sum(HighRisk) AS BIGINT) AS n_positive, CAST(sum(1 - HighRisk) AS BIGINT) AS n_negative,
       round_even(avg(CAST(HighRisk AS DOUBLE)), 4) AS share_positive,
       round_even(avg(CAST(1 - HighRisk AS DOUBLE)), 4) AS share_negative FROM lab""")
oracle("crosstab_category_label", f""", {_LAB_A}
SELECT StratificationCategory1, round_even(count(*) FILTER (WHERE HighRisk = 0) / count(*), 3) AS label_0,
       round_even(count(*) FILTER (WHERE HighRisk = 1) / count(*), 3) AS label_1
FROM lab GROUP BY StratificationCategory1""")
oracle("roc_driver_score", f""", {_LAB_A},
per AS (SELECT Driver AS threshold, sum(HighRisk) AS tp, sum(1 - HighRisk) AS fp FROM lab GROUP BY Driver),
cum AS (SELECT threshold, sum(tp) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctp,
               sum(fp) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cfp,
               sum(tp) OVER () AS P, sum(fp) OVER () AS N FROM per)
SELECT round_even(threshold, 6) AS threshold, round_even(ctp / nullif(P, 0), 6) AS tpr,
       round_even(cfp / nullif(N, 0), 6) AS fpr FROM cum""")
oracle("auc_driver_score", f""", {_LAB_A},
per AS (SELECT Driver AS s, sum(HighRisk) AS pos, sum(1 - HighRisk) AS neg FROM lab GROUP BY Driver),
nb AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM per)
SELECT round_even(sum(pos * (neg_below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM nb""")


# -- E1 -----------------------------------------------------------------------------
oracle("imputed_dataset", f""",
lj AS (SELECT o.YearStart, o.StratificationCategory1, o.Stratification1, o.Outcome, d.Driver, h.Habit
  FROM outcome_national o JOIN driver_national d USING (YearStart, StratificationCategory1, Stratification1)
  LEFT JOIN habit_national h USING (YearStart, StratificationCategory1, Stratification1)),
im AS (SELECT *, Habit IS NULL AS Habit_imputed,
              coalesce(Habit, avg(Habit) OVER (PARTITION BY StratificationCategory1, Stratification1),
                       (SELECT avg(Habit) FROM habit_national)) AS Habit_f FROM lj)
SELECT {KEYS}, round_even(Outcome, 4) AS Outcome, round_even(Driver, 4) AS Driver,
       round_even(Habit_f, 4) AS Habit, Habit_imputed
FROM im WHERE Outcome IS NOT NULL AND Driver IS NOT NULL AND Habit_f IS NOT NULL""")


# -- A / N --------------------------------------------------------------------------
# the round trips must give back exactly what was written
ORACLE["read_survey_csv"] = ORACLE["survey_view"]
ORACLE["national_tables_parquet"] = ORACLE["national_habit"]
ORACLE["report_csv_roundtrip"] = ORACLE["indicator_summary"]


def _cat(name, table, variables):
    return f"""SELECT '{name}' AS Dataset, count(*) AS Rows,
  CASE WHEN max(YearStart) - min(YearStart) + 1 = count(DISTINCT YearStart)
       THEN CAST(min(YearStart) AS VARCHAR) || '–' || CAST(max(YearStart) AS VARCHAR)
       ELSE string_agg(DISTINCT CAST(YearStart AS VARCHAR), ', ' ORDER BY CAST(YearStart AS VARCHAR)) END AS Years,
  '{variables}' AS Variables FROM {table}"""


oracle("dataset_catalog", """,
imp AS (SELECT o.YearStart FROM outcome_national o
        JOIN driver_national d USING (YearStart, StratificationCategory1, Stratification1)
        WHERE o.Outcome IS NOT NULL AND d.Driver IS NOT NULL)
""" + "\nUNION ALL ".join([
    _cat("outcome_national", "outcome_national", "Outcome"),
    _cat("driver_national", "driver_national", "Driver"),
    _cat("habit_national", "habit_national", "HabitA, HabitB, Habit"),
    _cat("modeling_two_way", "od", "Outcome, Driver"),
    _cat("modeling_three_way", "odh", "Outcome, Driver, Habit"),
    _cat("clustering", "imp", "Outcome, Driver, Habit")]))


# -- H / K ---------------------------------------------------------------------------
oracle("strata_slugs", """
SELECT DISTINCT StratificationCategory1, Stratification1,
       'outcome_q3_' || translate(lower(StratificationCategory1), '/ ', '__') AS slug,
       CASE StratificationCategory1 WHEN 'Segment' THEN 'Market segment' WHEN 'Priority' THEN 'Order priority'
            WHEN 'Total' THEN 'All orders' ELSE 'Other' END AS label
FROM outcome_national""")

oracle("standardized_features", f""",
s AS (SELECT avg(Driver) AS md, stddev_pop(Driver) AS sd, avg(Habit) AS mh, stddev_pop(Habit) AS sh FROM odh)
SELECT {KEYS}, round_even((Driver - md) / sd, 6) AS Driver_z, round_even((Habit - mh) / sh, 6) AS Habit_z
FROM odh, s""")


# -- K5-K10: ridge search in SQL (closed-form 2 x 2 solves) ------------------------------
def _fold_sums(name, fold):
    return f"""{name} AS (SELECT {fold} AS f, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(y) AS sy,
  sum(a * a) AS saa, sum(a * b) AS sab, sum(b * b) AS sbb, sum(a * y) AS say, sum(b * y) AS sby,
  sum(y * y) AS syy FROM zf GROUP BY {fold})"""


def _tot(name, src):
    return f"""{name} AS (SELECT sum(n) AS n, sum(sa) AS sa, sum(sb) AS sb, sum(sy) AS sy, sum(saa) AS saa,
  sum(sab) AS sab, sum(sbb) AS sbb, sum(say) AS say, sum(sby) AS sby, sum(syy) AS syy FROM {src})"""


# train sums tr_* (total minus fold), then the centred 2 x 2 ridge solve and the fold R^2
_SOLVE = """
  (t.sa - f.sa) / (t.n - f.n) AS ma, (t.sb - f.sb) / (t.n - f.n) AS mb, (t.sy - f.sy) / (t.n - f.n) AS my,
  t.n - f.n AS tn, t.saa - f.saa AS taa, t.sab - f.sab AS tab, t.sbb - f.sbb AS tbb,
  t.say - f.say AS tay, t.sby - f.sby AS tby"""
_CENTER = """caa, cab, cbb, cay, cby, ma, mb, my FROM (SELECT *, taa - tn * ma * ma AS caa, tab - tn * ma * mb AS cab,
  tbb - tn * mb * mb AS cbb, tay - tn * ma * my AS cay, tby - tn * mb * my AS cby FROM c0)"""
_W = """((cbb + alpha) * cay - cab * cby) / ((caa + alpha) * (cbb + alpha) - cab * cab) AS wa,
  ((caa + alpha) * cby - cab * cay) / ((caa + alpha) * (cbb + alpha) - cab * cab) AS wb"""
_R2 = """1.0 - (syy - 2 * (b0 * sy + wa * say + wb * sby)
        + (n * b0 * b0 + 2 * b0 * (wa * sa + wb * sb) + wa * wa * saa + 2 * wa * wb * sab + wb * wb * sbb))
      / (syy - sy * sy / n)"""

RIDGE_CTES = f""",
rb AS (SELECT YearStart, StratificationCategory1, Stratification1, Outcome AS y, Driver, Habit FROM odh),
st AS (SELECT avg(Driver) AS md0, CASE WHEN stddev_pop(Driver) > 0 THEN stddev_pop(Driver) ELSE 1 END AS sd0,
              avg(Habit) AS mh0, CASE WHEN stddev_pop(Habit) > 0 THEN stddev_pop(Habit) ELSE 1 END AS sh0 FROM rb),
z AS (SELECT rb.*, (Driver - md0) / sd0 AS a, (Habit - mh0) / sh0 AS b,
             row_number() OVER (ORDER BY YearStart, StratificationCategory1, Stratification1) - 1 AS i,
             count(*) OVER () AS n_all, {_HASH} % 5 AS hf FROM rb, st),
zf AS (SELECT *, CASE WHEN i < (n_all % 5) * (n_all // 5 + 1) THEN i // (n_all // 5 + 1)
                      ELSE (n_all % 5) + (i - (n_all % 5) * (n_all // 5 + 1)) // (n_all // 5) END AS cf FROM z),
{_fold_sums('fc', 'cf')}, {_tot('tc', 'fc')},
al AS (SELECT range AS ai, pow(10.0, -3 + range * (6.0 / 99)) AS alpha FROM range(100)),
c0 AS (SELECT f.f, {_SOLVE} FROM fc f, tc t),
c1 AS (SELECT f, {_CENTER}),
c2 AS (SELECT c1.*, al.ai, al.alpha, {_W} FROM c1, al),
c3 AS (SELECT c2.ai, c2.alpha, c2.f, c2.wa, c2.wb, c2.my - c2.ma * c2.wa - c2.mb * c2.wb AS b0, fc.*
       FROM c2 JOIN fc USING (f)),
path AS (SELECT ai, alpha, avg({_R2}) AS cv FROM c3 GROUP BY ai, alpha),
best AS (SELECT alpha FROM path ORDER BY cv DESC, ai ASC LIMIT 1),
fit0 AS (SELECT t.n, t.sa / t.n AS ma, t.sb / t.n AS mb, t.sy / t.n AS my, t.n AS tn, t.saa AS taa,
                t.sab AS tab, t.sbb AS tbb, t.say AS tay, t.sby AS tby FROM tc t),
fit1 AS (SELECT *, taa - tn * ma * ma AS caa, tab - tn * ma * mb AS cab, tbb - tn * mb * mb AS cbb,
                tay - tn * ma * my AS cay, tby - tn * mb * my AS cby FROM fit0),
fit2 AS (SELECT fit1.*, best.alpha, {_W} FROM fit1, best),
fit AS (SELECT fit2.alpha, fit2.wa, fit2.wb, fit2.my - fit2.ma * fit2.wa - fit2.mb * fit2.wb AS b0,
               tc.* FROM fit2, tc),
fitr AS (SELECT *, {_R2} AS r2 FROM fit),
fitx AS (SELECT *, sqrt(greatest((1.0 - r2) * (syy - sy * sy / n), 0) / n) AS rmse FROM fitr),
{_fold_sums('fh', 'hf')}, {_tot('th', 'fh')},
h0 AS (SELECT f.f, {_SOLVE} FROM fh f, th t),
h1 AS (SELECT * FROM (SELECT *, taa - tn * ma * ma AS caa, tab - tn * ma * mb AS cab, tbb - tn * mb * mb AS cbb,
                             tay - tn * ma * my AS cay, tby - tn * mb * my AS cby FROM h0)),
h2 AS (SELECT h1.*, best.alpha, {_W} FROM h1, best),
h3 AS (SELECT h2.wa, h2.wb, h2.my - h2.ma * h2.wa - h2.mb * h2.wb AS b0, fh.* FROM h2 JOIN fh USING (f)),
hcv AS (SELECT avg({_R2}) AS cv_mean, stddev_pop({_R2}) AS cv_std FROM h3)"""

oracle("ridge_alpha_path", RIDGE_CTES + """
SELECT round_even(alpha, 6) AS alpha, round_even(cv, 6) AS cv_r2 FROM path""")

oracle("ridge_cv", RIDGE_CTES + """,
rr AS (SELECT 'Driver' AS term, wa AS coef FROM fitx UNION ALL SELECT 'Habit', wb FROM fitx
       UNION ALL SELECT 'Intercept', b0 FROM fitx)
SELECT 'Ridge Outcome ~ Driver + Habit' AS model, term, round_even(coef, 4) AS coef,
       round_even(alpha, 4) AS alpha, round_even(r2, 4) AS r2_train, round_even(rmse, 4) AS rmse,
       round_even(cv_mean, 4) AS cv_r2, round_even(cv_std, 4) AS cv_r2_std, CAST(n AS BIGINT) AS n
FROM rr, fitx, hcv""")

oracle("model_compare", RIDGE_CTES + """
SELECT 'OLS Driver only' AS model, round_even(regr_r2(Outcome, Driver), 4) AS r2 FROM odh
UNION ALL SELECT 'OLS Habit only', round_even(regr_r2(Outcome, Habit), 4) FROM odh
UNION ALL SELECT 'Ridge combined', round_even(r2, 4) FROM fitx""")

oracle("ridge_predictions", RIDGE_CTES + f"""
SELECT {KEYS}, round_even(y, 4) AS actual, round_even(fitx.b0 + fitx.wa * z.a + fitx.wb * z.b, 4) AS predicted
FROM z, fitx""")

_OLS_SUMMARY = """
m{k} AS (SELECT regr_slope(Outcome, {x}) AS b1, CAST(regr_count(Outcome, {x}) AS BIGINT) AS n, regr_r2(Outcome, {x}) AS r2,
               regr_sxx(Outcome, {x}) AS sxx, regr_syy(Outcome, {x}) AS syy FROM {t}),
p{k} AS (SELECT *, b1 / sqrt((syy - b1 * b1 * sxx) / (n - 2) / sxx) AS tt FROM m{k})"""
oracle("model_summary", RIDGE_CTES + "," + _OLS_SUMMARY.format(k=1, x="Driver", t="od") + "," +
       _OLS_SUMMARY.format(k=2, x="Habit", t="odh") + f"""
SELECT 'M1: Outcome ~ Driver' AS model, n, round_even(r2, 4) AS r2,
       'b=' || printf('%.3f', round_even(b1, 3)) || ', p=' || printf('%.6f', round_even({t_two_sided_p_sql('tt', '(n - 2)', 'duckdb')}, 6)) AS finding FROM p1
UNION ALL
SELECT 'M2: Outcome ~ Habit', n, round_even(r2, 4),
       'b=' || printf('%.3f', round_even(b1, 3)) || ', p=' || printf('%.6f', round_even({t_two_sided_p_sql('tt', '(n - 2)', 'duckdb')}, 6)) FROM p2
UNION ALL
SELECT 'M3: Ridge (Driver + Habit)', CAST(n AS BIGINT), round_even(r2, 4), 'CV R2=' || printf('%.4f', round_even(cv_mean, 4))
FROM fitx, hcv""")


# -- I8: Shapiro-Wilk (n <= 500, so the sample is every row) ---------------------------
from ..functions.stats import (_SW_C1, _SW_C2, _SW_LARGE_MEAN, _SW_LARGE_SD,  # noqa: E402
                               _SW_SMALL_GAMMA, _SW_SMALL_MEAN, _SW_SMALL_SD)


def _poly_sql(coefs, x):
    return _horner(tuple(reversed(coefs)), x)


oracle("shapiro_wilk", f""",
swv AS (SELECT 'Outcome' AS ind, Outcome AS x FROM outcome_national WHERE Outcome IS NOT NULL
        UNION ALL SELECT 'Driver', Driver FROM driver_national WHERE Driver IS NOT NULL
        UNION ALL SELECT 'Habit', Habit FROM habit_national WHERE Habit IS NOT NULL),
sw1 AS (SELECT ind, x, row_number() OVER (PARTITION BY ind ORDER BY x) AS i,
               count(*) OVER (PARTITION BY ind) AS n FROM swv),
sw2 AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM sw1),
sw3 AS (SELECT *, {_ppf_x0('p')} AS x0 FROM sw2),
sw4 AS (SELECT *, ({normal_cdf_sql('x0')} - p) * 2.5066282746310002 * exp(x0 * x0 / 2.0) AS u FROM sw3),
sw5 AS (SELECT *, x0 - u / (1.0 + x0 * u / 2.0) AS m FROM sw4),
sw6 AS (SELECT *, sum(m * m) OVER (PARTITION BY ind) AS mm,
               max(CASE WHEN i = n THEN m END) OVER (PARTITION BY ind) AS m_n,
               max(CASE WHEN i = n - 1 THEN m END) OVER (PARTITION BY ind) AS m_n1,
               1.0 / sqrt(n) AS u1 FROM sw5),
sw7 AS (SELECT *, m_n / sqrt(mm) + {_poly_sql(_SW_C1, 'u1')} AS a_n,
               m_n1 / sqrt(mm) + {_poly_sql(_SW_C2, 'u1')} AS a_n1 FROM sw6),
sw8 AS (SELECT *, CASE WHEN n > 5 THEN (mm - 2 * m_n * m_n - 2 * m_n1 * m_n1) / (1 - 2 * a_n * a_n - 2 * a_n1 * a_n1)
                       ELSE (mm - 2 * m_n * m_n) / (1 - 2 * a_n * a_n) END AS phi FROM sw7),
sw9 AS (SELECT *, CASE WHEN n = 3 THEN CASE WHEN i = 1 THEN -sqrt(0.5) WHEN i = 3 THEN sqrt(0.5) ELSE 0.0 END
                       WHEN i = n THEN a_n WHEN i = 1 THEN -a_n
                       WHEN n > 5 AND i = n - 1 THEN a_n1 WHEN n > 5 AND i = 2 THEN -a_n1
                       ELSE m / sqrt(phi) END AS a FROM sw8),
sw10 AS (SELECT ind, any_value(n) AS n, sum(a * x) AS ax, var_pop(x) AS vp FROM sw9 GROUP BY ind),
sw11 AS (SELECT *, least(ax * ax / (vp * n), 1.0) AS W, CAST(n AS DOUBLE) AS nn FROM sw10),
sw12 AS (SELECT *, CASE WHEN n <= 11
    THEN (-ln({_poly_sql(_SW_SMALL_GAMMA, 'nn')} - ln(1 - W)) - {_poly_sql(_SW_SMALL_MEAN, 'nn')})
         / exp({_poly_sql(_SW_SMALL_SD, 'nn')})
    ELSE (ln(1 - W) - {_poly_sql(_SW_LARGE_MEAN, 'ln(nn)')}) / exp({_poly_sql(_SW_LARGE_SD, 'ln(nn)')}) END AS zz
  FROM sw11),
sw13 AS (SELECT *, CASE WHEN n < 3 THEN NULL
                        WHEN n = 3 THEN greatest(6.0 / pi() * (asin(sqrt(W)) - asin(sqrt(0.75))), 0.0)
                        ELSE {normal_cdf_sql('-zz')} END AS pv FROM sw12)
SELECT ind AS Indicator, n, round_even(W, 4) AS W, round_even(pv, 6) AS p_value, pv > 0.05 AS normal FROM sw13""")


# -- J10: KDE diagonal of the scatter matrix -------------------------------------------
def _kde_sql(col, grid):
    return f"""SELECT '{col}' AS measure, CAST(g.k AS INTEGER) AS point, round_even(g.gx, 6) AS x,
       round_even(d.ks / (s.n * s.bw * sqrt(2 * pi())), 6) AS density
FROM (SELECT count(*) AS n, stddev_samp({col}) * pow(CAST(count(*) AS DOUBLE), -0.2) AS bw,
             min({col}) AS lo, max({col}) AS hi FROM odh) s,
     LATERAL (SELECT range AS k, s.lo + range * ((s.hi - s.lo) / {grid - 1}) AS gx FROM range({grid})) g,
     LATERAL (SELECT sum(exp(-0.5 * pow((g.gx - {col}) / s.bw, 2))) AS ks FROM odh) d"""


oracle("kde_diagonal", "\nUNION ALL ".join(_kde_sql(c, 1000) for c in ("Outcome", "Driver", "Habit")))


oracle("box_outliers", f""",
q AS (SELECT StratificationCategory1, Stratification1, quantile_cont(Outcome, 0.25) AS q1,
             quantile_cont(Outcome, 0.75) AS q3
      FROM outcome_national WHERE Outcome IS NOT NULL GROUP BY 1, 2)
SELECT {KEYS}, round_even(Outcome, 4) AS Outcome
FROM outcome_national o JOIN q USING (StratificationCategory1, Stratification1)
WHERE Outcome < q1 - 1.5 * (q3 - q1) OR Outcome > q3 + 1.5 * (q3 - q1)""")


# -- M5: PCA explained-variance ratios = eigenvalues of the correlation matrix / 3
# (closed-form eigenvalues of a symmetric 3 x 3 matrix, trigonometric method)
oracle("pca_explained", """,
lj AS (SELECT o.YearStart, o.StratificationCategory1, o.Stratification1, o.Outcome, d.Driver, h.Habit
  FROM outcome_national o JOIN driver_national d USING (YearStart, StratificationCategory1, Stratification1)
  LEFT JOIN habit_national h USING (YearStart, StratificationCategory1, Stratification1)),
im AS (SELECT Outcome, Driver,
              coalesce(Habit, avg(Habit) OVER (PARTITION BY StratificationCategory1, Stratification1),
                       (SELECT avg(Habit) FROM habit_national)) AS Habit FROM lj),
c AS (SELECT corr(Outcome, Driver) AS a12, corr(Outcome, Habit) AS a13, corr(Driver, Habit) AS a23
      FROM im WHERE Outcome IS NOT NULL AND Driver IS NOT NULL AND Habit IS NOT NULL),
e0 AS (SELECT *, a12 * a12 + a13 * a13 + a23 * a23 AS p1 FROM c),
e1 AS (SELECT *, sqrt(2 * p1 / 6) AS p FROM e0),
e2 AS (SELECT *, (2 * a12 * a13 * a23) / (p * p * p) / 2 AS r FROM e1),
e3 AS (SELECT *, acos(greatest(least(r, 1.0), -1.0)) / 3 AS phi FROM e2),
e4 AS (SELECT 1 + 2 * p * cos(phi) AS l1, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM e3)
SELECT 1 AS component, round_even(l1 / 3, 4) AS explained_ratio FROM e4
UNION ALL SELECT 2, round_even((3 - l1 - l3) / 3, 4) FROM e4""")


oracle("silhouette_strata", """,
lj AS (SELECT o.YearStart, o.StratificationCategory1, o.Stratification1, o.Outcome, d.Driver, h.Habit
  FROM outcome_national o JOIN driver_national d USING (YearStart, StratificationCategory1, Stratification1)
  LEFT JOIN habit_national h USING (YearStart, StratificationCategory1, Stratification1)),
im0 AS (SELECT YearStart, StratificationCategory1, Outcome, Driver,
               coalesce(Habit, avg(Habit) OVER (PARTITION BY StratificationCategory1, Stratification1),
                        (SELECT avg(Habit) FROM habit_national)) AS Habit FROM lj),
im AS (SELECT *, row_number() OVER () AS id FROM im0
       WHERE Outcome IS NOT NULL AND Driver IS NOT NULL AND Habit IS NOT NULL),
sd AS (SELECT stddev_pop(Outcome) AS so, stddev_pop(Driver) AS sdd, stddev_pop(Habit) AS sh FROM im),
lab AS (SELECT id, Outcome, Driver, Habit, 'StratificationCategory1' AS labelling, StratificationCategory1 AS label FROM im
        UNION ALL SELECT id, Outcome, Driver, Habit, 'YearStart', CAST(YearStart AS VARCHAR) FROM im),
pair AS (SELECT a.labelling, a.id, a.label AS own, b.label AS other,
                sum(sqrt(pow((a.Outcome - b.Outcome) / so, 2) + pow((a.Driver - b.Driver) / sdd, 2)
                         + pow((a.Habit - b.Habit) / sh, 2))) AS s, count(*) AS n
         FROM lab a JOIN lab b USING (labelling), sd GROUP BY 1, 2, 3, 4),
ab AS (SELECT labelling, id, max(n) FILTER (WHERE own = other) AS n_own,
              max(s / nullif(n - 1, 0)) FILTER (WHERE own = other) AS a, min(s / n) FILTER (WHERE own <> other) AS b
       FROM pair GROUP BY 1, 2)
SELECT labelling, CAST((SELECT count(DISTINCT label) FROM lab l WHERE l.labelling = ab.labelling) AS INTEGER) AS clusters,
       count(*) AS n, round_even(avg(CASE WHEN n_own > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 4)
       AS silhouette
FROM ab GROUP BY labelling""")


def _eigvec(l):
    """Unit eigenvector of the correlation matrix for eigenvalue ``l`` (cross product of
    two rows of R - l I), sign-fixed so the largest-magnitude entry is positive."""
    return f"""(SELECT *, CASE WHEN abs(vx) >= abs(vy) AND abs(vx) >= abs(vz) THEN sign(vx)
                      WHEN abs(vy) >= abs(vz) THEN sign(vy) ELSE sign(vz) END / nv AS s
   FROM (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS nv FROM
     (SELECT a12 * a23 - a13 * (1 - {l}) AS vx, a13 * a12 - (1 - {l}) * a23 AS vy,
             (1 - {l}) * (1 - {l}) - a12 * a12 AS vz FROM ev)))"""


oracle("pca_scores", f""",
lj AS (SELECT o.YearStart, o.StratificationCategory1, o.Stratification1, o.Outcome, d.Driver, h.Habit
  FROM outcome_national o JOIN driver_national d USING (YearStart, StratificationCategory1, Stratification1)
  LEFT JOIN habit_national h USING (YearStart, StratificationCategory1, Stratification1)),
im0 AS (SELECT YearStart, StratificationCategory1, Stratification1, Outcome, Driver,
               coalesce(Habit, avg(Habit) OVER (PARTITION BY StratificationCategory1, Stratification1),
                        (SELECT avg(Habit) FROM habit_national)) AS Habit FROM lj),
im AS (SELECT * FROM im0 WHERE Outcome IS NOT NULL AND Driver IS NOT NULL AND Habit IS NOT NULL),
sd AS (SELECT avg(Outcome) AS mo, stddev_pop(Outcome) AS so, avg(Driver) AS md, stddev_pop(Driver) AS sdd,
              avg(Habit) AS mh, stddev_pop(Habit) AS sh,
              corr(Outcome, Driver) AS a12, corr(Outcome, Habit) AS a13, corr(Driver, Habit) AS a23 FROM im),
e1 AS (SELECT *, sqrt(2 * (a12 * a12 + a13 * a13 + a23 * a23) / 6) AS p FROM sd),
e2 AS (SELECT *, acos(greatest(least(a12 * a13 * a23 / (p * p * p), 1.0), -1.0)) / 3 AS phi FROM e1),
ev AS (SELECT *, 1 + 2 * p * cos(phi) AS l1, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM e2),
ev2 AS (SELECT *, 3 - l1 - l3 AS l2 FROM ev),
v1 AS {_eigvec('l1')},
v2 AS {_eigvec('(SELECT l2 FROM ev2)')}
SELECT {KEYS},
  round_even(((Outcome - mo) / so) * v1.vx * v1.s + ((Driver - md) / sdd) * v1.vy * v1.s
             + ((Habit - mh) / sh) * v1.vz * v1.s, 4) AS PCA1,
  round_even(((Outcome - mo) / so) * v2.vx * v2.s + ((Driver - md) / sdd) * v2.vy * v2.s
             + ((Habit - mh) / sh) * v2.vz * v2.s, 4) AS PCA2
FROM im, sd, v1, v2""")


# -- row-grain queries (plans/row_grain.py): no survey view needed ----------------------
def plain(name, body):
    ORACLE[name] = body.strip()


plain("row_pearson_part", f"""
SELECT {test_cols()} FROM (SELECT corr(p_partkey, p_retailprice) AS r, count(*) AS n FROM part)""")
plain("row_pairwise_lineitem", _pairs_sql("lineitem", [
    ("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_discount", "l_tax")]))
oracle("row_ols_part", _ols_sql("part", "p_retailprice", "p_partkey", "price ~ key"))
plain("row_histogram_quantity", """
WITH s AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 35 AS w FROM lineitem),
c AS (SELECT least(CAST(floor((l_quantity - lo) / w) AS INTEGER), 34) AS bin, count(*) AS n
      FROM lineitem, s WHERE l_quantity IS NOT NULL GROUP BY 1)
SELECT CAST(range AS INTEGER) AS bin, round_even(lo + range * w, 6) AS bin_lo,
       round_even(lo + (range + 1) * w, 6) AS bin_hi, coalesce(n, 0) AS count
FROM range(35) CROSS JOIN s LEFT JOIN c ON c.bin = range""")
plain("row_kde_price", """
WITH v AS (SELECT p_retailprice AS x FROM part),
s AS (SELECT count(*) AS n, stddev_samp(x) * pow(CAST(count(*) AS DOUBLE), -0.2) AS bw, min(x) AS lo, max(x) AS hi FROM v),
g AS (SELECT range AS k, lo + range * ((hi - lo) / 199) AS gx FROM range(200), s),
d AS (SELECT k, sum(exp(-0.5 * pow((gx - x) / bw, 2))) AS ks FROM g, v, s GROUP BY k)
SELECT CAST(g.k AS INTEGER) AS point, round_even(g.gx, 6) AS x,
       round_even(d.ks / (n * bw * sqrt(2 * pi())), 6) AS density
FROM g JOIN d USING (k), s""")


plain("row_kde_binned_lineitem", """
WITH v AS (SELECT l_extendedprice / 1000 AS x FROM lineitem WHERE l_extendedprice IS NOT NULL),
s AS (SELECT count(*) AS n, stddev_samp(x) * pow(CAST(count(*) AS DOUBLE), -0.2) AS bw, min(x) AS lo, max(x) AS hi FROM v),
p AS (SELECT floor((x - lo) / (bw / 32)) AS cell, (x - lo) / (bw / 32) AS place FROM v, s),
node AS (SELECT cell AS i, sum(1 - (place - cell)) AS weight FROM p GROUP BY 1
         UNION ALL SELECT cell + 1, sum(place - cell) FROM p GROUP BY 1),
g AS (SELECT range AS k, lo + range * ((hi - lo) / 199) AS gx FROM range(200), s),
d AS (SELECT k, sum(weight * exp(-0.5 * pow((gx - (lo + i * (bw / 32))) / bw, 2))) AS ks FROM g, node, s GROUP BY k)
SELECT CAST(g.k AS INTEGER) AS point, round_even(g.gx, 6) AS x,
       round_even(d.ks / (n * bw * sqrt(2 * pi())), 6) AS density
FROM g JOIN d USING (k), s""")


def _box_sql(table, keys, col):
    inside = f"{col} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    return f"""
q AS (SELECT {keys}, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS median,
             quantile_cont({col}, 0.75) AS q3 FROM {table} WHERE {col} IS NOT NULL GROUP BY {keys}),
b AS (SELECT q.*, min({col}) FILTER (WHERE {inside}) AS wlo, max({col}) FILTER (WHERE {inside}) AS whi,
             count(*) FILTER (WHERE NOT ({inside})) AS n_outliers, count(*) AS n
      FROM {table} JOIN q USING ({keys}) WHERE {col} IS NOT NULL GROUP BY ALL)
SELECT {keys}, round_even(q1, 4) AS q1, round_even(median, 4) AS median, round_even(q3, 4) AS q3,
       round_even(wlo, 4) AS whisker_lo, round_even(whi, 4) AS whisker_hi, n_outliers, n FROM b"""


plain("row_box_stats_orders", "WITH " + _box_sql("orders", "o_orderpriority", "o_totalprice").strip())
_Q = (("p01", 0.01), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p99", 0.99))
plain("row_quantiles_lineitem", "SELECT l_returnflag, " + ", ".join(
    f"round_even(quantile_cont(l_extendedprice, {q}), 4) AS {n}" for n, q in _Q)
    + " FROM lineitem GROUP BY l_returnflag")
_SCORED = """per AS (SELECT CAST(n_chars AS DOUBLE) AS s, sum(quality) AS tp, sum(1 - quality) AS fp
                     FROM labels JOIN documents USING (doc_id) GROUP BY 1)"""
plain("row_auc_length_quality", f"""
WITH {_SCORED},
nb AS (SELECT *, coalesce(sum(fp) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per)
SELECT round_even(sum(tp * (below + 0.5 * fp)) / nullif(sum(tp) * sum(fp), 0), 6) AS auc FROM nb""")
plain("row_roc_length_quality", f"""
WITH {_SCORED},
cum AS (SELECT s AS threshold, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER () AS P, sum(fp) OVER () AS N
        FROM per WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT round_even(threshold, 6) AS threshold, round_even(ctp / nullif(P, 0), 6) AS tpr,
       round_even(cfp / nullif(N, 0), 6) AS fpr FROM cum""")
plain("row_stratified_folds", """
SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY
  CAST(('0x' || substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 7)) AS BIGINT), doc_id) - 1) % 5 AS INTEGER) AS fold
FROM labels""")
plain("row_contiguous_folds", """
WITH rk AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
fd AS (SELECT o_orderkey, CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1)
                               ELSE (n % 7) + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS fold FROM rk)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last
FROM fd GROUP BY 1""")
plain("row_qq_price", f"""
WITH rk AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) AS i, count(*) OVER () AS n,
                   avg(p_retailprice) OVER () AS mu, stddev_pop(p_retailprice) OVER () AS sd FROM part),
p0 AS (SELECT *, CAST(i AS DOUBLE) / (n + 1) AS p FROM rk),
p1 AS (SELECT *, {_ppf_x0('p')} AS x0 FROM p0),
p2 AS (SELECT *, ({normal_cdf_sql('x0')} - p) * 2.5066282746310002 * exp(x0 * x0 / 2.0) AS u FROM p1),
p3 AS (SELECT *, x0 - u / (1.0 + x0 * u / 2.0) AS theo FROM p2)
SELECT CAST(i AS BIGINT) AS i, round_even(theo, 4) AS theoretical, round_even(v, 4) AS sample,
       round_even(mu + sd * theo, 4) AS line FROM p3""")

oracle("fit_line_habit", """,
s AS (SELECT min(Habit) AS lo, max(Habit) AS hi, regr_slope(Outcome, Habit) AS b1,
             regr_intercept(Outcome, Habit) AS b0, regr_r2(Outcome, Habit) AS r2 FROM odh),
l AS (SELECT range AS point, lo + (hi - lo) * range / 99 AS x, b0, b1, r2 FROM range(100), s)
SELECT CAST(point AS INTEGER) AS point, round_even(x, 4) AS x, round_even(b0 + b1 * x, 4) AS y_hat,
       round_even(b1, 4) AS slope, round_even(r2, 4) AS r2 FROM l""")
oracle("residual_points_habit", f""",
f AS (SELECT regr_slope(Outcome, Habit) AS b1, regr_intercept(Outcome, Habit) AS b0 FROM odh)
SELECT {KEYS}, round_even(b0 + b1 * Habit, 4) AS fitted, round_even(Outcome - (b0 + b1 * Habit), 4) AS residual
FROM odh, f""")
oracle("histogram_driver", """,
s AS (SELECT min(Driver) AS lo, (max(Driver) - min(Driver)) / 35 AS w FROM driver_national),
c AS (SELECT least(CAST(floor((Driver - lo) / w) AS INTEGER), 34) AS bin, count(*) AS n
      FROM driver_national, s WHERE Driver IS NOT NULL GROUP BY 1)
SELECT CAST(range AS INTEGER) AS bin, round_even(lo + range * w, 6) AS bin_lo,
       round_even(lo + (range + 1) * w, 6) AS bin_hi, coalesce(n, 0) AS count
FROM range(35) CROSS JOIN s LEFT JOIN c ON c.bin = range""")
for _m in ("Driver", "Habit"):
    oracle(f"box_stats_{_m.lower()}", "," + _box_sql(
        f"{_m.lower()}_national", "StratificationCategory1, Stratification1", _m))
