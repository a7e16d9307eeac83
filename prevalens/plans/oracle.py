"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each oracle query is ``WITH <shared CTEs> <body>``.  The CTEs restate the clean
step in plain SQL (survey view -> threshold -> pivots -> weighted national
tables), written independently of the Spark operators.  Doubles are rounded
half-even on both sides so summation order cannot flip a hash.
"""

from __future__ import annotations

from ..sources.fixture import SURVEY_VIEW_SQL

MIN_SAMPLE = 10

KEYS_STATE = "YearStart, LocationDesc, StratificationCategory1, Stratification1"
KEYS_NAT = "YearStart, StratificationCategory1, Stratification1"


def _state(name: str, class_pat: str, questions: dict) -> str:
    measures = ",\n       ".join(
        f"avg(CASE WHEN Question = '{q}' THEN Data_Value END) AS {m}"
        for q, m in questions.items())
    any_present = " OR ".join(f"{m} IS NOT NULL" for m in questions.values())
    qlist = ", ".join(f"'{q}'" for q in questions)
    return f"""{name} AS (
  SELECT * FROM (
    SELECT {KEYS_STATE},
       {measures},
       CAST(round_even(avg(Sample_Size), 0) AS BIGINT) AS Sample_Size
    FROM kept
    WHERE regexp_matches(Class, '(?i){class_pat}') AND Question IN ({qlist})
      AND YearStart IS NOT NULL AND LocationDesc IS NOT NULL
      AND StratificationCategory1 IS NOT NULL AND Stratification1 IS NOT NULL
    GROUP BY {KEYS_STATE}) s
  WHERE {any_present})"""


def _national(name: str, state: str, measures: list) -> str:
    wm = ",\n       ".join(
        f"sum(CASE WHEN {m} IS NOT NULL AND Sample_Size IS NOT NULL THEN {m} * Sample_Size END)"
        f" / nullif(sum(CASE WHEN {m} IS NOT NULL AND Sample_Size IS NOT NULL"
        f" THEN Sample_Size END), 0) AS {m}" for m in measures)
    return f"""{name} AS (
  SELECT {KEYS_NAT},
       count(DISTINCT LocationDesc) AS N_States,
       CAST(sum(Sample_Size) AS BIGINT) AS Total_Sample_Size,
       {wm}
  FROM {state}
  GROUP BY {KEYS_NAT})"""


CTES = [
    f"survey AS ({SURVEY_VIEW_SQL})",
    f"kept AS (SELECT * FROM survey WHERE Sample_Size >= {MIN_SAMPLE})",
    _state("outcome_state", "Outcome", {"outcome": "Outcome"}),
    _state("driver_state", "Driver", {"driver": "Driver"}),
    _state("habit_state", "Habit", {"habit_a": "HabitA", "habit_b": "HabitB"}),
    _national("outcome_national", "outcome_state", ["Outcome"]),
    _national("driver_national", "driver_state", ["Driver"]),
    _national("habit_national0", "habit_state", ["HabitA", "HabitB"]),
    """habit_national AS (
  SELECT *, (coalesce(HabitA, 0) + coalesce(HabitB, 0))
            / nullif(CAST(HabitA IS NOT NULL AS INTEGER) + CAST(HabitB IS NOT NULL AS INTEGER), 0)
            AS Habit
  FROM habit_national0)""",
    # two-way and three-way joins on the national key, complete cases only
    """od AS (
  SELECT o.YearStart, o.StratificationCategory1, o.Stratification1, o.Outcome, d.Driver
  FROM outcome_national o JOIN driver_national d USING (YearStart, StratificationCategory1, Stratification1)
  WHERE o.Outcome IS NOT NULL AND d.Driver IS NOT NULL)""",
    """odh AS (
  SELECT od.*, h.Habit
  FROM od JOIN habit_national h USING (YearStart, StratificationCategory1, Stratification1)
  WHERE h.Habit IS NOT NULL)""",
    """odhx AS (
  SELECT od.*, h.Habit, h.HabitA, h.HabitB
  FROM od JOIN habit_national h USING (YearStart, StratificationCategory1, Stratification1)
  WHERE h.Habit IS NOT NULL AND h.HabitA IS NOT NULL AND h.HabitB IS NOT NULL)""",
]


def sql(body: str) -> str:
    return "WITH " + ",\n".join(CTES) + "\n" + body
