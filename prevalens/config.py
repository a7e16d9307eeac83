"""Survey specifications: every survey-specific name lives here.

Operators take column names as arguments; a ``SurveySpec`` bundles the names
for one survey so the plans (clean, eda, models) can be run on any table of
the same shape.  Two specs ship:

* ``NUTRITION_SURVEY`` – the public state nutrition / physical activity /
  obesity indicator CSV (33 columns, one row per year, location, class,
  question and stratum).
* ``FIXTURE_SURVEY`` – the same shape derived from the TPC-H-style test tables
  (see ``prevalens.sources.fixture``).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class MeasureGroup:
    """One class of the long table and the questions pivoted out of it."""

    label: str                      # short label used in logs and report rows
    class_pattern: str              # case-insensitive "contains" test on the class column
    questions: dict                 # question text -> measure column name

    @property
    def measures(self) -> list:
        return list(self.questions.values())


@dataclass(frozen=True)
class SurveySpec:
    outcome: MeasureGroup
    driver: MeasureGroup
    habit: MeasureGroup
    habit_score: str                # row mean of the habit measures
    year: str = "YearStart"
    location: str = "LocationDesc"
    klass: str = "Class"
    question: str = "Question"
    value: str = "Data_Value"
    sample_size: str = "Sample_Size"
    category: str = "StratificationCategory1"
    stratum: str = "Stratification1"
    total_category: str = "Total"
    min_sample_size: float = 50.0
    value_range: tuple = (0.0, 100.0)
    year_range: tuple = (2000, 2030)
    drop_columns: tuple = ()
    strat_order: dict = field(default_factory=dict)
    label: str = "HighRisk"

    @property
    def state_keys(self) -> list:
        return [self.year, self.location, self.category, self.stratum]

    @property
    def national_keys(self) -> list:
        return [self.year, self.category, self.stratum]

    @property
    def strata_keys(self) -> list:
        return [self.category, self.stratum]

    @property
    def outcome_col(self) -> str:
        return self.outcome.measures[0]

    @property
    def driver_col(self) -> str:
        return self.driver.measures[0]

    @property
    def habit_parts(self) -> list:
        return self.habit.measures


# --- fixed values: the public nutrition survey CSV ---------------------------
# Columns dropped when present (redundant, constant or surrogate columns).
NUTRITION_DROP_COLUMNS = (
    "YearEnd", "LocationAbbr", "Datasource", "Topic", "Data_Value_Unit",
    "Data_Value_Type", "Data_Value_Alt", "Data_Value_Footnote_Symbol",
    "Data_Value_Footnote", "Total", "Low_Confidence_Limit",
    "High_Confidence_Limit", "GeoLocation", "Age(years)", "Education", "Sex",
    "Income", "Race/Ethnicity", "ClassID", "TopicID", "QuestionID",
    "DataValueTypeID", "LocationID", "StratificationCategoryID1",
    "StratificationID1",
)

# Question texts kept per class and their short measure names.
NUTRITION_OUTCOME_QUESTIONS = {
    "Percent of adults aged 18 years and older who have obesity": "Obesity",
}
NUTRITION_DRIVER_QUESTIONS = {
    "Percent of adults who engage in no leisure-time physical activity": "Inactive",
}
NUTRITION_HABIT_QUESTIONS = {
    "Percent of adults who report consuming fruit less than one time daily": "LowFruit",
    "Percent of adults who report consuming vegetables less than one time daily": "LowVeg",
}

# Display order of strata inside each category; None = order by median, descending.
NUTRITION_STRAT_ORDER = {
    "Age (years)": ["18 - 24", "25 - 34", "35 - 44", "45 - 54", "55 - 64", "65 or older"],
    "Income": ["Less than $15,000", "$15,000 - $24,999", "$25,000 - $34,999",
               "$35,000 - $49,999", "$50,000 - $74,999", "$75,000 or greater"],
    "Sex": ["Male", "Female"],
    "Education": ["Less than high school", "High school graduate",
                  "Some college or technical school", "College graduate"],
    "Race/Ethnicity": None,
}
# --- end of fixed values ------------------------------------------------------

NUTRITION_SURVEY = SurveySpec(
    outcome=MeasureGroup("Obesity", "Obesity", NUTRITION_OUTCOME_QUESTIONS),
    driver=MeasureGroup("Physical Activity", "Physical Activity", NUTRITION_DRIVER_QUESTIONS),
    habit=MeasureGroup("Fruits & Vegetables", "Fruits", NUTRITION_HABIT_QUESTIONS),
    habit_score="PoorDiet",
    min_sample_size=50.0,
    drop_columns=NUTRITION_DROP_COLUMNS,
    strat_order=NUTRITION_STRAT_ORDER,
)

# The fixture derived from the test tables: three classes by return flag,
# strata by market segment / order priority / total.
FIXTURE_SURVEY = SurveySpec(
    outcome=MeasureGroup("Outcome", "Outcome", {"outcome": "Outcome"}),
    driver=MeasureGroup("Driver", "Driver", {"driver": "Driver"}),
    habit=MeasureGroup("Habit", "Habit", {"habit_a": "HabitA", "habit_b": "HabitB"}),
    habit_score="Habit",
    min_sample_size=10.0,
    year_range=(1990, 2030),
    drop_columns=NUTRITION_DROP_COLUMNS,
    strat_order={
        "Priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
        "Segment": None,
    },
)
