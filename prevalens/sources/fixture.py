"""Survey-shaped long table derived from the TPC-H-style test tables.

Grain of the result: one row per (year, location, class, question, stratum),
where the strata are a GROUPING SETS layout: market segment, order priority,
and a total row.  ``Data_Value`` is the mean line quantity of the cell and
``Sample_Size`` its line count.

Scale notes (lineitem is the only table that grows fast):

* lineitem is reduced to one row per order (a sum / count per class-question
  cell) *before* the join.  The partial aggregate runs map-side, so an order
  that owns a third of all lines collapses to one row before anything is
  shuffled, and the result is hash-partitioned on exactly the order key the
  join needs: lineitem is shuffled once.
* orders / customer joins are plain equi-joins; AQE picks broadcast or
  sort-merge from runtime sizes and splits skewed partitions (a customer with
  a third of all orders).  nation has a fixed 25-row domain; the planner's own
  size check broadcasts it.
* the GROUPING SETS aggregate expands each joined row three times but is
  partially aggregated before its shuffle; its output size is bounded by
  years x locations x questions x strata, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# --- fixed values: how the fixture maps TPC-H columns onto the survey shape ---
RETURNFLAG_CLASS = {"A": "Outcome", "N": "Driver", "R": "Habit"}
HABIT_YEARS = (1996, 1998, 2000)      # habit questions asked only in these years
SEGMENT_CATEGORY = "Segment"
PRIORITY_CATEGORY = "Priority"
TOTAL_CATEGORY = "Total"
TOTAL_STRATUM = "Overall"
# --- end of fixed values -------------------------------------------------------


def _class_expr(flag):
    expr = None
    for code, name in RETURNFLAG_CLASS.items():
        expr = (F.when(flag == code, name) if expr is None
                else expr.when(flag == code, name))
    return expr


def _question_expr(flag, partkey):
    habit_q = F.when(partkey % 2 == 0, F.lit("habit_a")).otherwise(F.lit("habit_b"))
    return (F.when(flag == "A", F.lit("outcome"))
            .when(flag == "N", F.lit("driver"))
            .otherwise(habit_q))


# (class, question) cells a line can fall in; a NULL class covers unknown flags
_CELLS = [("Outcome", "outcome"), ("Driver", "driver"), ("Habit", "habit_a"),
          ("Habit", "habit_b"), (None, "habit_a"), (None, "habit_b")]


def survey_view(spark: SparkSession, sf_dir: str, *, raw_columns: bool = False) -> DataFrame:
    """The long survey table (8 survey columns; plus droppable extras if ``raw_columns``)."""
    flag, partkey = F.col("l_returnflag"), F.col("l_partkey")
    lines = (read_table(spark, sf_dir, "lineitem")
             .select("l_orderkey", "l_quantity",
                     _class_expr(flag).alias("Class"),
                     _question_expr(flag, partkey).alias("Question")))
    # One row per order; per (class, question) cell its sum, values, rows, min and max.
    # A cell's mean is over its values, its sample size counts all its rows.
    # Grouping by the order key alone keeps the map-side combine (an order with
    # a third of all lines collapses to one row before the shuffle) and leaves
    # the result hash-partitioned on exactly the key the orders join needs, so
    # lineitem is shuffled once.
    aggs = []
    for i, (c, q) in enumerate(_CELLS):
        hit = F.col("Class").eqNullSafe(F.lit(c)) & (F.col("Question") == q)
        qty = F.when(hit, F.col("l_quantity"))
        aggs += [F.sum(qty).alias(f"qty{i}"), F.count(qty).alias(f"m{i}"), F.count_if(hit).alias(f"n{i}")]
        if raw_columns:   # min / max only feed the raw file's confidence-limit columns
            aggs += [F.min(qty).alias(f"qmin{i}"), F.max(qty).alias(f"qmax{i}")]
    per_order = lines.groupBy("l_orderkey").agg(*aggs)

    orders = (read_table(spark, sf_dir, "orders")
              .select("o_orderkey", "o_custkey", "o_orderpriority",
                      F.year("o_orderdate").alias("YearStart")))
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select(
        "n_nationkey", F.col("n_name").alias("LocationDesc"))

    joined = (per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
              .join(customer, F.col("o_custkey") == F.col("c_custkey"))
              .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))
    # back to one row per (order, cell) with lines, just before the grouping sets
    def cell_struct(i, c, q):
        fields = [F.lit(c).cast("string").alias("Class"), F.lit(q).alias("Question"),
                  F.col(f"qty{i}").alias("qty"), F.col(f"m{i}").alias("m"),
                  F.col(f"n{i}").alias("n")]
        if raw_columns:
            fields += [F.col(f"qmin{i}").alias("qmin"), F.col(f"qmax{i}").alias("qmax")]
        return F.struct(*fields)
    cell = F.explode(F.array(*[cell_struct(i, c, q) for i, (c, q) in enumerate(_CELLS)])).alias("cell")
    long = (joined.select("YearStart", "LocationDesc", "c_mktsegment", "o_orderpriority", cell)
            .select("YearStart", "LocationDesc", "c_mktsegment", "o_orderpriority", "cell.*")
            .where((F.col("n") > 0)
                   & (~F.col("Class").eqNullSafe("Habit") | F.col("YearStart").isin(*HABIT_YEARS))))

    keys = ["YearStart", "LocationDesc", "Class", "Question"]
    seg, prio = "c_mktsegment", "o_orderpriority"
    extra = [F.min("qmin").alias("_qmin"), F.max("qmax").alias("_qmax")] if raw_columns else []
    cells = (long.groupingSets([keys + [seg], keys + [prio], keys], *keys, seg, prio)
             .agg(F.grouping(seg).alias("_g_seg"), F.grouping(prio).alias("_g_prio"),
                  F.try_divide(F.sum("qty"), F.sum("m")).alias("Data_Value"),
                  F.sum("n").cast("double").alias("Sample_Size"), *extra))

    category = (F.when(F.col("_g_seg") == 0, F.lit(SEGMENT_CATEGORY))
                .when(F.col("_g_prio") == 0, F.lit(PRIORITY_CATEGORY))
                .otherwise(F.lit(TOTAL_CATEGORY)))
    stratum = F.coalesce(F.col(seg), F.col(prio), F.lit(TOTAL_STRATUM))
    cols = [F.col("YearStart"), F.col("LocationDesc"), F.col("Class"), F.col("Question"),
            F.col("Data_Value"), F.col("Sample_Size"),
            category.alias("StratificationCategory1"), stratum.alias("Stratification1")]
    if raw_columns:
        cols += [
            F.col("YearStart").alias("YearEnd"),
            F.lit("TPCH").alias("Datasource"),
            F.col("Class").alias("Topic"),
            F.lit("%").alias("Data_Value_Unit"),
            F.lit("Value").alias("Data_Value_Type"),
            F.col("Data_Value").alias("Data_Value_Alt"),
            F.when(F.col("Sample_Size") < 10, F.lit("Small sample")).alias("Data_Value_Footnote"),
            F.col("_qmin").alias("Low_Confidence_Limit"),
            F.col("_qmax").alias("High_Confidence_Limit"),
        ]
    return cells.select(*cols)


# DuckDB twin of ``survey_view`` (used by the oracle SQL and the tests).
SURVEY_VIEW_SQL = """
SELECT YearStart, LocationDesc, Class, Question,
       sum_q / nullif(cnt_q, 0) AS Data_Value, CAST(cnt AS DOUBLE) AS Sample_Size,
       CASE WHEN g_seg = 0 THEN 'Segment' WHEN g_prio = 0 THEN 'Priority' ELSE 'Total' END
         AS StratificationCategory1,
       coalesce(c_mktsegment, o_orderpriority, 'Overall') AS Stratification1
FROM (
  SELECT YearStart, LocationDesc, Class, Question, c_mktsegment, o_orderpriority,
         grouping(c_mktsegment) AS g_seg, grouping(o_orderpriority) AS g_prio,
         sum(l_quantity) AS sum_q, count(l_quantity) AS cnt_q, count(*) AS cnt
  FROM (
    SELECT year(o.o_orderdate) AS YearStart, n.n_name AS LocationDesc,
           CASE l.l_returnflag WHEN 'A' THEN 'Outcome' WHEN 'N' THEN 'Driver'
                               WHEN 'R' THEN 'Habit' END AS Class,
           CASE WHEN l.l_returnflag = 'A' THEN 'outcome'
                WHEN l.l_returnflag = 'N' THEN 'driver'
                WHEN l.l_partkey % 2 = 0 THEN 'habit_a' ELSE 'habit_b' END AS Question,
           c.c_mktsegment, o.o_orderpriority, l.l_quantity
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
  ) b
  WHERE Class IS DISTINCT FROM 'Habit' OR YearStart IN (1996, 1998, 2000)
  GROUP BY GROUPING SETS ((YearStart, LocationDesc, Class, Question, c_mktsegment),
                          (YearStart, LocationDesc, Class, Question, o_orderpriority),
                          (YearStart, LocationDesc, Class, Question))
) g
"""
