"""DuckDB twins of the logistic and decision tree queries.

The logistic twin does not repeat the engine's Newton steps: it iterates with the
fixed bound X'X/4 of the second derivatives, whose inverse is found once by
Gauss-Jordan elimination on lists.  The tree twin finds every cut with plain windows
over the distinct values.
"""

from __future__ import annotations

from .oracle import sql
from .oracle_queries import _HASH, _LAB_A, _LAB_B, KEYS, ORACLE

_FEATURES = {"A": ("Driver", "Strat_Segment", "Strat_Total"),
             "B": ("Driver", "Habit", "Strat_Segment", "Strat_Total")}
_STEPS = 600


def _recursive(body: str) -> str:
    return sql(body).replace("WITH ", "WITH RECURSIVE ", 1)


def _rows(tag: str) -> str:
    """x{tag}: key columns, fold, y and the list x = [1, standardised features]."""
    table = "lab" if tag == "A" else "labb"
    names = _FEATURES[tag]
    z = ", ".join(f"(CAST({f} AS DOUBLE) - avg(CAST({f} AS DOUBLE)) OVER ()) / "
                  f"coalesce(nullif(stddev_pop(CAST({f} AS DOUBLE)) OVER (), 0), 1)" for f in names)
    return f"""x{tag} AS MATERIALIZED (
  SELECT {KEYS}, CAST(HighRisk AS DOUBLE) AS y, [1.0::DOUBLE, {z}] AS x,
         (row_number() OVER (PARTITION BY HighRisk ORDER BY {_HASH}, YearStart, StratificationCategory1,
                             Stratification1) - 1) % 5 AS fold FROM {table}),
m{tag} AS MATERIALIZED (SELECT x{tag}.*, model FROM x{tag}, range(0, 6) AS models(model) WHERE model <> fold)"""


def _logistic(tag: str) -> str:
    """w{tag}: model and its coefficient list."""
    p = len(_FEATURES[tag]) + 1
    gram = ", ".join("[" + ", ".join(
        [f"sum(x[{i}] * x[{j}]) / 4 + {1.0 if i == j and i > 1 else 0.0}" for j in range(1, p + 1)]
        + [str(float(i == j)) for j in range(1, p + 1)]) + "]" for i in range(1, p + 1))
    out = [f"inv{tag}0 AS MATERIALIZED (SELECT model, [{gram}] AS g FROM m{tag} GROUP BY model)"]
    for k in range(1, p + 1):
        out.append(f"inv{tag}{k} AS MATERIALIZED (SELECT model, list_transform(g, lambda line, i: list_transform(line, "
                   f"lambda v, j: CASE WHEN i = {k} THEN v / g[{k}][{k}] "
                   f"ELSE v - line[{k}] * g[{k}][j] / g[{k}][{k}] END)) AS g FROM inv{tag}{k - 1})")
    gradient = ", ".join(f"sum(e * x[{i}])" + (f" + any_value(w)[{i}]" if i > 1 else "") for i in range(1, p + 1))
    out.append(f"""steps{tag} AS (
  SELECT 0 AS step, model, [{', '.join(['0.0::DOUBLE'] * p)}] AS w FROM inv{tag}{p}
  UNION ALL
  SELECT step + 1, d.model, list_transform(w, lambda v, i: v - list_dot_product(g[i][{p + 1}:{2 * p}], d.d)) AS w
  FROM (SELECT any_value(step) AS step, model, any_value(w) AS w, [{gradient}] AS d
        FROM (SELECT step, m.model, x, w, 1 / (1 + exp(-list_dot_product(w, x))) - y AS e
              FROM steps{tag} AS s JOIN m{tag} AS m ON m.model = s.model) GROUP BY model) AS d
  JOIN inv{tag}{p} AS b ON b.model = d.model WHERE step < {_STEPS})""")
    out.append(f"w{tag} AS MATERIALIZED (SELECT model, w FROM steps{tag} WHERE step = {_STEPS})")
    out.append(f"""scored{tag} AS MATERIALIZED (
  SELECT model, fold, y, 1 / (1 + exp(-z)) AS score, CAST(z > 0 AS DOUBLE) AS prediction
  FROM (SELECT model, fold, y, list_dot_product(w, x) AS z FROM x{tag}, w{tag}
        WHERE model = fold OR model = 5))""")
    return ",\n".join(out)


def _tree(tag: str, depth: int = 5) -> str:
    """nodes{tag} and scored{tag}: the trees of all folds and of all rows."""
    n = len(_FEATURES[tag])
    out = [f"""r{tag}0 AS MATERIALIZED (
  SELECT x{tag}.*, model, CAST(model <> fold AS DOUBLE) AS weight, 1::BIGINT AS node
  FROM x{tag}, range(0, 6) AS models(model))"""]
    for d in range(depth + 1):
        out.append(f"""n{tag}{d} AS MATERIALIZED (
  SELECT model, node, sum(weight) AS n, sum(weight * y) AS ones FROM r{tag}{d}
  WHERE node >= {2 ** d} AND node < {2 ** (d + 1)} GROUP BY model, node)""")
        if d == depth:
            break
        out.append(f"""v{tag}{d} AS MATERIALIZED (
  SELECT r.model, r.node, f, r.x[f + 2] AS v, any_value(k.n) AS a, any_value(k.ones) AS a1, sum(weight) AS n,
         sum(weight * y) AS ones
  FROM r{tag}{d} AS r JOIN n{tag}{d} AS k ON k.model = r.model AND k.node = r.node, range(0, {n}) AS features(f)
  WHERE weight > 0 AND k.ones > 0 AND k.ones < k.n GROUP BY r.model, r.node, f, r.x[f + 2])""")
        out.append(f"""c{tag}{d} AS MATERIALIZED (
  SELECT model, node, f, v, a, a1, lead(v) OVER s AS above, sum(n) OVER s AS l, sum(ones) OVER s AS l1
  FROM v{tag}{d} WINDOW s AS (PARTITION BY model, node, f ORDER BY v))""")
        out.append(f"""b{tag}{d} AS MATERIALIZED (
  SELECT model, node, f, (v + above) / 2 AS threshold FROM c{tag}{d} WHERE above IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY
    (l1 * l1 + (l - l1) * (l - l1)) / l
    + ((a1 - l1) * (a1 - l1) + ((a - l) - (a1 - l1)) * ((a - l) - (a1 - l1))) / (a - l) DESC, f, v) = 1)""")
        out.append(f"""r{tag}{d + 1} AS MATERIALIZED (
  SELECT r.* REPLACE (CASE WHEN f IS NULL THEN r.node ELSE 2 * r.node + CAST(x[f + 2] > threshold AS BIGINT) END AS node)
  FROM r{tag}{d} AS r LEFT JOIN b{tag}{d} AS b ON b.model = r.model AND b.node = r.node)""")
    parts = [f"SELECT k.*, {d} AS depth, " + ("f, threshold" if d < depth else "NULL AS f, NULL AS threshold")
             + f" FROM n{tag}{d} AS k" + (f" LEFT JOIN b{tag}{d} AS b ON b.model = k.model AND b.node = k.node" if d < depth else "")
             for d in range(depth + 1)]
    out.append(f"nodes{tag} AS MATERIALIZED (" + "\n  UNION ALL BY NAME ".join(parts) + ")")
    out.append(f"""scored{tag} AS MATERIALIZED (
  SELECT r.model, fold, y, ones / n AS score, CAST(ones / n > 0.5 AS DOUBLE) AS prediction
  FROM r{tag}{depth} AS r JOIN nodes{tag} AS k ON k.model = r.model AND k.node = r.node
  WHERE r.model = fold OR r.model = 5)""")
    return ",\n".join(out)


def _report(tag: str, classifier: str) -> str:
    """report{tag}: one row as ``results_table`` writes it."""
    return f"""auc{tag} AS (
  SELECT p.model, sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) / count(*) AS auc
  FROM scored{tag} AS p JOIN scored{tag} AS q ON q.model = p.model AND p.y = 1 AND q.y = 0 GROUP BY p.model),
counts{tag} AS (
  SELECT model, count(*) FILTER (WHERE y = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE y = 0 AND prediction = 1) AS fp,
         count(*) FILTER (WHERE y = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE y = 1 AND prediction = 0) AS fn
  FROM scored{tag} GROUP BY model),
rates{tag} AS (
  SELECT c.model, coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) AS accuracy,
         coalesce(tp / nullif(tp + fp, 0), 0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0) AS rec,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, auc
  FROM counts{tag} AS c LEFT JOIN auc{tag} AS a ON a.model = c.model),
report{tag} AS (
  SELECT '{tag}' AS dataset, '{classifier}' AS Classifier, cv.*, round_even(accuracy, 4) AS Train_Acc,
         round_even(prec, 4) AS Precision, round_even(rec, 4) AS Recall, round_even(f1, 4) AS F1
  FROM rates{tag}, (SELECT round_even(avg(accuracy), 4) AS CV_Accuracy, round_even(stddev_pop(accuracy), 4) AS CV_Acc_Std,
    round_even(avg(f1), 4) AS CV_F1, round_even(stddev_pop(f1), 4) AS CV_F1_Std, round_even(avg(auc), 4) AS CV_AUC,
    round_even(stddev_pop(auc), 4) AS CV_AUC_Std FROM rates{tag} WHERE model < 5) AS cv WHERE model = 5)"""


_HEAD = f", {_LAB_A}, {_LAB_B}, {_rows('A')}, {_rows('B')}"
_LOGISTIC = f"{_HEAD}, {_logistic('A')}, {_logistic('B')}"
_TREES = f"{_HEAD}, {_tree('A')}, {_tree('B')}"


def _names(tag: str, at: str) -> str:
    return "[" + ", ".join(f"'{f}'" for f in _FEATURES[tag]) + f"][{at} + 1]"


def _nodes(tag: str, dataset: bool = True, depth: int = 5) -> str:
    return f"""SELECT {f"'{tag}' AS dataset," if dataset else ''} node AS id, node // 2 AS parent,
       CAST(depth AS INTEGER) AS depth, {_names(tag, 'f')} AS feature, round_even(threshold, 6) AS threshold,
       round_even(2 * (ones / n) * (1 - ones / n), 6) AS gini, CAST(n AS BIGINT) AS n, CAST(n - ones AS BIGINT) AS n_0,
       CAST(ones AS BIGINT) AS n_1 FROM nodes{tag} WHERE model = 5 AND depth <= {depth}"""


def _importance(tag: str) -> str:
    return f"""SELECT '{tag}' AS dataset, feature, round_even(coalesce(gain / total, 0), 4) AS importance FROM (
  SELECT feature, sum(gain) AS gain, sum(sum(gain)) OVER () AS total FROM (
    SELECT {_names(tag, 'f')} AS feature, n * 2 * (ones / n) * (1 - ones / n) - (
      SELECT sum(c.n * 2 * (c.ones / c.n) * (1 - c.ones / c.n)) FROM nodes{tag} AS c
      WHERE c.model = 5 AND c.node // 2 = k.node) AS gain FROM nodes{tag} AS k WHERE model = 5 AND f IS NOT NULL
    UNION ALL SELECT {_names(tag, 'f')}, 0.0 FROM range(0, {len(_FEATURES[tag])}) AS every(f)) GROUP BY feature)"""


def _coefs(tag: str) -> str:
    terms = "[" + ", ".join(f"'{t}'" for t in ("Intercept", *_FEATURES[tag])) + "]"
    return f"""SELECT '{tag}' AS dataset, CASE WHEN model = 5 THEN 'full' ELSE 'without fold ' || model END AS model,
       unnest({terms}) AS term, round_even(unnest(w), 6) AS coef FROM w{tag}"""


ORACLE["logistic_models"] = _recursive(f"{_LOGISTIC}\n{_coefs('A')} UNION ALL {_coefs('B')}")
ORACLE["logistic_report"] = _recursive(
    f"{_LOGISTIC}, {_report('A', 'Logistic Regression')}, {_report('B', 'Logistic Regression')}\n"
    "SELECT * FROM reportA UNION ALL SELECT * FROM reportB")
ORACLE["confusion_matrix_logistic"] = _recursive(f"""{_LOGISTIC}
SELECT CAST(y AS INTEGER) AS actual, count(*) FILTER (WHERE prediction = 0) AS pred_0,
       count(*) FILTER (WHERE prediction = 1) AS pred_1 FROM scoredA WHERE model = 5 GROUP BY y""")
ORACLE["roc_curve_logistic"] = _recursive(f"""{_LOGISTIC},
per AS (SELECT round(score, 9) AS threshold, sum(y) AS tp, sum(1 - y) AS fp FROM scoredA WHERE model = 5 GROUP BY round(score, 9))
SELECT round_even(threshold, 6) AS threshold,
       round_even(sum(tp) OVER s / nullif(sum(tp) OVER (), 0), 6) AS tpr,
       round_even(sum(fp) OVER s / nullif(sum(fp) OVER (), 0), 6) AS fpr
FROM per WINDOW s AS (ORDER BY threshold DESC)""")
ORACLE["tree_nodes"] = sql(f"{_TREES}\n{_nodes('A')} UNION ALL {_nodes('B')}")
ORACLE["tree_rules"] = sql(f"{_TREES}\n{_nodes('A', False, 3)}")
ORACLE["tree_importance"] = sql(f"{_TREES}\n{_importance('A')} UNION ALL {_importance('B')}")
ORACLE["tree_report"] = sql(f"{_TREES}, {_report('A', 'Decision Tree')}, {_report('B', 'Decision Tree')}\n"
                            "SELECT * FROM reportA UNION ALL SELECT * FROM reportB")
