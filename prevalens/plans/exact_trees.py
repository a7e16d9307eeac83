"""Decision trees and forests grown level by level from exact counts.

Every row is routed in every model (a fold's tree, a tree of a forest) with a
weight: 0 where the model must not learn from it.  A level is one pass:

1. counts per (model, node, feature, value), summed map side;
2. running counts in the order of the values (``windows.prefix_sums``: bucketed, no
   task holds a node), which give the gini gain of every cut between two distinct
   values; no bins;
3. the best cut of every impure node, and one aggregate over its rows for the
   midpoint between the values left and right of it;
4. rows move to the child nodes 2 n and 2 n + 1.

An impure node with few rows (``IN_TASK``) leaves the levels: one task takes its rows and
grows the rest of its tree by the same counts, gains, draws and ties, all such nodes of all
models in one job.  Levels, and with them jobs, therefore follow the logarithm of the rows
over ``IN_TASK`` and not the depth of the trees, which may be the number of rows; a task
never holds a larger node.

Weights are whole numbers, so the counts and therefore the tree do not depend on
the order or the partitioning of the rows.  Equal gains are decided by the lower
feature, then the lower value.  Rows without weight are routed along: their final
nodes are the held-out predictions.

A forest's bootstrap weights and feature choices are hashes of (tree, key) and
(tree, node, feature).  The weights are Poisson(1) counts, the usual limit of drawing
n rows out of n.

Edge cases: null and NaN feature values lie right of every value (a cut may part them from
the known ones);
a model whose rows all have weight 0 is one node with probability 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import windows
from ..session import materialize, package_for_workers

#: Rows up to which a node's tree is grown inside a task.
IN_TASK = 10_000
DEEPEST = 61
_NODE = ["model", "node"]
_FOUND = ["found_depth int", "found_n double", "found_ones double", "found_feature int", "found_threshold double"]


def gini(n: Column, ones: Column) -> Column:
    share = F.try_divide(ones, n)
    return F.coalesce(2 * share * (1 - share), F.lit(0.0))


def _purity(n: Column, ones: Column) -> Column:
    """Sum of squared class counts over the count."""
    return (ones * ones + (n - ones) * (n - ones)) / n


def _best_cuts(rows: DataFrame, nodes: DataFrame, max_features: int | None, seed: int) -> DataFrame:
    """(model, node, feature, at): the best cut x <= at of every impure node."""
    x = F.nullif(F.col("value"), F.lit(float("nan")))
    seen = (rows.where("weight > 0").select(*_NODE, "label", "weight", F.posexplode("x").alias("feature", "value"))
            .select(*_NODE, "feature", x.alias("value"), "weight", (F.col("label") * F.col("weight")).alias("ones"))
            .where("value is not null")
            .groupBy(*_NODE, "feature", "value").agg(F.sum("weight").alias("n"), F.sum("ones").alias("ones")))
    seen = materialize(seen)
    size = seen.count()
    if not size:
        return seen.select(*_NODE, "feature", F.col("value").alias("at"))
    # the buckets only spread the work: about 4,096 distinct values each
    most = max(256, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ran = windows.prefix_sums(seen, "value", ["n", "ones"], group_cols=[*_NODE, "feature"],
                              buckets=max(2, min(most, size // 4_096)))
    total = nodes.select(*_NODE, F.col("n").alias("all"), F.col("ones").alias("all_ones"))
    cut = ran.join(total, _NODE).where("cum_n < all")
    left_n, left = F.col("cum_n"), F.col("cum_ones")
    cut = cut.select(*_NODE, "feature", "value", (_purity(left_n, left) + _purity(
        F.col("all") - left_n, F.col("all_ones") - left)).alias("gain"))
    best = cut.groupBy(*_NODE, "feature").agg(
        F.max(F.struct("gain", (-F.col("value")).alias("low"))).alias("b"))
    if max_features is not None:
        # features without a cut do not count; at most one row per feature in a window
        drawn = F.row_number().over(Window.partitionBy(*_NODE).orderBy(
            F.xxhash64(F.lit(seed), *_NODE, "feature"), "feature"))
        best = best.withColumn("drawn", drawn).where(F.col("drawn") <= max_features)
    return (best.groupBy(*_NODE).agg(F.max(F.struct("b.gain", (-F.col("feature")).alias("f"), "b.low")).alias("b"))
            .select(*_NODE, (-F.col("b.f")).alias("feature"), (-F.col("b.low")).alias("at")))


def _draw(seed: int, model, node: int, features: np.ndarray) -> np.ndarray:
    """``xxhash64(seed, model, node, feature)`` of some features, as the levels compute it."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(h, by):
        return (h << np.uint64(by)) | (h >> np.uint64(64 - by))

    h = np.full(len(features), 42, np.uint64)
    for value in (np.int32(seed), model, np.int64(node), features.astype(np.int32)):
        v = np.atleast_1d(value)
        if v.dtype == np.int32:
            h = turned((h + p5 + np.uint64(4)) ^ (v.view(np.uint32).astype(np.uint64) * p1), 23) * p2 + p3
        else:
            h = turned((h + p5 + np.uint64(8)) ^ (turned(v.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def _cut(x: np.ndarray, weight: np.ndarray, ones: np.ndarray, draw, max_features: int | None):
    """(feature, threshold) of the best cut of a node's weighted rows, or None."""
    n, all_ones = float(weight.sum()), float(ones.sum())
    best = []                                            # (gain, -feature, -value) of every feature with a cut
    for f in range(x.shape[1]):
        known = ~np.isnan(x[:, f])
        values, at = np.unique(x[known, f], return_inverse=True)
        left_n = np.cumsum(np.bincount(at, weight[known], len(values)))
        left = np.cumsum(np.bincount(at, ones[known], len(values)))
        use = left_n < n
        if use.any():
            gain = _purity(left_n[use], left[use]) + _purity(n - left_n[use], all_ones - left[use])
            i = int(np.argmax(gain))
            best.append((float(gain[i]), -f, -float(values[use][i])))
    if max_features is not None and len(best) > max_features:
        features = np.array([-b[1] for b in best])
        best = [best[i] for i in np.lexsort((features, draw(features)))[:max_features]]
    if not best:
        return None
    _, f, at = max(best)
    value = x[:, -f]
    below, above = value[value <= -at].max(), value[value > -at]
    return -f, float((below + above.min()) / 2 if len(above) else below)


def _finish(max_depth: int | None, max_features: int | None, seed: int):
    """The rest of a node's tree: its rows with their final nodes, and one row per node found."""
    def run(table):
        model = table.column("model").to_numpy()[:1]
        lists = table.column("x").combine_chunks()
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        x = np.full((len(size), max(size.max(), 1)), np.nan)
        x[np.repeat(np.arange(len(size)), size),
          np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = (
            lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
        x = x + 0.0                                      # one zero
        weight = table.column("weight").to_numpy().astype(np.float64)
        ones = table.column("label").to_numpy().astype(np.float64) * weight
        final = table.column("node").to_numpy().copy()
        found, todo = [], [(int(final[0]), np.arange(len(final)))]
        while todo:
            node, rows = todo.pop()
            depth = node.bit_length() - 1
            n, k = float(weight[rows].sum()), float(ones[rows].sum())
            cut = None
            if 0 < k < n and depth < DEEPEST and (max_depth is None or depth < max_depth):
                used = rows[weight[rows] > 0]
                cut = _cut(x[used], weight[used], ones[used],
                           lambda features: _draw(seed, model, node, features), max_features)
            found.append((node, depth, n, k, *(cut or (None, None))))
            if cut is None:
                final[rows] = node
                continue
            left = x[rows, cut[0]] <= cut[1]
            todo += [(2 * node + side, part) for side, part in ((0, rows[left]), (1, rows[~left])) if len(part)]
        node, *fields = (list(c) for c in zip(*found))
        types = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64()]
        names = [f.split()[0] for f in _FOUND]
        routed = table.set_column(table.schema.get_field_index("node"), "node", pa.array(final, pa.int64()))
        for name, kind in zip(names, types):
            routed = routed.append_column(name, pa.nulls(len(final), kind))
        given = {"model": pa.array(np.repeat(model, len(node)), table.schema.field("model").type),
                 "node": pa.array(node, pa.int64()), **dict(zip(names, map(pa.array, fields, types)))}
        nodes = pa.table([given.get(c, pa.nulls(len(node), routed.schema.field(c).type)) for c in routed.column_names],
                         names=routed.column_names)
        return pa.concat_tables([routed.cast(nodes.schema), nodes])
    return run


def grow(rows: DataFrame, max_depth: int | None = 5, max_features: int | None = None, seed: int = 42,
         in_task: int = IN_TASK) -> tuple:
    """(nodes, routed rows) of all models.

    ``rows``: model, label (0 or 1), weight (whole), x (array) and any other columns.
    Nodes: model, node, depth, n, ones, gini, feature (from 0, null for a leaf), threshold.
    Routed rows: ``rows`` with their final node.  ``in_task`` sets where the work is done, not the result.
    """
    package_for_workers(rows.sparkSession)
    live = materialize(rows.withColumn("node", F.lit(1).cast("long")))
    done, waiting, depth = [], [], 0
    while True:
        level = (F.col("node") >= 2 ** depth) & (F.col("node") < 2 ** (depth + 1))
        nodes = materialize(live.where(level).groupBy(*_NODE).agg(
            F.sum("weight").cast("double").alias("n"), F.sum(F.col("label") * F.col("weight")).cast("double").alias("ones"),
            F.count(F.lit(1)).alias("held"), F.count(F.col("label") * F.col("weight")).alias("known")))
        impure = F.coalesce((F.col("ones") > 0) & (F.col("ones") < F.col("n")), F.lit(False))
        small = impure & (F.col("held") <= in_task) & (F.col("known") == F.col("held"))
        if max_depth is not None and depth >= max_depth or depth >= DEEPEST:
            done.append(_level(nodes, None, depth))
            break
        waiting.append(nodes.where(small).select(*_NODE))
        nodes = nodes.where(~small)
        impure = nodes.where(impure)
        if impure.isEmpty():
            done.append(_level(nodes, None, depth))
            break
        inside = live.join(impure.select(*_NODE), _NODE, "left_semi")
        cuts = materialize(_best_cuts(inside, impure, max_features, seed))
        value = F.get("x", F.col("feature"))
        value = F.nullif(value, F.lit(float("nan")))
        reach = inside.where("weight > 0").join(cuts, _NODE)
        ends = reach.groupBy(*_NODE, "feature", "at").agg(
            F.max(F.when(value <= F.col("at"), value)).alias("below"),
            F.min(F.when(value > F.col("at"), value)).alias("above"))
        # a node whose right side holds null values only is cut at the value itself
        ends = materialize(ends.select(*_NODE, "feature", F.when(
            F.col("above").isNull(), F.col("below")).otherwise((F.col("below") + F.col("above")) / 2).alias("threshold")))
        done.append(_level(nodes, ends, depth))
        right = (~F.coalesce(value <= F.col("threshold"), F.lit(False))).cast("long")
        live = materialize(live.join(ends, _NODE, "left").withColumn(
            "node", F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right))
            .drop("feature", "threshold").select(*live.columns))
        depth += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    if not waiting:
        return out, live
    left = waiting[0]
    for part in waiting[1:]:
        left = left.unionByName(part)
    once = {f.name: T.StructField(f.name, f.dataType) for f in live.schema.fields}   # a column may be given twice
    schema = T.StructType([*once.values(), *T.StructType.fromDDL(", ".join(_FOUND)).fields])
    grown = materialize(live.join(left, _NODE, "left_semi").select(*once).groupBy(*_NODE).applyInArrow(
        _finish(max_depth, max_features, seed), schema))
    found = grown.where("found_depth is not null").select(
        *_NODE, F.col("found_depth").alias("depth"), F.col("found_n").alias("n"), F.col("found_ones").alias("ones"),
        gini(F.col("found_n"), F.col("found_ones")).alias("gini"), F.col("found_feature").alias("feature"),
        F.col("found_threshold").alias("threshold"))
    live = live.join(left, _NODE, "left_anti").select(*live.columns).union(
        grown.where("found_depth is null").select(*live.columns))
    return out.unionByName(found), live


def _level(nodes: DataFrame, ends: DataFrame | None, depth: int) -> DataFrame:
    if ends is None:
        nodes = nodes.withColumn("feature", F.lit(None).cast("int")).withColumn("threshold", F.lit(None).cast("double"))
    else:
        nodes = nodes.join(ends, _NODE, "left")
    return materialize(nodes.select(*_NODE, F.lit(depth).alias("depth"), "n", "ones",
                                    gini(F.col("n"), F.col("ones")).alias("gini"), "feature", "threshold"))


def leaf_scores(nodes: DataFrame, routed: DataFrame) -> DataFrame:
    """``routed`` with ``prob``, the share of label 1 in the final node."""
    leaf = nodes.select(*_NODE, F.coalesce(F.try_divide("ones", "n"), F.lit(0.0)).alias("prob"))
    return routed.join(leaf, _NODE)


def poisson_weight(key: Column, tree: Column, seed: int) -> Column:
    """Poisson(1) count from a hash of tree and key."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), tree, key), 11).cast("double") / float(1 << 53)
    total, out = 0.0, F.lit(0)
    for i in range(18):                       # beyond: under 1e-16
        total += math.exp(-1) / math.factorial(i)
        out = out + (u >= F.lit(total)).cast("int")
    return out


def fold_rows(data: DataFrame, k: int = 5) -> DataFrame:
    """Rows of the models 0 ... k - 1 (without that fold) and k (all)."""
    every = F.explode(F.array(*[F.lit(m) for m in range(k + 1)])).alias("model")
    return data.select("*", every).withColumn(
        "weight", (F.col("model") != F.coalesce("fold", F.lit(-1))).cast("int"))


def forest_rows(data: DataFrame, key: Column, trees: int, k: int = 5, seed: int = 42) -> DataFrame:
    """Rows of ``trees`` trees per fold model; model = fold model * trees + tree."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    rows = fold_rows(data, k).withColumn("of", F.col("model")).select("*", tree)
    return (rows.withColumn("weight", F.col("weight") * poisson_weight(key, F.col("tree"), seed))
            .withColumn("model", F.col("of") * trees + F.col("tree")).drop("tree"))


def importances(nodes: DataFrame, features: list) -> DataFrame:
    """(feature, importance): mean over the models of their normalised gini decreases; sums to 1."""
    child = nodes.select("model", F.shiftright("node", 1).alias("node"), (F.col("n") * F.col("gini")).alias("rest"))
    child = child.groupBy(*_NODE).agg(F.sum("rest").alias("rest"))
    gain = (nodes.where("feature is not null").join(child, _NODE)
            .select("model", "feature", (F.col("n") * F.col("gini") - F.col("rest")).alias("gain"))
            .groupBy("model", "feature").agg(F.sum("gain").alias("gain")))
    total = gain.groupBy("model").agg(F.sum("gain").alias("total"))
    models = nodes.where("depth = 0 and feature is not null").agg(F.count(F.lit(1)).alias("models"))
    share = (gain.join(total, "model").groupBy("feature")
             .agg(F.sum(F.try_divide("gain", "total")).alias("share")))
    names = F.array(*[F.lit(f) for f in features])
    every = (nodes.sparkSession.range(len(features)).select(F.col("id").cast("int").alias("feature"))
             .join(share, "feature", "left"))
    return every.select(F.get(names, F.col("feature")).alias("feature"),
                        F.coalesce(F.try_divide(F.col("share"), models.scalar()), F.lit(0.0)).alias("importance"))


def node_table(nodes: DataFrame, features: list, max_depth: int | None = None) -> DataFrame:
    """One row per node: id, parent (0 for the root), depth, feature and threshold (null for a leaf), gini, counts."""
    names = F.array(*[F.lit(f) for f in features])
    out = nodes.select(
        F.col("node").alias("id"), F.shiftright("node", 1).alias("parent"), "depth",
        F.get(names, F.col("feature")).alias("feature"), "threshold", "gini", F.col("n").cast("long").alias("n"),
        (F.col("n") - F.col("ones")).cast("long").alias("n_0"), F.col("ones").cast("long").alias("n_1"))
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)
