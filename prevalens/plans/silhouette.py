"""Plain-Euclidean silhouette of labelled points, in blocks.

The silhouette of a point needs its distance to every other point, so the work is quadratic in
the number of distinct points; the pairs never become rows:

* rows are first counted per distinct (point, labels), so repeated rows cost nothing;
* points are dealt by hash into blocks of about ``block`` points; a task holds two blocks and
  hands over one row per point: its summed distances to each label's members in the other block;
* all labellings (every k of a sweep) share the distances of one pass.

With N distinct points and B = N / block: N (B + 1) / 2 rows in, N B rows out, N^2 / 2 distances;
a task's memory is set by ``block`` and the number of labels.  Meant for tables of up to some
million distinct points; beyond that use the squared form, which is linear.

Labels are a small domain (one column of sums each).  Rows with a null label, or a null, NaN or
infinite coordinate, are left out.  A point alone in its cluster scores 0, as do points all of
whose distances are 0.  A labelling with fewer than two clusters has a null score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .kmeans import squared_distances

BLOCK = 2_048
_CHUNK = 512
_NUMBERS = pa.list_(pa.field("element", pa.float64()))
_NAMES = pa.list_(pa.field("element", pa.string()))


def _labelled_points(data: DataFrame, label_cols: list, features: str) -> DataFrame:
    """(x, l, w): distinct feature arrays with their labels and row counts, written once."""
    x = F.col(features)
    if data.schema[features].dataType.typeName() != "array":
        x = vector_to_array(x)
    usable = F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    labels = F.array(*[F.col(c).cast("string") for c in label_cols])
    rows = (data.select(x.alias("x"), labels.alias("l"))
            .where(usable & F.forall("l", lambda v: v.isNotNull())))
    return materialize(rows.groupBy("x", "l").agg(F.count(F.lit(1)).alias("w")))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _member_weights(labels: np.ndarray, w: np.ndarray, names: list) -> np.ndarray:
    """Points x all labels of all labellings: the point's weight in its labels' columns."""
    return np.hstack([(labels[:, m:m + 1] == np.array(found, dtype=object)) * w[:, None].astype(np.float64)
                      for m, found in enumerate(names)])


def _sums(x: np.ndarray, others: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), weights.shape[1]))
    for at in range(0, len(x), _CHUNK):
        out[at:at + _CHUNK] = np.sqrt(squared_distances(x[at:at + _CHUNK], others)) @ weights
    return out


def _cell(names: list):
    """The distances of one pair of blocks, summed for the points of both."""
    def run(key, table):
        first, second = key[0].as_py(), key[1].as_py()
        block = table.column("b").to_numpy()
        sides = [table.filter(pa.array(block == b)).combine_chunks() for b in sorted({first, second})]
        x = [_matrix(s.column("x").combine_chunks()) for s in sides]
        own = [_member_weights(_matrix(s.column("l").combine_chunks()), s.column("w").to_numpy(), names)
               for s in sides]
        if first == second:
            found = [_sums(x[0], x[0], own[0])]
        else:
            found = [_sums(x[0], x[1], own[1]), _sums(x[1], x[0], own[0])]
        parts = [pa.Table.from_arrays(
            [s.column("x").cast(_NUMBERS), s.column("l").cast(_NAMES), s.column("w"),
             *[pa.array(np.ascontiguousarray(f[:, j])) for j in range(f.shape[1])]],
            names=["x", "l", "w", *[f"s{j}" for j in range(f.shape[1])]]) for s, f in zip(sides, found)]
        return pa.concat_tables(parts)
    return run


def _scores(names: list, sizes: list):
    """Sums per point -> weighted silhouette per labelling, one row per task and labelling."""
    def run(batches):
        total, rows = [0.0] * len(names), [0] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            labels, w = _matrix(batch.column("l")), batch.column("w").to_numpy()
            at = 0
            for m, found in enumerate(names):
                k = len(found)
                sums = np.column_stack([batch.column(f"s{at + j}").to_numpy() for j in range(k)])
                at += k
                if k < 2:
                    continue
                own = labels[:, m:m + 1] == np.array(found, dtype=object)
                size = np.broadcast_to(np.array(sizes[m], dtype=np.float64), own.shape)
                n_own = size[own]
                a = sums[own] / np.maximum(n_own - 1, 1)
                b = np.where(own, np.inf, sums / size).min(axis=1)
                top = np.maximum(a, b)
                score = np.where((n_own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
                total[m] += float((score * w).sum())
                rows[m] += int(w.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(names)), pa.int32()), pa.array(total, pa.float64()), pa.array(rows, pa.int64())],
            names=["m", "total", "n"])
    return run


def silhouettes(data: DataFrame, label_cols: list, features: str = "features", block: int = BLOCK) -> DataFrame:
    """(labelling, clusters, n, silhouette): the mean silhouette of every label column."""
    spark = data.sparkSession
    points = _labelled_points(data, label_cols, features)
    pairs = points.select("w", F.posexplode("l").alias("m", "label"))
    counted = pairs.groupBy("m", "label").agg(F.sum("w").alias("n")).collect()   # one row per label
    names = [sorted(r["label"] for r in counted if r["m"] == m) for m in range(len(label_cols))]
    size = {(r["m"], r["label"]): r["n"] for r in counted}
    sizes = [[size[m, v] for v in found] for m, found in enumerate(names)]
    schema = "labelling string, clusters int, n long, silhouette double"
    if not counted:
        return spark.createDataFrame([(c, 0, 0, None) for c in label_cols], schema)
    blocks = -(-points.count() // block)
    width = sum(len(found) for found in names)
    b, o = F.col("b"), F.col("o")
    cells = (points.withColumn("b", F.pmod(F.xxhash64("x", "l"), F.lit(blocks)).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .select("x", "l", "w", "b", F.least(b, o).alias("first"), F.greatest(b, o).alias("second")))
    fields = ", ".join(f"s{j} double" for j in range(width))
    summed = (cells.groupBy("first", "second")
              .applyInArrow(_cell(names), f"x array<double>, l array<string>, w long, {fields}")
              .groupBy("x", "l", "w").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)]))
    done = (summed.mapInArrow(_scores(names, sizes), "m int, total double, n long")
            .groupBy("m").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
    order = F.col("m") + 1
    return done.select(
        F.element_at(F.array(*[F.lit(c) for c in label_cols]), order).alias("labelling"),
        F.element_at(F.array(*[F.lit(len(found)) for found in names]), order).alias("clusters"),
        F.element_at(F.array(*[F.lit(sum(s)).cast("long") for s in sizes]), order).alias("n"),
        F.try_divide("total", F.nullif("n", F.lit(0))).alias("silhouette"))
