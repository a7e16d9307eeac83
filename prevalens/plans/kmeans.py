"""K-Means from order-free sums: the rows alone decide the model, not their layout.

* Rows are first counted per distinct point, so a point that many rows share is one
  weighted point.
* Seeding is k-means++ as a race: every point draws an exponential time from a hash of
  (seed, step, point), divided by weight x squared distance to the centres so far; the
  earliest point is the next centre.  That is one minimum over all points per centre.
* A Lloyd step sums weights, coordinates and costs as whole numbers of 2^-30, so the
  order of rows and tasks cannot change a digit.
* All starts of all k share each pass: a task assigns its points to the centres of every
  model that still moves and hands over one row per (model, cluster).

Distances are computed coordinate by coordinate (no matrix product, whose rounding depends
on the batch), ties go to the lower cluster.  An emptied cluster keeps its centre.  With
fewer distinct points than k the spare centres repeat the first point and stay empty.
Rows whose features are null or hold NaN or infinity are refused by the caller's clean step.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Whole numbers that stand for 1.0 in the sums.
UNIT = 1 << 30
_SAFE = float(1 << 62)


@dataclass
class Start:
    """One seeded start; ``cost`` belongs to ``centers``."""
    k: int
    seed: int
    centers: np.ndarray | None = None
    cost: float | None = None
    steps: int = 0
    moves: list = field(default_factory=list)


def weighted_points(data: DataFrame, features: str = "features") -> DataFrame:
    """(x, w): distinct feature arrays and their row counts, written once."""
    x = vector_to_array(F.col(features))
    return materialize(data.select(x.alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("w")))


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Rows x centres, summed coordinate by coordinate."""
    out = np.zeros((len(x), len(centers)))
    for j in range(x.shape[1]):
        gap = x[:, j:j + 1] - centers[:, j]
        out += gap * gap
    return out


def uniform(x: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A number in (0, 1) per point, from a hash of (seed, step, coordinates)."""
    with np.errstate(over="ignore"):
        h = np.full(len(x), np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step), np.uint64)
        for j in range(x.shape[1]):
            h ^= np.ascontiguousarray(x[:, j] + 0.0).view(np.uint64)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
            h ^= h >> np.uint64(31)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _points(batch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("x")
    return (lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1),
            batch.column("w").to_numpy())


def _whole(values: np.ndarray, w: np.ndarray) -> np.ndarray:
    """values x w in units, as whole numbers of any size."""
    units = np.rint(values * UNIT)
    if np.abs(units).max() * float(w.max()) * len(w) < _SAFE:
        return units.astype(np.int64) * w.reshape(-1, *[1] * (values.ndim - 1))
    exact = np.array([int(v) for v in units.ravel()], dtype=object).reshape(units.shape)
    return exact * w.astype(object).reshape(-1, *[1] * (values.ndim - 1))


def _next_centers(points: DataFrame, starts: list, step: int) -> dict:
    """The winner of every start's race: model -> point."""
    held = [(i, s.seed, s.centers) for i, s in enumerate(starts)]

    def run(batches):
        best: dict = {}
        for batch in batches:
            x, w = _points(batch)
            if not len(x):
                continue
            for i, seed, centers in held:
                far = np.ones(len(x)) if centers is None else squared_distances(x, centers).min(axis=1)
                with np.errstate(divide="ignore"):
                    time = -np.log(uniform(x, seed, step)) / (w * far)
                at = np.flatnonzero(time == time.min())
                found = min((float(time[j]), x[j].tolist()) for j in at.tolist())
                if i not in best or found < best[i]:
                    best[i] = found
        names = list(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int32()), pa.array([best[i][0] for i in names], pa.float64()),
             pa.array([best[i][1] for i in names], pa.list_(pa.float64()))], names=["model", "time", "x"])

    won = (points.mapInArrow(run, "model int, time double, x array<double>")
           .groupBy("model").agg(F.min(F.struct("time", "x")).alias("m")).select("model", "m.x"))
    return {r["model"]: np.array(r["x"]) for r in won.collect()}      # one row per start


def _lloyd_sums(points: DataFrame, held: list, width: int) -> dict:
    """(model, cluster) -> (weight, cost, coordinate sums) as whole numbers."""
    names = ["n", "cost", *[f"s{j}" for j in range(width)]]

    def run(batches):
        sums = {(i, c): [0] * (width + 2) for i, centers in held for c in range(len(centers))}
        for batch in batches:
            x, w = _points(batch)
            if not len(x):
                continue
            moved = _whole(x, w)
            for i, centers in held:
                d = squared_distances(x, centers)
                label = d.argmin(axis=1)
                cost = _whole(d[np.arange(len(x)), label], w)
                for c in range(len(centers)):
                    at = label == c
                    if at.any():
                        part = [w[at].sum(), cost[at].sum(), *moved[at].sum(axis=0)]
                        sums[i, c] = [a + int(b) for a, b in zip(sums[i, c], part)]
        keys = [key for key, v in sums.items() if v[0]]
        number = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.int32()),
             *[pa.array([Decimal(sums[key][j]) for key in keys], number) for j in range(width + 2)]],
            names=["model", "cluster", *names])

    schema = "model int, cluster int, " + ", ".join(f"{n} decimal(38,0)" for n in names)
    total = points.mapInArrow(run, schema).groupBy("model", "cluster").agg(*[F.sum(n).alias(n) for n in names])
    return {(r["model"], r["cluster"]): [int(r[n]) for n in names] for r in total.collect()}   # models x k rows


def fit_starts(points: DataFrame, ks, n_init: int, seed: int = 42, max_iter: int = 300,
               tol: float = 1e-4) -> list:
    """Every start of every k, moved until no centre moves further than ``tol``.

    ``centers`` are those that ``cost`` and the assignment belong to, sorted by their
    coordinates, so cluster numbers depend on the rows alone.
    """
    starts = [Start(k, seed + i) for k in ks for i in range(n_init)]
    for step in range(max(s.k for s in starts)):
        open_ = [s for s in starts if s.k > step]
        won = _next_centers(points, open_, step)
        if not won:
            raise ValueError("no points to cluster")
        for i, s in enumerate(open_):
            s.centers = won[i][None, :] if s.centers is None else np.vstack([s.centers, won[i]])
    width = starts[0].centers.shape[1]
    moving = list(range(len(starts)))
    for _ in range(max_iter):
        sums = _lloyd_sums(points, [(i, starts[i].centers) for i in moving], width)
        still = []
        for i in moving:
            s = starts[i]
            new, cost = s.centers.copy(), 0
            for c in range(s.k):
                if (i, c) in sums:
                    n, spent, *coords = sums[i, c]
                    cost += spent
                    new[c] = [v / (n * UNIT) for v in coords]
            s.cost, s.steps = cost / UNIT, s.steps + 1
            s.moves.append(float(np.sqrt(((new - s.centers) ** 2).sum(axis=1)).max()))
            if s.moves[-1] > tol and s.steps < max_iter:
                s.centers = new
                still.append(i)
        moving = still
        if not moving:
            break
    for s in starts:
        s.centers = s.centers[np.lexsort(s.centers.T[::-1])]
    return starts


def best_starts(starts: list) -> dict:
    """k -> the start with the lowest cost (first seed wins ties)."""
    out: dict = {}
    for s in starts:
        if s.k not in out or s.cost < out[s.k].cost:
            out[s.k] = s
    return out


def assign(data: DataFrame, centers: np.ndarray, name: str, features: str = "features") -> DataFrame:
    """``data`` with the number of the nearest centre, as a row expression."""
    x = vector_to_array(F.col(features))
    gaps = []
    for center in centers:
        d = F.lit(0.0)
        for j, v in enumerate(center.tolist()):
            d = d + (x[j] - F.lit(v)) * (x[j] - F.lit(v))
        gaps.append(d)
    if len(gaps) == 1:
        return data.withColumn(name, F.lit(0))
    far = F.array(*gaps)
    return data.withColumn(name, (F.array_position(far, F.array_min(far)) - 1).cast("int"))
