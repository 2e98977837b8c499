"""Elastic-net logistic regressions for all units, candidates and inner folds in one loop of scans.

Proximal Newton: a scan adds up loss, gradient and Hessian of every fit (unit x candidate x left-out inner fold) from one stored copy of a unit's rows,
each row counting for all fits but those that leave its inner fold out. The next coefficients minimise the quadratic model of a fit plus its
penalty by coordinate descent, in one small task a unit. A step that made the objective worse is halved. So a search costs as
many scans as its slowest fit, not a job per fold and candidate, and what is shuffled are sums.

The objective is ``sum of losses + l1 * |b|_1 + l2 / 2 * |b|_2^2`` without the intercept, ``l1 = l1_ratio / C`` and ``l2 = (1 - l1_ratio) / C``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework import schema
from latticework.operators import metrics
from latticework.operators.profile import moments
from latticework.plans.newton import CLIP, category_levels, design
from latticework.plans.search import INNER
from latticework.session import attach, materialize, settle

ITERATIONS = 25
TOLERANCE = 1e-6
UNIT = "_unit"
SUMS = f"{UNIT} long, sums array<double>"
STATE = f"{UNIT} long, beta array<double>, prev array<double>, objective array<double>, residual array<double>"


def penalties(params: dict) -> tuple[float, float]:
    c, ratio = float(params.get("C", 1.0)), float(params.get("l1_ratio", 0.0))
    return ratio / c, (1 - ratio) / c


def descend(hessian: np.ndarray, slope: np.ndarray, start: np.ndarray, l1: float, l2: float, sweeps: int = 1000) -> np.ndarray:
    """The minimum of ``slope (b - start) + (b - start) H (b - start) / 2`` plus the penalties, coordinate by coordinate; the first has none."""
    b, pull = start.copy(), slope.copy()  # pull: gradient of the quadratic part at b
    diagonal = np.maximum(np.diag(hessian), 1e-12)
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(b)):
            if j == 0:
                new = b[0] - pull[0] / diagonal[0]
            else:
                at = diagonal[j] * b[j] - pull[j]
                new = np.sign(at) * max(abs(at) - l1, 0.0) / (diagonal[j] + l2)
            move = new - b[j]
            if move:
                pull += hessian[:, j] * move
                b[j] = new
                most = max(most, abs(move))
        if most < 1e-9:
            break
    return settled(hessian, slope, start, b, l1, l2)


def settled(hessian: np.ndarray, slope: np.ndarray, start: np.ndarray, b: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The minimum from nearby ``b`` by feature-sign search: solves for fixed signs, with steps cut where an entry changes its own.

    What small moves leave of the gradient grows with the number of rows, and entries that nearly depend on each other move slowly.
    """
    ridge = np.append(0.0, np.full(len(b) - 1, l2))
    slope_at = lambda v: slope + hessian @ (v - start) + ridge * v
    value = lambda v: (slope + hessian @ (v - start) / 2) @ (v - start) + (ridge * v) @ v / 2 + l1 * np.abs(v[1:]).sum()
    best, now = b, b.copy()
    sign = np.append(0.0, np.sign(now[1:]))
    for _ in range(10 * len(b)):
        on = sign != 0
        on[0] = True
        step = np.zeros(len(b))
        step[on] = np.linalg.lstsq(hessian[np.ix_(on, on)] + np.diag(ridge[on]), -(slope_at(now) + l1 * sign)[on], rcond=None)[0]
        crossing = [float(-now[k] / step[k]) for k in np.flatnonzero(on[1:]) + 1 if step[k] * sign[k] < 0 and 0 < -now[k] / step[k] < 1]
        points = []
        for t in [*crossing, 1.0]:
            point = now + t * step
            point[1:][np.isclose(point[1:], 0.0, rtol=0.0, atol=1e-14)] = 0.0
            points.append(point)
        now = min(points, key=value)
        sign = np.append(0.0, np.sign(now[1:]))
        if unmet(slope_at(now) - ridge * now, now, l1, l2) < unmet(slope_at(best) - ridge * best, best, l1, l2):
            best = now
        if now is points[-1]:  # solved for these signs: let in the zero that asks most
            pull = np.where(now[1:] == 0, np.abs(slope_at(now)[1:]) - l1, 0.0)
            if not len(pull) or pull.max() <= 1e-9:
                break
            k = 1 + int(pull.argmax())
            sign[k] = -np.sign(slope_at(now)[k])
    return best


def unmet(slope: np.ndarray, b: np.ndarray, l1: float, l2: float) -> float:
    """How far the coefficients are from optimal: the largest distance of 0 from the subgradient."""
    g = slope + l2 * np.append(0.0, b[1:])
    inside = np.where(b != 0, np.abs(g + l1 * np.sign(b)), np.maximum(np.abs(g) - l1, 0.0))
    return float(max(abs(g[0]), inside[1:].max(initial=0.0)))


def _sums(beta: dict[int, np.ndarray] | None, left_out: list[int], candidates: int):
    """Loss, gradient and Hessian of every fit per unit of a partition; ``left_out`` lists the inner folds (-1: none), candidate by candidate.

    ``beta`` holds the coefficients of all units, or is None when they come with the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            units, inner, y_all = (batch.column(i).to_numpy() for i in range(3))
            x_all = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            d = x_all.shape[1]
            for unit in np.unique(units).tolist():
                mine = units == unit
                x, y = x_all[mine], y_all[mine]
                counted = np.array([inner[mine] != f for f in left_out] * candidates, float)  # fits x rows
                if beta is None:
                    told = batch.column(4)[int(mine.argmax())].as_py()
                    b = None if told is None else np.array(told).reshape(len(counted), d)
                else:
                    b = beta.get(unit)
                z = np.clip((np.zeros((len(counted), d)) if b is None else b) @ x.T, -CLIP, CLIP)
                p = 1 / (1 + np.exp(-z))
                loss = (counted * (np.logaddexp(0, z) - y * z)).sum(1)
                slope = (counted * (p - y)) @ x
                weight = counted * p * (1 - p)
                bend = np.stack([x.T @ (x * w[:, None]) for w in weight])
                found = np.concatenate([loss[:, None], slope, bend.reshape(len(counted), -1)], 1)
                total[unit] = total[unit] + found if unit in total else found
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array([t.ravel() for t in total.values()], pa.list_(pa.float64()))], names=[UNIT, "sums"])

    return run


def _stepper(size: int, penalty: list[tuple[float, float]], folds: int):
    def step(parts: pd.DataFrame) -> pd.DataFrame:
        sums = np.add.reduce(parts["sums"].to_list()).reshape(-1, 1 + size + size * size)
        first = parts.iloc[0]
        fits = len(sums)
        now = np.zeros((fits, size)) if first["beta"] is None else np.asarray(first["beta"]).reshape(fits, size)
        prev = now.copy() if first["prev"] is None else np.asarray(first["prev"]).reshape(fits, size)
        before = np.full(fits, np.inf) if first["objective"] is None else np.asarray(first["objective"])
        new, kept, value, residual = now.copy(), prev.copy(), before.copy(), np.zeros(fits)
        for i, row in enumerate(sums):
            l1, l2 = penalty[i // folds]
            b, slope = now[i], row[1 : 1 + size]
            objective = row[0] + l1 * np.abs(b[1:]).sum() + l2 / 2 * (b[1:] ** 2).sum()
            residual[i] = unmet(slope, b, l1, l2)
            if residual[i] <= TOLERANCE:
                kept[i], value[i] = b, objective
            elif objective > before[i] + 1e-9 * max(1.0, abs(before[i])):
                new[i] = (b + prev[i]) / 2
            else:
                kept[i], value[i] = b, objective
                new[i] = descend(row[1 + size :].reshape(size, size), slope, b, l1, l2)
        return pd.DataFrame({UNIT: [int(first[UNIT])], "beta": [new.ravel()], "prev": [kept.ravel()], "objective": [value], "residual": [residual]})

    return step


def fit(rows: DataFrame, candidates: Sequence[dict], left_out: Sequence[int], label: str, iterations: int = ITERATIONS) -> DataFrame:
    """``_unit, candidate, inner_fold, coefficients, residual`` of all fits; ``rows`` has ``_unit``, ``_inner``, the label and the design ``_x``."""
    spark = rows.sparkSession
    slim = materialize(rows.select(F.col(UNIT).cast("long").alias(UNIT), F.col(INNER).cast("long").alias(INNER), F.col(label).cast("double").alias("_y"), "_x"))
    size = slim.select(F.max(F.size("_x"))).first()[0] or 1
    folds, penalty = list(left_out), [penalties(p) for p in candidates]
    state, small = spark.createDataFrame([], STATE), True
    for _ in range(iterations):
        if small:
            current = {r[0]: np.array(r[1]).reshape(-1, size) for r in state.select(UNIT, "beta").collect()}  # within the bounds of `settle`
            sums = slim.mapInArrow(_sums(current, folds, len(penalty)), SUMS)
        else:
            sums = attach(slim, state.select(UNIT, "beta"), UNIT).mapInArrow(_sums(None, folds, len(penalty)), SUMS)
        state, small = settle(attach(sums, state.select(UNIT, "beta", "prev", "objective"), UNIT).groupBy(UNIT).applyInPandas(_stepper(size, penalty, len(folds)), STATE))
        if state.filter(F.exists("residual", lambda r: r > TOLERANCE)).isEmpty():
            break
    entries = [F.struct(F.lit(c).alias("candidate"), F.lit(f).alias("inner_fold"), F.slice("beta", 1 + (c * len(folds) + i) * size, size).alias("coefficients"),
                        F.get("residual", F.lit(c * len(folds) + i)).alias("residual")) for c in range(len(penalty)) for i, f in enumerate(folds)]
    return state.select(UNIT, F.explode(F.array(*entries)).alias("_e")).select(UNIT, "_e.*")


def _scored(rows: DataFrame, model: DataFrame, on: Sequence[str]) -> DataFrame:
    met = attach(rows, model.select(*on, "coefficients"), list(on))
    dot = F.aggregate(F.zip_with("_x", "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return met.withColumn("predicted_probability", 1 / (1 + F.exp(-F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), dot))))).drop("coefficients")


def search_elastic(
    rows: DataFrame, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], candidates: Sequence[dict], label: str = schema.TARGET,
) -> tuple[DataFrame, DataFrame]:
    """Scored rows without an inner fold, and the search table, for all units: ``(predictions, search)``.

    ``rows`` has ``_inner`` for training rows and null for rows to be scored. Numbers are standardised with a unit's training rows, once for all its
    inner folds. ``search`` has mean average precision, the largest optimality residual, and the chosen candidate (ties: the first).
    """
    keys = list(keys)
    train = rows.filter(f"{INNER} is not null")
    levels = category_levels(train, categorical)
    stats, _ = settle(moments(train, numeric, keys))
    units, _ = settle(train.select(*keys).distinct().withColumn(UNIT, F.monotonically_increasing_id()))
    placed = materialize(attach(design(rows, keys, numeric, levels, stats), units, keys))
    known = placed.filter(f"{INNER} is not null")
    last = known.agg(F.max(INNER)).first()[0]
    folds = [*range(int(last or 0) + 1), -1]
    model = materialize(fit(known, candidates, folds, label))
    numbers = F.array(*[F.lit(i) for i in range(len(candidates))])
    check = known.select(UNIT, label, "_x", F.col(INNER).alias("inner_fold"), F.explode(numbers).alias("candidate"))
    on = [UNIT, "candidate", "inner_fold"]
    found = metrics.average_precision(_scored(check, model, on), on, label).groupBy(UNIT, "candidate").agg(F.avg("pr_auc").alias("mean_average_precision"))
    worst = model.groupBy(UNIT, "candidate").agg(F.max("residual").alias("residual"), F.count(F.lit(1)).alias("fits"))
    order = F.struct(F.col("mean_average_precision").isNotNull(), F.round("mean_average_precision", 12), -F.col("candidate"))
    found = materialize(attach(found, worst, [UNIT, "candidate"]))
    best = found.groupBy(UNIT).agg(F.max_by("candidate", order).alias("candidate"))
    names = F.array(*[F.lit(json.dumps(p, sort_keys=True)) for p in candidates])
    table = attach(attach(found, best.withColumn("chosen", F.lit(True)), [UNIT, "candidate"]), units, UNIT)
    table = materialize(table.select(*keys, UNIT, "candidate", F.get(names, F.col("candidate")).alias("params"), "mean_average_precision", "residual", "fits",
                                     F.coalesce("chosen", F.lit(False)).alias("chosen")))
    final = attach(model.filter("inner_fold = -1"), table.filter("chosen").select(UNIT, "candidate"), [UNIT, "candidate"], "left_semi")
    return _scored(placed.filter(f"{INNER} is null"), final, [UNIT]).drop(INNER, UNIT, "_x"), table.drop(UNIT)
