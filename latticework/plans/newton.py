"""Logistic regressions by Newton steps, many groups at once, and a one-split tree.

Each step adds up gradient and Hessian per group over all rows, in numpy per Arrow batch; only
``p + p * p`` numbers per group and task are shuffled. A hot group is spread over tasks like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.functions.text import MISSING_CATEGORY, UNSEEN_CATEGORY, category
from latticework.operators.ordering import prefix_sums
from latticework.operators.profile import moments
from latticework.session import attach, materialize, settle

# --- fixed values ----------------------------------------------------------------------------------
ITERATIONS = 6
RIDGE = 1.0
TOLERANCE = 1e-6
JITTER = 1e-9
CLIP = 35.0
MIN_LEAF = 250
# ---------------------------------------------------------------------------------------------------

KEY = "_key"


def category_levels(train: DataFrame, categorical: Sequence[str]) -> dict[str, list[str]]:
    """Sorted levels per column over all training rows, with the missing and unseen tokens."""
    out = {}
    for c in categorical:
        numeric = isinstance(train.schema[c].dataType, T.NumericType)
        seen = train.select(category(c, numeric).alias("v")).distinct().limit(10_001).collect()
        if len(seen) > 10_000:
            raise ValueError(f"{c} has too many levels for one-hot encoding")
        out[c] = sorted({r["v"] for r in seen} | {MISSING_CATEGORY, UNSEEN_CATEGORY})
    return out


def design_names(numeric: Sequence[str], levels: dict[str, list[str]]) -> list[str]:
    names = ["intercept"]
    for c in numeric:
        names += [f"{c}_zscore", f"{c}_missing"]
    return names + [f"{c}={level}" for c, listed in levels.items() for level in listed]


def design(df: DataFrame, keys: Sequence[str], numeric: Sequence[str], levels: dict[str, list[str]], stats: DataFrame) -> DataFrame:
    """Rows with the design vector ``_x``: intercept, z-score and missing flag per number, one flag per level.

    ``stats`` holds mean and std per key and feature, fitted on training rows.
    """
    wide = stats.groupBy(*keys).agg(*[
        a for c in numeric for a in (
            F.max(F.when(F.col("feature") == c, F.col("mean"))).alias(f"_a_{c}"), F.max(F.when(F.col("feature") == c, F.col("std"))).alias(f"_s_{c}"))
    ]) if numeric else None
    placed = df if wide is None else (attach(df, wide, list(keys)) if keys else df.crossJoin(F.broadcast(wide)))  # one row without keys
    parts: list[Column] = [F.lit(1.0)]
    for c in numeric:
        x = F.col(c).cast("double")
        parts += [F.coalesce((x - F.col(f"_a_{c}")) / F.col(f"_s_{c}"), F.lit(0.0)), x.isNull().cast("double")]
    for c, listed in levels.items():
        text = category(c, isinstance(df.schema[c].dataType, T.NumericType))
        known = F.when(text.isin(listed), text).otherwise(UNSEEN_CATEGORY)
        parts += [(known == level).cast("double") for level in listed]
    helpers = [f"_{p}_{c}" for c in numeric for p in "as"]
    return placed.withColumn("_x", F.array(*parts)).drop(*helpers)


def _partials(betas: dict[str, list[float]] | None):
    """Gradient and Hessian sums per group of one partition, straight from the Arrow buffers.

    ``betas`` holds the current coefficients, or is None when they come with the rows as ``_beta``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y_all = batch.column("_y").to_numpy(zero_copy_only=False)
            x_all = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            encoded = batch.column(KEY).dictionary_encode()
            codes, names = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary.to_pylist()
            order = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[order], np.arange(len(names) + 1))
            for i, name in enumerate(names):
                rows = order[bounds[i]:bounds[i + 1]]
                x, y = x_all[rows], y_all[rows]
                beta = batch.column("_beta")[int(rows[0])].as_py() if betas is None else betas.get(name)
                beta = np.zeros(x.shape[1]) if beta is None else np.asarray(beta)
                p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -CLIP, CLIP)))
                found = (x.T @ (p - y), x.T @ (x * (p * (1.0 - p))[:, None]), len(y))
                sums[name] = tuple(a + b for a, b in zip(sums[name], found)) if name in sums else found
        if sums:
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([s[0].tolist() for s in sums.values()], lists), pa.array([s[1].ravel().tolist() for s in sums.values()], lists),
                 pa.array([s[2] for s in sums.values()], pa.int64())], names=[KEY, "_g", "_h", "_n"])

    return run


def newton_step(curvature: np.ndarray, slope: np.ndarray, beta: np.ndarray, ridge: float) -> np.ndarray:
    """The step ``s`` of one Newton iteration on ``loss(b) + ridge / 2 * sum(b_j^2, j >= 1)``.

    ``(H + D) s = g + D b`` with ``D = diag(0, ridge, ..., ridge)``. The system is scaled to unit diagonal and
    decomposed into eigenvectors; directions whose eigenvalue is lost in rounding (a design column that is a sum of others)
    get no step, which is the shortest least-squares solution in the scaled space.
    """
    weights = np.append(0.0, np.full(len(beta) - 1, ridge))
    penalised = curvature + np.diag(weights + JITTER)
    unit = np.diag(penalised) ** -0.5
    values, vectors = np.linalg.eigh(unit[:, None] * penalised * unit)
    kept = values > values[-1] * len(values) * np.finfo(float).eps
    along = vectors[:, kept].T @ (unit * (slope + weights * beta))
    return unit * (vectors[:, kept] @ (along / values[kept]))


def _solver(ridge: float):
    def solve(parts: pd.DataFrame) -> pd.DataFrame:
        slope = np.add.reduce(parts["_g"].to_list())
        now = parts["_beta"].iloc[0]
        beta = np.zeros_like(slope) if now is None else np.asarray(now)
        step = newton_step(np.add.reduce(parts["_h"].to_list()).reshape(len(slope), -1), slope, beta, ridge)
        return pd.DataFrame({KEY: parts[KEY].iloc[:1], "_beta": [beta - step], "_step": [float(np.abs(step).max())], "rows": [int(parts["_n"].sum())]})

    return solve


def fit_grouped_logistic(
    data: DataFrame, keys: Sequence[str], label: str, iterations: int = ITERATIONS, ridge: float = RIDGE, tolerance: float = TOLERANCE
) -> DataFrame:
    """One ridge logistic regression per group over the design vectors ``_x``.

    Returns keys, ``coefficients``, ``rows``, ``iterations``, ``converged`` and the last largest step.
    """
    spark = data.sparkSession
    keys = list(keys)
    packed = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = data.select(packed.alias(KEY), "_x", F.col(label).cast("double").alias("_y"), *keys)
    rows = materialize(rows.repartition(parts))  # read once per step; spread evenly whatever the groups
    names = rows.select(KEY, *keys).distinct()
    slim = rows.select(KEY, "_x", "_y")
    beta, small = spark.createDataFrame([], f"{KEY} string, _beta array<double>"), True
    part_schema = f"{KEY} string, _g array<double>, _h array<double>, _n bigint"
    step_schema = f"{KEY} string, _beta array<double>, _step double, rows bigint"
    for done in range(1, iterations + 1):
        if small:
            current = {r[KEY]: r["_beta"] for r in beta.select(KEY, "_beta").collect()}  # bounded: checked when settled
            partial = slim.mapInArrow(_partials(current), part_schema)
        else:
            partial = attach(slim, beta.select(KEY, "_beta"), KEY).mapInArrow(_partials(None), part_schema)
        stepped = attach(partial, beta.select(KEY, "_beta"), KEY).groupBy(KEY).applyInPandas(_solver(ridge), step_schema)
        beta, small = settle(stepped)
        if not beta.filter(F.col("_step") > tolerance).limit(1).count():
            break
    fitted = attach(names, beta, KEY)
    return fitted.select(
        *keys, F.col("_beta").alias("coefficients"), "rows", F.lit(done).alias("iterations"), (F.col("_step") <= tolerance).alias("converged"),
        F.col("_step").alias("max_abs_step"),
    )


def predict_logistic(data: DataFrame, model: DataFrame, keys: Sequence[str], name: str = "predicted_probability") -> DataFrame:
    """Probability from the design vector and the group's coefficients."""
    table = model.select(*keys, "coefficients")
    placed = attach(data, table, list(keys)) if keys else data.crossJoin(F.broadcast(table))  # one row without keys
    dot = F.aggregate(F.zip_with("_x", "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    clipped = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), dot))
    return placed.withColumn(name, F.when(F.col("coefficients").isNotNull(), 1.0 / (1.0 + F.exp(-clipped)))).drop("coefficients", "_x")


def fit_predict(
    rows: DataFrame, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], label: str, is_train: str = "is_train",
    iterations: int = ITERATIONS, ridge: float = RIDGE,
) -> tuple[DataFrame, DataFrame]:
    """Fit per group on the rows marked train, predict the others: (test rows with probability, models)."""
    train = rows.filter(is_train)
    levels = category_levels(train, categorical)
    stats, _ = settle(moments(train, numeric, keys))
    placed = design(rows, keys, numeric, levels, stats)
    model = fit_grouped_logistic(placed.filter(is_train), keys, label, iterations, ridge)
    return predict_logistic(placed.filter(f"not ({is_train})"), model, keys), model


FOLD = "_fold"


def _level_number(rows: DataFrame, name: str, listed: Sequence[str]) -> Column:
    """Place of a row's level in the sorted list, that of the unseen token for others."""
    text = category(name, isinstance(rows.schema[name].dataType, T.NumericType))
    place = F.array_position(F.array(*[F.lit(v) for v in listed]), text)
    return F.when(place > 0, place - 1).otherwise(F.lit(listed.index(UNSEEN_CATEGORY))).cast("int")


def _raw_design(batch: pa.RecordBatch, sizes: Sequence[int], numbers: int) -> np.ndarray:
    """``design`` without scaling, from value columns ``_n0..`` and level numbers ``_c0..``."""
    n = batch.num_rows
    x = np.zeros((n, 1 + 2 * numbers + sum(sizes)))
    x[:, 0] = 1.0
    for j in range(numbers):
        value = batch.column(f"_n{j}")
        x[:, 1 + 2 * j] = value.fill_null(0.0).to_numpy(zero_copy_only=False)
        x[:, 2 + 2 * j] = value.is_null().to_numpy(zero_copy_only=False)
    first = 1 + 2 * numbers
    for j, size in enumerate(sizes):
        x[np.arange(n), first + batch.column(f"_c{j}").to_numpy()] = 1.0
        first += size
    return x


def _fold_partials(coefficients: dict[int, np.ndarray], sizes: Sequence[int], numbers: int):
    """Gradient and curvature sums per held-out fold of one partition: each row counts for every fold but its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own, y = batch.column(FOLD).to_numpy(), batch.column("_y").to_numpy()
            x = _raw_design(batch, sizes, numbers)
            for fold, beta in coefficients.items():
                counts = own != fold
                p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -CLIP, CLIP)))
                found = [x.T @ np.where(counts, p - y, 0.0), x.T @ (x * np.where(counts, p * (1.0 - p), 0.0)[:, None]), int(counts.sum())]
                sums[fold] = [a + b for a, b in zip(sums[fold], found)] if fold in sums else found
        lists = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([s[0].tolist() for s in sums.values()], lists), pa.array([s[1].ravel().tolist() for s in sums.values()], lists),
             pa.array([s[2] for s in sums.values()], pa.int64())], names=[FOLD, "_g", "_h", "_n"])

    return run


def _sum_parts(parts: pd.DataFrame) -> pd.DataFrame:
    total = {c: [np.add.reduce(parts[c].to_list())] for c in ("_g", "_h")}
    return pd.DataFrame({FOLD: parts[FOLD].iloc[:1], **total, "_n": [int(parts["_n"].sum())]})


def _scalings(data: DataFrame, numeric: Sequence[str], size: int) -> dict[int, np.ndarray]:
    """Per held-out fold the matrix that turns raw design columns into scaled ones, with the moments of the other folds.

    A raw number column holds the value, 0 where missing, and its missing flag follows it; ``(v - mean) / std`` is then a combination of
    the value, the flag and the intercept. The moments of the other folds come from those of each fold.
    """
    aggs = [a for c in numeric for a in (F.count(c), F.coalesce(F.avg(c), F.lit(0.0)), F.coalesce(F.var_pop(c), F.lit(0.0)))]
    per_fold = {r[0]: np.array(r[1:], float).reshape(-1, 3) for r in data.groupBy(FOLD).agg(F.count(F.lit(1)), *aggs).drop("count(1)").collect()}  # one row a fold
    out = {}
    for fold in sorted(per_fold):
        parts = np.array([m for f, m in per_fold.items() if f != fold]).reshape(-1, len(numeric), 3)
        n = parts[:, :, 0]
        total = n.sum(0)
        mean = np.divide((n * parts[:, :, 1]).sum(0), total, out=np.zeros(len(numeric)), where=total > 0)
        spread = (n * (parts[:, :, 2] + (parts[:, :, 1] - mean) ** 2)).sum(0)
        std = np.sqrt(np.divide(spread, total, out=np.zeros(len(numeric)), where=total > 0))
        std[~(std > 0)] = 1.0
        change = np.eye(size)
        for j in range(len(numeric)):
            value, flag = 1 + 2 * j, 2 + 2 * j
            change[value, value], change[0, value], change[flag, value] = 1 / std[j], -mean[j] / std[j], mean[j] / std[j]
        out[fold] = change
    return out


def fit_folds(
    rows: DataFrame, fold: str, numeric: Sequence[str], categorical: Sequence[str], label: str, iterations: int = ITERATIONS, ridge: float = RIDGE,
    tolerance: float = TOLERANCE,
) -> tuple[DataFrame, DataFrame]:
    """One ridge logistic per held-out fold, over one stored copy of the rows: (all rows with their own fold's probability, models).

    A row is stored as it is; tasks make its unscaled design of a value per number and a level number per category. Scaling is linear, so
    sums over raw columns are turned into those over each fold's scaled columns by a small matrix. Steps are solved on the driver: as many
    small systems as there are folds.
    """
    spark = rows.sparkSession
    levels = category_levels(rows, categorical)
    unscaled = spark.createDataFrame([(c, 0.0, 1.0) for c in numeric], "feature string, mean double, std double")
    placed = materialize(rows.withColumn(FOLD, F.col(fold).cast("long")))
    slim = placed.select(
        FOLD, F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_n{j}") for j, c in enumerate(numeric)],
        *[_level_number(rows, c, listed).alias(f"_c{j}") for j, (c, listed) in enumerate(levels.items())])
    sizes = [len(listed) for listed in levels.values()]
    values = placed.select(FOLD, *[F.col(c).cast("double").alias(c) for c in numeric])
    size = len(design_names(numeric, levels))
    change = _scalings(values, numeric, size)
    beta = {f: np.zeros(size) for f in change}
    done, step, counts = 0, {f: np.inf for f in change}, {f: 0 for f in change}
    schema = f"{FOLD} long, _g array<double>, _h array<double>, _n bigint"
    while change and done < iterations and max(step.values()) > tolerance:
        done += 1
        partial = slim.mapInArrow(_fold_partials({f: change[f] @ b for f, b in beta.items()}, sizes, len(numeric)), schema)
        for r in partial.groupBy(FOLD).applyInPandas(_sum_parts, schema).collect():  # one row a fold
            f, a = r[FOLD], change[r[FOLD]]
            move = newton_step(a.T @ np.array(r["_h"]).reshape(size, size) @ a, a.T @ np.array(r["_g"]), beta[f], ridge)
            beta[f], step[f], counts[f] = beta[f] - move, float(np.abs(move).max()), r["_n"]
    fitted = [(f, beta[f].tolist(), counts[f], done, step[f] <= tolerance, step[f], (change[f] @ beta[f]).tolist()) for f in change]
    model = spark.createDataFrame(
        fitted, "held_out long, coefficients array<double>, rows bigint, iterations int, converged boolean, max_abs_step double, _raw array<double>")
    raw = design(placed, [], numeric, levels, unscaled)
    scored = predict_logistic(raw, model.select(F.col("held_out").alias(FOLD), F.col("_raw").alias("coefficients")), [FOLD])
    return scored.drop(FOLD), model.drop("_raw")


def fit_stumps(
    data: DataFrame, fold: str, held_out: Sequence[int], numeric: Sequence[str], levels: dict[int, dict[str, list[str]]], stats: DataFrame, label: str,
    min_leaf: int = MIN_LEAF, slices: int | None = None,
) -> DataFrame:
    """Best single split by Gini over decile thresholds of the design columns, one row per held-out fold, of the rows of all other folds.

    All folds share one sort: equal values of a number are one row with its rows and positives per held-out fold, and running sums along the
    values give every decile and the counts on its left. Missing numbers stand at the fold's mean, which is z-score 0. Flags are split at one
    half. Without an improving split the feature is NULL and both sides are the base rate. Only the rows at deciles reach the driver.
    """
    spark, folds = data.sparkSession, list(enumerate(held_out))
    rows = data.select(F.col(fold).alias("_fold"), F.col(label).cast("double").alias("_y"), *dict.fromkeys([*numeric, *(c for own in levels.values() for c in own)]))
    columns = list(dict.fromkeys(c for own in levels.values() for c in own))
    texts = [F.struct(F.lit(c).alias("c"), category(c, isinstance(rows.schema[c].dataType, T.NumericType)).alias("v")) for c in columns]
    whole = F.struct(F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("v"))
    told = rows.select("_fold", "_y", F.explode(F.array(whole, *texts)).alias("_t")).groupBy("_fold", "_t").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p"))
    flags: dict = {}  # per column and level (None for all rows): rows and positives of each fold
    for r in told.collect():
        flags.setdefault(tuple(r["_t"]), []).append((r["_fold"], r["n"], r["p"]))

    def of(key: tuple, h: int) -> tuple[int, float]:
        own = [(n, p) for f, n, p in flags.get(key, []) if f != h]
        return sum(n for n, _ in own), sum(p for _, p in own)

    scaling = {(r["held_out"], r["feature"]): (r["mean"], r["std"]) for r in stats.collect()} if numeric else {}
    total = {h: of((None, None), h) for h in held_out}
    probs = [i / 10 for i in range(1, 10)]
    ends = {h: [(int(np.floor(q * (n - 1))), int(np.ceil(q * (n - 1)))) for q in probs] for h, (n, _) in total.items() if n}
    absent, cuts = {}, {}
    if numeric and ends:
        entries = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(numeric)])
        outside = [(f"{s}{k}", F.col("_fold") != h, s) for k, h in folds for s in "np"]
        sums = [F.sum(F.when(kept, F.lit(1) if s == "n" else F.col("_y")).otherwise(0)).alias(name) for name, kept, s in outside]
        counts = materialize(rows.select("_fold", "_y", F.explode(entries).alias("_e")).select("_fold", "_y", "_e.*").groupBy("f", "v").agg(*sums))
        means = []
        for r in counts.filter("v is null").collect():  # a row per number
            for k, h in folds:
                absent[h, r["f"]] = (r[f"n{k}"], r[f"p{k}"])
                own = [r[f"{s}{j}"] if j == k else type(r[f"{s}{j}"])(0) for j, _ in folds for s in "np"]
                means.append((r["f"], float(scaling[h, numeric[r["f"]]][0]), *own))
        values = counts.filter("v is not null")
        if means:
            again = values.unionByName(spark.createDataFrame(means, counts.schema))
            values = again.groupBy("f", "v").agg(*[F.sum(name).alias(name) for name, _, _ in outside])
        running = prefix_sums(values, ["f"], [("v", True)], {f"_{name}": name for name, _, _ in outside}, slices)
        meets = [
            (F.col(f"n{k}") > 0) & (F.col(f"_n{k}") > low) & (F.col(f"_n{k}") - F.col(f"n{k}") <= high) for k, h in folds for low, high in sorted(set(ends.get(h, [])))
        ]
        for r in running.filter(reduce(or_, meets)).collect():  # 18 rows or fewer of each fold and number
            for k, h in folds:
                if r[f"n{k}"]:
                    cuts.setdefault((h, r["f"]), []).append((r["v"], r[f"_n{k}"] - r[f"n{k}"], r[f"_n{k}"], r[f"_p{k}"]))

    def deciles(h: int, i: int):
        """``(threshold, rows, positives)`` on the left of each decile of a number."""
        mean, std = scaling[h, numeric[i]]
        if not (np.isfinite(mean) and np.isfinite(std)):
            return
        at = lambda rank: next(c for c in cuts[h, i] if c[1] <= rank < c[2])
        for q, (low, high) in zip(probs, ends[h]):
            a, b = at(low), at(high)
            cut = a[0] + (b[0] - a[0]) * (q * (total[h][0] - 1) - low)
            yield (cut - mean) / std, *(b if cut >= b[0] else a)[2:]

    def options(h: int):
        n, p = total[h]
        flag = lambda own: (0.5, n - own[0], p - own[1])
        for i in range(len(numeric)):
            for t in deciles(h, i):
                yield 1 + 2 * i, *t
            yield 2 + 2 * i, *flag(absent.get((h, i), (0, 0.0)))
        for j, (c, level) in enumerate((c, level) for c, listed in levels[h].items() for level in listed):
            yield 1 + 2 * len(numeric) + j, *flag(of((c, level), h))

    impurity = lambda p, n: 1 - (p / n) ** 2 - (1 - p / n) ** 2
    found = []
    for h in held_out:
        n, p = total[h]
        need = min(min_leaf, max(1, n // 4))
        sides = [(i, t, a, s, n - a, p - s) for i, t, a, s in (options(h) if n else ()) if a >= need and n - a >= need]
        losses = [((a * impurity(s, a) + b * impurity(u, b)) / n, i, t, s / a, u / b) for i, t, a, s, b, u in sides]
        rate = p / n if n else None
        loss, i, t, left, right = min(losses, default=(np.inf, None, None, rate, rate))
        if n and not loss < impurity(p, n):
            i, t, left, right = None, None, rate, rate
        found.append((None if i is None else design_names(numeric, levels[h])[i], i, t, left, right, rate, n, h))
    return spark.createDataFrame(
        found, "split_feature string, feature_index int, threshold double, left_probability double, right_probability double, default_probability double, sample_rows long, held_out int")


def predict_stump(data: DataFrame, stump: DataFrame, name: str = "predicted_probability") -> DataFrame:
    placed = data.crossJoin(F.broadcast(stump.select("feature_index", "threshold", "left_probability", "right_probability", "default_probability")))
    value = F.get("_x", F.col("feature_index"))
    side = F.when(value <= F.col("threshold"), F.col("left_probability")).otherwise(F.col("right_probability"))
    return placed.withColumn(name, F.when(F.col("feature_index").isNull(), F.col("default_probability")).otherwise(side)).drop(
        "feature_index", "threshold", "left_probability", "right_probability", "default_probability", "_x"
    )
