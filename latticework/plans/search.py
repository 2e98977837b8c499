"""Inner search over parameters for many fits at once: every unit (a city and repeat, a held-out fold), candidate and inner fold together.

A unit's training rows carry their inner fold; its other rows are to be scored. All searches are one table of fits, so a search costs as many jobs
as one fit; then each unit is fitted again on all its training rows with the parameters of the best mean average precision.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework import schema
from latticework.operators import metrics
from latticework.operators.ordering import rank_in_group
from latticework.operators.sample import shuffle_key
from latticework.plans import trees
from latticework.session import attach, materialize

FAMILIES = ("random_forest", "hist_gradient_boosting")
INNER = "_inner"


def stratified_inner(rows: DataFrame, keys: Sequence[str], splits: int, label: str = schema.TARGET, key: str = "cell_id", seed: int = 42) -> DataFrame:
    """Training rows of each unit with ``_inner``, dealt class by class in a random order.

    A unit with fewer rows of a class than ``splits`` gets that many folds; one with fewer than two of a class is an error.
    """
    keys = list(keys)
    smallest = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.min("_n").alias("_least"), F.count(F.lit(1)).alias("_classes"))
    enough = F.when((F.col("_classes") == 2) & (F.col("_least") >= 2), F.least(F.lit(splits), F.col("_least")))
    parts = smallest.select(*keys, F.coalesce(enough, F.raise_error(F.lit("An inner search needs two rows of each class in every unit")).cast("int")).alias("_parts"))
    ranked = rank_in_group(rows.withColumn("_h", shuffle_key([*keys, key], seed)), [*keys, label], [("_h", True), (key, True)], "_r")
    return attach(ranked, parts, keys).withColumn(INNER, F.pmod(F.col("_r") - 1, F.col("_parts")).cast("int")).drop("_h", "_r", "_parts")


def _parameters(family: str, params: dict, features: int) -> list[Column]:
    """Columns of the table of fits for one candidate; names and meanings of the search presets."""
    def lit(value, kind: str, name: str) -> Column:
        return F.lit(value).cast(kind).alias(name)

    if family == "random_forest":
        share = params.get("max_features", "sqrt")
        used = features if share is None else max(1, int(features**0.5)) if share == "sqrt" else max(1, int(share * features))
        return [lit(params.get("n_estimators", 100), "int", "n_trees"), lit(params.get("max_depth"), "int", "max_depth"),
                lit(params.get("min_samples_leaf", 1), "int", "min_leaf"), lit(used, "int", "n_features")]
    if family == "hist_gradient_boosting":
        return [lit(params.get("max_iter", 200), "int", "max_iter"), lit(params.get("learning_rate", 0.1), "double", "learning_rate"),
                lit(params.get("max_leaf_nodes", 31), "int", "max_leaf_nodes"), lit(params.get("min_samples_leaf", 20), "int", "min_leaf"),
                lit(params.get("l2_regularization", 0.0), "double", "l2")]
    raise ValueError(f"Unsupported model: {family}")


def _fitted(family: str, train: DataFrame, fits: DataFrame, keys: Sequence[str], features: int, sets: Sequence[int], label: str, key: str, seed: int) -> DataFrame:
    if family == "random_forest":
        return trees.grow_forest(train, fits, keys, features, label, key, (), seed)
    return trees.boost(train, fits, keys, features, label, key, sets)


def search_trees(
    rows: DataFrame, keys: Sequence[str], family: str, numeric: Sequence[str], categorical: Sequence[str], candidates: Sequence[dict],
    label: str = schema.TARGET, key: str = "cell_id", seed: int = 42, bins: int = trees.BINS,
) -> tuple[DataFrame, DataFrame]:
    """Scored rows without an inner fold, and the search table, for all units: ``(predictions, search)``.

    ``rows`` has ``_inner`` for training rows and null for rows to be scored; ``key`` is a row's own inside its unit. Bins, medians and levels come
    from a unit's training rows. ``search`` has the mean average precision of each candidate and marks the chosen one; ties go to the first.
    """
    if family not in FAMILIES:
        raise ValueError(f"Unsupported model: {family}")
    keys, features = list(keys), len(numeric) + len(categorical)
    forest = family == "random_forest"
    placed = materialize(trees.binned(rows, F.col(INNER).isNotNull(), keys, numeric, categorical, bins, impute=forest, ordinal=forest))
    slim = placed.select(*keys, key, label, INNER, trees.BINS_COLUMN)
    sets = range(len(numeric), features)
    combine = "mean" if forest else "boosted"
    options = [F.struct(F.lit(i).alias("candidate"), *_parameters(family, p, features)) for i, p in enumerate(candidates)]

    held = slim.filter(f"{INNER} is not null").groupBy(*keys).agg(F.max(INNER).alias("_last"))
    fits = held.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("inner_fold"), F.array(*options).alias("_o"))
    fits = materialize(fits.select(*keys, "inner_fold", F.explode("_o").alias("_o")).select(*keys, "inner_fold", "_o.*"))
    own = [*keys, "candidate", "inner_fold"]
    known = attach(slim.filter(f"{INNER} is not null"), held, keys)
    numbers = F.array(*[F.lit(i) for i in range(len(candidates))])
    others = F.filter(F.sequence(F.lit(0), F.col("_last")), lambda f: f != F.col(INNER))
    train = known.withColumn("inner_fold", F.explode(others)).withColumn("candidate", F.explode(numbers)).drop(INNER, "_last")
    check = known.withColumn("inner_fold", F.col(INNER)).withColumn("candidate", F.explode(numbers)).drop(INNER, "_last")
    model = _fitted(family, train, fits, own, features, sets, label, key, seed)
    scored = trees.predict(check, model, own, key, combine=combine)
    found = metrics.average_precision(scored, own, label).groupBy(*keys, "candidate").agg(F.avg("pr_auc").alias("mean_average_precision"), F.count(F.lit(1)).alias("inner_folds"))
    found = materialize(found)
    order = F.struct(F.col("mean_average_precision").isNotNull(), F.round("mean_average_precision", 12), -F.col("candidate"))
    best = found.groupBy(*keys).agg(F.max_by("candidate", order).alias("candidate"))
    names = F.array(*[F.lit(json.dumps(p, sort_keys=True)) for p in candidates])
    table = attach(found, best.withColumn("_best", F.lit(True)), [*keys, "candidate"])
    table = materialize(table.withColumn("params", F.get(names, F.col("candidate"))).withColumn("chosen", F.coalesce("_best", F.lit(False))).drop("_best"))

    final = fits.select(*keys, *[c for c in fits.columns if c not in (*keys, "inner_fold")]).distinct()
    final = attach(final, table.filter("chosen").select(*keys, "candidate"), [*keys, "candidate"], "left_semi").drop("candidate")
    model = _fitted(family, slim.filter(f"{INNER} is not null"), final, keys, features, sets, label, key, seed)
    return trees.predict(placed.filter(f"{INNER} is null").drop(INNER), model, keys, key, combine=combine).drop(trees.BINS_COLUMN), table
