"""Evaluation runs built from the Newton models: all folds, or all cities and splits, in one job each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework import schema
from latticework.functions.text import MISSING_CATEGORY, UNSEEN_CATEGORY, category
from latticework.operators import metrics
from latticework.operators.folds import balanced_folds, block_splits, requested_folds, spatial_blocks, with_fold
from latticework.operators.profile import moments
from latticework.operators.sample import first_rows, stratified_sample, stratified_splits
from latticework.plans.elastic import search_elastic
from latticework.plans.models import grid_points, tuning_preset
from latticework.plans.newton import design, fit_folds, fit_predict, fit_stumps, predict_stump
from latticework.plans.search import INNER, search_trees, stratified_inner
from latticework.session import attach, materialize, settle


def fold_rows(rows: DataFrame, folds: DataFrame, group: str = schema.GROUP) -> DataFrame:
    """Each row once per held-out fold, marked train or test; rows of unlisted groups raise.

    Every row is trained on by all folds but its own, so the table is (number of folds) times longer.
    """
    placed = with_fold(rows, folds, group)
    listed = folds.agg(F.array_sort(F.collect_set("outer_fold")).alias("_folds"))  # one row
    fold = F.when(F.col("outer_fold").isNull(), F.raise_error(F.lit("A row's group is missing from the fold table")).cast("int")).otherwise(F.col("outer_fold"))
    spread = placed.crossJoin(F.broadcast(listed)).withColumn("held_out", F.explode("_folds"))
    return spread.withColumn("is_train", F.col("held_out") != fold).drop("_folds", "outer_fold")


def leak_check(rows: DataFrame, group: str = schema.GROUP) -> DataFrame:
    """Train and test groups and rows per held-out fold, and how many groups are on both sides (must be 0).

    ``rows`` are rows, or group counts in a column ``n``, which saves a copy of each row per fold.
    """
    size = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    sides = rows.groupBy("held_out", group).agg(F.bool_or("is_train").alias("a"), F.bool_or(~F.col("is_train")).alias("b"), size.alias("n"))
    return sides.groupBy("held_out").agg(
        F.count_if("a").alias("train_groups"), F.count_if("b").alias("test_groups"), F.sum(F.when(F.col("a"), F.col("n")).otherwise(0)).alias("train_rows"),
        F.sum(F.when(F.col("b"), F.col("n")).otherwise(0)).alias("test_rows"), F.count_if(F.col("a") & F.col("b")).alias("overlapping_groups"),
    )


def newton_run(
    rows: DataFrame, folds: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str = schema.TARGET, group: str = schema.GROUP,
    iterations: int = 6, ridge: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """Held-out predictions and coefficients of the ridge logistic for all folds at once."""
    missing = F.raise_error(F.lit("A row's group is missing from the fold table")).cast("int")
    placed = with_fold(schema.drop_unlabelled(rows, label), folds, group)
    placed = placed.withColumn("outer_fold", F.when(F.col("outer_fold").isNull(), missing).otherwise(F.col("outer_fold")))
    scored, model = fit_folds(placed, "outer_fold", numeric, categorical, label, iterations, ridge)
    return scored.withColumn("model_name", F.lit("logistic_regression")), model


def _fold_levels(placed: DataFrame, categorical: Sequence[str]) -> dict[int, dict[str, list[str]]]:
    """``category_levels`` of every fold's own rows, by one scan."""
    texts = [F.struct(F.lit(c).alias("c"), category(c, isinstance(placed.schema[c].dataType, T.NumericType)).alias("v")) for c in categorical]
    if not texts:
        return {}
    limit = 10_000
    found, _ = settle(placed.select("outer_fold", F.explode(F.array(*texts)).alias("_t")).select("outer_fold", "_t.*").distinct())
    many = found.groupBy("c").agg(F.countDistinct("v").alias("n")).filter(F.col("n") > limit).first()
    if many:
        raise ValueError(f"{many['c']} has too many levels for one-hot encoding")
    out: dict[int, dict[str, list[str]]] = {}
    for r in found.collect():
        out.setdefault(r["outer_fold"], {}).setdefault(r["c"], []).append(r["v"])
    return out


def _stumps(placed: DataFrame, held_out: Sequence[int], numeric, categorical, label, group, key, per_group, min_leaf):
    """``(levels, stats, rules)``: levels per held-out fold, scaling and rules with ``held_out``. Levels and scaling come from all training rows, and so do the rules
    unless ``per_group`` bounds them; the first rows of a group are the same for every fold that trains on it. One scan each for all folds."""
    own = _fold_levels(placed, categorical)
    tokens = {MISSING_CATEGORY, UNSEEN_CATEGORY}
    levels = {fold: {c: sorted({v for f, seen in own.items() if f != fold for v in seen.get(c, [])} | tokens) for c in categorical} for fold in held_out}
    spread = placed.select("outer_fold", *numeric).withColumn("held_out", F.explode(F.array(*[F.lit(f) for f in held_out]))).filter("outer_fold != held_out")
    stats, _ = settle(moments(spread, numeric, ["held_out"]))
    columns = dict.fromkeys([group, key, label, "outer_fold", *numeric, *categorical])
    sample = placed if per_group is None else materialize(first_rows(placed.select(*columns), per_group, group, key))
    return levels, stats, fit_stumps(sample, "outer_fold", held_out, numeric, levels, stats, label, min_leaf)


def stump_run(
    rows: DataFrame, folds: DataFrame, held_out: int, numeric: Sequence[str], categorical: Sequence[str], label: str = schema.TARGET,
    group: str = schema.GROUP, key: str = "cell_id", per_group: int | None = None, min_leaf: int = 250,
) -> tuple[DataFrame, DataFrame]:
    """Held-out predictions and the rule of the one-split tree for one fold, fitted on all training rows, or on the first ``per_group`` rows per group."""
    placed = with_fold(schema.drop_unlabelled(rows, label), folds, group)
    train = placed.filter(F.col("outer_fold") != held_out)
    levels, stats, rules = _stumps(train, [held_out], numeric, categorical, label, group, key, per_group, min_leaf)
    rule = rules.drop("held_out")
    test = design(placed.filter(F.col("outer_fold") == held_out), [], numeric, levels[held_out], stats.drop("held_out"))
    return predict_stump(test, rule).withColumn("model_name", F.lit("decision_stump")), rule


def stump_rules(
    rows: DataFrame, folds: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str = schema.TARGET, group: str = schema.GROUP,
    key: str = "cell_id", per_group: int | None = None, min_leaf: int = 250,
) -> DataFrame:
    """The rules of ``stump_run`` for every fold, with ``held_out``; the rows are scanned as often as for one fold."""
    placed = with_fold(schema.drop_unlabelled(rows, label), folds, group).filter(F.col("outer_fold").isNotNull())
    return _stumps(placed, requested_folds(folds), numeric, categorical, label, group, key, per_group, min_leaf)[2]


def _metrics_with_baseline(scored: DataFrame, rows: DataFrame, keys: Sequence[str], label: str, key: str, model: str = "logistic") -> DataFrame:
    prevalence = rows.filter("is_train").groupBy(*keys).agg(F.avg(F.col(label).cast("double")).alias("_prevalence"))
    scores = F.create_map(F.lit(model), F.col("predicted_probability"), F.lit("city_prevalence_baseline"), F.col("_prevalence"))
    both = attach(scored, prevalence, list(keys)).select(*keys, label, key, F.explode(scores).alias("model_name", "_score"))
    return metrics.prediction_metrics(both, [*keys, "model_name"], label, "_score", ties=(key,))


def _bounded_training(rows: DataFrame, keys: Sequence[str], cap: int, key: str, label: str, seed: int) -> DataFrame:
    """At most ``cap`` training rows per fit, class shares kept, and all held-out rows."""
    train = rows.filter("is_train").withColumn("_fit", F.to_json(F.struct(*keys)))
    return stratified_sample(train, cap, "_fit", key, label, seed).drop("_fit").unionByName(rows.filter("not is_train"))


def within_group_run(
    rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], cap: int = 20_000, repeats: int = 3, group: str = schema.GROUP, key: str = "cell_id",
    label: str = schema.TARGET, seed: int = 42, ridge: float = 1.0,
) -> DataFrame:
    """Metrics of a model per group and repeated stratified split, beside the group's own prevalence.

    All groups and repeats are fitted together, on at most ``cap`` training rows each; every held-out row is scored.
    """
    labelled = schema.drop_unlabelled(rows, label)
    splits = materialize(stratified_splits(labelled, repeats, 0.2, group, key, label, seed).withColumn("is_train", ~F.col("is_test")))
    keys = [group, "repeat_id"]
    scored, _ = fit_predict(_bounded_training(splits, keys, cap, key, label, seed), keys, numeric, categorical, label, ridge=ridge)
    return _metrics_with_baseline(scored, splits, keys, label, key)


def spatial_run(
    rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], cap: int = 20_000, group: str = schema.GROUP, key: str = "cell_id",
    label: str = schema.TARGET, lon: str = "centroid_lon", lat: str = "centroid_lat", seed: int = 42, ridge: float = 1.0,
) -> DataFrame:
    """The same, holding out one quadrant of each group at a time."""
    labelled = schema.drop_unlabelled(rows, label)
    placed = block_splits(spatial_blocks(labelled, group, lon, lat), group).withColumn("is_train", ~F.col("is_test"))
    placed = materialize(placed)
    keys = [group, "held_out_block"]
    scored, _ = fit_predict(_bounded_training(placed, keys, cap, key, label, seed), keys, numeric, categorical, label, ridge=ridge)
    return _metrics_with_baseline(scored, placed, keys, label, key)


def _search(
    rows: DataFrame, keys: Sequence[str], family: str, numeric: Sequence[str], categorical: Sequence[str], candidates: Sequence[dict], label: str, key: str, seed: int,
) -> tuple[DataFrame, DataFrame]:
    if family == "logistic_saga":
        return search_elastic(rows, keys, numeric, categorical, candidates, label)
    return search_trees(rows, keys, family, numeric, categorical, candidates, label, key, seed)


def held_out_search(
    rows: DataFrame, folds: DataFrame, family: str, numeric: Sequence[str], categorical: Sequence[str], preset: str = "smoke", grid: Sequence[dict] | None = None,
    splits: int | None = None, group: str = schema.GROUP, key: str = "cell_id", label: str = schema.TARGET, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Nested evaluation of all held-out folds together: every row scored by the fit that leaves its group out, and the search table.

    Inner folds hold whole groups, balanced by rows. Each row is kept once per fold that trains on it, as every fold has its own scaling and bins.
    """
    inner, points = (splits, grid) if grid is not None and splits is not None else tuning_preset(family, preset)
    spread = fold_rows(schema.drop_unlabelled(rows, label), folds, group)
    sizes, _ = settle(spread.filter("is_train").groupBy("held_out", group).agg(F.count(F.lit(1)).alias("row_count")))  # groups x folds
    placed = None
    for fold in requested_folds(folds):
        part = balanced_folds(sizes.filter(F.col("held_out") == fold), inner, group).select(F.lit(fold).alias("held_out"), group, F.col("outer_fold").alias(INNER))
        placed = part if placed is None else placed.unionByName(part)
    marked = attach(spread, placed, ["held_out", group]).drop("is_train")  # rows of the held-out groups have no inner fold
    scored, table = _search(marked, ["held_out"], family, numeric, categorical, grid_points(points), label, key, seed)
    return scored.withColumnRenamed("held_out", "outer_fold").withColumn("model_name", F.lit(family)), table.withColumnRenamed("held_out", "outer_fold")


def _searched(
    splits: DataFrame, keys: Sequence[str], family: str, numeric: Sequence[str], categorical: Sequence[str], candidates: Sequence[dict], inner: int, cap: int,
    label: str, key: str, seed: int,
) -> tuple[DataFrame, DataFrame]:
    bounded = _bounded_training(splits, keys, cap, key, label, seed)
    train = stratified_inner(bounded.filter("is_train"), keys, inner, label, key, seed)
    rows = train.unionByName(bounded.filter("not is_train").withColumn(INNER, F.lit(None).cast("int")))
    scored, table = _search(rows, keys, family, numeric, categorical, candidates, label, key, seed)
    return _metrics_with_baseline(scored, splits, keys, label, key, family), table


def within_group_search(
    rows: DataFrame, family: str, numeric: Sequence[str], categorical: Sequence[str], preset: str = "smoke", grid: Sequence[dict] | None = None, splits: int | None = None,
    cap: int = 20_000, repeats: int = 3, group: str = schema.GROUP, key: str = "cell_id", label: str = schema.TARGET, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Tree models inside each group with an inner stratified search: metrics per group, repeat and model, and the search table.

    All groups, repeats, candidates and inner folds are grown together, on at most ``cap`` training rows of a group and repeat; every held-out row
    is scored. The group's own training prevalence is the baseline.
    """
    inner, points = (splits, grid) if grid is not None and splits is not None else tuning_preset(family, preset)
    labelled = schema.drop_unlabelled(rows, label)
    split = materialize(stratified_splits(labelled, repeats, 0.2, group, key, label, seed).withColumn("is_train", ~F.col("is_test")).drop("is_test"))
    return _searched(split, [group, "repeat_id"], family, numeric, categorical, grid_points(points), inner, cap, label, key, seed)


def spatial_search(
    rows: DataFrame, family: str, numeric: Sequence[str], categorical: Sequence[str], preset: str = "smoke", grid: Sequence[dict] | None = None, splits: int | None = None,
    cap: int = 20_000, group: str = schema.GROUP, key: str = "cell_id", label: str = schema.TARGET, lon: str = "centroid_lon", lat: str = "centroid_lat", seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """The same, holding out one quadrant of each group at a time."""
    inner, points = (splits, grid) if grid is not None and splits is not None else tuning_preset(family, preset)
    labelled = schema.drop_unlabelled(rows, label)
    split = block_splits(spatial_blocks(labelled, group, lon, lat), group).withColumn("is_train", ~F.col("is_test")).drop("is_test")
    return _searched(materialize(split), [group, "held_out_block"], family, numeric, categorical, grid_points(points), inner, cap, label, key, seed)
