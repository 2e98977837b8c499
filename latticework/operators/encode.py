"""Target means by category or quantile bin, fitted on the other folds, and the prevalence baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.text import category
from latticework.operators.ordering import quantiles
from latticework.session import attach, settle

EDGE = 1e-9


def category_means(train: DataFrame, column: str, label: str) -> DataFrame:
    """Mean label per category text."""
    return train.groupBy(category(column).alias("_cat")).agg(F.avg(F.col(label).cast("double")).alias("_mean"))


def encode_category(df: DataFrame, train: DataFrame, column: str, label: str, name: str = "encoded") -> DataFrame:
    """Training mean of the row's category; the overall training mean for categories not seen."""
    overall = train.agg(F.avg(F.col(label).cast("double")).alias("_global"))
    keyed = attach(df.withColumn("_cat", category(column)), category_means(train, column, label), "_cat")
    return keyed.crossJoin(F.broadcast(overall)).withColumn(name, F.coalesce("_mean", "_global")).drop("_cat", "_mean", "_global")


def bin_edges(quantile_array: Column) -> Column:
    """Distinct quantile edges widened a little at both ends; NULL when fewer than two remain."""
    distinct = F.array_sort(F.array_distinct(quantile_array))
    n = F.size(distinct)
    widened = F.transform(
        distinct, lambda e, i: F.when(i == 0, e - EDGE).when(i == n - 1, e + EDGE).otherwise(e)
    )
    return F.when(n >= 2, widened)


def bin_of(value: Column, edges: Column) -> Column:
    """Right-closed bin number from 0, the lowest edge included; NULL outside the edges."""
    below = F.size(F.filter(edges, lambda e: e < value))
    inside = (value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1))
    return F.when(inside, F.greatest(F.lit(0), below - 1))


def encode_bins(
    df: DataFrame, train: DataFrame, column: str, label: str, bins: int = 10, name: str = "encoded", slices: int | None = None
) -> DataFrame:
    """Training mean of the row's quantile bin; the overall training mean where there is no bin."""
    probs = [i / bins for i in range(bins + 1)]
    edges = quantiles(train, [], column, probs, "_q", slices).select(bin_edges(F.col("_q")).alias("_edges"))
    overall = train.agg(F.avg(F.col(label).cast("double")).alias("_global"))
    fitted = settle(overall.crossJoin(edges))[0]  # one row
    x = F.col(column).cast("double")
    binned = train.crossJoin(F.broadcast(fitted)).withColumn("_bin", bin_of(x, F.col("_edges")))
    means = binned.filter(F.col("_bin").isNotNull()).groupBy("_bin").agg(F.avg(F.col(label).cast("double")).alias("_mean"))
    placed = df.crossJoin(F.broadcast(fitted)).withColumn("_bin", bin_of(x, F.col("_edges")))
    return attach(placed, means, "_bin").withColumn(name, F.coalesce("_mean", "_global")).drop("_bin", "_mean", "_global", "_edges")


def _other_folds(df: DataFrame, fold: str, by: Sequence[str], label: str) -> DataFrame:
    """Label sums per fold and key over all *other* folds: the total minus the fold's own share."""
    own = df.groupBy(fold, *by).agg(F.sum(F.col(label).cast("double")).alias("_s"), F.count(label).alias("_c"))
    total = own.groupBy(*by).agg(F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"))
    # a row only looks up its own fold and key, so the pairs that occur are enough
    filled = attach(own, total, list(by)) if by else own.crossJoin(F.broadcast(total))  # one total row
    return filled.select(fold, *by, F.try_divide(F.col("_ts") - F.col("_s"), F.col("_tc") - F.col("_c")).alias("_mean"))


def fold_baselines(
    df: DataFrame, label: str, categories: dict[str, str], binned: dict[str, str], fold: str = "outer_fold", bins: int = 10,
    global_name: str = "global_mean_baseline", slices: int | None = None,
) -> DataFrame:
    """Held-out predictions of every baseline for every fold in one pass, one row per row and model.

    ``categories`` and ``binned`` map a model name to its column. Category means are leave-one-fold-out
    sums; quantile edges are fitted on the other folds' values. No loop over folds.
    """
    base = attach(df, _other_folds(df, fold, [], label).withColumnRenamed("_mean", "_global"), fold)
    scores = {global_name: F.col("_global")}
    for i, (model, column) in enumerate(categories.items()):
        key, mean = f"_k{i}", f"_m{i}"
        keyed = df.select(fold, label, category(column).alias(key))
        means = _other_folds(keyed, fold, [key], label).withColumnRenamed("_mean", mean)
        base = attach(base.withColumn(key, category(column)), means, [fold, key]).drop(key)
        scores[model] = F.coalesce(mean, "_global")
    folds = F.array_sort(F.collect_set(fold))
    for i, (model, column) in enumerate(binned.items()):
        edges_name, key, mean = f"_e{i}", f"_b{i}", f"_n{i}"
        every = df.agg(folds.alias("_folds"))  # one row: the fold numbers
        trained = (
            df.select(fold, F.col(label).cast("double").alias("_y"), F.col(column).cast("double").alias("_x"))
            .crossJoin(F.broadcast(every))
            .withColumn("_for", F.explode(F.array_remove("_folds", F.col(fold))))
            .drop("_folds", fold)
        )
        probs = [j / bins for j in range(bins + 1)]
        edges = settle(
            quantiles(trained, ["_for"], "_x", probs, "_q", slices).select(
                F.col("_for").alias(fold), bin_edges(F.col("_q")).alias(edges_name)
            )
        )[0]
        placed = attach(trained.withColumnRenamed("_for", fold), edges, fold).withColumn(key, bin_of(F.col("_x"), F.col(edges_name)))
        means = placed.filter(F.col(key).isNotNull()).groupBy(fold, key).agg(F.avg("_y").alias(mean))
        base = attach(base, edges, fold).withColumn(key, bin_of(F.col(column).cast("double"), F.col(edges_name)))
        base = attach(base, means, [fold, key]).drop(key, edges_name)
        scores[model] = F.coalesce(mean, "_global")
    per_model = F.create_map(*[x for model, value in scores.items() for x in (F.lit(model), value)])
    helpers = [c for c in base.columns if c not in df.columns]
    return base.select(*df.columns, F.explode(per_model).alias("model_name", "predicted_probability")).drop(*helpers)
