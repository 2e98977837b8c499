"""Ranking metrics of labelled scores, for any list of group keys.

Average precision and ROC AUC come from one row per (group, score) and running counts over them, so
ties are handled exactly and a hot group is spread over tasks. Labels are 0/1 integers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.numeric import decile, top_count
from latticework.operators import ordering
from latticework.operators.ordering import prefix_sums, quantiles, rank_in_group
from latticework.session import attach, materialize, settle

POOLED = "_all"


def score_counts(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Rows and positives per group and distinct score; ``df`` holds rows, or such counts of finer groups."""
    counted = {"_s", "_p", "_n"} <= set(df.columns)
    value = F.col("_s") if counted else F.col(score).cast("double").alias("_s")
    positives, rows = (F.sum("_p"), F.sum("_n")) if counted else (F.sum(F.col(label).cast("long")), F.count(F.lit(1)))
    return df.groupBy(*keys, value).agg(positives.alias("_p"), rows.alias("_n"))


def score_table(df: DataFrame, keys: Sequence[str], label: str, score: str, slices: int | None = None) -> DataFrame:
    """One row per group and distinct score, with counts and running counts from the top score down."""
    table = score_counts(df, keys, label, score)
    return prefix_sums(table, keys, [("_s", False)], {"_cp": "_p", "_cn": "_n"}, slices)


def _top_positives(df, keys, label, score, ties, fraction, table, totals, slices):
    """Positives among the first ``top_count`` rows by score, ties on the boundary broken by ``ties``."""
    with_n = attach(table, totals.select(*keys, F.col("_tot")), keys)
    with_n = with_n.withColumn("_top", top_count("_tot", fraction))
    above = with_n.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("_cn") <= F.col("_top"), F.col("_p"))), F.lit(0)).alias("_above"))
    boundary, _ = settle(
        with_n.filter((F.col("_cn") > F.col("_top")) & (F.col("_cn") - F.col("_n") < F.col("_top"))).select(
            *keys, "_s", (F.col("_top") - F.col("_cn") + F.col("_n")).alias("_k"), "_p", "_n"
        )
    )
    settled = boundary.filter("_p = 0 or _p = _n").select(*keys, F.when(F.col("_p") > 0, F.col("_k")).otherwise(0).alias("_part"))
    mixed = boundary.filter("_p > 0 and _p < _n").select(*keys, "_s", "_k")
    part = settled
    if mixed.limit(1).count():
        rows = df.select(*keys, F.col(score).cast("double").alias("_s"), F.col(label).cast("long").alias("_y"), *ties)
        tied = attach(rows, mixed, [*keys, "_s"], "inner")
        ranked = rank_in_group(tied, [*keys], [(t, True) for t in ties], "_r", slices)
        part = settled.unionByName(
            ranked.groupBy(*keys).agg(F.sum(F.when(F.col("_r") <= F.col("_k"), F.col("_y")).otherwise(0)).alias("_part"))
        )
    return attach(above, part, keys).select(*keys, (F.col("_above") + F.coalesce("_part", F.lit(0))).alias("_hits"))


def prediction_metrics(
    df: DataFrame, keys: Sequence[str], label: str = "hotspot_10pct", score: str = "predicted_probability",
    fraction: float = 0.1, ties: Sequence[str] = ("city_id", "cell_id"), single_class: str = "null",
    slices: int | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """Rows, positives, prevalence, AP (``pr_auc``), ROC AUC and recall in the top fraction, per group.

    ``single_class="null"`` leaves AP empty when only one class is present; ``"positives"`` leaves it
    empty only without positives. Null keys form their own group. ``counts`` are score counts of these or finer
    groups, if already made; rows are then read for ties on the boundary only.
    """
    pooled = not keys
    if pooled:
        df, keys = df.withColumn(POOLED, F.lit(1)), [POOLED]
        counts = None if counts is None else counts.withColumn(POOLED, F.lit(1))
    keys = list(keys)
    table = materialize(score_table(counts if counts is not None else df, keys, label, score, slices))
    totals, _ = settle(table.groupBy(*keys).agg(F.sum("_p").alias("_pos"), F.sum("_n").alias("_tot")))
    rows = attach(table, totals, keys)
    below = F.col("_tot") - F.col("_cn")
    sums = rows.groupBy(*keys, "_pos", "_tot").agg(
        F.sum(F.try_divide(F.col("_p"), F.col("_pos")) * F.col("_cp") / F.col("_cn")).alias("_ap"),
        F.sum((below + (F.col("_n") + 1) / 2.0) * F.col("_p")).alias("_ranks"),
    )
    hits = _top_positives(df, keys, label, score, ties, fraction, table, totals, slices)
    return _metric_columns(attach(sums, hits, keys), keys, single_class, pooled)


def _metric_columns(joined: DataFrame, keys: Sequence[str], single_class: str, pooled: bool) -> DataFrame:
    p, n = F.col("_pos"), F.col("_tot")
    enough = (p > 0) & (p < n) if single_class == "null" else p > 0
    out = joined.select(
        *keys,
        n.alias("row_count"),
        p.alias("positive_count"),
        (p / n).alias("prevalence"),
        F.when(enough, F.col("_ap")).alias("pr_auc"),
        F.when((p > 0) & (p < n), F.try_divide(F.col("_ranks") - p * (p + 1) / 2.0, p.cast("double") * (n - p))).alias("roc_auc"),
        F.try_divide(F.col("_hits"), p).alias("recall_at_top_10pct"),
    )
    return out.drop(POOLED) if pooled else out


def average_precision(
    df: DataFrame, keys: Sequence[str], label: str = "hotspot_10pct", score: str = "predicted_probability", slices: int | None = None
) -> DataFrame:
    """AP alone per group, without the ranking of boundary ties that recall needs."""
    p, n = F.col("_pos"), F.col("_tot")
    table = score_table(df, keys, label, score, slices)
    totals = table.groupBy(*keys).agg(F.sum("_p").alias("_pos"), F.sum("_n").alias("_tot"))
    share = F.try_divide(F.col("_p"), F.col("_pos")) * F.col("_cp") / F.col("_cn")
    return attach(table, totals, list(keys)).groupBy(*keys, "_pos", "_tot").agg(F.sum(share).alias("_ap")).select(
        *keys, F.when((p > 0) & (p < n), F.col("_ap")).alias("pr_auc")
    )


def run_summary(
    df: DataFrame, model: str = "model_name", fold: str = "outer_fold", city: str = "city_id", **options
) -> DataFrame:
    """Per model: pooled metrics and means of the per-fold and per-city metrics."""
    label, score = options.get("label", "hotspot_10pct"), options.get("score", "predicted_probability")
    options["counts"] = materialize(score_counts(df, [model, fold, city], label, score))  # rolled up for each level
    pooled = prediction_metrics(df, [model], **options)
    by_fold = prediction_metrics(df, [model, fold], **options)
    by_city = prediction_metrics(df, [model, fold, city], **options)
    folds = by_fold.groupBy(model).agg(
        F.countDistinct(fold).alias("outer_fold_count"),
        F.avg("pr_auc").alias("mean_fold_pr_auc"),
        F.avg("recall_at_top_10pct").alias("mean_fold_recall_at_top_10pct"),
    )
    cities = by_city.groupBy(model).agg(
        F.countDistinct(city).alias("heldout_city_count"), F.avg("pr_auc").alias("mean_city_pr_auc")
    )
    joined = attach(attach(pooled, folds, model), cities, model)
    return joined.select(
        model, "outer_fold_count", "heldout_city_count",
        F.col("row_count").alias("heldout_row_count"), F.col("positive_count").alias("heldout_positive_count"),
        F.col("prevalence").alias("heldout_prevalence"), F.col("pr_auc").alias("pooled_pr_auc"),
        "mean_fold_pr_auc", "mean_city_pr_auc",
        F.col("recall_at_top_10pct").alias("pooled_recall_at_top_10pct"), "mean_fold_recall_at_top_10pct",
    )


def weighted_means(
    df: DataFrame, group: str, metrics: Sequence[str], weight: str, fold: str = "outer_fold", sums: Sequence[str] = ()
) -> DataFrame:
    """Plain and row-weighted means of fold metrics per model; a null metric adds 0 to the weighted sum."""
    w = F.col(weight).cast("double")
    return df.groupBy(group).agg(
        F.countDistinct(fold).alias("n_folds"),
        F.sum(weight).alias("total_rows"),
        *[F.sum(s).alias(f"total_{s}") for s in sums],
        *[F.avg(m).alias(f"mean_fold_{m}") for m in metrics],
        *[F.try_divide(F.sum(F.col(m) * w), F.sum(w)).alias(f"weighted_mean_fold_{m}") for m in metrics],
    )


def calibration(
    df: DataFrame, keys: Sequence[str], label: str = "hotspot_10pct", score: str = "predicted_probability",
    bins: int = 10, slices: int | None = None,
) -> DataFrame:
    """Mean score and positive rate in quantile bins; empty bins are dropped, one-class groups give no rows."""
    pooled = not keys
    if pooled:
        df, keys = df.withColumn(POOLED, F.lit(1)), [POOLED]
    keys = list(keys)
    edges = quantiles(df, keys, score, [i / bins for i in range(1, bins)], "_edges", slices)
    s = F.col(score).cast("double")
    binned = attach(df.filter(s.isNotNull()), edges, keys).withColumn("_bin", F.size(F.filter("_edges", lambda e: e < s)))
    points = binned.groupBy(*keys, "_bin").agg(
        F.avg(s).alias("predicted_probability_mean"), F.avg(F.col(label).cast("double")).alias("observed_positive_rate")
    )
    group = Window.partitionBy(*keys)  # at most ``bins`` rows per group from here on
    both = points.withColumns({
        "_lo": F.min("observed_positive_rate").over(group), "_hi": F.max("observed_positive_rate").over(group),
        "bin_index": F.row_number().over(group.orderBy("_bin")) - 1,
    }).filter(~((F.col("_hi") == 0) | (F.col("_lo") == 1)))
    return both.select(*[k for k in keys if k != POOLED], "bin_index", "predicted_probability_mean", "observed_positive_rate")


def top_flags(
    df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], fraction: float = 0.1,
    flag: str = "in_top", slices: int | None = None,
) -> DataFrame:
    """True for the first ``max(1, ceil(n * fraction))`` rows with a score; ties in ``ties`` order."""
    valid = df.withColumn("_ok", F.col(score).isNotNull())
    inner = [*keys, "_ok"]
    sized = rank_in_group(valid, inner, [(score, False), *[(t, True) for t in ties]], "_r", slices, "_n")
    return sized.withColumn(flag, F.col("_ok") & (F.col("_r") <= top_count("_n", fraction))).drop("_ok", "_r", "_n")


def prediction_labels(
    df: DataFrame, keys: Sequence[str] = (), score: str = "predicted_probability", tie: str = "cell_id",
    fraction: float = 0.1, slices: int | None = None,
) -> DataFrame:
    """Rank from the highest score, top flag and decile ``ceil(rank * 10 / n)``."""
    pooled = not keys
    if pooled:
        df, keys = df.withColumn(POOLED, F.lit(1)), [POOLED]
    sized = rank_in_group(df, keys, [(score, False), (tie, True)], "prediction_rank", slices, "_n")
    return sized.withColumns({
        "predicted_hotspot_10pct": F.col("prediction_rank") <= top_count("_n", fraction),
        "prediction_decile": decile("prediction_rank", "_n"),
    }).drop("_n", POOLED)


def error_type(predicted: Column, actual: Column) -> Column:
    return (
        F.when(predicted & actual, F.lit("true_positive"))
        .when(predicted, F.lit("false_positive"))
        .when(actual, F.lit("false_negative"))
        .otherwise(F.lit("true_negative"))
    )


def map_labels(
    df: DataFrame, group: str = "city_id", label: str = "hotspot_10pct", score: str = "predicted_probability",
    ties: Sequence[str] = ("cell_id",), fraction: float = 0.1, slices: int | None = None,
) -> DataFrame:
    """Top flag per group, residual and TP/FP/FN/TN label."""
    flagged = top_flags(df, [group], score, ties, fraction, "predicted_hotspot_10pct", slices)
    actual = F.col(label).cast("int")
    return flagged.withColumns({
        "prediction_residual": F.col(score).cast("double") - actual,
        "error_type": error_type(F.col("predicted_hotspot_10pct"), actual == 1),
    })


def map_summary(df: DataFrame, keys: Sequence[str], label: str = "hotspot_10pct") -> DataFrame:
    """Counts of ``map_labels`` rows per group."""
    kinds = ["true_positive", "false_positive", "false_negative", "true_negative"]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("predicted_hotspot_10pct").alias("predicted_hotspot_count"),
        F.sum(F.col(label).cast("long")).alias("true_hotspot_count"),
        *[F.count_if(F.col("error_type") == k).alias(f"{k}_count") for k in kinds],
    )


def prediction_overview(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), score: str = "predicted_probability") -> DataFrame:
    """Counts, spread of the score, lowest score in the top set and rows with any missing feature."""
    spread = ordering.medians(df, keys, {"predicted_probability_median": score})
    top = F.col("predicted_hotspot_10pct")
    missing = F.lit(False)
    for name in features:
        missing = missing | F.col(name).isNull()
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(top).alias("predicted_hotspot_count"),
        F.avg(top.cast("double")).alias("predicted_hotspot_fraction"),
        F.min(score).alias("predicted_probability_min"),
        F.avg(score).alias("predicted_probability_mean"),
        F.max(score).alias("predicted_probability_max"),
        F.min(F.when(top, F.col(score))).alias("top_decile_probability_threshold"),
        F.count_if(missing).alias("rows_with_any_missing_features"),
    )
    return attach(counts, spread, list(keys)) if keys else counts.crossJoin(F.broadcast(spread))  # one row each


def decile_table(df: DataFrame, keys: Sequence[str] = (), score: str = "predicted_probability", key: str = "cell_id") -> DataFrame:
    return df.groupBy(*keys, "prediction_decile").agg(
        F.count(key).alias("row_count"),
        F.min(score).alias("predicted_probability_min"),
        F.avg(score).alias("predicted_probability_mean"),
        F.max(score).alias("predicted_probability_max"),
        F.count_if("predicted_hotspot_10pct").alias("predicted_hotspot_count"),
    )


def label_score_sanity(
    df: DataFrame, keys: Sequence[str], label: str, score: str, fraction: float = 0.1,
    ties: Sequence[str] = ("city_id", "cell_id"),
) -> DataFrame:
    """AP, ROC AUC and positive rate of the top set, for the score and for its inverse."""
    both = df.select("*", F.explode(F.create_map(F.lit("original"), F.col(score), F.lit("inverted"), -F.col(score)))
                     .alias("direction", "_directed"))
    out = prediction_metrics(both, [*keys, "direction"], label, "_directed", fraction, ties)
    hits = F.col("recall_at_top_10pct") * F.col("positive_count")
    return out.select(
        *keys, "direction", F.col("row_count").alias("rows"), F.col("prevalence").alias("positive_rate"),
        F.col("pr_auc").alias("ap"), "roc_auc", (hits / top_count("row_count", fraction)).alias("top_positive_rate"),
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str, slices: int | None = None) -> DataFrame:
    """Ascending rank with ties sharing their mean, computed on distinct values and joined back."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    running = prefix_sums(counts, keys, [(value, True)], {"_c": "_n"}, slices)
    ranks = running.select(*keys, value, (F.col("_c") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(name))
    return attach(df, ranks, [*keys, value])


def spearman(df: DataFrame, keys: Sequence[str], left: str, right: str, name: str = "spearman", slices: int | None = None) -> DataFrame:
    """Correlation of average ranks over rows where both values are present; null when one is constant."""
    valid = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*keys, F.col(left).alias("_l"), F.col(right).alias("_r"))
    ranked = average_rank(average_rank(valid, keys, "_l", "_rl", slices), keys, "_r", "_rr", slices)
    varies = (F.max("_rl") > F.min("_rl")) & (F.max("_rr") > F.min("_rr"))
    return ranked.groupBy(*keys).agg(F.when(varies, F.corr("_rl", "_rr")).alias(name))
