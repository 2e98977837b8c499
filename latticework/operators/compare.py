"""Joins and summaries that compare models, runs and groups.

Model labels and column names are parameters, so one operator serves any pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework import schema
from latticework.functions.params import canonical_json
from latticework.functions.text import climate_label
from latticework.session import attach

CITY_KEYS = ("outer_fold", "city_id", "city_name", "climate_group")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "Table") -> None:
    repeats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if repeats:
        raise ValueError(f"{what} has repeated keys, for example {tuple(repeats[0])[:-1]}")


def replace_columns(base: DataFrame, update: DataFrame, keys: Sequence[str] = ("city_id", "cell_id")) -> DataFrame:
    """Columns of ``update`` replace those of ``base`` by key; base rows are all kept, each once."""
    keys = list(keys)
    require_unique(update, keys, "Update table")
    fresh = [c for c in update.columns if c not in keys]
    return base.drop(*fresh).join(update, keys, "left")


def _winner(delta: Column, left: str, right: str) -> Column:
    return F.when(delta > 0, right).when(delta < 0, left).otherwise("tie")


def pair_metrics(
    left: DataFrame, right: DataFrame, left_label: str, right_label: str, left_short: str, right_short: str,
    keys: Sequence[str] = CITY_KEYS, metrics: dict[str, str] | None = None, carry: Sequence[str] = ("row_count", "positive_count", "prevalence"),
) -> DataFrame:
    """One-to-one join of two models' metrics with deltas (right minus left) and winner labels.

    ``metrics`` maps a metric column to the short name used in its delta and winner columns.
    """
    metrics = metrics or {"pr_auc": "pr_auc", "recall_at_top_10pct": "recall"}
    keys = list(keys)
    for side, label in ((left, left_label), (right, right_label)):
        require_unique(side, keys, f"Metrics of {label}")
    l = left.select(*keys, *carry, *[F.col(m).alias(f"{m}_{left_short}") for m in metrics])
    r = right.select(*keys, *[F.col(m).alias(f"{m}_{right_short}") for m in metrics])
    joined = l.join(r, keys)
    for metric, short in metrics.items():
        delta = F.col(f"{metric}_{right_short}") - F.col(f"{metric}_{left_short}")
        joined = joined.withColumn(f"{short}_delta_{right_short}_minus_{left_short}", delta).withColumn(
            f"{short}_winner", _winner(delta, left_label, right_label)
        )
    return joined


def fold_comparison(left: DataFrame, right: DataFrame, left_short: str, right_short: str, ids: Sequence[str], same: Sequence[str],
                    metrics: Sequence[str], digits: int = 4) -> DataFrame:
    """Join on the id columns, require the ``same`` columns to agree, and give rounded metrics and deltas."""
    for side in (left, right):
        require_unique(side, ids, "Fold metrics")
    l = left.select(*ids, *same, *[F.col(m).alias(f"{m}_{left_short}") for m in metrics])
    r = right.select(*ids, *[F.col(c).alias(f"_same_{c}") for c in same], *[F.col(m).alias(f"{m}_{right_short}") for m in metrics])
    joined = l.join(r, list(ids))
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_same_{c}"))
    agreeing = joined.withColumn("_check", F.assert_true(~differs, F.lit("The two runs describe different folds")))
    out = agreeing.filter(F.col("_check").isNull())
    columns = [*[F.col(f"{m}_{s}") for m in metrics for s in (left_short, right_short)]]
    deltas = [F.bround(F.col(f"{m}_{right_short}") - F.col(f"{m}_{left_short}"), digits).alias(f"{m}_delta") for m in metrics]
    return out.select(*ids, *same, *[F.bround(c, digits).alias(n) for c, n in zip(columns, [f"{m}_{s}" for m in metrics for s in (left_short, right_short)])], *deltas)


def reference_gaps(df: DataFrame, references: dict[str, DataFrame], keys: Sequence[str], gaps: dict[str, tuple[str, str]]) -> DataFrame:
    """Left join one or more reference tables and add ``{gap: (column, reference_column)}`` differences.

    A missing reference keeps the row and leaves its gap empty. Two references give the chained form.
    """
    out = df
    for name, table in references.items():
        require_unique(table, keys, f"Reference {name}")
        out = out.join(table, list(keys), "left")
    return out.withColumns({gap: F.col(a) - F.col(b) for gap, (a, b) in gaps.items()})


def checked_lookup(df: DataFrame, table: DataFrame, key: str, equal: dict[str, str]) -> DataFrame:
    """Left lookup where listed columns of both sides must agree wherever both are present."""
    joined = attach(df, table, key)
    wrong = F.lit(False)
    for a, b in equal.items():
        wrong = wrong | F.coalesce(F.col(a) != F.col(b), F.lit(False))
    bad = joined.filter(wrong).limit(1).count()
    if bad:
        raise ValueError(f"Lookup by {key} disagrees on {', '.join(equal)}")
    return joined


def group_deltas(df: DataFrame, by: str, deltas: dict[str, str], winners: dict[str, dict[str, str]], means: Sequence[str] = (), key: str = "city_id") -> DataFrame:
    """Counts, wins per model and mean/median deltas per group.

    ``deltas``: short name -> delta column; ``winners``: winner column -> {output name: model label}.
    """
    return df.groupBy(by).agg(
        F.count(key).alias("city_count"),
        *[F.count_if(F.col(column) == model).alias(out) for column, outs in winners.items() for out, model in outs.items()],
        *[F.avg(m).alias(f"mean_{m}") for m in means],
        *[a for short, column in deltas.items() for a in (F.avg(column).alias(f"mean_{short}_delta"), F.median(column).alias(f"median_{short}_delta"))],
    )


def disparity(by_group: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """Max minus min of group means for a baseline and a candidate, per metric, and the change."""
    wide = by_group.agg(*[
        (F.max(c) - F.min(c)).alias(f"{m}__{i}") for m, pair in metrics.items() for i, c in enumerate(pair)
    ])
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}__0").alias("baseline_range"), F.col(f"{m}__1").alias("candidate_range"),
                 (F.col(f"{m}__1") - F.col(f"{m}__0")).alias("range_delta"))
        for m in metrics
    ])
    return wide.select(F.explode(rows).alias("_e")).select("_e.*")


def paired_summary(df: DataFrame, deltas: dict[str, str], digits: int = 4) -> DataFrame:
    """Mean, median, sd, min, max, wins, losses and ties of paired deltas, one row per metric."""
    long = df.select(F.explode(F.create_map(*[x for name, c in deltas.items() for x in (F.lit(name), F.col(c))])).alias("metric", "_d"))
    r = lambda c, name: F.bround(c, digits).alias(name)
    return long.groupBy("metric").agg(
        r(F.avg("_d"), "mean_delta"), r(F.median("_d"), "median_delta"), r(F.stddev_samp("_d"), "sd_delta"),
        r(F.min("_d"), "min_delta"), r(F.max("_d"), "max_delta"),
        F.count_if(F.col("_d") > 0).alias("wins"), F.count_if(F.col("_d") < 0).alias("losses"), F.count_if(F.col("_d") == 0).alias("ties"),
    )


def climate_summary(summary: DataFrame, by: str = "climate_group", key: str = "city_id") -> DataFrame:
    """Groups, row sums, min/median/max rows, prevalence as a ratio of sums, per labelled climate group."""
    named = summary.withColumn("_label", climate_label(by))
    out = named.groupBy("_label").agg(
        F.countDistinct(key).alias("city_count"), F.sum("row_count").alias("total_rows"),
        F.sum("hotspot_positive_count").alias("hotspot_count"),
        F.bround(F.try_divide(F.sum("hotspot_positive_count"), F.sum("hotspot_non_missing_count")), 4).alias("hotspot_prevalence"),
        F.min("row_count").alias("min_rows"), F.rint(F.median("row_count")).cast("long").alias("median_rows"),
        F.max("row_count").alias("max_rows"),
        F.bround(F.median("n_valid_ecostress_passes_median"), 1).alias("median_valid_passes"),
    )
    return out.withColumnRenamed("_label", by)


def repeat_summary(
    splits: DataFrame, keys: Sequence[str] = ("city_id", "city_name", "climate_group", "model_name"),
    metrics: Sequence[str] = ("pr_auc", "recall_at_top_10pct"), firsts: Sequence[str] = (), means: Sequence[str] = (), repeat: str = "repeat_id",
) -> DataFrame:
    """Mean and sample std (0 for a single repeat) of repeated splits per group and model."""
    return splits.groupBy(*keys).agg(
        F.count(repeat).alias("repeat_count"),
        *[F.first(c, True).alias(c) for c in firsts],
        *[a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))],
        *[F.avg(c).alias(f"{c}_mean") for c in means],
    )


def roll_up(by_city: DataFrame, keys: Sequence[str], means: Sequence[str], stds: Sequence[str] = (), key: str = "city_id") -> DataFrame:
    """City table to climate table: distinct cities, means, and sample std with null as 0."""
    return by_city.groupBy(*keys).agg(
        F.countDistinct(key).alias("city_count"),
        *[F.avg(m).alias(f"mean_{m}") for m in means],
        *[F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias(f"std_{s}") for s in stds],
    )


def importance_summary(df: DataFrame, value: str, rank: str, feature: str = "feature_name", base: str = "base_feature_name") -> DataFrame:
    """Mean, population std, median rank, rank std and positive share of a per-fold importance."""
    x = F.col(value)
    return df.groupBy(feature).agg(
        F.first(base, True).alias(base), F.count(F.lit(1)).alias("fold_count"), F.avg(x).alias(f"mean_{value}"),
        F.stddev_pop(x).alias(f"std_{value}"), F.median(rank).alias("median_rank"), F.stddev_pop(rank).alias("rank_std"),
        F.avg((x > 0).cast("double")).alias("positive_share"),
    )


def coefficient_summary(df: DataFrame, value: str = "coefficient", rank: str = "absolute_rank", feature: str = "feature_name", base: str = "base_feature_name") -> DataFrame:
    """Median coefficient, size and rank, majority sign and its share over folds."""
    sign = F.signum(value)
    stats = df.groupBy(feature).agg(
        F.first(base, True).alias(base), F.count(F.lit(1)).alias("fold_count"), F.median(value).alias("median_coefficient"),
        F.median(F.abs(value)).alias("median_abs_coefficient"), F.median(rank).alias("median_absolute_rank"),
        F.mode(sign, True).alias("_sign"), F.count_if(sign > 0).alias("_p"), F.count_if(sign < 0).alias("_m"), F.count_if(sign == 0).alias("_z"),
    )
    most = F.greatest("_p", "_m", "_z")
    label = F.when(F.col("_sign") > 0, "positive").when(F.col("_sign") < 0, "negative").otherwise("zero")
    return stats.withColumn("majority_sign", label).withColumn("sign_consistency", most / F.col("fold_count")).drop("_sign", "_p", "_m", "_z")


def ranked_importance(df: DataFrame, value: str, fold: str = "outer_fold", name: str = "importance_rank") -> DataFrame:
    """Dense rank of the value inside its fold, largest first (one row per feature and fold)."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(fold).orderBy(F.col(value).desc())))


def linear_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson r, least-squares slope and intercept over rows with both values."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def union_tables(*tables: DataFrame) -> DataFrame:
    """Union by name, columns missing on one side as NULL."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def distinct_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order``, so the kept row does not depend on input order."""
    kept = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(kept.alias("_row")).select("_row.*")


def model_columns_to_rows(df: DataFrame, ids: Sequence[str], models: dict[str, dict[str, str]]) -> DataFrame:
    """Wide model columns to rows: ``{model_name: {output column: source column}}``."""
    entries = F.array(*[
        F.struct(F.lit(model).alias("model_name"), *[F.col(source).alias(out) for out, source in columns.items()])
        for model, columns in models.items()
    ])
    return df.select(*ids, F.explode(entries).alias("_m")).select(*ids, "_m.*")


def missing_ids(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).subtract(present.select(key))


def shared_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def top_rows(df: DataFrame, order: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """First ``n`` rows by the full order (a top-k report, no global sort of the table)."""
    return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in order]).limit(n)


def label_extremes(df: DataFrame, name: str, metrics: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """Names holding the largest or smallest value of any metric, plus listed names that are present."""
    ends = df.agg(*[
        a for m in metrics for a in (F.max_by(name, F.struct(m, name)).alias(f"{m}_hi"), F.min_by(name, F.struct(m, name)).alias(f"{m}_lo"))
    ])
    picked = ends.select(F.explode(F.array(*[F.col(c) for c in ends.columns])).alias(name))
    forced = df.filter(F.col(name).isin(list(always))).select(name)
    return picked.union(forced).distinct()


def rounded_report(df: DataFrame, columns: dict[str, str], digits: dict[str, int] | None = None, climate: str | None = None) -> DataFrame:
    """Select, rename (``{source: report name}``) and round half to even."""
    digits = digits or {}
    shaped = [
        (climate_label(c) if c == climate else F.bround(c, digits[c]) if c in digits else F.col(c)).alias(name) for c, name in columns.items()
    ]
    return df.select(*shaped)


def benchmark_rows(baselines: DataFrame, tuned: DataFrame, keep: Sequence[str], notes: dict[str, str]) -> DataFrame:
    """Chosen baseline rows under the tuned rows' columns, then the tuned rows; absent columns are NULL."""
    schema.require_columns(baselines, ["model_name"], "Baseline summary")
    note = F.create_map(*[F.lit(x) for pair in notes.items() for x in pair])
    rows = baselines.filter(F.col("model_name").isin(list(keep))).select(
        F.col("model_name").alias("run_label"), F.lit("baseline").alias("model_family"), F.lit("n/a").alias("preset"),
        F.lit("all available").alias("rows_per_city"), "pooled_pr_auc", "mean_city_pr_auc", "pooled_recall_at_top_10pct",
        note[F.col("model_name")].alias("notes"),
    )
    return union_tables(rows, tuned.withColumn("rows_per_city", F.col("rows_per_city").cast("string")))


def benchmark_report(rows: DataFrame, digits: int = 4) -> DataFrame:
    """Benchmark rows rounded, with the no-skill reference row on top."""
    columns = ["pooled_pr_auc", "mean_city_pr_auc", "pooled_recall_at_top_10pct"]
    no_skill = rows.sparkSession.range(1).select(
        F.lit("no_skill_reference").alias("run_label"), *[F.lit(0.1).alias(c) for c in columns], F.lit(0).alias("position")
    )
    listed = rows.select("run_label", *[F.bround(c, digits).alias(c) for c in columns], F.lit(1).alias("position"))
    return no_skill.unionByName(listed)


def consensus_parameters(
    df: DataFrame, params: str = "best_params_json", score: str = "best_inner_cv_average_precision", fold: str = "outer_fold"
) -> DataFrame:
    """How many folds chose each parameter set, and its mean score."""
    schema.require_columns(df, [params, score, fold], "Best-parameter table")
    return df.groupBy(canonical_json(params).alias("params")).agg(
        F.count(F.lit(1)).alias("fold_count"), F.avg(score).alias("mean_score"), F.min(fold).alias("outer_fold_min")
    )


def consensus_choice(summary: DataFrame) -> DataFrame:
    """The set chosen by most folds, then the best mean score, then the first text."""
    return top_rows(summary, [("fold_count", False), ("mean_score", False), ("params", True)], 1)


def training_rows(df: DataFrame, keys: Sequence[str] = ("city_id", "city_name", "climate_group"), label: str = "hotspot_10pct", key: str = "cell_id") -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(key).alias("row_count"), F.sum(F.col(label).cast("long")).alias("hotspot_positive_count"))
    return out.withColumn("hotspot_prevalence", F.try_divide("hotspot_positive_count", "row_count"))
