"""Status tables: roll-ups per city, retry selection, readiness and blockers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.text import SUCCESS_STATUSES, is_incomplete, status_text

# --- fixed values: status words and the order of stages ------------------------------------------
KNOWN = ["completed", "skipped_existing", "blocked_missing_credentials", "failed"]
OPEN = ["submitted", "pending", "not_started", ""]
STAGES = ["raw_support_acquisition", "support_layer_prep", "appeears_ndvi", "appeears_ecostress", "feature_assembly"]
# ------------------------------------------------------------------------------------------------


def normalized_status(value: Column | str) -> Column:
    """Known words as they are, open ones as ``not_started``, everything else as ``failed``."""
    text = status_text(value)
    return F.when(text.isin(KNOWN), text).when(text.isin(OPEN), "not_started").otherwise("failed")


def failure_reason(value: Column | str) -> Column:
    """Reason implied by a status word that is neither known nor open."""
    text = status_text(value)
    unknown = ~text.isin(KNOWN) & ~text.isin(OPEN)
    return F.when(text == "blocked", "stage_blocked").when(unknown, F.concat(F.lit("unexpected_status:"), text)).otherwise("")


def join_texts(value: str, order: str, sep: str = "; ") -> Column:
    """Distinct non-blank texts of a group in ``order``, joined (datasets of one city are few)."""
    cleaned = F.when(F.trim(value) != "", F.struct(F.col(order).alias("o"), F.trim(value).alias("v")))
    return F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(cleaned)), lambda s: s["v"])), sep)


def roll_up_datasets(df: DataFrame, city: str = "city_id", dataset: str = "dataset", status: str = "status", error: str = "error") -> DataFrame:
    """One status per city: failed > blocked > all skipped > completed, with the error texts joined."""
    text = status_text(status)
    done = text.isin(SUCCESS_STATUSES)
    out = df.withColumn("_part", F.concat(F.col(dataset), F.lit("="), F.col(status))).groupBy(city).agg(
        F.bool_or(text == "failed").alias("_failed"), F.bool_or(text == "blocked").alias("_blocked"),
        F.bool_and(text == "skipped_existing").alias("_skipped"), F.bool_and(done).alias("_done"),
        join_texts("_part", dataset).alias("message"), join_texts(error, dataset).alias("_errors"),
    )
    broken = F.col("_failed") | F.col("_blocked") | ~F.col("_done")
    default = (
        F.when(F.col("_failed"), "raw support acquisition failed").when(F.col("_blocked"), "raw support acquisition blocked")
        .otherwise("raw_support_status_unrecognized")
    )
    named = F.when(F.col("_failed") | F.col("_blocked"), F.coalesce(F.nullif("_errors", F.lit("")), default)).otherwise(default)
    return out.select(
        city,
        F.when(broken, "failed").when(F.col("_skipped"), "skipped_existing").otherwise("completed").alias("status"),
        F.when(broken, named).otherwise("").alias("error"), "message",
    )


def overall_status(stages: DataFrame, city: str = "city_id", stage: str = "stage", status: str = "status", order: Sequence[str] = tuple(STAGES)) -> DataFrame:
    """Overall status per city and its primary stage: the first failed one, else the first unfinished one."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(stage))
    s = normalized_status(status)
    ok = s.isin(SUCCESS_STATUSES)
    out = stages.groupBy(city).agg(
        F.bool_and(ok).alias("_ok"), F.bool_or(s == "blocked_missing_credentials").alias("_blocked"), F.bool_or(s == "failed").alias("_failed"),
        F.min_by(F.when(s == "failed", F.col(stage)), F.when(s == "failed", rank)).alias("_f"),
        F.min_by(F.when(~ok, F.col(stage)), F.when(~ok, rank)).alias("_o"),
    )
    return out.select(
        city,
        F.when(F.col("_ok"), "completed").when(F.col("_blocked"), "blocked_missing_credentials").when(F.col("_failed"), "failed")
        .otherwise("not_started").alias("overall_status"),
        F.coalesce("_f", "_o").alias("primary_stage"),
    )


def unmet_prerequisites(stages: DataFrame, labels: dict[str, str], city: str = "city_id", stage: str = "stage", status: str = "status") -> DataFrame:
    """Labels of prerequisite stages without success per city, in the given order."""
    done = F.collect_set(F.when(status_text(status).isin(SUCCESS_STATUSES), F.col(stage)))  # at most one per stage
    out = stages.groupBy(city).agg(done.alias("_done"))
    open_labels = F.array_compact(F.array(*[F.when(~F.array_contains("_done", s), F.lit(text)) for s, text in labels.items()]))
    return out.select(city, open_labels.alias("blocked_by"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    text = F.coalesce(F.col(status), F.lit(""))
    return df.groupBy(text.alias(status)).agg(F.count(F.lit(1)).alias("n")).filter(F.col(status) != "")


def stage_record(df: DataFrame, stage: str, mode: str, status: str = "status", city: str = "city_id") -> DataFrame:
    """One summary row of a stage: records, cities and status counts as JSON."""
    text = F.coalesce(F.col(status), F.lit(""))
    per_status = df.groupBy(text.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    counts = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("s") != "", F.struct("s", "n"))))))
    cities = df.agg(F.countDistinct(city).alias("n_effective_cities"))
    return per_status.agg(F.sum("n").alias("n_records"), counts.alias("status_counts_json")).crossJoin(F.broadcast(cities)).select(
        F.lit(stage).alias("stage"), F.lit(mode).alias("selection_mode"), "n_effective_cities", "n_records", "status_counts_json"
    )


def effective_ids(df: DataFrame, key: str = "city_id") -> DataFrame:
    return df.select(F.col(key).try_cast("int").alias(key)).filter(F.col(key).isNotNull()).distinct()


def split_stages(df: DataFrame, column: str = "blocked_stages", name: str = "stage") -> DataFrame:
    """Distinct non-blank stage names out of ``a;b`` texts."""
    parts = df.select(F.explode(F.split(F.coalesce(F.col(column), F.lit("")), ";")).alias("_s")).select(F.trim("_s").alias(name))
    return parts.filter(F.col(name) != "").distinct()


def needing_retry(cities: DataFrame, records: DataFrame, city: str = "city_id", status: str = "status") -> DataFrame:
    """Cities whose last status is unfinished or missing."""
    last = records.select(city, F.col(status).alias("_status"))
    return cities.join(last, city, "left").filter(is_incomplete("_status")).drop("_status")


def missing_any(cities: DataFrame, flags: DataFrame, required: Sequence[str], city: str = "city_id") -> DataFrame:
    """Cities where any required flag is false, null or not recorded."""
    ready = F.lit(True)
    for name in required:
        ready = ready & F.coalesce(F.col(name), F.lit(False))
    return cities.join(flags.filter(ready).select(city), city, "left_anti")


def readiness(flags: DataFrame, prep: dict[str, str], features: dict[str, tuple[Sequence[str], str]], keep: Sequence[str] = ("city_id",)) -> DataFrame:
    """Blocker texts and ready flags from existence flags.

    ``prep`` maps a flag to its blocker; ``features`` maps a name to (flags of which one is enough, blocker).
    """
    have = lambda c: F.coalesce(F.col(c), F.lit(False))

    def any_of(columns: Sequence[str]) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | have(c)
        return out

    prep_list = F.array_compact(F.array(*[F.when(~have(c), F.lit(text)) for c, text in prep.items()]))
    feature_list = F.array_compact(F.array(*[F.when(~any_of(cols), F.lit(text)) for cols, text in features.values()]))
    out = flags.withColumns({"_prep": prep_list, "_features": feature_list})
    return out.select(
        *keep,
        (F.size("_prep") == 0).alias("support_prep_ready"), (F.size("_features") == 0).alias("feature_extraction_ready"),
        F.array_join("_prep", ";").alias("prep_blocking_reasons"), F.array_join("_features", ";").alias("feature_blocking_reasons"),
        F.array_join(F.array_sort(F.array_union("_prep", "_features")), ";").alias("blocking_reasons"),
    )
