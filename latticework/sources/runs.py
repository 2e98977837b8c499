"""The run registry: nested JSON lines in, one wide history row per run out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.functions.params import (
    as_int, as_int_list, as_number, as_text, canonical_json, comparison_descriptor, int_list_text, joined_notes, search_contract, signature,
)

# --- fixed values: registry fields ---------------------------------------------------------------
RUN = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("timestamp_utc", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("preset", T.StringType()),
    T.StructField("command", T.StringType()),
    T.StructField("interpreter_path", T.StringType()),
    T.StructField("dataset_path", T.StringType()),
    T.StructField("dataset_format", T.StringType()),
    T.StructField("dataset_row_count", T.LongType()),
    T.StructField("folds_path", T.StringType()),
    T.StructField("outer_folds_used", T.ArrayType(T.IntegerType())),
    T.StructField("sample_rows_per_city", T.IntegerType()),
    T.StructField("grid_search_n_jobs", T.IntegerType()),
    T.StructField("model_n_jobs", T.IntegerType()),
    T.StructField("output_dir", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
    T.StructField("wall_clock_seconds", T.DoubleType()),
    T.StructField("git_commit", T.StringType()),
    T.StructField("notes", T.ArrayType(T.StringType())),
    T.StructField("metadata_path", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("error_message", T.StringType()),
])
METRICS = ["pooled_pr_auc", "mean_fold_pr_auc", "mean_city_pr_auc", "pooled_recall_at_top_10pct", "mean_fold_recall_at_top_10pct"]
# -------------------------------------------------------------------------------------------------


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Registry records from JSON lines; blank lines are skipped, metric values may be numbers or text."""
    return spark.read.schema(RUN).json(path)


def append_runs(df: DataFrame, path: str) -> None:
    df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RUN]).write.mode("append").json(path)


def metrics_map(summary: DataFrame, columns: list[str]) -> DataFrame:
    """A metrics row as the registry's ``metrics`` map."""
    return summary.withColumn("metrics", F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]))


def read_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Run metadata documents as ``(metadata_path, meta)``."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("metadata_path"), F.col("value").alias("meta"))


def _meta(path: str) -> Column:
    return F.get_json_object("meta", f"$.{path}")


def history_rows(runs: DataFrame, metadata: DataFrame) -> DataFrame:
    """One wide row per run: metadata fields first, the record's own where metadata has none."""
    joined = runs.join(metadata.select("metadata_path", "meta"), "metadata_path", "left")
    features = F.coalesce(_meta("selected_feature_columns"), F.lit("[]"))
    grid = F.coalesce(F.when(_meta("param_grid").startswith("["), _meta("param_grid")), F.lit("[]"))
    splits, candidates = _meta("inner_cv_splits_requested"), _meta("search_space.param_candidate_count")
    rows = joined.withColumns({
        "_folds": F.coalesce(F.when(_meta("selected_outer_folds").isNotNull(), as_int_list(_meta("selected_outer_folds"))),
                             F.col("outer_folds_used"), F.array().cast("array<int>")),
        "sample_rows_per_city": F.coalesce(as_int(_meta("sample_rows_per_city")), F.col("sample_rows_per_city").cast("long")),
        "grid_search_n_jobs": F.coalesce(as_int(_meta("grid_search_n_jobs")), F.col("grid_search_n_jobs").cast("long")),
        "model_n_jobs": F.coalesce(as_int(_meta("model_n_jobs")), F.col("model_n_jobs").cast("long")),
        "selected_feature_columns": canonical_json(features),
        "feature_contract_signature": signature(features),
        "inner_cv_splits_requested": as_int(splits),
        "param_candidate_count": as_int(candidates),
        "estimated_total_inner_fits": as_int(_meta("search_space.estimated_total_inner_fits")),
        "_contract": search_contract(F.coalesce("model_type", F.lit("")), "preset", splits, candidates, grid),
        "search_contract_signature": signature(F.to_json(F.struct(
            F.col("model_type"), F.col("preset"), canonical_json(features).alias("features"), splits.alias("splits"), canonical_json(grid).alias("grid"),
        ))),
    })
    rows = rows.withColumns({
        "search_contract_version": F.col("_contract.version"),
        "search_contract_descriptor": F.col("_contract.descriptor"),
        "comparison_signature": signature(F.to_json(F.struct(
            "model_type", "search_contract_signature", "dataset_path", "dataset_format", "_folds", "sample_rows_per_city",
        ))),
        "comparison_descriptor": comparison_descriptor(F.col("_contract.version"), "_folds", "sample_rows_per_city", as_text("dataset_format")),
        "run_status": as_text("status"),
        "output_dir_name": F.element_at(F.split(F.regexp_replace("output_dir", "/+$", ""), "/"), -1),
        "outer_fold_count": F.size("_folds"),
        "outer_folds_used": int_list_text("_folds"),
        "registry_notes": joined_notes("notes"),
        "auto_history_status_label": F.when(F.lower(F.coalesce("status", F.lit(""))) == "success", "unreviewed").otherwise("failed"),
        **{m: as_number(F.col("metrics")[m]) for m in METRICS},
    })
    return rows.select(
        "run_id", "timestamp_utc", "model_type", "preset", "run_status", "output_dir", "output_dir_name", "git_commit", "dataset_path",
        "dataset_format", "dataset_row_count", "folds_path", "outer_folds_used", "outer_fold_count", "sample_rows_per_city",
        "grid_search_n_jobs", "model_n_jobs", "selected_feature_columns", "feature_contract_signature", "inner_cv_splits_requested",
        "param_candidate_count", "estimated_total_inner_fits", "search_contract_version", "search_contract_descriptor",
        "search_contract_signature", "comparison_signature", "comparison_descriptor", *METRICS, "wall_clock_seconds", "registry_notes",
        "metadata_path", "error_type", "error_message", "auto_history_status_label",
    )
