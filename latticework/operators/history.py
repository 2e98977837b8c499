"""Run history: order, frontier, previous run and manual annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.ordering import previous_values, rank_in_group, running_max_before

ALL = "_all"


def run_order(df: DataFrame, at: str = "timestamp_utc", run: str = "run_id", slices: int | None = None) -> DataFrame:
    """Position by (time, id), the date, and the time as ISO text with a UTC offset."""
    when = F.col(at) if df.schema[at].dataType.simpleString() == "timestamp" else F.try_to_timestamp(F.col(at))
    timed = df.withColumns({"_at": when, ALL: F.lit(1)})
    ordered = rank_in_group(timed, [ALL], [("_at", True), (run, True)], "run_order", slices)
    return ordered.withColumns({
        "run_date": F.date_format("_at", "yyyy-MM-dd"), at: F.date_format("_at", "yyyy-MM-dd'T'HH:mm:ssxxx"),
    }).drop("_at", ALL)


def frontier(
    df: DataFrame, group: str = "comparison_signature", order: Sequence[str] = ("run_order",), metric: str = "pooled_pr_auc",
    ok: str = "run_status = 'success'", slices: int | None = None,
) -> DataFrame:
    """Best metric of earlier successful runs, the difference to it, and whether this run moved it.

    A NaN metric counts as missing.
    """
    value = F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric).cast("double"))
    good = F.when(F.expr(ok), value)
    out = running_max_before(df, [group], [(c, True) for c in order], good, "prior_best", slices)
    counts = F.expr(ok) & value.isNotNull()
    return out.withColumns({
        "delta_vs_prior_best": value - F.col("prior_best"),
        "moved_frontier": F.when(counts, F.col("prior_best").isNull() | (value > F.col("prior_best"))),
    })


def previous_run(
    df: DataFrame, model: str = "model_type", order: Sequence[str] = ("run_order",), run: str = "run_id",
    contract: str = "search_contract_signature", comparison: str = "comparison_signature", slices: int | None = None,
) -> DataFrame:
    """Previous run of the same model, what changed since, and a note saying so."""
    names = {"previous_run_id": run, "_contract": contract, "_comparison": comparison}
    out = previous_values(df, [model], [(c, True) for c in order], names, slices)
    first = F.col("previous_run_id").isNull()
    changed = F.when(~first, ~F.col(contract).eqNullSafe(F.col("_contract")))
    moved = F.when(~first, ~F.col(comparison).eqNullSafe(F.col("_comparison")))
    note = (
        F.when(first, "First recorded run for this model family in the registry.")
        .when(changed, "Search contract changed relative to the previous recorded run for this model family.")
        .when(moved, "Evaluation slice changed relative to the previous recorded run for this model family.")
        .otherwise("Directly comparable to the previous recorded run for this model family.")
    )
    return out.withColumns({"contract_changed": changed, "comparison_changed": moved, "auto_comparability_note": note}).drop("_contract", "_comparison")


def annotate(df: DataFrame, annotations: DataFrame, key: str, overrides: dict[str, tuple[str, str]]) -> DataFrame:
    """Left join manual notes; ``{output: (manual column, automatic column)}`` takes the manual text unless blank."""
    manual = [c for c in annotations.columns if c != key and c not in overrides]
    joined = df.drop(*[c for c in manual if c in df.columns]).join(annotations.select(key, *manual), key, "left")
    return joined.withColumns({
        out: F.coalesce(F.when(F.trim(m) != "", F.col(m)), F.col(a)) for out, (m, a) in overrides.items()
    })


def annotation_template(df: DataFrame, annotations: DataFrame, key: str, context: Sequence[str], manual: Sequence[str]) -> DataFrame:
    """Context columns of every run with its manual columns, blank where nothing was written."""
    present = [c for c in manual if c in annotations.columns]
    joined = df.select(key, *context).join(annotations.select(key, *present), key, "left")
    return joined.select(
        key, *context, *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in present else F.lit("").alias(c) for c in manual]
    )
