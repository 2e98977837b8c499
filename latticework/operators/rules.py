"""Row rules and value checks on cell tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework import schema
from latticework.operators.ordering import rank_in_group
from latticework.session import attach

OPEN_WATER = 11
MIN_PASSES = 3


def _gates(df: DataFrame, group: str, klass: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.max(F.col(klass).isNotNull()).alias("_has_class"), F.max(F.col(value).isNotNull()).alias("_has_value")
    )


def _keep_land(klass: str, water: int) -> Column:
    # a null class is dropped wherever the group has any class at all
    return ~F.col("_has_class") | F.coalesce(F.col(klass) != water, F.lit(False))


def group_rules(
    df: DataFrame, group: str = "city_id", klass: str = "land_cover_class", value: str = "lst_median_may_aug",
    passes: str = "n_valid_ecostress_passes", water: int = OPEN_WATER, min_passes: int = MIN_PASSES,
    gates: DataFrame | None = None,
) -> DataFrame:
    """Drop water, and, in groups with any value, rows with too few passes (null passes count as 0).

    ``gates`` lets a caller take the per-group availability from an earlier, unfiltered table.
    """
    gated = attach(df, _gates(df if gates is None else gates, group, klass, value), group)
    enough = ~F.col("_has_value") | (F.coalesce(F.col(passes), F.lit(0)) >= min_passes)
    return gated.filter(_keep_land(klass, water) & enough).drop("_has_class", "_has_value")


def final_rules(
    df: DataFrame, group: str = "city_id", klass: str = "land_cover_class", value: str = "lst_median_may_aug",
    passes: str = "n_valid_ecostress_passes", water: int = OPEN_WATER, min_passes: int = MIN_PASSES,
) -> DataFrame:
    """Drop water; keep rows without a value whatever their passes, others only with enough passes."""
    gated = attach(df, _gates(df, group, klass, value), group)
    enough = F.col(value).isNull() | (F.coalesce(F.col(passes), F.lit(0)) >= min_passes)
    return gated.filter(_keep_land(klass, water) & enough).drop("_has_class", "_has_value")


def cell_filter(df: DataFrame, mode: str = "study_area", flag: str = "is_core_city_cell", group: str | None = None) -> DataFrame:
    """All cells, or only the core ones; raises when no core flag is known (per group if given)."""
    mode = mode.strip().lower()
    if mode == "study_area":
        return df
    if mode != "core_city":
        raise ValueError(f"Unsupported cell_filter_mode: {mode}")
    schema.require_columns(df, [flag], "Core-city filter input")
    keys = [group] if group else []
    known = df.groupBy(*keys).agg(F.count(flag).alias("known"), F.count(F.lit(1)).alias("rows"))
    if known.filter("rows > 0 and known = 0").limit(1).count():
        raise ValueError("Core-city filtering needs core flags, and they are all null")
    return df.filter(F.coalesce(F.col(flag), F.lit(False)))


def cap_cells(df: DataFrame, limit: int, group: str = "city_id", key: str = "cell_id") -> DataFrame:
    """The first ``limit`` cells of each group by key."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    return rank_in_group(df, [group], [(key, True)], "_n").filter(F.col("_n") <= limit).drop("_n")


def city_record(cities: DataFrame, city_id: int | None = None, city_name: str | None = None) -> DataFrame:
    """Exactly one city by id or by case-insensitive name."""
    if (city_id is None) == (city_name is None):
        raise ValueError("Provide exactly one of city_name or city_id")
    wanted = F.col("city_id") == city_id if city_id is not None else F.lower("city_name") == city_name.strip().lower()
    match = cities.filter(wanted)
    found = match.limit(2).count()
    if found != 1:
        raise ValueError(f"{'City not found' if found == 0 else 'More than one city matches'}: {city_id or city_name}")
    return match


def prefer_codes(df: DataFrame, layer: str, code: str, codes: dict[str, Sequence[int]]) -> DataFrame:
    """Keep rows with the layer's listed codes; a layer where none match is kept whole."""
    hit = F.lit(False)
    listed = F.lit(False)
    for name, values in codes.items():
        hit = hit | ((F.col(layer) == name) & F.coalesce(F.col(code).isin(list(values)), F.lit(False)))
        listed = listed | (F.col(layer) == name)
    marked = df.withColumn("_hit", hit)
    any_hit = marked.groupBy(layer).agg(F.max("_hit").alias("_any"))
    return attach(marked, any_hit, layer).filter(F.col("_hit") | ~F.col("_any") | ~listed).drop("_hit", "_any")


def require_transfer_input(df: DataFrame, features: Sequence[str], key: str = "cell_id") -> None:
    """Checks on a new city's table: columns, rows, unique non-null keys, one city."""
    schema.require_columns(df, [key, *features], "Transfer input")
    groups = [c for c in ("city_id", "city_name") if c in df.columns]
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))  # keys are spread over tasks
    counts = per_key.agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col(key).isNull(), F.col("n"))).alias("nulls"),
        F.sum(F.when(F.col(key).isNotNull(), F.col("n") - 1)).alias("repeats"),
    ).first()
    if not counts["rows"]:
        raise ValueError("Transfer input contains no rows")
    if counts["nulls"]:
        raise ValueError(f"Transfer input contains missing {key} values")
    if counts["repeats"]:
        raise ValueError(f"Transfer input contains duplicate {key} values: {counts['repeats']}")
    for name in groups:
        if df.select(name).filter(F.col(name).isNotNull()).distinct().limit(2).count() > 1:
            raise ValueError(f"Transfer input should hold one city; {name} has multiple values")
