"""Picking representative, latest or preferred rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.ordering import medians, rank_in_group
from latticework.session import attach


def nearest_to_median(
    df: DataFrame, group: str, value: str, ties: Sequence[str], per_group: int = 1, median: str = "group_median",
    distance: str = "abs_distance", prefer: dict[str, str] | None = None, name: str = "city_name",
) -> DataFrame:
    """Rows nearest to their group's median, ties by ``ties`` in order.

    ``prefer`` names, per group, a row that wins a tie on distance before the other tie columns.
    """
    mids = medians(df, [group], {median: value})
    placed = attach(df, mids, group).withColumn(distance, F.abs(F.col(value) - F.col(median)))
    order = [distance, *ties]
    if prefer:
        favourite = F.create_map(*[F.lit(x) for pair in prefer.items() for x in pair])[F.col(group)]
        placed = placed.withColumn("_prefer", F.when(F.col(name) == favourite, 0).otherwise(1))
        order = [distance, "_prefer", *ties]
    if per_group == 1:
        best = F.min_by(F.struct(*placed.columns), F.struct(*order))  # partial aggregation, no sort
        picked = placed.groupBy(group).agg(best.alias("_row")).select("_row.*")
    else:
        picked = rank_in_group(placed, [group], [(c, True) for c in order], "_r").filter(F.col("_r") <= per_group).drop("_r")
    return picked.drop("_prefer")


def representatives(
    df: DataFrame, mode: str = "representative_with_forced", group: str = "climate_group", value: str = "pr_auc", key: str = "city_id",
    name: str = "city_name", forced: str = "Denver", ids: Sequence[int] | None = None,
) -> DataFrame:
    """Selected rows with the reason: explicit ids, one forced row, all rows, or medians plus the forced row."""
    blank = {"group_median": F.lit(None).cast("double"), "abs_distance": F.lit(None).cast("double")}
    is_forced = F.lower(name) == forced.lower()

    def reason(rows: DataFrame, why: str, rule: str) -> DataFrame:
        return rows.withColumns({**blank, "selection_reason": F.lit(why), "selection_rule": F.lit(rule)})

    if ids is not None:
        chosen = df.filter(F.col(key).isin(list(ids)))
        found = {r[0] for r in chosen.select(key).distinct().collect()}  # bounded by the given list
        if set(ids) - found:
            raise ValueError(f"Requested ids not found: {sorted(set(ids) - found)}")
        return reason(chosen, "explicit_city_ids", "explicit_city_ids")
    if mode == "forced_only":
        chosen = df.filter(is_forced)
        if not chosen.limit(1).count():
            raise ValueError(f"{forced} was requested but not found")
        return reason(chosen, "forced_only", mode)
    if mode == "all":
        return reason(df, "all_cities", mode)
    if mode != "representative_with_forced":
        raise ValueError(f"Unsupported selection: {mode}")
    near = nearest_to_median(df, group, value, [value, key]).withColumns({
        "selection_reason": F.lit("climate_group_median_nearest"), "selection_rule": F.lit(mode),
    })
    near = near.withColumn(
        "selection_reason",
        F.when(is_forced, F.concat("selection_reason", F.lit(";forced_already_selected"))).otherwise(F.col("selection_reason")),
    )
    first = df.filter(is_forced).orderBy(key).limit(1)
    extra = reason(first, "forced", mode).join(near.select(key), key, "left_anti")
    return near.unionByName(extra.select(*near.columns))


def latest_by_key(df: DataFrame, key: Column, published: str, updated: str, url: str, name: str = "key") -> DataFrame:
    """The latest row per key by (published, updated, url), null dates first; rows without a key are dropped."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keyed = df.withColumn(name, F.nullif(key, F.lit(""))).filter(F.col(name).isNotNull())
    newest = F.max_by(F.struct(*keyed.columns), F.struct(blank(published), blank(updated), blank(url)))
    return keyed.groupBy(name).agg(newest.alias("_row")).select("_row.*")


def first_existing(candidates: DataFrame, keys: Sequence[str], priority: str, exists: str) -> DataFrame:
    """The first existing candidate per key by priority; keys with none keep a row with NULLs."""
    columns = [c for c in candidates.columns if c not in keys]
    best = F.min_by(F.when(F.col(exists), F.struct(*columns)), F.when(F.col(exists), F.col(priority)))
    return candidates.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")
