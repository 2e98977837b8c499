"""Columns over nested parameters: canonical text, signatures, grids, lenient casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.functions.presets import BOOSTING_SMOKE, FOREST_FRONTIER, FOREST_FULL, FOREST_SMOKE, stored_text
from latticework.functions.text import ColumnLike, _col

# --- fixed values: names of the known search grids ----------------------------------------------
FOREST_GRIDS = {
    ("depth_feature_leaf_smoke", "depth/feature/leaf smoke grid"): stored_text(FOREST_SMOKE[0]),
    ("targeted_frontier", "targeted frontier grid around the smoke-winning RF region"): stored_text(FOREST_FRONTIER[0]),
    ("depth_feature_leaf_full", "depth/feature/leaf full grid"): stored_text(FOREST_FULL[0]),
}
BOOSTING_GRIDS = {("phase1_smoke_lr_leaf", "Phase 1 smoke grid on learning-rate and leaf-count capacity"): stored_text(BOOSTING_SMOKE[0])}
# ------------------------------------------------------------------------------------------------


def canonical_json(text: ColumnLike) -> Column:
    """The same JSON with keys sorted at every level and no spaces; NULL when unreadable."""
    return F.to_json(F.try_parse_json(_col(text)))


def signature(text: ColumnLike, length: int = 12) -> Column:
    """Short hash of the canonical JSON."""
    return F.substring(F.sha1(canonical_json(text)), 1, length)


def as_int(value: ColumnLike) -> Column:
    return F.trim(_col(value).cast("string")).try_cast("bigint")


def as_number(value: ColumnLike) -> Column:
    return F.trim(_col(value).cast("string")).try_cast("double")


def as_text(value: ColumnLike) -> Column:
    return F.nullif(F.trim(_col(value).cast("string")), F.lit(""))


def as_int_list(text: ColumnLike) -> Column:
    """Integers of ``"1, 2,3"`` or ``"[1,2,3]"``; empty for NULL or blank."""
    parts = F.split(F.regexp_replace(F.coalesce(_col(text).cast("string"), F.lit("")), r"[\[\]\s]", ""), ",")
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.try_cast("int"))


def int_list_text(values: ColumnLike) -> Column:
    return F.coalesce(F.array_join(F.transform(_col(values), lambda v: v.cast("string")), ","), F.lit(""))


def joined_notes(notes: ColumnLike) -> Column:
    """Non-blank notes joined with `` | ``; NULL for a NULL array."""
    return F.array_join(F.filter(_col(notes), lambda n: F.trim(n) != ""), " | ")


def grid_maps(text: ColumnLike) -> Column:
    """A parameter grid in JSON as an array of ``name -> JSON text``."""
    return F.from_json(_col(text), "array<map<string,string>>")


def _values(raw: Column) -> Column:
    """A JSON list (or scalar) as an array of plain texts, JSON null as the word null."""
    listed = F.from_json(F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]"))), "array<string>")
    bare = F.when(raw.startswith("[") | raw.rlike(r"^-?[0-9.]|^(true|false|null)$"), listed).otherwise(F.array(raw))
    return F.transform(bare, lambda v: F.coalesce(v, F.lit("null")))


def grid_values(grid: Column, name: str) -> Column:
    """Distinct sorted values of one parameter over all entries of the grid."""
    per_entry = F.transform(
        F.filter(grid, lambda m: F.map_contains_key(m, name)), lambda m: F.coalesce(_values(m[name]), F.array(F.lit("null")))
    )
    return F.array_sort(F.array_distinct(F.flatten(per_entry)))


def grid_names(grid: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(grid, F.map_keys))))


def _is_grid(grid: Column, expected: dict[str, list[str]]) -> Column:
    same = grid_names(grid) == F.array(*[F.lit(n) for n in sorted(expected)])
    for name, values in expected.items():
        same = same & (grid_values(grid, name) == F.array(*[F.lit(v) for v in sorted(values)]))
    return F.coalesce(same, F.lit(False))


def _pair(slug: str, text: str) -> Column:
    return F.struct(F.lit(slug).alias("slug"), F.lit(text).alias("text"))


def _named_grid(grid: Column, known: dict, own: tuple[str, str], other: tuple[str, str]) -> Column:
    names = sorted(next(iter(known.values())))
    out = F.when(F.lit(False), _pair(*other))
    for title, expected in known.items():
        out = out.when(_is_grid(grid, expected), _pair(*title))
    same_names = F.coalesce(grid_names(grid) == F.array(*[F.lit(n) for n in names]), F.lit(False))
    return out.when(same_names, _pair(*own)).otherwise(_pair(*other))


def _logistic_grid(grid: Column) -> Column:
    ratios = F.transform(grid_values(grid, "model__l1_ratio"), lambda v: v.try_cast("double"))
    l2, l1 = F.exists(ratios, lambda r: r == 0.0), F.exists(ratios, lambda r: r == 1.0)
    mixed = F.exists(ratios, lambda r: (r > 0.0) & (r < 1.0))
    l2, l1, mixed = (F.coalesce(x, F.lit(False)) for x in (l2, l1, mixed))
    penalty = F.coalesce(F.array_contains(grid_names(grid), "model__penalty"), F.lit(False))
    return (
        F.when(penalty, _pair("explicit_penalty_grid", "explicit penalty grid"))
        .when(l2 & l1 & mixed, _pair("l1_ratio_family_complete", "l1_ratio family-complete grid"))
        .when(l2 & mixed & ~l1, _pair("l1_ratio_missing_l1", "l1_ratio grid missing pure l1 branch"))
        .when(l2 & l1 & ~mixed, _pair("l1_ratio_l1_l2_only", "l1_ratio l1/l2-only grid"))
        .when(mixed & ~l2 & ~l1, _pair("elasticnet_only", "elastic-net-only grid"))
        .otherwise(_pair("custom_l1_ratio_grid", "custom l1_ratio grid"))
    )


def search_contract(
    model: ColumnLike, preset: ColumnLike, splits: ColumnLike, candidates: ColumnLike, grid_text: ColumnLike
) -> Column:
    """``struct(version, descriptor)`` naming the search a run used, by comparing its grid with known ones."""
    model = _col(model)
    grid = F.coalesce(grid_maps(grid_text), F.array().cast("array<map<string,string>>"))
    forest = _named_grid(
        grid, FOREST_GRIDS, ("depth_feature_leaf_custom", "depth/feature/leaf custom grid"),
        ("custom_rf_grid", "custom random-forest grid"),
    )
    boosting = _named_grid(
        grid, BOOSTING_GRIDS, ("phase1_custom_lr_leaf", "Phase 1 custom histogram-gradient-boosting grid"),
        ("custom_hgb_grid", "custom histogram-gradient-boosting grid"),
    )
    named = (
        F.when(model.isin("logistic_saga", "logistic_saga_climate_interactions"), _logistic_grid(grid))
        .when(model == "random_forest", forest)
        .when(model == "hist_gradient_boosting", boosting)
        .otherwise(_pair("generic_grid", "generic param grid"))
    )
    interacting = model == "logistic_saga_climate_interactions"
    preset = F.coalesce(as_text(preset), F.lit("custom"))
    splits = F.coalesce(F.nullif(as_int(splits), F.lit(0)).cast("string"), F.lit("na"))
    candidates = F.coalesce(F.nullif(as_int(candidates), F.lit(0)).cast("string"), F.lit("na"))
    version = F.concat(
        model, F.lit("__"), preset, F.lit("__"), named["slug"],
        F.when(interacting, F.lit("__climate_numeric_interactions")).otherwise(F.lit("")),
        F.lit("__cv"), splits, F.lit("__pc"), candidates,
    )
    descriptor = F.concat(
        model, F.lit(" preset="), preset, F.lit("; "), named["text"],
        F.when(interacting, F.lit(" with training-only climate-by-numeric interactions")).otherwise(F.lit("")),
        F.lit("; inner_cv="), splits, F.lit("; candidates="), candidates,
    )
    return F.struct(version.alias("version"), descriptor.alias("descriptor"))


def comparison_descriptor(version: ColumnLike, folds: ColumnLike, rows: ColumnLike, fmt: ColumnLike) -> Column:
    ids = _col(folds)
    fold_text = F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, F.lit("all_folds")).otherwise(
        F.concat(F.lit("folds_"), F.array_join(F.transform(ids, lambda v: v.cast("string")), "-"))
    )
    rows_text = F.coalesce(
        F.concat(F.lit("sample_"), _col(rows).cast("string"), F.lit("_per_city")), F.lit("all_rows")
    )
    return F.concat_ws(
        "; ", _col(version), fold_text, rows_text, F.concat(F.lit("dataset="), F.coalesce(_col(fmt), F.lit("unknown")))
    )


def grid_summary(grid_text: ColumnLike) -> Column:
    """``C: 0.1/1.0; l1_ratio: 0.0 | ...`` from a JSON grid."""
    def entry(m: Column) -> Column:
        return F.array_join(
            F.transform(
                F.map_entries(m),
                lambda e: F.concat(F.replace(e["key"], F.lit("model__"), F.lit("")), F.lit(": "), F.array_join(_values(e["value"]), "/")),
            ),
            "; ",
        )

    return F.array_join(F.transform(grid_maps(grid_text), entry), " | ")


def best_params_text(params_text: ColumnLike) -> Column:
    """``C=1.0, l1_ratio=0.5`` from a JSON object, names sorted."""
    entries = F.array_sort(F.map_entries(F.from_json(_col(params_text), "map<string,string>")))
    return F.array_join(
        F.transform(
            entries,
            lambda e: F.concat(F.replace(e["key"], F.lit("model__"), F.lit("")), F.lit("="), F.coalesce(e["value"], F.lit("None"))),
        ),
        ", ",
    )
